"""Session settings, the shared folder for intermediate tables, and small plan helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "inkstone", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, else a temporary folder (local runs only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="inkstone-")
    return f"file://{_own}"


_own: str | None = None
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed by drop_written."""
    path = f"{shared_dir(spark)}/inkstone-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be over already
        pass


def drop(*tables: DataFrame) -> None:
    """Remove tables that written has made and nothing will read again."""
    for df in tables:
        for at in [x for x in _made if x[1] == getattr(df, "_written", None)]:
            _remove(*at)
            _made.remove(at)


@atexit.register
def drop_written() -> None:
    """Remove all intermediate tables of this process; also what finished is for."""
    for at in _made:
        _remove(*at)
    _made.clear()


@contextmanager
def finished() -> Iterator[None]:
    """Around a query whose rows are consumed inside: removes the intermediate tables made since it was entered."""
    before = set(_made)
    try:
        yield
    finally:
        for at in [x for x in _made if x not in before]:
            _remove(*at)
            _made.remove(at)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet. False if another writer has made it: the file system decides, not a rename."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def in_blocks(spark: SparkSession, blocks: Iterable[Any], scan: Callable[[Broadcast], DataFrame]) -> DataFrame | None:
    """The rows of a scan for each block of data that is broadcast. Of several blocks one is in the tasks' memory at a time: its
    rows are written before the next is sent, so neither memory nor the plan grows with their number. None for no block."""
    every = iter(blocks)
    first = next(every, None)
    if first is None:
        return None
    second = next(every, None)
    if second is None:
        return scan(spark.sparkContext.broadcast(first))
    out = None
    for block in chain([first, second], every):
        sent = spark.sparkContext.broadcast(block)
        rows = written(scan(sent), "block")
        out = rows if out is None else out.unionByName(rows)
        sent.destroy()
    return out


def spread(df: DataFrame) -> DataFrame:
    """Split an input of few files over all cores before costly work by row; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. Clusters without that folder need the package
    installed or sent with spark.submit.pyFiles."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
