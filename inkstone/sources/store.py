"""A versioned record store: each version is a set of Parquet folders, named by a small pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.coerce import DIFFICULTY
from inkstone.operators.analytics import checked, delete_preview, remaining
from inkstone.operators.dedupe import insertable
from inkstone.session import create_file, read_file

META = "struct<region:string,year:int,grade:string,exam_name:string,source_type:string>"
SCHEMA = (
    "id string, seq bigint, doc_hash string, content string, question_type string, knowledge_points array<string>, difficulty int, "
    f"embedding array<float>, source_meta {META}"
)


def stored_form(rows: DataFrame) -> DataFrame:
    """rows in the store's columns: what is missing gets its default, rows without id the id q and their seq."""
    have = set(rows.columns)
    col = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    return rows.select(
        F.coalesce(col("id", "string"), F.concat(F.lit("q"), col("seq", "string"))).alias("id"), col("seq", "bigint").alias("seq"), col("doc_hash", "string").alias("doc_hash"),
        F.coalesce(col("content", "string"), F.lit("")).alias("content"), F.coalesce(col("question_type", "string"), F.lit("未知题型")).alias("question_type"),
        F.coalesce(col("knowledge_points", "array<string>"), F.array().cast("array<string>")).alias("knowledge_points"),
        F.coalesce(col("difficulty", "int"), F.lit(DIFFICULTY)).alias("difficulty"), col("embedding", "array<float>").alias("embedding"), col("source_meta", META).alias("source_meta"),
    )


def flat_form(rows: DataFrame) -> DataFrame:
    """Records with all metadata as text: points joined by commas, source_meta as JSON."""
    return rows.select(
        "id", "seq", "content", "question_type", F.array_join("knowledge_points", ",").alias("knowledge_points"),
        F.col("difficulty").cast("string").alias("difficulty"), F.to_json("source_meta").alias("source_meta"),
    )


def nested_form(rows: DataFrame) -> DataFrame:
    """What flat_form has made, typed again. source_meta that is no JSON object becomes a struct of NULLs."""
    empty = F.from_json(F.lit("{}"), META)
    return rows.select(
        "id", "seq", "content", "question_type",
        F.when(F.col("knowledge_points") == "", F.array().cast("array<string>")).otherwise(F.split("knowledge_points", ",")).alias("knowledge_points"),
        F.col("difficulty").try_cast("int").alias("difficulty"), F.coalesce(F.from_json("source_meta", META), empty).alias("source_meta"),
    )


class Store:
    """Append adds a folder, delete and reset make a new set; a version that is being read is never written to."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int | None = None) -> None:
        self.spark, self.folder, self.dimension = spark, folder.rstrip("/"), dimension
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._fs = hadoop.Path, hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def versions(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith("version-"))

    def parts(self, version: str | None = None) -> list[str]:
        name = version or self._latest()
        return json.loads(read_file(self.spark, f"{self.folder}/{name}")) if name else []

    def read(self, version: str | None = None) -> DataFrame:
        parts = self.parts(version)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], SCHEMA)

    def _publish(self, parts: list[str], base: str | None) -> str:
        """A new version after base, the one that was read for it. Of several writers after the same one, one succeeds."""
        name = f"version-{int(base[8:]) + 1 if base else 1:08d}"
        if not create_file(self.spark, f"{self.folder}/{name}", json.dumps(parts)):
            raise RuntimeError(f"{name} was made by another writer")
        return name

    def _latest(self) -> str | None:
        """The newest version that is written out; a writer may have only just made a newer one."""
        return next((v for v in reversed(self.versions()) if read_file(self.spark, f"{self.folder}/{v}")), None)

    def _write(self, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def append(self, rows: DataFrame) -> dict[str, int]:
        """Add the rows whose id is new (the first of each), in the store's columns. Vectors must have the store's dimension."""
        base, batch = self._latest(), rows
        old = self.read(base)
        part = self._write(stored_form(insertable(batch, old)))
        added = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{part}")
        want = self.dimension or (old.where("embedding is not null").select(F.size("embedding")).first() or [None])[0]
        sizes = [r[0] for r in added.where("embedding is not null").select(F.size("embedding")).distinct().limit(2).collect()]
        if len(sizes) > 1 or (sizes and want and sizes[0] != want):
            self._fs.delete(self._path(f"{self.folder}/{part}"), True)
            raise ValueError(f"vectors of {sizes} dimensions, the store has {want}")
        n, total = added.count(), rows.count()
        self._publish([*self.parts(base), part], base)
        return {"total_input": total, "added": n, "skipped_existing": total - n}

    def upsert(self, rows: DataFrame) -> dict[str, int]:
        """Add the rows whose id is new, the last of each id by seq: what a store with an upsert of its own does with repeats."""
        last = rows.groupBy("id").agg(F.max("seq").alias("_last")).withColumnRenamed("id", "_id")
        kept = rows.join(last, F.col("id") == F.col("_id")).where("seq = _last").drop("_id", "_last")
        out, total = self.append(kept.unionByName(rows.where("id is null"))), rows.count()
        return {"total_input": total, "added": out["added"], "skipped_existing": total - out["added"]}

    def delete(self, filters: dict, dry_run: bool = True, sample: int = 20) -> dict:
        """Delete what matches; with dry_run only tell what would be. An empty filter is an error."""
        base = self._latest()
        row = delete_preview(self.read(base), checked(filters), sample).first().asDict()
        if not dry_run:
            self._publish([self._write(remaining(self.read(base), filters))], base)
        return row | {"dry_run": dry_run}

    def reset(self, dry_run: bool = False) -> dict:
        base = self._latest()
        n = self.read(base).count()
        if not dry_run:
            self._publish([], base)
        return {"deleted": n, "dry_run": dry_run}


def open_store(spark: SparkSession, folder: str, backend: str = "parquet", dimension: int | None = None) -> Store:
    """The store of a folder. There is one form to write; "json" takes over a JSON file of records from the folder's
    metadata.json into an empty store, other names are an error."""
    if backend not in ("parquet", "json"):
        raise ValueError(f"unknown backend {backend}")
    out = Store(spark, f"{folder.rstrip('/')}/records", dimension)
    if backend == "json" and not out.versions():
        from inkstone.sources.exchange import read_json_store

        out.append(read_json_store(spark, f"{folder.rstrip('/')}/metadata.json"))
    return out
