"""Problem 5: new batches against all history, by immutable suffix arrays of segments."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.index import BITS, DEPTH, ENTRY, candidates, class_nodes, common_runs, entries, first_of_lists, list_parts, sketches, verified
from inkstone.llm.text import letters_digits
from inkstone.session import create_file, drop, read_file, scratch, spread, written

#: A segment is merged into the one before it unless that has more than RATIO times its rows.
RATIO = 2
#: Ranges of keys that a segment's tables are divided into; a batch reads those it has keys in.
RANGES = 32
#: Batches of a backlog are taken together until they have this share of the rows that are stored.
SHARE = 0.25
NEVER = 2**63 - 1

ID = "lower(regexp_replace(cast({} as string), '(?U)^\\\\s+|\\\\s+$', ''))"
#: A segment's tables.
TABLES = {
    "ids": "idk string, seq bigint", "nodes": "node bigint, cls string, norm string", "array": ENTRY,
    "sketch": ENTRY.replace("room int, ", ""),
}
_PART = "cast(pmod(xxhash64({}), {}) as int)"


def keyed(rows: DataFrame, seq_col: str, id_col: str, text_col: str) -> DataFrame:
    """(id, idk, cls, norm): the seq of each row, its id for comparison, and its normal form, NULL if too short to match."""
    base = rows.select(F.col(seq_col).cast("bigint").alias("id"), F.expr(ID.format(f"`{id_col}`")).alias("idk"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            norm = [n if t is not None and len(n := letters_digits(t)) >= DEPTH else None for t in pdf["text"]]
            cls = [None if n is None else xxhash.xxh3_128_hexdigest(n.encode("utf-8", "surrogatepass")) for n in norm]
            yield pdf[["id", "idk"]].assign(cls=cls, norm=norm)

    return spread(base.where("id is not null")).mapInPandas(run, "id bigint, idk string, cls string, norm string")


def _least_by(base: DataFrame, links: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """base (node, idk, cls) with the least node of marks (node, idk, cls) that has the same id, class or a linked class.

    Marks are aggregated to one row per id and class before they are joined.
    """
    by_id = marks.where("idk is not null").groupBy("idk").agg(F.min("node").alias("m1"))
    by_cls = marks.where("cls is not null").groupBy("cls").agg(F.min("node").alias("m2"))
    near = links.join(by_cls.select(F.col("cls").alias("other"), F.col("m2").alias("m3")), "other").groupBy("cls").agg(F.min("m3").alias("m3"))
    out = base.join(by_id, "idk", "left").join(by_cls, "cls", "left").join(near, "cls", "left")
    return out.withColumn(name, F.least("m1", "m2", "m3")).drop("m1", "m2", "m3")


def in_order(free: DataFrame, links: DataFrame, max_rounds: int = 500) -> DataFrame:
    """(node, idk, cls, accepted_seq) of the rejected among free (node, idk, cls), whose classes are linked by links (cls, other), both ways.

    Whoever has no undecided or accepted earlier neighbour is accepted, whoever has an accepted one is rejected. A round is
    a few aggregates over the undecided only.
    """
    undecided, rounds = written(_least_by(free, links, free, "least"), "undecided"), []
    for _ in range(max_rounds):
        won = undecided.where("least >= node").select("node", "idk", "cls")
        rounds.append(won)
        open_ = _least_by(undecided.where("least < node").drop("least"), links, won, "winner")
        open_ = open_.where("winner is null or winner > node").select("node", "idk", "cls")
        undecided = written(_least_by(open_, links, open_, "least"), "undecided")
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError("the order of acceptance didn't settle")
    accepted = reduce(DataFrame.unionByName, rounds)
    return _least_by(free, links, accepted, "accepted_seq").where("accepted_seq < node").select("node", "idk", "cls", "accepted_seq")


class SegmentStore:
    """Accepted records as immutable segments in a folder, which batches are searched against.

    A segment has three tables, divided into ranges of their keys and sorted within: the suffix array of its texts (their
    suffixes in order of the first DEPTH characters, as far as a pair of the similarity must meet in them), the texts by
    node, and the ids. Besides, the first text of each list of sketch suffixes. A batch's suffixes are looked up in the
    ranges that hold some of them. What is accepted becomes a segment; segments of like size are merged, so there are about
    log2(batches) of them and a record is rewritten about as often. Nothing that is written is changed. The arrays are made for one
    similarity, and the order of runs is that of the first segment.
    """

    def __init__(self, spark: SparkSession, folder: str, similarity: float = 0.6, ranges: int = RANGES) -> None:
        self.spark, self.folder, self.similarity, self.ranges = spark, folder.rstrip("/"), similarity, ranges
        fs = spark._jvm.org.apache.hadoop.fs
        self._path, self._fs = fs.Path, fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))
        self._known: pd.DataFrame | None = None

    def _names(self, begin: str) -> list[str]:
        return sorted(x for s in self._fs.listStatus(self._path(self.folder)) if (x := s.getPath().getName()).startswith(begin))

    def _list(self) -> tuple[str | None, list[dict]]:
        for name in reversed(self._names("list-")):
            if text := read_file(self.spark, f"{self.folder}/{name}"):  # else a writer has only just made it
                return name, json.loads(text)
        return None, []

    def segments(self) -> list[dict]:
        """The segments in order of making: name and rows. The list is the newest of the numbered list files."""
        return self._list()[1]

    def _publish(self, segments: list[dict], base: str | None) -> None:
        name = f"list-{int(base[5:]) + 1 if base else 1:08d}"
        if not create_file(self.spark, f"{self.folder}/{name}", json.dumps(segments)):
            raise RuntimeError(f"{name} was made by another writer")

    def _order(self, nodes: DataFrame) -> pd.DataFrame:
        """The order of runs, with the similarity of the arrays: written with the first segment, kept from then on."""
        path = f"{self.folder}/order"
        if self._known is None:
            if not self._fs.exists(self._path(f"{path}/_SUCCESS")):
                first = common_runs(nodes).assign(similarity=self.similarity)
                self.spark.createDataFrame(first, "key bigint, n bigint, similarity double").write.mode("overwrite").parquet(path)
            self._known = self.spark.read.parquet(path).toPandas().sort_values("key")
        if (self._known["similarity"] != self.similarity).any():
            raise ValueError("the segments' arrays are made for another similarity")
        return self._known

    def _bounds(self) -> list[int]:
        """Where the ranges of the arrays begin: at even shares of the frequent runs."""
        key, n = self._known["key"].to_numpy(np.int64), self._known["n"].to_numpy(np.int64)
        at = np.searchsorted(np.cumsum(n), np.arange(1, self.ranges) * n.sum() / self.ranges) if len(key) else []
        return sorted({int(key[i]) for i in at})

    def _ranged(self, rows: DataFrame, what: str) -> DataFrame:
        """rows with part, the range of its key."""
        if what == "array":
            bounds = self._bounds()
            return rows.withColumn("part", F.expr(f"array_size(filter(array({', '.join(f'{b}L' for b in bounds)}), b -> b <= key))").cast("int") if bounds else F.lit(0))
        return rows.withColumn("part", F.expr(_PART.format({"nodes": "node", "ids": "idk", "sketch": "key"}[what], self.ranges)))

    def _table(self, segment: str, what: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[what]}, part int").parquet(f"{self.folder}/{segment}/{what}")

    def _save(self, rows: DataFrame, segment: str, what: str, *order: str) -> None:
        """The exchange by range may divide a range over tasks, and join small ones, as their sizes are."""
        ranged = self._ranged(rows, what).hint("rebalance", "part").sortWithinPartitions("part", *order)
        ranged.write.option("compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{segment}/{what}")

    def read(self, what: str, segments: list[dict], keys: DataFrame | None = None) -> DataFrame | None:
        """The segments' table: all of it, or the ranges that hold keys (a column named as the table's key)."""
        if not segments:
            return None
        every = reduce(DataFrame.unionByName, [self._table(s["name"], what) for s in segments])
        if keys is not None:
            touched = [r["part"] for r in self._ranged(keys, what).select("part").distinct().collect()]  # ranges at most
            every = every.where(F.col("part").isin(touched))
        return every.drop("part")

    def _segment(self, ids: DataFrame, nodes: DataFrame, array: DataFrame | None = None) -> dict:
        """Write (idk, seq) and (node, cls, norm) as a segment; its array is made from the nodes, or is what others had of them."""
        name = f"seg-{1 + len(self._names('seg-')):08d}"
        self._save(ids.groupBy("idk").agg(F.min("seq").alias("seq")), name, "ids", "idk")
        self._save(nodes, name, "nodes", "node")
        nodes = self._table(name, "nodes").drop("part")
        self._save(entries(nodes, self._order(nodes), self.similarity) if array is None else array, name, "array", "key", "node")
        first = F.min(F.struct("node", "size", *BITS)).alias("x")
        self._save(sketches(nodes).groupBy("key").agg(first).select("key", "x.*"), name, "sketch", "key")
        return {"name": name, "rows": max(nodes.count(), self._table(name, "ids").count())}

    def add(self, records: DataFrame) -> None:
        """Append accepted records (id, idk, cls, norm), none of whose texts is stored, as a segment, and merge segments of like size."""
        base, segments = self._list()
        nodes = class_nodes(records.where("cls is not null").select("id", "cls", "norm"))
        segments = [*segments, self._segment(records.where("idk is not null").select("idk", F.col("id").alias("seq")), nodes)]
        while len(segments) > 1 and segments[-2]["rows"] <= RATIO * segments[-1]["rows"]:
            two = segments[-2:]
            segments = [*segments[:-2], self._segment(self.read("ids", two), self.read("nodes", two), self.read("array", two))]
        self._publish(segments, base)

    def load(self, records: DataFrame, seq_col: str = "seq", id_col: str = "id", text_col: str = "content") -> int:
        """Take records as accepted, unchecked, into a store that is empty. Returns the segment's rows."""
        if self.segments():
            raise ValueError("only an empty store can be loaded")
        full = written(keyed(records, seq_col, id_col, text_col), "records")
        self.add(full)
        drop(full)
        return self.segments()[-1]["rows"]

    def _near(self, nodes: DataFrame, segments: list[dict]) -> DataFrame:
        """(node, m): the least stored node that each node of the batch has the similarity to, where there is one.

        The sketch gives a first one for most, and a search of the arrays looks for those under it only, so a batch that
        repeats a large family of stored texts costs about a pair a record.
        """
        t, order = self.similarity, self._order(nodes)
        sketch = written(sketches(nodes), "sketch")
        pairs = written(first_of_lists(sketch, self.read("sketch", segments, sketch.select("key")), t), "pairs")
        texts = self.read("nodes", segments, pairs.select(F.col("a").alias("node")))
        first = written(verified(pairs, texts, nodes, t).groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("node"), "m"), "first")
        most = nodes.join(first, "node", "left").select("node", "norm", F.coalesce("m", F.lit(NEVER)).alias("most"))
        own = written(entries(most, order, t, ("most",)), "entries")
        old = self.read("array", segments, own.select("key")).withColumn("most", F.lit(NEVER)).withColumn("fresh", F.lit(False))
        both = own.withColumn("fresh", F.lit(True)).unionByName(old)
        # the order of runs counts the first segment's texts only, so lists are counted here
        n = both.groupBy("key").agg(F.count("*").alias("n"), F.max("fresh").alias("fresh"))
        parts = written(list_parts(n), "parts")
        found = written(candidates(both, parts, t, F.col("fresh"), most="most"), "pairs")
        texts = self.read("nodes", segments, found.select(F.col("b").alias("node")))
        under = verified(found, nodes, texts, t).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        out = written(first.unionByName(under).groupBy("node").agg(F.min("m").alias("m")), "near")
        drop(sketch, pairs, first, own, parts, found)
        return out

    def _among(self, nodes: DataFrame) -> DataFrame:
        """(cls, other): pairs of nodes of the batch with the similarity, both ways."""
        index = written(entries(nodes, self._order(nodes), self.similarity), "entries")
        parts = written(list_parts(index.groupBy("key").agg(F.count("*").alias("n"))), "parts")
        links = written(verified(candidates(index, parts, self.similarity), nodes, nodes, self.similarity), "links")
        drop(index, parts)
        return links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))

    def accept(self, batch: DataFrame, seq_col: str = "seq", id_col: str = "id", text_col: str = "content", keep: bool = True) -> DataFrame:
        """Check a batch against all segments and itself, append what is accepted, and return (accepted_seq, seq) of the rest.

        Records of the batch with the same id and text decide alike, so one stands for all. Those that repeat a stored record
        are decided at once; the others are taken in order of seq. Without keep nothing is appended.
        """
        full = written(keyed(batch, seq_col, id_col, text_col), "records")
        nodes = written(class_nodes(full.where("cls is not null").select("id", "cls", "norm")), "nodes")
        segments = self.segments()
        # from here on a class goes by its node
        fresh = full.join(nodes.select("cls", F.col("node").alias("of")), "cls", "left").select(F.col("id").alias("seq"), "idk", F.col("of").alias("cls"))
        one = fresh.where("idk is not null or cls is not null").groupBy("idk", "cls").agg(F.min("seq").alias("node"))
        if segments:
            near = self._near(nodes, segments).select(F.col("node").alias("cls"), F.col("m").alias("m2"))
            ids = full.select("idk").where("idk is not null")
            by_id = self.read("ids", segments, ids).join(ids.distinct(), "idk", "left_semi").groupBy("idk").agg(F.min("seq").alias("m1"))
            one = one.join(by_id, "idk", "left").join(near, "cls", "left").withColumn("stored", F.least("m1", "m2"))
        else:
            one = one.withColumn("stored", F.lit(None).cast("bigint"))
        one = written(one.select("node", "idk", "cls", "stored"), "decided")
        free = one.where("stored is null").select("node", "idk", "cls")
        open_ = nodes.join(free.select(F.col("cls").alias("node")).distinct(), "node", "left_semi")
        late = in_order(free, self._among(open_))
        out = one.where("stored is not null").select("node", "idk", "cls", F.col("stored").alias("accepted_seq")).unionByName(late)
        same = F.expr("f.idk <=> d.idk and f.cls <=> d.cls")
        # of records that decide alike the first may be accepted, and the others repeat it
        first = one.where("stored is null").select("idk", "cls", "node").join(late.select("node"), "node", "left_anti")
        again = first.select("node", "idk", "cls", F.col("node").alias("accepted_seq"))
        found = fresh.alias("f").join(out.unionByName(again).alias("d"), same).where("d.accepted_seq < f.seq").select("d.accepted_seq", "f.seq")
        found = written(found, "rejected")
        if keep:
            self.add(full.join(found.select(F.col("seq").alias("id")), "id", "left_anti"))
        return found

    def accept_backlog(self, rows: DataFrame, batch_col: str, seq_col: str = "seq", id_col: str = "id", text_col: str = "content", share: float = SHARE, keep: bool = True) -> DataFrame:
        """accept for all batches of rows, in order of seq. Batches are taken together until they have the share of the rows
        that are stored by then, so that history is searched a number of times that grows with the logarithm of the backlog.
        Without keep the last of them aren't appended: for a store that nothing is searched in afterwards."""
        starts = rows.where(F.col(seq_col).isNotNull()).groupBy(batch_col).agg(F.min(seq_col).cast("bigint").alias("first"), F.count("*").alias("n"))
        starts = sorted((r["first"], r["n"]) for r in starts.collect())  # one a batch
        stored, out, at = sum(s["rows"] for s in self.segments()), [], 0
        while at < len(starts):
            begin, n = at, 0
            while at < len(starts) and (at == begin or n < share * stored):
                n, at = n + starts[at][1], at + 1
            some = rows.where(F.col(seq_col) >= starts[begin][0])
            some = some.where(F.col(seq_col) < starts[at][0]) if at < len(starts) else some
            out.append(self.accept(some, seq_col, id_col, text_col, keep or at < len(starts)))
            stored += n
        if not out:
            return rows.sparkSession.createDataFrame([], "accepted_seq bigint, seq bigint")
        return reduce(DataFrame.unionByName, out)


def rejected(
    history: DataFrame, incoming: DataFrame, seq_col: str = "seq", id_col: str = "id", text_col: str = "content", batch_col: str = "batch_no", similarity: float = 0.6,
    share: float = SHARE,
) -> DataFrame:
    """(accepted_seq, seq): the incoming records that repeat an accepted one, with the smallest seq of those they repeat.

    All of history is accepted; incoming records are taken by seq. A record repeats another if their ids are equal without
    letter case and outer spaces, or if their contents have at least the similarity (of sets of three-character runs of
    the normal form). History becomes a segment of a SegmentStore, and the batches go through it one after another, small
    ones together. No pair of the similarity is left out, whatever its length, and every pair is verified exactly.

    NULL ids and NULL, blank or very short contents (under three letters or digits) match nothing. Repeated rows repeat
    the first. Rows with NULL seq are left out. Other columns are ignored, whatever their names.
    """
    store = SegmentStore(history.sparkSession, scratch(history.sparkSession, "segments"), similarity)
    store.load(history, seq_col, id_col, text_col)
    return store.accept_backlog(incoming, batch_col, seq_col, id_col, text_col, share, False)
