"""Problem 8: long exact spans shared between records, by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.text import WindowHash, codes, local_combine, mix64

#: Perfect difference sets, by period.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121),
}


#: Base of the second hash.
SECOND = 0xD1342543DE82EF95


def cover_for(min_len: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor width for spans of min_len: the largest period that leaves anchors of a third of the span."""
    period = max((p for p in COVERS if min_len - p + 1 >= max(1, min_len // 3)), default=1)
    return period, COVERS.get(period, (0,)), min_len - period + 1


def covers(period: int, cover: tuple[int, ...]) -> bool:
    """Whether every difference modulo the period occurs between two members."""
    return {0} | {d % period for a, b in combinations(cover, 2) for d in (a - b, b - a)} == set(range(period))


def _emit(owner: np.ndarray, key: np.ndarray, pos: np.ndarray, more: np.ndarray | None = None) -> pd.DataFrame:
    """Rows for the exchange: k, id, pos (negative, less one, for rows that are settled here), and m, 31 further bits of the key.
    Settled rows travel under a key of their own, so that no key is hot."""
    known, send = local_combine(key, owner, more)
    again = known & ~send
    own = key ^ mix64(owner.view(np.uint64) ^ mix64(pos.astype(np.uint64)))
    out = pd.DataFrame({"k": np.where(again, own, key).view(np.int64), "id": owner, "pos": np.where(known, -pos - 1, pos).astype(np.int32)})
    return out if more is None else out.assign(m=more.astype(np.int32))


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key has rows of another record."""
    w = Window.partitionBy(*key)
    return (
        rows.withColumn("lo", F.min("id").over(w)).withColumn("hi", F.max("id").over(w))
        .where((F.col("pos") < 0) | (F.col("lo") != F.col("hi"))).select("id", F.expr("if(pos < 0, -pos - 1, pos)").alias("pos"))
    )


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200) -> DataFrame:
    """(id_col, start_pos, end_pos): maximal stretches of positions that lie in some run of min_len characters which
    another record has too, counted from 1, both ends included.

    Windows of width min_len - period + 1 are hashed only where the position modulo the period is in a difference
    cover: any two equal runs of min_len characters, wherever they begin, hold an equal window at such a place in both.
    Anchors that two records share are then extended: all runs of min_len around them are compared in the same way.
    Rows rest on 95 bits of two hashes of a run of min_len, so the chance of any false row is about (runs compared)^2 / 2^96;
    anchors have 64 bits, of which a false one only costs a comparison.

    Records with NULL id or text, and texts under min_len, share nothing. Equal texts share everything. A run repeated
    only within one record doesn't count. Other columns are ignored, whatever their names.
    """
    period, cover, width = cover_for(min_len)
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.where(F.col("id").isNotNull() & (F.length("text") >= min_len))

    def anchors_of(text: str, hash_: WindowHash, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = codes(text)
        h = hash_(c)
        at = np.flatnonzero(np.resize(on, len(h)))
        return c, at, h[at]

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hash_, on = WindowHash(width), np.isin(np.arange(period), cover)
        for pdf in batches:
            found = [anchors_of(t, hash_, on)[1:] for t in pdf["text"]]
            owner = np.repeat(pdf["id"].to_numpy(np.int64), [len(at) for at, _ in found])
            if len(owner):
                yield _emit(owner, np.concatenate([h for _, h in found]), np.concatenate([at for at, _ in found]).astype(np.int32))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hash_, other = WindowHash(min_len), WindowHash(min_len, SECOND)
        for pdf in batches:
            owner, key, pos, more = [], [], [], []
            for id_, text, at in zip(pdf["id"], pdf["text"], pdf["at"], strict=True):
                c = codes(text)
                h = hash_(c)
                step = np.zeros(len(h) + 1, np.int32)
                at = np.asarray(at, np.int64)
                np.add.at(step, np.clip(at - period + 1, 0, len(h)), 1)
                np.add.at(step, np.clip(at + 1, 0, len(h)), -1)
                s = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                owner.append(np.full(len(s), id_, np.int64))
                key.append(h[s])
                more.append((other(c)[s] if len(s) else h[s]) >> np.uint64(33))
                pos.append(s)
            if owner:
                yield _emit(np.concatenate(owner), np.concatenate(key), np.concatenate(pos).astype(np.int32), np.concatenate(more))

    row = "k bigint, id bigint, pos int"
    near = _shared(base.mapInPandas(anchors, row), "k").groupBy("id").agg(F.collect_list("pos").alias("at"))
    same = _shared(base.join(near, "id").mapInPandas(runs, f"{row}, m int"), "k", "m")
    by = Window.partitionBy("id").orderBy("pos")
    same = same.withColumn("new", (F.col("pos") > F.lag("pos").over(by) + min_len).cast("int"))
    same = same.withColumn("stretch", F.sum(F.coalesce("new", F.lit(0))).over(by))
    return same.groupBy("id", "stretch").agg(
        (F.min("pos") + 1).cast("bigint").alias("start_pos"), (F.max("pos") + min_len).cast("bigint").alias("end_pos")
    ).select(F.col("id").alias(id_col), "start_pos", "end_pos")


def shared_fraction(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200) -> DataFrame:
    """(id_col, n_chars, shared_chars, shared_fraction) for every record; 0 where nothing is shared or the text is NULL or empty."""
    spans = shared_spans(docs, id_col, text_col, min_len).groupBy(id_col).agg(F.sum(F.expr("end_pos - start_pos + 1")).alias("shared"))
    out = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars"))
    return out.join(spans, id_col, "left").select(
        id_col, "n_chars", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared_chars"),
        F.round(F.coalesce("shared", F.lit(0)) / F.greatest("n_chars", F.lit(1)), 5).alias("shared_fraction"),
    )
