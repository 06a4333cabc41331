"""Exact nearest neighbours: one query against a store, and many queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.vector import EPSILON, closeness, cosine, squared_distance
from inkstone.session import in_blocks, spread, written

#: Query vectors in a block: 32,768 of 64 doubles are 16 MB, of 384 doubles 96 MB.
BLOCK_QUERIES = 32_768
#: Rows and columns of a matrix product; pairs scored in double precision at a time.
ROWS, COLUMNS, SCORED = 1024, 2048, 65_536
#: Groups of a first product, whose largest values bound the kth; vectors longer than SINGLE are multiplied in double precision.
GROUPS, SINGLE, TINY = 32, 1e15, 1e-30


def _score(metric: str, vector: Column, query: Column) -> Column:
    if metric not in ("cosine", "closeness"):
        raise ValueError("metric is cosine or closeness")
    return cosine(vector, query) if metric == "cosine" else closeness(squared_distance(vector, query))


def top_k(
    store: DataFrame, query: list[float], k: int = 10, where: Column | None = None, metric: str = "cosine", mode: str = "prefilter",
    vector_col: str = "embedding", seq_col: str = "seq",
) -> DataFrame:
    """The k most similar rows of store with similarity and rank, ties by seq.

    mode prefilter scores only what passes the filter; postfilter takes the 2k nearest of all first and may return fewer
    than k. Rows without a vector, and vectors of another length than the query, are left out; k under 1 gives no rows.
    """
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    rows = store.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    scored = lambda df: df.withColumn("similarity", _score(metric, F.col(vector_col), q))
    order = [F.col("similarity").desc(), F.col(seq_col)]
    if mode == "prefilter":
        best = scored(rows if where is None else rows.where(where)).orderBy(*order).limit(max(k, 0))
    elif mode == "postfilter":
        best = scored(rows).orderBy(*order).limit(max(2 * k, 0))
        best = (best if where is None else best.where(where)).orderBy(*order).limit(max(k, 0))
    else:
        raise ValueError("mode is prefilter or postfilter")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _packed(df: DataFrame, id_col: str, vector_col: str, name: str, copies: int | None = None) -> DataFrame:
    """A table (id, v) of vectors as the bytes of their doubles. Of equal vectors in a batch of rows only those with the smallest ids
    stay, copies of them, since no more can be among so many nearest."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.unique(pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False))
            if len(sizes) > 1:
                raise ValueError("vectors must have one length")
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, int(sizes[0]))
            out = pd.DataFrame({"id": batch.column("id").to_numpy(), "v": [x.tobytes() for x in v]})[np.isfinite(v).all(1)]
            if copies is not None:
                out = out.sort_values("id", kind="stable")
                out = out[out.groupby("v", sort=False).cumcount() < copies]
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["v"], pa.binary())], ["id", "v"])

    return written(spread(rows).mapInArrow(run, "id bigint, v binary"), name)


def _matrix(packed: list[bytes]) -> np.ndarray:
    if len({len(x) for x in packed}) > 1:
        raise ValueError("vectors must have one length")
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), len(packed[0]) // 8)


def _true(flags: np.ndarray) -> np.ndarray:
    """The flat places of what is true, by words of 8, since few are."""
    flat = flags.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    w, at = np.nonzero(flat.reshape(-1, 8)[words])
    return words[w] * 8 + at


class _Nearest:
    """The k nearest of all vectors added so far for each of a block of queries, by score rounded to 12 decimals, then by id.

    Pairs are told by a product in single precision; those that by its largest possible error may be among the k are scored
    in double precision, so the result is the one of a comparison of all pairs in double precision.
    """

    def __init__(self, own: np.ndarray, at: np.ndarray, k: int, metric: str, keep_self: bool) -> None:
        self.own, self.k, self.cosine, self.keep_self = own, k, metric == "cosine", keep_self
        self.at = at / (np.sqrt((at * at).sum(1)) + EPSILON)[:, None] if self.cosine else at
        self.own2 = (self.at * self.at).sum(1)
        self.n, self.s = np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), -np.inf)

    def add(self, n: np.ndarray, v: np.ndarray) -> None:
        if v.shape[1] != self.at.shape[1]:
            raise ValueError("vectors must have one length")
        if self.cosine:
            v = v / (np.sqrt((v * v).sum(1)) + EPSILON)[:, None]
        v2 = (v * v).sum(1)
        longest = np.sqrt(v2.max())
        kind = np.float32 if max(longest, np.sqrt(self.own2.max())) < SINGLE else np.float64
        room = np.empty(ROWS * COLUMNS, kind)
        other = (v if self.cosine else np.concatenate([v, -v2[:, None] / 2], 1)).astype(kind)
        for i in range(0, len(self.own), ROWS):
            at, own2 = self.at[i : i + ROWS], self.own2[i : i + ROWS]
            mine = (at if self.cosine else np.concatenate([at, np.ones((len(at), 1))], 1)).astype(kind)
            error = (at.shape[1] + 8) * np.finfo(kind).eps * (np.sqrt(own2) + longest) ** 2 + TINY
            for j in range(0, len(n), COLUMNS):
                to = other[j : j + COLUMNS]
                product = room[: len(at) * len(to)].reshape(len(at), len(to))
                np.matmul(mine, to.T, out=product)
                self._tile(i, product, own2, error, n[j : j + COLUMNS], v[j : j + COLUMNS])

    def _least(self, s: np.ndarray, own2: np.ndarray) -> np.ndarray:
        """The least product a pair has whose score isn't below s."""
        s = s - 2e-12
        if self.cosine:
            return s
        with np.errstate(divide="ignore", over="ignore"):
            return np.where(s > 0, (own2 - (1 / np.maximum(s, 0) - 1)) / 2, -np.inf)

    def _tile(self, i: int, product: np.ndarray, own2: np.ndarray, error: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        own, best_n, best_s = self.own[i : i + ROWS], self.n[i : i + ROWS], self.s[i : i + ROWS]
        if not self.keep_self:
            product[own[:, None] == n] = -np.inf
        kth = best_s[:, -1]
        if np.isneginf(kth).any() and len(n) >= 2 * (groups := max(self.k, GROUPS)):
            # of the largest of each group the kth is no more than the kth of all
            top = product[:, : len(n) // groups * groups].reshape(len(product), groups, -1).max(2)
            low = np.partition(top, groups - self.k, axis=1)[:, groups - self.k].astype(np.float64) - error
            kth = np.maximum(kth, low if self.cosine else 1 / (1 + np.maximum(own2 - 2 * low, 0)))
        least = np.nextafter((self._least(kth, own2) - error).astype(product.dtype), product.dtype.type(-np.inf))
        able = np.flatnonzero(product.max(1) >= least)
        q, c = np.divmod(_true(product[able] >= least[able, None]), len(n))
        q = able[q]
        if not self.keep_self:
            other = own[q] != n[c]
            q, c = q[other], c[other]
        if not len(q):
            return
        s = np.concatenate([self._score(i + q[x : x + SCORED], v, c[x : x + SCORED]) for x in range(0, len(q), SCORED)])
        better = s >= best_s[q, -1]
        q, c, s = q[better], c[better], s[better]
        seen = np.unique(q)
        q, c_n, s = np.concatenate([q, np.repeat(seen, self.k)]), np.concatenate([n[c], best_n[seen].ravel()]), np.concatenate([s, best_s[seen].ravel()])
        order = np.lexsort((c_n, -s, q))
        q, c_n, s = q[order], c_n[order], s[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        keep = at < self.k
        best_n[q[keep], at[keep]], best_s[q[keep], at[keep]] = c_n[keep], s[keep]

    def _score(self, q: np.ndarray, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.cosine:
            return np.round(np.einsum("ij,ij->i", self.at[q], v[c]), 12)
        apart = self.at[q] - v[c]
        return np.round(1 / (1 + np.einsum("ij,ij->i", apart, apart)), 12)

    def rows(self) -> pa.RecordBatch:
        found = np.isfinite(self.s)
        q = np.broadcast_to(self.own[:, None], self.s.shape)[found]
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.n[found]), pa.array(self.s[found])], ["q", "n", "s"])


def knn_join(
    queries: DataFrame, store: DataFrame, k: int = 3, query_id: str = "seq", store_id: str = "seq", query_vector: str = "embedding",
    store_vector: str = "embedding", metric: str = "closeness", keep_self: bool = True, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the k nearest rows of store for each query, ties by neighbour_id.

    Vectors of both sides are written once. Those of queries are read in blocks, one of which is with the tasks at a time; each
    task scores a block against its part of the store by matrix products and keeps k candidates a query, so what is shuffled is
    k rows a query and task, not the pairs. A block that is sent to the tasks has block_queries vectors at most. Rows without id
    or without a finite vector take no part; vectors must have one length, others are an error.
    """
    if metric not in ("cosine", "closeness"):
        raise ValueError("metric is cosine or closeness")
    spark = store.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, neighbour_id bigint, similarity double, rank int")
    if k < 1:
        return empty
    q = _packed(queries, query_id, query_vector, "queries")
    base = _packed(store, store_id, store_vector, "vectors", k if keep_self else k + 1)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "n"))

    def scan(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, packed = sent.value
            nearest = _Nearest(own, _matrix([packed]).reshape(len(own), -1), k, metric, keep_self)
            for batch in batches:
                if batch.num_rows:
                    nearest.add(batch.column("id").to_numpy(), _matrix(batch.column("v").to_pylist()))
            yield nearest.rows()

        return base.mapInArrow(run, "q bigint, n bigint, s double").withColumn("rank", rank).where(F.col("rank") <= k)

    def blocks() -> Iterator[tuple[np.ndarray, bytes]]:
        rows = q.toLocalIterator()
        while some := list(islice(rows, block_queries)):
            yield np.array([r["id"] for r in some], np.int64), _matrix([r["v"] for r in some]).tobytes()

    every = in_blocks(spark, blocks(), scan)
    if every is None:
        return empty
    return every.select(F.col("q").alias("query_id"), F.col("n").alias("neighbour_id"), F.col("s").alias("similarity"), "rank")


def examples_and_practice(hits: DataFrame, n_examples: int = 3, n_practice: int = 5, window: tuple[int, int] = (2, 4)) -> DataFrame:
    """hits with part (example, practice) and number: the examples are the most similar of middling difficulty; the
    practice is what comes next in order of rank whose content isn't an example's."""
    level = F.coalesce("difficulty", F.lit(3)).between(*window)
    ex = hits.where(level).orderBy(F.col("similarity").desc(), "rank").limit(n_examples).withColumn("part", F.lit("example"))
    used = ex.select(F.col("content").alias("used"))
    pr = hits.join(used, F.col("content") == F.col("used"), "left_anti").orderBy("rank").limit(n_practice).withColumn("part", F.lit("practice"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("rank"))
    by_similarity = F.row_number().over(Window.partitionBy("part").orderBy(F.col("similarity").desc(), "rank"))
    return ex.unionByName(pr).withColumn("number", F.when(F.col("part") == "example", by_similarity).otherwise(number))
