"""Problem 6: filling containers of fixed capacity, by vector best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that one task packs at a time. Loss at the end of a group is under one container in some hundreds.
GROUP_ITEMS = 4096
#: Pieces in a container, and the share of capacity squared that the sum of squared sizes may have. A piece that has more by
#: itself is alone in its container.
MAX_ITEMS, ATTENTION = 32, 0.9


def byte_tokens(text: Column) -> Column:
    """Size in tokens of the byte-level tokenizer: one a UTF-8 byte, no end mark."""
    return F.octet_length(text).cast("bigint")


def cut_points(raw: bytes, capacity: int) -> list[int]:
    """Ends of the pieces of a text: as full as possible, never inside a character."""
    out, at = [], 0
    while len(raw) - at > capacity:
        end = at + capacity
        while end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        at = end if end > at else at + capacity
        out.append(at)
    return [*out, len(raw)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 8192) -> DataFrame:
    """(id, piece, n_pieces, tokens): one row for a text that fits, several only for one of more than capacity tokens.
    NULL texts give no row, empty ones a piece of 0 tokens."""
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = byte_tokens(F.col("text"))
    whole = base.where(size <= capacity).select("id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), size.alias("tokens"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for id_, text in zip(pdf["id"], pdf["text"], strict=True):
                ends = cut_points(text.encode("utf-8", "surrogatepass"), capacity)
                rows += [(id_, k, len(ends), end - begin) for k, (begin, end) in enumerate(zip([0, *ends], ends, strict=False))]
            yield pd.DataFrame(rows, columns=["id", "piece", "n_pieces", "tokens"])

    return whole.unionByName(base.where(size > capacity).mapInPandas(cut, "id bigint, piece int, n_pieces int, tokens bigint"))


def best_fit(tokens: np.ndarray, capacity: int, max_items: int, max_attention: float, rule: str = "dot") -> np.ndarray:
    """Container of each item. An item has the vector (tokens, 1, tokens^2); a container admits it if no component passes
    its capacity (tokens, item count, attention cost). Among the containers that admit it, rule "dot" takes the one whose
    residual vector has the smallest weighted dot product with the item (the tightest along what the item demands),
    "norm" the one with the smallest weighted norm of what would be left; ties go to the earliest container. Weights are
    the items' mean demand of each component. Items go from large to small, ties by position.
    """
    n = len(tokens)
    full = np.array([capacity, max_items, max_attention], float)
    demand = np.stack([tokens, np.ones(n), tokens.astype(float) ** 2], 1) / full
    weight = demand.mean(0) if n else np.ones(3)
    left, used, out = np.empty((max(n, 1), 3)), 0, np.full(n, -1, np.int64)
    open_ = np.empty(0, np.int64)
    for i in np.lexsort((np.arange(n), -tokens)):
        d = demand[i]
        r = left[open_]
        ok = (r >= d - 1e-12).all(1)  # what is over a capacity by itself finds no container, and none is open after it
        if ok.any():
            at = np.flatnonzero(ok)
            score = ((r[at] - d) ** 2 * weight).sum(1) if rule == "norm" else r[at] @ (weight * d)
            bin_ = open_[at[score.argmin()]]
        else:
            bin_, used = used, used + 1
            left[bin_] = 1.0
            open_ = np.append(open_, bin_)
        left[bin_] -= d
        out[i] = bin_
        if left[bin_, 0] * capacity < 1 or left[bin_, 1] * max_items < 1 or left[bin_, 2] * max_attention < 1:
            open_ = open_[open_ != bin_]
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 8192, max_items: int = MAX_ITEMS,
    max_attention: float | None = None, rule: str = "dot", group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """(id_col, piece, n_pieces, tokens, container): every piece of every text in a container.

    No container holds more than capacity tokens, max_items pieces or, of several pieces, max_attention (default ATTENTION of
    capacity squared) of the sum of squared sizes. A text is cut only if it has more than capacity tokens. Only ids and sizes are shuffled, into random
    groups of about group_items pieces, each packed by one task; a group leaves about one container partly filled.
    container is group * 2^32 + number. NULL texts aren't packed, empty ones take an item's place and no tokens.
    """
    rows = pieces(docs, id_col, text_col, capacity)
    groups = max(1, round(docs.count() / group_items))
    rows = rows.withColumn("grp", F.expr(f"pmod(xxhash64(id, piece), {groups})"))
    limit = ATTENTION * float(capacity) ** 2 if max_attention is None else float(max_attention)
    if capacity < 1 or max_items < 1 or limit <= 0:
        raise ValueError("capacities must be positive")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], kind="stable")
        bins = best_fit(pdf["tokens"].to_numpy(np.int64), capacity, max_items, limit, rule)
        return pdf[["id", "piece", "n_pieces", "tokens"]].assign(container=pdf["grp"].to_numpy(np.int64) * (1 << 32) + bins)

    out = rows.repartition(groups, "grp").groupBy("grp").applyInPandas(one, "id bigint, piece int, n_pieces int, tokens bigint, container bigint")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def cut_documents(docs: DataFrame, capacity: int = 8192) -> DataFrame:
    """(doc_id): the documents that the packing has cut."""
    return pack(docs, capacity=capacity).where("n_pieces > 1 and piece = 0").select("doc_id")
