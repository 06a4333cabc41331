"""Three stages of dedupe: keys within a document, ids in the store, similarity to stored records."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from inkstone.functions.text import normal_form, number_in_upload, question_form
from inkstone.operators.search import knn_join
from inkstone.session import written

TEXT_SIMILARITY, EMBEDDING_SIMILARITY, CANDIDATES, PREVIEW = 0.92, 0.80, 3, 160
#: Kinds of characters that a bound on text similarity tells apart, as a power of two.
KIND_BITS = 6


def stable_key(doc_hash: Column, content: Column) -> Column:
    """document:number, or document:h:md5 of the normal form where there is no number."""
    number = number_in_upload(content)
    return F.concat_ws(":", F.coalesce(doc_hash, F.lit("")), F.coalesce(number, F.concat(F.lit("h:"), F.md5(question_form(content)))))


def content_key(content: Column) -> Column:
    return F.md5(normal_form(content))


def first_wins(rows: DataFrame, key: Column, seq: str = "seq", nulls_pass: bool = False) -> DataFrame:
    """rows with kept: whether a row is the first of its key. Firsts are aggregated before the exchange and joined back, so
    a key of any size is never in one task. With nulls_pass rows with a NULL key are all kept, else the first of them."""
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(seq).alias("_first")).withColumnRenamed("_key", "_key_of_first")
    out = keyed.join(first, F.col("_key").eqNullSafe(F.col("_key_of_first")))
    kept = F.col(seq) == F.col("_first")
    return out.withColumn("kept", (kept | F.col("_key").isNull()) if nulls_pass else kept).drop("_key", "_first", "_key_of_first")


def insertable(batch: DataFrame, store: DataFrame, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """The rows of batch that an insert adds: not in the store, first of their id in the batch; rows without id pass."""
    new = batch.join(store.select(id_col).where(F.col(id_col).isNotNull()), id_col, "left_anti")
    return first_wins(new, F.col(id_col), seq, nulls_pass=True).where("kept").drop("kept")


@F.pandas_udf(DoubleType())
def text_similarity(new: pd.Series, old: pd.Series) -> pd.Series:
    """Ratio of matching characters of the longest matching blocks (difflib, with its default heuristic)."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(new, old, strict=True)], dtype="float64")


@F.pandas_udf(BinaryType())
def _counts(forms: pd.Series) -> pd.Series:
    """How often a text has characters of each kind (a hash). NULL for an empty text."""
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return pd.Series([np.bincount((code(t) * np.uint32(2654435761)) >> (32 - KIND_BITS), minlength=1 << KIND_BITS).astype("<u4").tobytes() if t else None for t in forms])


@F.pandas_udf(DoubleType())
def _most(new: pd.Series, old: pd.Series) -> pd.Series:
    """A bound that text_similarity can't exceed, by what two texts have of each kind of character."""
    out = pd.Series(np.nan, index=new.index)
    both = new.notna() & old.notna()
    if both.any():
        a, b = (np.frombuffer(b"".join(x[both]), "<u4").reshape(-1, 1 << KIND_BITS).astype(np.int64) for x in (new, old))
        out[both] = 2.0 * np.minimum(a, b).sum(1) / (a.sum(1) + b.sum(1))
    return out


def similar_to_stored(
    batch: DataFrame, store: DataFrame, text: float = TEXT_SIMILARITY, embedding: float = EMBEDDING_SIMILARITY, metric: str = "closeness",
    candidates: int = CANDIDATES, seq: str = "seq",
) -> DataFrame:
    """(seq, id, content_preview, match_id, match_preview, embedding_similarity, text_similarity): the rows of batch that
    repeat a stored record.

    Of a row's nearest stored records the one most similar in text counts (then in embedding, then the nearest); the row is
    a repeat if that one reaches either threshold. Records whose normal form is empty aren't compared; batch rows aren't
    compared with each other. Texts are joined and compared only for rows of which some candidate can reach a threshold.
    """
    near = knn_join(batch, store, candidates, seq, seq, metric=metric).select(F.col("query_id").alias("new"), F.col("neighbour_id").alias("old"), "similarity", "rank")
    counts = lambda df, name: df.select(F.col(seq).alias(name), _counts(question_form(F.col("content"))).alias(f"{name}_counts"))
    bounded = near.join(counts(batch, "new"), "new").join(counts(store, "old"), "old").withColumn("most", _most("new_counts", "old_counts")).where("most is not null")
    able = bounded.groupBy("new").agg(F.collect_list(F.struct("old", "similarity", "rank")).alias("p"), F.max("similarity").alias("s"), F.max("most").alias("most"))
    able = written(able.where((F.col("s") >= embedding) | (F.col("most") >= text)).select("new", F.inline("p")), "pairs")
    side = lambda df, name: df.select(F.col(seq).alias(name), F.col("id").alias(f"{name}_id"), F.col("content").alias(f"{name}_text"), question_form(F.col("content")).alias(f"{name}_form"))
    pairs = able.join(side(batch, "new"), "new").join(side(store, "old"), "old").withColumn("t", text_similarity("new_form", "old_form"))
    best = pairs.groupBy("new").agg(F.max_by(F.struct("new_id", "new_text", "old_id", "old_text", "similarity", "t"), F.struct("t", "similarity", -F.col("rank"))).alias("b"))
    return best.where((F.col("b.t") >= text) | (F.col("b.similarity") >= embedding)).select(
        F.col("new").alias(seq), F.col("b.new_id").alias("id"), F.substring("b.new_text", 1, PREVIEW).alias("content_preview"),
        F.col("b.old_id").alias("match_id"), F.substring("b.old_text", 1, PREVIEW).alias("match_preview"),
        F.col("b.similarity").alias("embedding_similarity"), F.col("b.t").alias("text_similarity"),
    )


def report(stages: DataFrame) -> DataFrame:
    """One row of counters from rows tagged with reason: NULL for accepted rows, else the stage that rejected them."""
    n = lambda *r: F.count_if(F.col("reason").isin(*r))
    total, exact, known, near = F.count("*"), n("internal_exact"), n("db_existing_id"), n("similarity")
    return stages.agg(
        total.alias("extracted_total"), (total - exact).alias("after_internal_exact"), (total - exact - known).alias("after_db_existing_id"),
        (total - exact - known - near).alias("after_similarity"), exact.alias("internal_exact"), known.alias("db_existing_id"), near.alias("similarity"),
    )


def staged(batch: DataFrame, store: DataFrame, seq: str = "seq", similar: DataFrame | None = None) -> DataFrame:
    """(seq, id, reason): every row of batch with its stable key and the stage that rejects it, NULL if none does."""
    keyed = batch.withColumn("id", stable_key(F.col("doc_hash"), F.col("content")))
    first = first_wins(keyed.select(seq, "id"), F.col("id"), seq)
    known = store.select("id").where("id is not null").distinct().withColumn("known", F.lit(True))
    out = first.join(known, "id", "left")
    if similar is not None:
        out = out.join(similar.select(seq, F.lit(True).alias("near")), seq, "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("boolean"))
    reason = F.when(~F.col("kept"), "internal_exact").when(F.col("known"), "db_existing_id").when(F.col("near"), "similarity")
    return out.select(seq, "id", reason.alias("reason"))


def rejects(exact: DataFrame, known: DataFrame, similar: DataFrame) -> DataFrame:
    """The three kinds of rejected rows in one table; columns that a kind lacks are NULL."""
    tag = lambda df, reason: df.withColumn("reason", F.lit(reason))
    return tag(exact, "internal_exact").unionByName(tag(known, "db_existing_id"), allowMissingColumns=True).unionByName(tag(similar, "similarity"), allowMissingColumns=True)
