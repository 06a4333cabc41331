"""Pages, counts and groups over stored records, and deletion as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import u_trim
from inkstone.operators.filters import meta_filter, pruned

META = ("region", "year", "grade", "exam_name", "source_type")
EMPTY, PREVIEW = "(empty)", 200


def query_page(store: DataFrame, filters: dict | None = None, offset: int = 0, limit: int = 20, include_content: bool = False, seq: str = "seq") -> DataFrame:
    """Matching rows in order of insertion from offset, with content or a preview of it."""
    text = F.col("content") if include_content else F.substring("content", 1, PREVIEW).alias("content_preview")
    page = store.where(meta_filter(filters)).orderBy(seq).offset(offset).limit(limit)
    return page.select(seq, "id", "question_type", F.coalesce("knowledge_points", F.array().cast("array<string>")).alias("knowledge_points"), F.coalesce("difficulty", F.lit(3)).alias("difficulty"), "source_meta", text)


def group_key(x: Column) -> Column:
    """The value as trimmed text; NULL, blank and 0 are one group."""
    t = u_trim(x.cast("string"))
    return F.when(t.isNull() | (t == "") | (t == "0"), EMPTY).otherwise(t)


def group_counts(store: DataFrame, by: str, filters: dict | None = None, top: int = 50, seq: str = "seq", permissive: bool = False) -> DataFrame:
    """(key, count, rank): the most frequent values of a metadata field, ties in order of first occurrence."""
    if by not in META and not permissive:
        raise ValueError(f"group_by must be one of {META}")
    key = group_key(F.col(f"source_meta.{by}")) if by in META else F.lit(EMPTY)
    n = store.where(meta_filter(filters)).select(key.alias("key"), seq).groupBy("key").agg(F.count("*").alias("count"), F.min(seq).alias("first"))
    order = [F.col("count").desc(), F.col("first")]
    best = n.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("key", "count", "rank")


def stats(store: DataFrame, backend: str = "parquet") -> DataFrame:
    return store.agg(F.count("*").alias("total")).select("total", F.lit(backend).alias("backend"), F.when(F.col("total") > 0, "ready").otherwise("empty").alias("status"))


def checked(filters: dict | None, permissive: bool = False) -> dict:
    """The filters of a deletion: none left after pruning is an error, since they would delete everything."""
    if not filters or (not pruned(filters) and not permissive):
        raise ValueError("a deletion needs a filter")
    return filters


def delete_preview(store: DataFrame, filters: dict, sample: int = 20, seq: str = "seq") -> DataFrame:
    """One row: matched, remaining, and the ids of the first matches."""
    hit = meta_filter(checked(filters))
    n = store.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("remaining"))
    ids = store.where(hit & F.col("id").isNotNull()).orderBy(seq).limit(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, "id"))), lambda s: s["id"]).alias("sample"))
    one = n.unionByName(ids, allowMissingColumns=True)
    return one.agg(F.max("matched").alias("matched"), F.max("remaining").alias("remaining"), F.first("sample", ignorenulls=True).alias("sample"))


def remaining(store: DataFrame, filters: dict, permissive: bool = False) -> DataFrame:
    return store.where(~meta_filter(checked(filters, permissive), permissive=permissive))


def newest_first(log: DataFrame, offset: int = 0, limit: int = 50, seq: str = "seq") -> DataFrame:
    return log.orderBy(F.col(seq).desc()).offset(offset).limit(limit)


def is_scanned(pages: DataFrame, doc: str = "doc_hash", page: str = "page_no", text: str = "content", head: int = 3) -> DataFrame:
    """(doc, chars, ratio, scanned): by the first pages, whether a document has no text layer worth reading: a placeholder,
    under 100 characters (without white space at either end), or under a fifth of meaningful ones, of all characters of a
    page, on average over pages that aren't empty. Pages of white space count as meaningless ones."""
    from inkstone.functions.text import meaningful_ratio

    rows = pages.where(F.col(page).between(1, head)).select(F.col(doc).alias("doc"), F.coalesce(text, F.lit("")).alias("t"))
    n = rows.groupBy("doc").agg(
        F.sum(F.length(u_trim(F.col("t")))).alias("chars"), F.coalesce(F.avg(F.when(F.col("t") != "", meaningful_ratio(F.col("t")))), F.lit(0.0)).alias("ratio"),
        F.bool_or(F.col("t").rlike(r"\{#\{[^}]*\}#\}")).alias("placeholder"),
    )
    return n.select(F.col("doc").alias(doc), "chars", F.round("ratio", 5).alias("ratio"), (F.col("placeholder") | (F.col("chars") < 100) | (F.col("ratio") < 0.2)).alias("scanned"))
