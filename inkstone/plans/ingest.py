"""The whole way: documents to stored records, and a query to a rendered document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.meta import head, name_or_fallback, text_lines, user_first, with_report
from inkstone.functions.providers import EmbeddingProvider, HashEmbedding, TextProvider, typed_records
from inkstone.functions.text import clean_text, kept_after_extraction
from inkstone.operators.dedupe import report, similar_to_stored, staged
from inkstone.operators.render import handout
from inkstone.operators.search import examples_and_practice, top_k
from inkstone.operators.segment import segments
from inkstone.plans.extraction import enriched_by_provider, extract_with_provider, meta_with_provider
from inkstone.session import written
from inkstone.sources import logs
from inkstone.sources.logs import utc_now
from inkstone.sources.store import META, Store

#: Class levels with a range of difficulty of their own.
LEVELS = {"冲竞赛": (3, 5)}
DEFAULT_LEVEL, EXTRA = (2, 4), 5


def extracted(docs: DataFrame, user_meta: str | None = None, boilerplate: str = "heuristic") -> DataFrame:
    """(doc_hash, place, content, question_type, source_meta) of documents (doc_hash, text).

    Metadata comes from the raw text; records from the cleaned text, cut at numbers, without instructions, kept if complete
    or numbered. user_meta is an expression of the metadata struct that takes precedence. place counts within a document.
    """
    user = F.from_json(F.lit("{}"), META) if user_meta is None else F.expr(user_meta)
    known = with_report(docs.select("doc_hash", "text"), "text").withColumn("_m", user_first(user, F.col("report.meta")))
    known = known.withColumn("source_meta", F.struct("_m.region", "_m.year", "_m.grade", name_or_fallback(F.col("_m")).alias("exam_name"), "_m.source_type"))
    rows = segments(known.select("doc_hash", "source_meta", clean_text(F.col("text")).alias("text"))).withColumnRenamed("segment", "content")
    rows = typed_records(rows, boilerplate=boilerplate).where(kept_after_extraction(F.col("content")))
    return rows.select("doc_hash", F.col("segment_no").cast("bigint").alias("place"), "content", "question_type", "source_meta")


def extracted_by_provider(docs: DataFrame, provider: TextProvider, user_meta: str | None = None) -> DataFrame:
    """extracted, with records and metadata by a provider's answers, and with knowledge_points and difficulty."""
    user = F.from_json(F.lit("{}"), META) if user_meta is None else F.expr(user_meta)
    reports = with_report(docs.select("doc_hash", "text"), "text").withColumn("head", head(F.coalesce(text_lines(F.col("text")), F.array().cast("array<string>"))))
    known = meta_with_provider(reports, provider).select("doc_hash", user_first(user, F.col("meta")).alias("_m"))
    known = known.select("doc_hash", F.struct("_m.region", "_m.year", "_m.grade", name_or_fallback(F.col("_m")).alias("exam_name"), "_m.source_type").alias("source_meta"))
    rows = extract_with_provider(docs.select("doc_hash", clean_text(F.col("text")).alias("text")), provider)
    rows = rows.select("doc_hash", F.col("index").cast("bigint").alias("place"), "content", "question_type", "knowledge_points", "difficulty")
    return enriched_by_provider(written(rows, "records"), provider, "doc_hash", "place").join(known, "doc_hash")


def import_events(docs: DataFrame, rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """A log event per document: what was extracted and added, what each stage removed, the store's size after it."""
    n = lambda *r: F.count_if(F.col("reason").isin(*r)).cast("int")
    by = rows.join(keys.select("seq", "reason"), "seq").groupBy("doc_hash").agg(
        F.first("source_meta").alias("meta_used"), F.count("*").cast("int").alias("extracted_total"), F.count_if(F.col("reason").isNull()).cast("int").alias("added"),
        F.count_if(F.col("reason").isNotNull()).cast("int").alias("duplicates_removed"),
        F.struct(n("internal_exact").alias("internal_exact"), n("db_existing_id").alias("db_existing_id"), n("similarity").alias("similarity")).alias("dedupe_report"),
    )
    name = F.element_at(F.split("path", "/"), -1) if "path" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_hash").alias("pdf_hash"), name.alias("pdf_filename")).join(by.withColumnRenamed("doc_hash", "pdf_hash"), "pdf_hash", "left").select(
        utc_now().alias("ts"), "pdf_filename", "pdf_hash", "meta_used", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("extracted_total", "added")],
        F.lit(total).cast("bigint").alias("vector_db_total"), F.coalesce("duplicates_removed", F.lit(0)).alias("duplicates_removed"), "dedupe_report",
    )


def numbered(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows (doc_hash, place, ...), written, with seq after all stored ones, in order of document and place. Numbers come from a
    sort by range, so no task sees more than its part; they have gaps and no two are alike."""
    last = stored.agg(F.max("seq")).first()[0]
    ordered = rows.repartitionByRange("doc_hash", "place").sortWithinPartitions("doc_hash", "place")
    return written(ordered.withColumn("seq", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1)), "numbered")


def ingest(
    docs: DataFrame, store: Store, embedding: EmbeddingProvider | None = None, similarity: bool = True, user_meta: str | None = None,
    provider: TextProvider | None = None, log: str | None = None,
) -> tuple[dict, DataFrame, DataFrame]:
    """Put documents' records into the store. Returns (counts, report row, rejected (seq, id, reason)).

    Ingesting the same documents again adds nothing. Cheap stages come first: vectors are made for new ids only. With a
    provider, records, metadata and missing fields are by its answers; log is a folder that gets an event a document.
    """
    embedding = embedding or HashEmbedding()
    old = store.read()
    rows = numbered(written(extracted(docs, user_meta) if provider is None else extracted_by_provider(docs, provider, user_meta), "extracted"), old)
    keys = written(staged(rows, old), "staged")
    new = rows.join(keys.where("reason is null").select("seq", "id"), "seq").withColumn("embedding", embedding.expression(F.col("content")))
    new = written(new, "embedded")
    if similarity and not old.isEmpty():
        near = written(similar_to_stored(new, old).select("seq"), "similar")
        keys = keys.join(near.withColumn("near", F.lit(True)), "seq", "left").select("seq", "id", F.coalesce("reason", F.when(F.col("near"), "similarity")).alias("reason"))
        new = new.join(near, "seq", "left_anti")
    keys = written(keys, "keys")
    counts = store.append(new)
    if log:
        logs.append(import_events(docs, rows, keys, store.read().count()), log)
    return counts, report(keys), keys.where("reason is not null")


def build_handout(store: DataFrame, title: str, points: list[str], embedding: EmbeddingProvider, level: str = "中等", examples: int = 3, practice: int = 5) -> DataFrame:
    """(markdown): the store's best records for a topic as a document."""
    query = store.sparkSession.range(1).select(embedding.expression(F.lit(f"{title} {', '.join(points)}")).alias("v")).first()["v"]
    from inkstone.operators.filters import retrieval_filter

    hits = top_k(store, list(query), examples + practice + EXTRA, retrieval_filter(points, LEVELS.get(level, DEFAULT_LEVEL)))
    return handout(examples_and_practice(hits, examples, practice), title)
