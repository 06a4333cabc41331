"""The engine's queries, by name. Each runs over its whole tables; plans/oracle.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import coerce, meta, text, vector
from inkstone.functions.providers import asked, enriched, needs_enrichment, typed_records
from inkstone.operators import analytics, dedupe, filters, render, search, segment
from inkstone.plans import extraction, oracle
from inkstone.plans.canned import Canned
from inkstone.session import spread, table, written
from inkstone.sources import exchange, logs, store
from inkstone.sources.documents import flattened

Query = Callable[[SparkSession, str], DataFrame]

FILTERS = {"region": " 青坡", "source_type": "期", "year": 2021}
POINTS, LEVEL = ["数列", "概率", "统计"], (2, 4)
QUERY_SHARE = 20  # searches take every row whose id is divisible by this, against all rows


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions")


def documents(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text"))


# scans, predicates, pages


def scan_page_query(s: SparkSession, d: str) -> DataFrame:
    page = analytics.query_page(questions(s, d), None, 40, 20)
    return page.select("seq", "id", "question_type", F.array_join("knowledge_points", "|").alias("points"), "difficulty", F.col("source_meta.region").alias("region"), "content_preview")


def meta_filter(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).where(filters.meta_filter(FILTERS)).select("seq", "id", F.col("source_meta.region").alias("region"), F.col("source_meta.source_type").alias("source_type"))


def meta_filter_id(s: SparkSession, d: str) -> DataFrame:
    """By the id of the first record of a grade, with that grade."""
    q = questions(s, d)
    first = q.where(filters.meta_filter({"grade": "初"})).where("id is not null").orderBy("seq").select("id").first()
    return q.where(filters.meta_filter({"grade": "初", "exam_name": " ", "id": first[0] if first else "none"})).select("seq", "id")


def match_total(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).agg(F.count_if(filters.meta_filter(FILTERS)).alias("matched"), F.count("*").alias("total"))


def retrieval_filter(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).where(filters.retrieval_filter(POINTS, LEVEL)).select("seq", "difficulty")


def retrieval_filter_empty(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).where(filters.retrieval_filter([], LEVEL)).select("seq", "difficulty")


def first_point_filter(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).where(filters.first_point_filter(POINTS)).select("seq")


# aggregates


def group_counts_region(s: SparkSession, d: str) -> DataFrame:
    return analytics.group_counts(questions(s, d), "region")


def group_counts_year(s: SparkSession, d: str) -> DataFrame:
    return analytics.group_counts(questions(s, d), "year", {"region": "市"}, 10)


def group_counts_source_type(s: SparkSession, d: str) -> DataFrame:
    return analytics.group_counts(questions(s, d), "source_type", {"year": "2020"}, 30)


def group_counts_lang(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").groupBy(analytics.group_key(F.col("lang")).alias("key"))
    return rows.agg(F.count("*").alias("count"), F.min("doc_id").alias("first"), F.sum("n_chars").alias("chars"))


def store_stats(s: SparkSession, d: str) -> DataFrame:
    return analytics.stats(questions(s, d))


# dedupe


def exact_dedupe_first_wins(s: SparkSession, d: str) -> DataFrame:
    rows = questions(s, d).select("seq", "content")
    return dedupe.first_wins(rows, dedupe.content_key(F.col("content"))).where("kept").select("seq", dedupe.content_key(F.col("content")).alias("content_key"))


def stable_key_dedupe(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "incoming_records").withColumn("id", dedupe.stable_key(F.col("doc_hash"), F.col("content")))
    return dedupe.first_wins(rows, F.col("id")).select("seq", "id", "kept")


def existing_ids_semi(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "incoming_records").join(questions(s, d).select("id"), "id", "left_semi").select("seq", "id")


def new_ids_anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "incoming_records").join(questions(s, d).select("id"), "id", "left_anti").select("seq", "id")


def insert_dedupe(s: SparkSession, d: str) -> DataFrame:
    return dedupe.insertable(table(s, d, "incoming_records"), questions(s, d)).select("seq", "id")


def _worded(df: DataFrame) -> DataFrame:
    return df.select("seq", "id", "content").where("content is not null").withColumn("embedding", vector.hash_embedding(F.regexp_replace("content", "(.{2})", "$1 "), 64))


def _staged(s: SparkSession, d: str) -> DataFrame:
    """The three stages over incoming records; the third takes all that the first two leave."""
    batch, stored = table(s, d, "incoming_records"), questions(s, d)
    left = dedupe.staged(batch, stored).where("reason is null").select("seq")
    left = written(left, "left")
    similar = dedupe.similar_to_stored(_worded(batch.join(left, "seq", "left_semi")), _worded(stored))
    return dedupe.staged(batch, stored, similar=written(similar.select("seq"), "similar"))


def dedupe_first_stages(s: SparkSession, d: str) -> DataFrame:
    """The first two stages, by key and by stored id."""
    return dedupe.staged(table(s, d, "incoming_records"), questions(s, d))


def dedupe_report(s: SparkSession, d: str) -> DataFrame:
    return dedupe.report(_staged(s, d))


def dedupe_rejects(s: SparkSession, d: str) -> DataFrame:
    rows = _staged(s, d).where("reason is not null")
    return rows.join(table(s, d, "incoming_records").select("seq", F.substring("content", 1, dedupe.PREVIEW).alias("content_preview")), "seq").select("seq", "id", "reason", "content_preview")


def similarity_dedupe(s: SparkSession, d: str) -> DataFrame:
    """All incoming records against all of the store, by hashed words and by text."""
    out = dedupe.similar_to_stored(_worded(table(s, d, "incoming_records")), _worded(questions(s, d)))
    return out.select("seq", "id", "match_id", F.round("embedding_similarity", 5).alias("embedding_similarity"), F.round("text_similarity", 5).alias("text_similarity"))


def text_similarity(s: SparkSession, d: str) -> DataFrame:
    form = lambda df, n: df.where("id is not null").groupBy("id").agg(F.min_by("content", "seq").alias("c")).select("id", text.question_form(F.col("c")).alias(n))
    pairs = form(table(s, d, "incoming_records"), "new").join(form(questions(s, d), "old"), "id")
    return pairs.select("id", F.round(dedupe.text_similarity("new", "old"), 5).alias("text_similarity"))


# search


def _query_vector(rows: DataFrame, key: str) -> list[float]:
    first = rows.where("embedding is not null").orderBy(key).select("embedding").first()
    return list(first[0]) if first else []


def _hits(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.round("similarity", 5).alias("similarity"), "rank")


def knn_top10_cosine(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return _hits(search.top_k(e, _query_vector(e, "vec_id"), 10, seq_col="vec_id"), "vec_id")


def knn_top3_l2(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all."""
    e = table(s, d, "embeddings")
    out = search.knn_join(e.where(F.col("vec_id") % QUERY_SHARE == 0), e, 3, "vec_id", "vec_id")
    return out.withColumn("similarity", F.round("similarity", 5))


def knn_prefilter(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d)
    return _hits(search.top_k(q, _query_vector(q, "seq"), 10, filters.retrieval_filter(POINTS, LEVEL)), "seq")


def knn_postfilter_overfetch(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d)
    return _hits(search.top_k(q, _query_vector(q, "seq"), 10, filters.retrieval_filter(POINTS, LEVEL), "closeness", "postfilter"), "seq")


def knn_first_point(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d)
    return _hits(search.top_k(q, _query_vector(q, "seq"), 10, filters.first_point_filter(POINTS), "closeness"), "seq")


def knn_questions(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth stored record against all, itself left out."""
    q = questions(s, d).select("seq", "embedding")
    out = search.knn_join(q.where(F.col("seq") % QUERY_SHARE == 0), q, 3, metric="cosine", keep_self=False)
    return out.withColumn("similarity", F.round("similarity", 5))


def _parts(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d)
    hits = search.top_k(q, _query_vector(q, "seq"), 13, filters.retrieval_filter(POINTS, (1, 5)))
    return search.examples_and_practice(hits)


def examples_practice_split(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).select("part", "number", "seq", F.round("similarity", 5).alias("similarity"))


def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select("doc_id", vector.hash_embedding(F.col("text"), 64).alias("v"))
    return rows.select("doc_id", F.size("v").alias("dim"), F.round(vector.norm(F.col("v")), 3).alias("length"))


# deletion


def delete_dry_run(s: SparkSession, d: str) -> DataFrame:
    return analytics.delete_preview(questions(s, d), {"region": "云滩"}, 5).select("matched", "remaining", F.array_join("sample", "|").alias("sample"))


def delete_remaining(s: SparkSession, d: str) -> DataFrame:
    return analytics.remaining(questions(s, d), {"region": "云滩", "grade": "初"}).select("seq", "id")


# text


def chunk_overlap(s: SparkSession, d: str) -> DataFrame:
    return segment.chunks(documents(s, d)).select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5"))


def clean_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scanned_records").select("rec_id", F.md5(text.clean_text(F.col("content"))).alias("cleaned"))


def clean_documents(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", text.clean_text(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("cleaned"))


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("seq", text.normal_form(F.col("content")).alias("normal"), text.question_form(F.col("content")).alias("question"))


def cjk_space_merge(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scanned_records").select("rec_id", F.md5(text.join_ideographs(F.col("content"))).alias("joined"))


def text_quality_ratio(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.round(text.meaningful_ratio(F.col("text")), 5).alias("ratio"))


def scanned_detector(s: SparkSession, d: str) -> DataFrame:
    return analytics.is_scanned(table(s, d, "scanned_records"))


def pages_flattened(s: SparkSession, d: str) -> DataFrame:
    """All records of a page, in order of rec_id, make its text."""
    record = F.struct("rec_id", F.coalesce("content", F.lit("")).alias("c"))
    page = table(s, d, "scanned_records").groupBy("doc_hash", "page_no").agg(F.array_join(F.array_sort(F.collect_list(record))["c"], "\n").alias("content"))
    return flattened(page).select("doc_hash", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def question_number_a(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("seq", text.number_in_record(F.col("content")).alias("number"))


def question_number_b(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("seq", text.number_in_upload(F.col("content")).alias("number"))


def question_type_heuristic(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("seq", text.record_type(F.col("content")).alias("kind"))


def completeness(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return questions(s, d).select(
        "seq", text.is_complete(c).alias("complete"), text.is_subquestion(c).alias("sub"), text.kept_after_extraction(c).alias("kept"), text.kept_in_chunk(c).alias("kept_chunk")
    )


def boilerplate_heuristic(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.explode(meta.text_lines(F.col("text"))).alias("line")).groupBy("doc_id").agg(F.count_if(text.is_instruction(F.col("line"))).alias("instructions"), F.count("*").alias("lines"))


# documents to records


def lines_head(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.posexplode(F.slice(meta.text_lines(F.col("text")), 1, meta.HEAD_LINES)).alias("line_no", "line"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    return meta.with_report(documents(s, d), "text", "r").drop("text")


def meta_year_grade_type_region(s: SparkSession, d: str) -> DataFrame:
    return _reports(s, d).select("doc_id", "r.meta.year", "r.meta.grade", "r.meta.source_type", "r.meta.region")


def title_line_score(s: SparkSession, d: str) -> DataFrame:
    return _reports(s, d).select("doc_id", "r.meta.exam_name", F.col("r.confidence")["exam_name"].alias("confidence"))


def low_confidence(s: SparkSession, d: str) -> DataFrame:
    return _reports(s, d).select("doc_id", F.array_join(meta.low_confidence(F.col("r.confidence")), "|").alias("fields"), meta.needs_provider(F.col("r.confidence")).alias("ask"))


def meta_merge_precedence(s: SparkSession, d: str) -> DataFrame:
    """Stored metadata first, then what the paper's first import says."""
    log = table(s, d, "import_history").where("meta_used is not null").groupBy("pdf_hash").agg(F.min_by("meta_used", "import_id").alias("inferred"))
    rows = questions(s, d).join(log, F.col("doc_hash") == F.col("pdf_hash"), "left")
    return rows.select("seq", meta.user_first(F.col("source_meta"), F.col("inferred")).alias("m")).select("seq", "m.region", "m.year", "m.grade", "m.exam_name", "m.source_type")


def exam_name_fallback(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("seq", meta.name_or_fallback(F.col("source_meta")).alias("name"))


def question_split(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(documents(s, d)).select("doc_id", "segment_no", F.md5("segment").alias("segment_md5"))


def extracted_types(s: SparkSession, d: str) -> DataFrame:
    rows = segment.segments(documents(s, d))
    return typed_records(rows, "segment").where(text.kept_after_extraction(F.col("segment"))).groupBy("question_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def missing_numbers(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    found = segment.segments(docs).select("doc_id", text.number_in_upload(F.col("segment")).try_cast("bigint").alias("number"))
    return segment.missing_numbers(docs, found, "doc_id")


def recovered_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers that no kept record has, with the last segment of that number."""
    parts = segment.segments(documents(s, d)).select("doc_id", "segment_no", "segment", text.number_in_upload(F.col("segment")).try_cast("bigint").alias("number"))
    kept = parts.where(text.is_complete(F.col("segment")))
    gap = segment.missing_numbers(documents(s, d), kept, "doc_id")
    return segment.recovered(gap, parts.where("number is not null"), "doc_id", seq="segment_no").select("doc_id", "number", "segment_no", F.md5("segment").alias("segment_md5"))


def provider_extraction(s: SparkSession, d: str) -> DataFrame:
    """Extraction with the offline provider: every document falls back to its numbered segments."""
    rows = extraction.extract_with_provider(documents(s, d), extraction.Rules(), "doc_id")
    return rows.select("doc_id", F.col("index").alias("record_no"), F.md5("content").alias("content_md5"), "question_type")


def _chunk_replies(s: SparkSession, d: str) -> DataFrame:
    rows = segment.chunks(documents(s, d)).drop("text")
    return asked(rows, F.concat(F.lit("提取题目，返回JSON数组。\n"), F.col("chunk")), Canned()).select("doc_id", "chunk_no", F.col("answer.value").alias("reply"))


def provider_replies(s: SparkSession, d: str) -> DataFrame:
    """Records of a provider's answers by chunk, some of which are cut off or broken."""
    rows = extraction.records_from_replies(_chunk_replies(s, d), "doc_id")
    return rows.select("doc_id", "seq", "content", "question_type", F.array_join("knowledge_points", "|").alias("points"), "difficulty")


def provider_types(s: SparkSession, d: str) -> DataFrame:
    return extraction.with_types(questions(s, d).select("seq", "content").where("content is not null"), Canned()).select("seq", "question_type")


def provider_types_together(s: SparkSession, d: str) -> DataFrame:
    return extraction.types_together(questions(s, d).select("doc_hash", "seq", "content"), Canned(), "doc_hash", "seq").select("seq", "question_type")


def provider_instructions(s: SparkSession, d: str) -> DataFrame:
    rows = questions(s, d).select("doc_hash", "seq", "content").where("content is not null")
    one = extraction.without_instructions(rows, Canned()).select("seq", F.lit("kept").alias("asked"))
    many = extraction.instructions_together(rows, Canned(), "doc_hash", "seq").where("not instruction").select("seq", F.lit("kept together").alias("asked"))
    return one.unionByName(many)


def provider_enrichment(s: SparkSession, d: str) -> DataFrame:
    rows = questions(s, d).select("doc_hash", "seq", "content", F.coalesce("knowledge_points", F.array().cast("array<string>")).alias("knowledge_points"), "difficulty")
    out = extraction.enriched_by_provider(rows, Canned(), "doc_hash", "seq")
    return out.select("seq", F.array_join("knowledge_points", "|").alias("points"), "difficulty")


def provider_metadata(s: SparkSession, d: str) -> DataFrame:
    """Metadata by rules, completed by a provider where a rule is unsure."""
    rows = meta.with_report(documents(s, d), "text").withColumn("head", F.coalesce(F.substring("text", 1, 40), F.lit("")))
    return extraction.meta_with_provider(rows, Canned()).select("doc_id", "meta.region", "meta.year", "meta.grade", "asked")


def provider_recovery(s: SparkSession, d: str) -> DataFrame:
    """Numbers without a kept record, as a provider finds them."""
    docs = documents(s, d)
    parts = segment.segments(docs).select("doc_id", "segment", text.number_in_upload(F.col("segment")).try_cast("bigint").alias("number"))
    gap = segment.missing_numbers(docs, parts.where(text.is_complete(F.col("segment"))), "doc_id")
    return extraction.recovered_by_provider(docs, gap, Canned(), "doc_id").select("doc_id", "number", "content", "difficulty")


def merge_by_number(s: SparkSession, d: str) -> DataFrame:
    out = segment.merged_by_number(table(s, d, "incoming_records").where("doc_hash is not null"))
    return out.select("doc_hash", "number", "seq", F.md5("content").alias("content_md5"), "index")


# coercions and logs


def kp_coercion(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("seq", F.array_join(coerce.points_from_text(F.array_join("knowledge_points", "、")), "|").alias("points"))


def difficulty_clamp(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("seq", coerce.difficulty(F.col("difficulty")).alias("level"), coerce.difficulty(F.concat(F.lit(" "), F.col("difficulty").cast("string"), F.when(F.col("seq") % 7 == 0, ".5").otherwise(""))).alias("from_text"), coerce.difficulty(F.col("difficulty") * F.lit(0.75)).alias("from_number"))


def enrichment_gate(s: SparkSession, d: str) -> DataFrame:
    return needs_enrichment(enriched(questions(s, d)), "doc_hash")


def json_array_parse(s: SparkSession, d: str) -> DataFrame:
    """Each event's object in replies of five shapes: fenced with trailing commas, without the closing bracket, with a broken
    object between, without any, and with curly quotes around words."""
    one = F.regexp_replace("props", r"\}$", ',"content":"x"}')
    shape = F.col("event_id") % 5
    reply = (
        F.when(shape == 0, F.concat(F.lit("```json\n["), F.regexp_replace("props", r"\}$", ',"content":"x",}'), F.lit(",]\n```")))
        .when(shape == 1, F.concat(F.lit("结果：["), one, F.lit(", "), one, F.lit(", ")))
        .when(shape == 2, F.concat(F.lit("["), one, F.lit(', {"content": "y", oops}, '), one, F.lit("]")))
        .when(shape == 3, F.lit("没有题目")).otherwise(F.translate(F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")), '"', "”"))
    )
    items = coerce.json_items(reply, "array<struct<content:string,k:bigint>>")
    return table(s, d, "events").select("event_id", F.size(items).alias("n"), F.get(items, 0)["k"].alias("k"))


def history_page(s: SparkSession, d: str) -> DataFrame:
    log = logs.latest_by_import(table(s, d, "import_history").select("import_id", "pdf_hash", "extracted_total", "added"))
    return analytics.newest_first(log, 10, 50, "import_id").select("import_id", "pdf_hash", "extracted_total", "added")


def history_lines(s: SparkSession, d: str) -> DataFrame:
    """The log written as lines, some broken, and read again."""
    line = F.when(F.col("import_id") % 10 == 0, F.lit("{bad")).when(F.col("import_id") % 10 == 5, F.lit("  ")).otherwise(F.to_json(F.struct("ts", "pdf_hash", "extracted_total", "added", "meta_used")))
    got = logs.parsed(table(s, d, "import_history").select("import_id", line.alias("value")))
    return got.select("import_id", "event.pdf_hash", "event.added", "event.meta_used.region").distinct()


def import_totals(s: SparkSession, d: str) -> DataFrame:
    log = logs.latest_by_import(table(s, d, "import_history").select("import_id", "pdf_hash", "extracted_total", "added", "duplicates_removed"))
    return log.groupBy("pdf_hash").agg(F.count("*").alias("imports"), F.sum("extracted_total").alias("extracted"), F.sum("added").alias("added"), F.sum("duplicates_removed").alias("removed"))


def flat_metadata(s: SparkSession, d: str) -> DataFrame:
    """Records flattened to text and typed again."""
    back = store.nested_form(store.flat_form(store.stored_form(questions(s, d))))
    return back.select("seq", F.array_join("knowledge_points", "|").alias("points"), "difficulty", "source_meta.region", "source_meta.year")


# documents from records


def image_link_rewrite(s: SparkSession, d: str) -> DataFrame:
    """Every image of a sheet as a link in its text; those that the even rows name are files."""
    rows = table(s, d, "assignment_rows").where("size(images) > 0")
    link = F.array_join(F.transform("images", lambda p, i: F.concat(F.lit(" ![图"), i, F.lit("]("), p, F.lit(")"))), "")
    listing = rows.where("row_id % 2 = 0").select(F.explode("images").alias("path")).select(F.concat(F.lit("/data"), "path").alias("path")).distinct()
    shown = exchange.shown_images(rows.select("row_id", F.concat(F.coalesce("content", F.lit("")), link).alias("text")), listing, "row_id", "text")
    return shown.select("row_id", F.md5("text").alias("html_md5"))


def image_paths(s: SparkSession, d: str) -> DataFrame:
    """Image paths of sheets, resolved against the files that the even rows name."""
    links = table(s, d, "assignment_rows").select("row_id", F.posexplode("images").alias("at", "path"))
    listing = links.where("row_id % 2 = 0").select(F.concat(F.lit("/data"), "path").alias("path")).distinct()
    return exchange.resolved_images(links, listing).select("row_id", "at", "path", "resolved")


def assignment_html(s: SparkSession, d: str) -> DataFrame:
    return render.sheets(table(s, d, "assignment_rows"), answers=True).select("sheet_id", "n", F.md5("html").alias("html_md5"))


def handout_render(s: SparkSession, d: str) -> DataFrame:
    return render.handout(_parts(s, d), "数列与概率")


def handout_html(s: SparkSession, d: str) -> DataFrame:
    return handout_render(s, d).select(F.md5(render.markdown_html(F.col("markdown"))).alias("html_md5"))


def queries() -> dict[str, Query]:
    found = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_"}
    return {n: f for n, f in found.items() if n not in ("queries", "oracle_sql", "questions", "documents")}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
