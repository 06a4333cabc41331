"""Records and metadata from a text provider, with the rules as defaults and as fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.coerce import difficulty, first_array, first_object, json_items, points_from_list, points_from_text
from inkstone.functions.meta import FIELDS, needs_provider, surer
from inkstone.functions.providers import TextProvider, asked, asked_by_ordinal, needs_enrichment
from inkstone.functions.text import is_instruction, kept_after_extraction, kept_in_chunk, normal_form, number_in_record, number_in_upload, record_type
from inkstone.operators.dedupe import first_wins
from inkstone.operators.segment import chunks, missing_numbers, recovered, segments
from inkstone.session import written

#: Answers that mean yes, and words by which an answered type is told.
YES = ("是", "yes", "true")
TYPES = {"选择题": ("选择", "单选", "多选"), "填空题": ("填空", "填", "空"), "解答题": ("解答", "应用", "证明", "计算", "求解")}
PREVIEW_TYPE, PREVIEW_INSTRUCTION, PREVIEW_TOGETHER, PREVIEW_ENRICH = 500, 300, 200, 1200
META_REPLY = "region string, year string, grade string, exam_name string, source_type string"


class Rules:
    """Offline provider: answers nothing, so every caller falls back to its rules."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [""] * len(prompts)


def _contains(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return F.coalesce(out, F.lit(False))


def type_from_answer(answer: Column, content: Column) -> Column:
    """One of the three types by words of the answer, else by the rules."""
    low, out = F.lower(answer), None
    for name, words in TYPES.items():
        out = F.when(_contains(low, words), name) if out is None else out.when(_contains(low, words), name)
    return out.otherwise(record_type(content))


def with_types(rows: DataFrame, provider: TextProvider, content: str = "content") -> DataFrame:
    """rows with question_type by the provider's answers; a failed or useless answer leaves the rules'."""
    got = asked(rows, F.concat(F.lit("题型？只返回名称。\n"), F.substring(content, 1, PREVIEW_TYPE)), provider)
    return got.withColumn("question_type", type_from_answer(F.col("answer.value"), F.col(content))).drop("answer")


def without_instructions(rows: DataFrame, provider: TextProvider | None, content: str = "content") -> DataFrame:
    """rows that aren't instructions: by the provider's yes, by the rules where it fails or there is none."""
    if provider is None:
        return rows.where(~is_instruction(F.col(content)))
    got = asked(rows, F.concat(F.lit("是否为试卷说明？只返回是或否。\n"), F.substring(content, 1, PREVIEW_INSTRUCTION)), provider)
    value = F.lower(F.col("answer.value"))
    said = F.when(F.coalesce(value, F.lit("")) != "", _contains(value, YES)).otherwise(is_instruction(F.col(content)))
    return got.where(~said).drop("answer")


def types_together(rows: DataFrame, provider: TextProvider, doc: str, at: str, content: str = "content") -> DataFrame:
    """rows with question_type, asked about together: what the answer says, unknown where it leaves a row out, by the rules
    where there is no answer."""
    got = asked_by_ordinal(rows, doc, at, F.substring(content, 1, PREVIEW_TOGETHER), "各题题型？返回JSON数组。", provider)
    said = F.coalesce(F.get_json_object(F.when(F.col("reply") != "", F.col("reply")), "$.question_type"), F.lit("未知题型"))
    return got.withColumn("question_type", F.when(F.col("reply").isNull(), record_type(F.col(content))).otherwise(said)).drop("reply")


def instructions_together(rows: DataFrame, provider: TextProvider, doc: str, at: str, content: str = "content") -> DataFrame:
    """rows with instruction, asked about together: false where the answer leaves a row out, by the rules without an answer."""
    got = asked_by_ordinal(rows, doc, at, F.substring(content, 1, PREVIEW_TOGETHER), "各段是否为试卷说明？返回JSON数组。", provider)
    said = F.coalesce(F.get_json_object(F.when(F.col("reply") != "", F.col("reply")), "$.is_instruction") == "true", F.lit(False))
    return got.withColumn("instruction", F.when(F.col("reply").isNull(), is_instruction(F.col(content))).otherwise(said)).drop("reply")


def enriched_by_provider(rows: DataFrame, provider: TextProvider, doc: str, at: str, content: str = "content") -> DataFrame:
    """rows with knowledge_points and difficulty by the provider, for all records of a document if any of them lacks points or
    has the default difficulty. What the answer leaves out stays as it is."""
    need = needs_enrichment(rows, doc)
    gated = rows.join(need, rows[doc].eqNullSafe(need[doc])).drop(need[doc])
    got = asked_by_ordinal(gated.where("needed").drop("needed"), doc, at, F.substring(F.trim(content), 1, PREVIEW_ENRICH), "各题知识点和难度？返回JSON数组。", provider)
    one = F.from_json(F.when(F.col("reply") != "", F.col("reply")), "knowledge_points array<string>, difficulty string")
    got = got.withColumn("_said", one).withColumns({
        "knowledge_points": F.when(F.col("_said").isNotNull(), points_from_list(F.col("_said.knowledge_points"))).otherwise(F.col("knowledge_points")),
        "difficulty": F.when(F.col("_said").isNotNull(), difficulty(F.col("_said.difficulty"))).otherwise(F.col("difficulty")),
    })
    return got.drop("_said", "reply").unionByName(gated.where("not needed").drop("needed"))


def recovered_by_provider(docs: DataFrame, gap: DataFrame, provider: TextProvider, doc: str = "doc_hash", text: str = "text") -> DataFrame:
    """(doc, number, content, question_type, knowledge_points, difficulty): records of missing numbers, gap (doc, number), that
    the provider finds in the document. Others that it names are left out; of several with one number all stay."""
    lacking = gap.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_set("number")), ",").alias("_numbers"))  # at most NUMBER_LIMIT
    got = asked(docs.select(doc, text).join(lacking, doc), F.concat(F.lit("补题，返回JSON数组。\n"), "_numbers", F.lit("\n"), text), provider)
    rows = got.select(doc, F.posexplode(json_items(F.col("answer.value"))).alias("at", "r")).select(
        doc, "at", F.trim("r.content").alias("content"), F.col("r.question_type").alias("said"),
        points_from_text(F.regexp_replace("r.knowledge_points", r'[\[\]"]', "")).alias("knowledge_points"), difficulty(F.col("r.difficulty")).alias("difficulty"),
    )
    rows = rows.withColumn("number", number_in_record(F.col("content")).try_cast("bigint")).join(gap, [doc, "number"], "left_semi")
    kind = F.coalesce(F.when(~F.col("said").isin("", "未知题型"), F.col("said")), record_type(F.col("content")))
    return rows.select(doc, "number", "at", "content", kind.alias("question_type"), "knowledge_points", "difficulty")


def records_from_replies(replies: DataFrame, doc: str = "doc_hash", reply: str = "reply") -> DataFrame:
    """(doc, seq, content, question_type, knowledge_points, difficulty): the records in JSON replies (doc, chunk_no, reply), in
    order of chunk and place, coerced, of sufficient length, the first of equal normal forms."""
    rows = replies.select(doc, "chunk_no", F.posexplode(json_items(F.col(reply))).alias("at", "r"))
    rows = rows.select(
        doc, F.shiftleft(F.col("chunk_no").cast("bigint"), 32).alias("base"), "at", F.trim("r.content").alias("content"), F.col("r.question_type").alias("said"),
        points_from_text(F.regexp_replace("r.knowledge_points", r'[\[\]"]', "")).alias("knowledge_points"), difficulty(F.col("r.difficulty")).alias("difficulty"),
    )
    rows = rows.where(kept_in_chunk(F.col("content"))).withColumn("seq", F.col("base") + F.col("at"))
    kept = first_wins(rows, F.struct(doc, normal_form(F.col("content"))), "seq").where("kept")
    kind = F.coalesce(F.when(F.col("said") != "", F.col("said")), record_type(F.col("content")))
    return kept.select(doc, "seq", "content", kind.alias("question_type"), "knowledge_points", "difficulty")


def extract_with_provider(docs: DataFrame, provider: TextProvider, doc: str = "doc_hash", text: str = "text", fallback: bool = True) -> DataFrame:
    """(doc, seq, content, question_type, knowledge_points, difficulty, index) of documents (doc, text).

    The provider is asked by overlapping chunks, and whether what it gives are instructions; for record numbers that the text
    has and the replies lack it is asked once more; a document where that finds none has them recovered from the numbered
    segments (the last one of a number); incomplete records go. A document without any record falls back to its segments.
    index counts from 1.
    """
    asked_ = asked(chunks(docs.select(doc, text), text).drop(text), F.concat(F.lit("提取题目，返回JSON数组。\n"), F.col("chunk")), provider)
    got = written(without_instructions(records_from_replies(asked_.select(doc, "chunk_no", F.col("answer.value").alias("reply")), doc), provider), "replies")
    parts = segments(docs.select(doc, text), text).select(doc, F.col("segment_no").alias("seq"), F.col("segment").alias("content"), number_in_upload(F.col("segment")).try_cast("bigint").alias("number"))
    have = got.select(doc, number_in_record(F.col("content")).try_cast("bigint").alias("number"))
    gap = missing_numbers(docs, have, doc, text).join(got.select(doc).distinct(), doc, "left_semi")
    said = written(recovered_by_provider(docs, gap, provider, doc, text), "recovered")
    blank = F.array().cast("array<string>").alias("knowledge_points"), F.lit(3).alias("difficulty")
    late = F.lit(1).cast("bigint") * (1 << 62)
    found = recovered(gap.join(said.select(doc).distinct(), doc, "left_anti"), parts.where("number is not null"), doc)
    rows = got.unionByName(said.select(doc, (late + F.col("at")).alias("seq"), "content", "question_type", "knowledge_points", "difficulty"))
    rows = rows.unionByName(found.select(doc, (late + F.col("seq")).alias("seq"), "content", record_type(F.col("content")).alias("question_type"), *blank))
    rows = rows.where(kept_after_extraction(F.col("content")))
    if fallback:
        rest = parts.join(rows.select(doc).distinct(), doc, "left_anti")
        rest = rest.where(kept_after_extraction(F.col("content")) & ~is_instruction(F.col("content")))
        rows = rows.unionByName(rest.select(doc, F.col("seq").cast("bigint"), "content", record_type(F.col("content")).alias("question_type"), *blank))
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(doc).orderBy("seq")))


def meta_with_provider(reports: DataFrame, provider: TextProvider, head: str = "head", sure: float = 0.8, report: str = "report") -> DataFrame:
    """reports with meta and asked: the metadata of the report, completed by the provider where a rule is unsure.

    Only documents with a field under 0.6 are asked. A field of the reply counts where the rules found none or are less sure
    than `sure`.
    """
    ask = needs_provider(F.col(f"{report}.confidence"))
    keep = [F.col(c) for c in reports.columns]
    some = asked(reports.where(ask), F.concat(F.lit("返回JSON元数据。\n"), F.col(head)), provider).withColumn("_reply", first_object(F.col("answer.value"), META_REPLY)).drop("answer")
    all_ = some.unionByName(reports.where(~ask), allowMissingColumns=True)
    base, conf = F.col(f"{report}.meta"), F.col(f"{report}.confidence")
    said = lambda f: F.when(F.col("_reply")[f] != "", F.col("_reply")[f])
    typed = lambda f: said(f).try_cast("int") if f == "year" else said(f)
    fields = [surer(base[f], conf[f], F.coalesce(typed(f), base[f]), F.when(typed(f).isNotNull(), F.lit(sure))).alias(f) for f in FIELDS]
    return all_.select(*keep, F.struct(*fields).alias("meta"), ask.alias("asked"))


def topic_points(answer: Column) -> Column:
    """Knowledge points of a topic reply: those of its first JSON object, or array, or the text itself."""
    one = first_object(answer, "knowledge_points array<string>")["knowledge_points"]
    return F.coalesce(one, first_array(answer, "array<string>"), points_from_text(answer))


def lesson_topic(title: Column, grade: Column, region: Column, points: Column, level: Column) -> Column:
    """A topic as a JSON object."""
    return F.to_json(F.struct(title.alias("title"), grade.alias("grade"), region.alias("region"), points.alias("knowledge_points"), level.alias("class_level"), F.lit("A").alias("template_style")))
