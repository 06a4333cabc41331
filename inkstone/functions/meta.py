"""Metadata of a document from its first lines, with confidences, and how sources of metadata are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import D, S, WS, ascii_digits, first_group, u_trim

#: Vocabularies, in order of precedence.
GRADES = ("高一", "高二", "高三", "初一", "初二", "初三")
SOURCE_TYPES = ("期中", "期末", "月考", "模拟", "一模", "二模", "三模", "联考")
NAME_WORDS = ("考试", "试卷", "试题", "检测", "测验", "联考", "月考", "期中", "期末")
HEAD_LINES, NAME_LINES, CANDIDATE_LINES, NAME_LENGTH = 30, 25, 10, 90
#: Confidence of each field when a rule finds it.
CONFIDENCE = {"year": 0.95, "grade": 0.9, "source_type": 0.85, "region": 0.75}
FIELDS = ("region", "year", "grade", "exam_name", "source_type")
LOW, ASK = 0.7, 0.6
UNNAMED = "未命名试卷"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def text_lines(x: Column) -> Column:
    """The lines that aren't blank, trimmed. Lines end as for Python's splitlines."""
    return F.filter(F.transform(F.split(x, LINE_ENDS), u_trim), lambda s: s != "")


def head(lines: Column, n: int = HEAD_LINES) -> Column:
    return F.array_join(F.slice(lines, 1, n), "\n")


def year(x: Column) -> Column:
    y = F.coalesce(
        first_group(x, rf"(20{D}{{2}}){S}*年"), first_group(x, rf"(20{D}{{2}}){S}*[-—–~至一]{S}*20{D}{{2}}{S}*学年"),
        first_group(x, rf"(20{D}{{2}}){S}*[-—–~]{S}*20{D}{{2}}"),
    )
    return ascii_digits(y).cast("int")


def first_of(x: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that x contains."""
    return F.coalesce(*[F.when(x.contains(w), F.lit(w)) for w in words])


def region(x: Column) -> Column:
    return first_group(x, r"([\x{4e00}-\x{9fa5}]{2,8}(?:市|省|自治区|区|县))")


def title_score(line: Column, grade: Column, kind: Column, year_: Column) -> Column:
    has = lambda w, n: F.when(F.coalesce(line.contains(w), F.lit(False)), n).otherwise(0)
    return has(grade, 2) + has(kind, 2) + has(year_.cast("string"), 2) + has(F.lit("学年"), 1) + has(F.lit("数学"), 1)


def title_line(lines: Column, grade: Column, kind: Column, year_: Column) -> Column:
    """(score, -position, line) of the best line with a name word; the first of equal ones. NULL without such a line."""
    named = lambda s: (F.length(s) <= NAME_LENGTH) & s.rlike("|".join(NAME_WORDS))
    scored = F.transform(
        F.slice(lines, 1, NAME_LINES),
        lambda s, i: F.when(named(s), F.struct(title_score(s, grade, kind, year_).alias("score"), (-i).alias("at"), s.alias("line"))),
    )
    return F.array_max(F.filter(scored, lambda t: t.isNotNull()))


def clean_name(x: Column) -> Column:
    return u_trim(F.regexp_replace(F.regexp_replace(x, rf"(?i)[,，]{S}*msu.*$", ""), f"[{WS}]+", " "))


def with_report(rows: DataFrame, text: str, name: str = "report") -> DataFrame:
    """rows with a struct (meta, confidence, evidence) of a document's text, by rules only. A field that isn't found is NULL
    with confidence 0; NULL text finds nothing.

    Lines, head and fields are columns of their own on the way, so each is worked out once a row.
    """
    c = lambda n: F.col(f"_meta_{n}")
    out = rows.withColumn("_meta_lines", F.coalesce(F.slice(text_lines(F.col(text)), 1, HEAD_LINES), F.array().cast("array<string>")))
    out = out.withColumn("_meta_head", head(c("lines")))
    out = out.withColumns({"_meta_y": year(c("head")), "_meta_g": first_of(c("head"), GRADES), "_meta_k": first_of(c("head"), SOURCE_TYPES), "_meta_r": region(c("head"))})
    out = out.withColumn("_meta_best", title_line(c("lines"), c("g"), c("k"), c("y")))
    out = out.withColumn("_meta_name", clean_name(c("best")["line"]))
    sure = lambda x, p: F.when(x.isNotNull(), F.lit(p)).otherwise(0.0)
    confidence = F.create_map(
        F.lit("year"), sure(c("y"), CONFIDENCE["year"]), F.lit("grade"), sure(c("g"), CONFIDENCE["grade"]), F.lit("source_type"), sure(c("k"), CONFIDENCE["source_type"]),
        F.lit("region"), sure(c("r"), CONFIDENCE["region"]), F.lit("exam_name"), F.when(c("best")["score"] >= 2, 0.7).when(c("best").isNotNull(), 0.6).otherwise(0.0),
    )
    report = F.struct(
        F.struct(c("r").alias("region"), c("y").alias("year"), c("g").alias("grade"), c("name").alias("exam_name"), c("k").alias("source_type")).alias("meta"),
        confidence.alias("confidence"),
        F.struct(F.slice(c("lines"), 1, CANDIDATE_LINES).alias("title_candidates"), c("name").alias("exam_name_line"), F.lit(False).alias("llm_used")).alias("evidence"),
    )
    return out.select(*[F.col(f"`{x}`") for x in rows.columns], report.alias(name))


def low_confidence(confidence: Column, least: float = LOW) -> Column:
    """The fields whose confidence is under least, in the order of FIELDS."""
    return F.filter(F.array(*map(F.lit, FIELDS)), lambda k: F.coalesce(confidence[k], F.lit(0.0)) < least)


def needs_provider(confidence: Column) -> Column:
    return F.exists(F.array(*map(F.lit, ("region", "exam_name", "year", "grade"))), lambda k: F.coalesce(confidence[k], F.lit(0.0)) < ASK)


def truthy(x: Column, kind: str = "string") -> Column:
    """x unless it is empty text or 0."""
    return F.when(x != (0 if kind == "int" else ""), x)


def user_first(user: Column, inferred: Column) -> Column:
    """Metadata of both, field by field: the user's value unless it is NULL, empty or 0."""
    return F.struct(*[F.coalesce(truthy(user[f], "int" if f == "year" else "string"), inferred[f]).alias(f) for f in FIELDS])


def surer(base: Column, base_confidence: Column, other: Column, other_confidence: Column) -> Column:
    """other where base is NULL or less sure than other, else base."""
    return F.when(base.isNull() | (F.coalesce(base_confidence, F.lit(0.0)) < F.coalesce(other_confidence, F.lit(0.0))), other).otherwise(base)


def name_or_fallback(meta: Column) -> Column:
    """exam_name, or one put together from year, region and source type, or a constant."""
    part = lambda x, end="": F.coalesce(F.concat(F.when(u_trim(x.cast("string")) != "", u_trim(x.cast("string"))), F.lit(end)), F.lit(""))
    built = F.concat(part(meta["year"], "年"), part(meta["region"]), part(meta["source_type"]))
    return F.coalesce(truthy(meta["exam_name"]), F.when(built != "", built), F.lit(UNNAMED))
