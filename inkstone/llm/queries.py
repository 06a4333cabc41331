"""Queries of the problems, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from inkstone.llm import canonical, incremental, leakage, lookalike, neardup, packing, scanned, spans
from inkstone.session import table

Query = Callable[[SparkSession, str], DataFrame]


FIELDS = {"region": "source_meta.region", "source_type": "source_meta.source_type", "grade": "source_meta.grade"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.noise(table(spark, d, "scanned_records"))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired(table(spark, d, "scanned_records"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "questions").select("seq", "source_meta").unionByName(table(spark, d, "incoming_records").select("seq", "source_meta"))
    return canonical.mapped(rows, table(spark, d, "reference_values"), "seq", FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("seq", "field", "ref_id")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched(_mapped(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(spark, d, "questions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.equal_looking(table(spark, d, "assignment_rows"))


def p4_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "assignment_rows")).select("row_id", F.md5("form").alias("form_md5"), F.length("form").alias("n_chars"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.rejected(table(spark, d, "questions"), table(spark, d, "incoming_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(table(spark, d, "documents"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_fraction(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_fraction(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Only for what SQL can say on whole tables in reasonable time; the rest is tested against brute force on fixtures."""
    return {
        "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 8192",
    }
