"""The import log: JSON lines, appended; blank and malformed lines are skipped when it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import u_trim

META = "struct<region:string,year:int,grade:string,exam_name:string,source_type:string>"
REPORT = "struct<internal_exact:int,db_existing_id:int,similarity:int>"
EVENT = (
    f"struct<ts:string,pdf_filename:string,pdf_hash:string,meta_used:{META},extracted_total:int,added:int,vector_db_total:bigint,"
    f"duplicates_removed:int,dedupe_report:{REPORT}>"
)


def utc_now() -> Column:
    """The time of the query in UTC, as text."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def append(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(folder)


def parsed(lines: DataFrame, value: str = "value", schema: str = EVENT) -> DataFrame:
    """lines with event: the object of each line. Lines that are blank or no JSON object are dropped."""
    text = u_trim(F.col(value))
    ok = (text != "") & text.startswith("{") & F.try_parse_json(text).isNotNull()
    return lines.where(ok).withColumn("event", F.from_json(text, schema))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.read.text(folder)).select("event.*")


def latest_by_import(log: DataFrame, key: str = "import_id") -> DataFrame:
    """A row per import; of rows logged twice any stands, since they are equal but for NULLs: the one with most fields."""
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in log.columns), F.lit(0))
    rest = F.struct(*[c for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(rest, F.struct(filled, F.xxhash64(*[F.to_json(F.struct(c)) for c in log.columns]))).alias("r")).select(key, "r.*")
