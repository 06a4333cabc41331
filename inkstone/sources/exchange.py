"""Other forms of a store, and rendered documents as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import image_links
from inkstone.sources.store import META

RECORD = f"id string, content string, question_type string, knowledge_points array<string>, difficulty int, source_meta {META}, embedding array<float>"


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file {"metadata": [...]}, with seq as their place in it."""
    one = spark.read.schema(f"metadata array<struct<{RECORD.replace(' string', ':string').replace(' array', ':array').replace(' int', ':int').replace(' struct', ':struct')}>>").json(path, multiLine=True)
    return one.select(F.posexplode("metadata").alias("seq", "r")).select(F.col("seq").cast("bigint"), "r.*")


def write_json_lines(rows: DataFrame, folder: str) -> None:
    """Records as JSON lines, for stores that aren't Parquet."""
    rows.write.mode("error").json(folder)


def read_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{RECORD}, seq bigint, doc_hash string").json(folder)


def resolved_images(links: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """links with resolved: the listed file a path stands for, by its name under any folder; NULL if none is listed. listing
    has one column, path; of files with one name the first by path stands."""
    name = lambda c: F.element_at(F.split(c, "[/\\\\]"), -1)
    files = listing.select(F.col("path").alias("resolved"), name(F.col("path")).alias("_name")).groupBy("_name").agg(F.min("resolved").alias("resolved"))
    return links.withColumn("_name", name(F.col(path))).join(files, "_name", "left").drop("_name")


def shown_images(rows: DataFrame, listing: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): rows with the Markdown images that resolve as HTML images of the listed file; the others are left as they
    are. key is unique."""
    links = rows.select(key, F.explode(F.array_distinct(image_links(F.col(text)))).alias("l")).select(key, "l.*")
    found = resolved_images(links, listing).where("resolved is not null")
    html = F.concat(F.lit('<img alt="'), "alt", F.lit('" src="'), "resolved", F.lit('">'))
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("whole", html.alias("html")))).alias("_found"))
    shown = F.aggregate(F.coalesce("_found", F.array().cast("array<struct<whole:string,html:string>>")), F.col(text), lambda t, f: F.replace(t, f["whole"], f["html"]))
    return rows.select(key, text).join(found, key, "left").select(key, shown.alias(text))


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9A-Za-z\x{4e00}-\x{9fa5}._-]", "_")


def export(rows: DataFrame, folder: str, name: str, text: str) -> int:
    """Write each row's text to a folder of its own, name=<name>, through the cluster's file system; returns how many. Rows with
    NULL name are left out."""
    out = rows.select(safe_name(F.col(name).cast("string")).alias("name"), F.col(text).alias("text")).where("name is not null")
    out.repartition("name").write.mode("overwrite").partitionBy("name").text(folder)
    return out.count()


def write_json_store(rows: DataFrame, folder: str) -> None:
    """Records as one JSON object {"metadata": [...]} in a folder, in order of seq, as read_json_store reads it. One object is one
    file, so this is for stores that a task can hold; write_json_lines is for the others."""
    fields = [c.split(" ")[0] for c in RECORD.replace(META, "struct").split(", ")]
    one = rows.agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("r")))).alias("m"))
    one.select(F.to_json(F.struct(F.transform("m", lambda m: m["r"]).alias("metadata"))).alias("value")).coalesce(1).write.mode("error").text(folder)
