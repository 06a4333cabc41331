"""From texts to records: chunks, numbered segments, missing numbers, and merging by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import D, NEVER_SORTED, NUMBER_LIMIT, S, WS, YEARS, ascii_digits, normal_form, number_in_record, u_trim

CHUNK, OVERLAP, LEAST = 2000, 400, 30
#: Where a record begins: at the start of a line, a number, one in parentheses, or an ideograph numeral.
STARTS = rf"(^|\n)(?={D}+[.、]{S}+|\({D}+\){S}+|[一二三四五六七八九十]+[、．]{S}+)"
MARK = "\x01"


def chunks(docs: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with chunk_no (from 0) and chunk: pieces of size characters, each beginning size - overlap after the one before;
    one piece if the text fits. NULL texts give no rows, empty ones an empty piece."""
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    at = F.when(F.col(text).isNotNull(), F.sequence(F.lit(0), n))
    return docs.withColumn("chunk_no", F.explode(at)).withColumn("chunk", F.expr(f"substring(`{text}`, chunk_no * {step} + 1, {size})"))


def segments(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with segment_no (from 1) and segment: the text from each record start to the next, white space made single,
    without what comes before the first and without segments under `least` characters."""
    parts = F.split(F.regexp_replace(F.col(text), STARTS, "$1" + MARK), MARK)
    parts = F.transform(F.slice(parts, 2, 1_000_000_000), u_trim)
    kept = F.filter(parts, lambda s: F.length(s) >= least)
    out = docs.select("*", F.posexplode(F.transform(kept, lambda s: F.regexp_replace(s, f"[{WS}]+", " "))).alias("_at", "segment"))
    return out.withColumn("segment_no", F.col("_at") + 1).drop("_at")


def line_numbers(text: Column) -> Column:
    """The numbers at the starts of lines that can be record numbers."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|\n){S}*({D}+){S}*[.、)]"), 1)
    n = F.transform(found, lambda s: ascii_digits(s).try_cast("bigint"))
    return F.filter(n, lambda x: x.between(1, NUMBER_LIMIT) & ~x.between(*YEARS))


def missing_numbers(docs: DataFrame, found: DataFrame, key: str, text: str = "text", number: str = "number") -> DataFrame:
    """(key, number): numbers from 1 to the largest at a line start of the text that no record in found has."""
    expected = docs.select(key, F.array_max(line_numbers(F.col(text))).alias("n")).where("n is not null")
    expected = expected.select(key, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias(number))
    return expected.join(found.select(key, number).distinct(), [key, number], "left_anti")


def recovered(missing: DataFrame, candidates: DataFrame, key: str, number: str = "number", seq: str = "seq") -> DataFrame:
    """For each missing number the last candidate record that has it."""
    rest = [c for c in candidates.columns if c not in (key, number)]
    best = candidates.join(missing, [key, number], "left_semi").groupBy(key, number).agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return best.select(key, number, "r.*")


def merged_by_number(rows: DataFrame, doc: str = "doc_hash", seq: str = "seq", content: str = "content") -> DataFrame:
    """(doc, number, seq, content, index): records of a document with the same number as one; those without a number as
    they are, after them.

    The longest text leads (the first of equals); texts whose normal form it contains are dropped, the others follow in
    order, one a line. index counts from 1 by number, then by seq. Blank records are dropped. Texts of one number are few
    by nature (numbers are those of one paper); only keys and texts are shuffled.
    """
    base = rows.select(F.col(doc).alias("doc"), F.col(seq).alias("seq"), u_trim(F.col(content)).alias("text")).where("text != ''")
    base = base.withColumn("number", number_in_record(F.col("text"))).withColumn("form", normal_form(F.col("text")))
    group = base.where("number is not null").groupBy("doc", "number").agg(
        F.max_by(F.struct("text", "form", "seq"), F.struct(F.length("text"), -F.col("seq"))).alias("base"),
        F.array_sort(F.collect_list(F.struct("seq", "text", "form"))).alias("parts"), F.min("seq").alias("first"),
    )
    extra = F.transform(F.filter("parts", lambda p: ~F.col("base")["form"].contains(p["form"])), lambda p: p["text"])
    one = group.select("doc", "number", F.col("base.seq").alias("seq"), F.col("first").alias("at"), F.array_join(F.concat(F.array("base.text"), extra), "\n").alias("content"))
    alone = base.where("number is null").select("doc", "number", "seq", F.col("seq").alias("at"), F.col("text").alias("content"))
    order = F.coalesce(F.col("number").try_cast("bigint"), F.lit(NEVER_SORTED))
    out = one.unionByName(alone)
    return out.withColumn("index", F.row_number().over(Window.partitionBy("doc").orderBy(order, F.col("number").isNull(), "at"))).select(F.col("doc").alias(doc), "number", "seq", "content", "index")
