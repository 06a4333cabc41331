"""Documents as files: identity by content, pages by a provider."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators.analytics import is_scanned
from inkstone.session import written

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


class PageProvider(Protocol):
    """Reads a document's pages. Made once a task; must be picklable."""

    def pages(self, content: bytes) -> list[str]: ...


class PlainText:
    """Offline default: UTF-8 text whose pages are divided by form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


def files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(doc_hash, path, content): the files whose name ends in suffix, without case; identity is the MD5 of the bytes."""
    rows = spark.read.format("binaryFile").load(folder).where(F.lower("path").endswith(suffix))
    return rows.select(F.md5("content").alias("doc_hash"), "path", "content")


def pages(docs: DataFrame, provider: PageProvider, max_pages: int | None = None) -> DataFrame:
    """(doc_hash, page_no, content) of files; a document that can't be read gives one page of NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, raw in zip(pdf["doc_hash"], pdf["content"], strict=True):
                try:
                    got = provider.pages(bytes(raw))[:max_pages]
                except Exception:
                    got = [None]
                out += [(key, i, t) for i, t in enumerate(got, 1)]
            yield pd.DataFrame(out, columns=["doc_hash", "page_no", "content"])

    return docs.select("doc_hash", "content").mapInPandas(run, "doc_hash string, page_no int, content string")


def flattened(page_table: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """(doc, text): the pages of a document with a mark before each, joined by line feeds."""
    mark = F.format_string("--- 第 %d 页 ---\n%s", F.col("page_no"), F.coalesce("content", F.lit("")))
    one = page_table.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_no", mark.alias("t")))).alias("p"))
    return one.select(doc, F.array_join(F.transform("p", lambda p: p["t"]), "\n").alias("text"))


def read_pages(docs: DataFrame, native: PageProvider, scanned: PageProvider, max_pages: int | None = None) -> DataFrame:
    """(doc_hash, page_no, content): the pages of files by their text layer, and by text recognition for those whose text layer
    isn't worth reading (is_scanned over the first pages)."""
    first = written(pages(docs, native, max_pages), "pages")
    poor = is_scanned(first).where("scanned").select("doc_hash")
    return first.join(poor, "doc_hash", "left_anti").unionByName(pages(docs.join(poor, "doc_hash", "left_semi"), scanned, max_pages))
