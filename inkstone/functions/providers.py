"""Seams for external models, with deterministic offline defaults."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.coerce import difficulty, points_from_list
from inkstone.functions.text import is_instruction, record_type
from inkstone.functions.vector import hash_embedding

ANSWER = "answer struct<value:string,error:string>"


class TextProvider(Protocol):
    """Answers prompts in batches. Made once a task; must be picklable."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class EmbeddingProvider(Protocol):
    def expression(self, text: Column) -> Column: ...


class HashEmbedding:
    """Offline default: word counts by hash bucket."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def expression(self, text: Column) -> Column:
        return hash_embedding(text, self.dim)


def asked(rows: DataFrame, prompt: Column, provider: TextProvider, size: int = 64) -> DataFrame:
    """rows with answer: (value, error) of the provider for each prompt, asked in batches; an error is an error, not a text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), size):
                part = list(pdf["_prompt"].iloc[at : at + size])
                try:
                    out += [{"value": v, "error": None} for v in provider.generate(part)]
                except Exception as e:
                    out += [{"value": None, "error": str(e)}] * len(part)
            yield pdf.drop(columns="_prompt").assign(answer=out)

    return rows.withColumn("_prompt", prompt).mapInPandas(run, f"{schema}, {ANSWER}")


def asked_by_ordinal(rows: DataFrame, doc: str, at: str, item: Column, head: str, provider: TextProvider, size: int = 20) -> DataFrame:
    """rows with reply: one prompt asks about up to `size` records of a document, in order, a line each (ordinal, tab, item
    without line ends), and is answered by a JSON array of objects with an index. reply is the row's object as JSON, empty
    text if the answer lacks its index, and NULL if there is no answer that can be read."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def objects(answer: str | None) -> dict[int, dict] | None:
        try:
            found = json.loads(re.search(r"\[.*\]", answer or "", re.DOTALL)[0])
            return {int(r.get("index", n)): r for n, r in enumerate(found, 1)}
        except (TypeError, ValueError, AttributeError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, items = pdf[doc].tolist(), pdf["_item"].tolist()
            cuts, begin = [], 0
            for i in range(1, len(items) + 1):
                if i == len(items) or docs[i] != docs[begin] or i - begin == size:
                    cuts.append((begin, i))
                    begin = i
            prompts = [head + "\n" + "\n".join(f"{n}\t{t or ''}" for n, t in enumerate(items[a:b], 1)) for a, b in cuts]
            try:
                answers = provider.generate(prompts)
            except Exception:
                answers = [None] * len(prompts)
            reply = []
            for (a, b), answer in zip(cuts, answers, strict=True):
                got = objects(answer)
                reply += [None if got is None else json.dumps(got[n], ensure_ascii=False) if n in got else "" for n in range(1, b - a + 1)]
            yield pdf.drop(columns="_item").assign(reply=reply)

    line = F.regexp_replace(item, r"[\r\n\t]+", " ")
    ordered = rows.withColumn("_item", line).repartitionByRange(doc, at).sortWithinPartitions(doc, at)
    return ordered.mapInPandas(run, f"{schema}, reply string")


def typed_records(rows: DataFrame, content: str = "content", boilerplate: str = "heuristic") -> DataFrame:
    """rows with question_type, and without instructions (boilerplate heuristic; off keeps them)."""
    kept = rows.where(~is_instruction(F.col(content))) if boilerplate == "heuristic" else rows
    return kept.withColumn("question_type", record_type(F.col(content)))


def enriched(rows: DataFrame, points: str = "knowledge_points", level: str = "difficulty") -> DataFrame:
    return rows.withColumn(points, points_from_list(F.col(points))).withColumn(level, difficulty(F.col(level)))


def needs_enrichment(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, needed): whether any record of a document lacks knowledge points or has the default difficulty."""
    lacks = (F.coalesce(F.size("knowledge_points"), F.lit(0)) <= 0) | F.coalesce(F.col("difficulty"), F.lit(3)).eqNullSafe(3)
    return rows.groupBy(doc).agg(F.bool_or(lacks).alias("needed"))
