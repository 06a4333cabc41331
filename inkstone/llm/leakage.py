"""Problem 7: passages of evaluation items in training texts, by one Aho-Corasick automaton."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.text import letters_digits
from inkstone.session import in_blocks, spread

#: Item text that goes into one automaton; beyond it, the items are taken in blocks, each with a scan of its own.
BLOCK_CHARS = 4_000_000


def origin(text: str) -> list[int]:
    """For each character of letters_digits(text), the place in text of the character it comes from.

    A base and the marks after it are normalised together. Where that differs from the normal form of the whole text
    (rare compositions over more characters), the last place found stands for the rest.
    """
    out, at, n = [], 0, len(text)
    while at < n:
        end = at + 1
        while end < n and (unicodedata.combining(text[end]) or unicodedata.category(text[end]) in ("Mn", "Mc")):
            end += 1
        out += [at] * len(letters_digits(text[at:end]))
        at = end
    want = len(letters_digits(text))
    return (out + [out[-1] if out else 0] * (want - len(out)))[:want]


def _seeds(items: dict[int, str], min_len: int) -> tuple[object, int]:
    """Automaton over item pieces: any run of min_len characters of an item holds a whole piece."""
    import ahocorasick

    width = max(1, min_len * 3 // 5)
    step = min_len - width + 1
    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for item, norm in items.items():
        if len(norm) >= min_len:
            for at in range(0, len(norm) - width + 1, step):
                where[norm[at : at + width]].append((item, at))
    found = ahocorasick.Automaton()
    for piece, places in where.items():
        found.add_word(piece, tuple(places))
    if where:
        found.make_automaton()
    return found if where else None, width


def _matches(norm: str, automaton: object, width: int, items: dict[int, str], min_len: int) -> dict[int, list[tuple[int, int]]]:
    """By item, the maximal runs (begin, end) of norm which the item has too."""
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    done: dict[tuple[int, int], int] = {}  # by item and diagonal: the end of the run that was seen last
    for last, places in automaton.iter(norm):
        first = last - width + 1
        for item, at in places:
            if done.get((item, first - at), -1) > first:
                continue
            text = items[item]
            a, b = first, at
            while a and b and norm[a - 1] == text[b - 1]:
                a, b = a - 1, b - 1
            x, y = last + 1, at + width
            while x < len(norm) and y < len(text) and norm[x] == text[y]:
                x, y = x + 1, y + 1
            done[item, first - at] = x
            if x - a >= min_len:
                out[item].append((a, x))
    return out


def leaked_spans(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = "answer",
    min_len: int = 40, block_chars: int = BLOCK_CHARS, places: bool = True,
) -> DataFrame:
    """(id_col, item_id_col, part, start_pos, end_pos): maximal runs of min_len characters or more that a document and an
    item share, both in NFKC, lower case, letters and digits only. part is text or answer (answers under min_len can't
    match). Positions are those of the document's own text, from 1, both ends included; NULL with places=False.

    The items pass through the driver in blocks of block_chars; each block is one automaton, sent to all tasks, and a scan of
    the documents. Of several blocks one is in memory at a time, at any number of items. Documents aren't shuffled. NULL, empty and
    short texts match nothing; repeated rows give repeated results; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = [(item_text_col, "text")] + ([(answer_col, "answer")] if answer_col and answer_col in items.columns else [])
    base = spread(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0))
    schema = f"`{id_col}` bigint, `{item_id_col}` bigint, part string, start_pos bigint, end_pos bigint"

    def scan(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            texts = {k: v[2] for k, v in sent.value.items()}
            automaton, width = _seeds(texts, min_len)
            for pdf in batches if automaton else ():
                rows = []
                for id_, text in zip(pdf["id"], pdf["text"], strict=True):
                    norm = letters_digits(text)
                    if len(norm) < min_len:
                        continue
                    if found := _matches(norm, automaton, width, texts, min_len):
                        back = origin(text) if places else None
                        for k, runs in found.items():
                            item, part, _ = sent.value[k]
                            rows += [(id_, item, part, back[a] + 1 if back else None, back[b - 1] + 1 if back else None) for a, b in sorted(set(runs))]
                yield pd.DataFrame(rows, columns=[id_col, item_id_col, "part", "start_pos", "end_pos"]).astype({"start_pos": "Int64", "end_pos": "Int64"})

        return base.mapInPandas(run, schema)

    wanted = items.select(F.col(item_id_col).cast("bigint").alias("item"), *[F.col(c).cast("string").alias(name) for c, name in parts])

    def blocks() -> Iterator[dict[int, tuple[int, str, str]]]:
        block, size = {}, 0
        for row in wanted.toLocalIterator():
            for _, part in parts:
                norm = letters_digits(row[part] or "")
                if row["item"] is None or len(norm) < min_len:
                    continue
                if size + len(norm) > block_chars and block:
                    yield block
                    block, size = {}, 0
                block[len(block)] = (row["item"], part, norm)
                size += len(norm)
        if block:
            yield block

    found = in_blocks(spark, blocks(), scan)
    return spark.createDataFrame([], schema) if found is None else found


def leaked(docs: DataFrame, items: DataFrame, min_len: int = 40) -> DataFrame:
    """(doc_id, item_id): documents that share at least min_len consecutive normal-form characters with an item's text. Answers
    are patterns of the same automaton; what matches only them is in leaked_spans."""
    spans = leaked_spans(docs, items, min_len=min_len)
    return spans.where("part = 'text'").select("doc_id", "item_id").distinct()
