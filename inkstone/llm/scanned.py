"""Problem 1: text from scanned pages: page furniture, broken words and misread characters found and repaired."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import spread, written

#: Marks that scans leave at the end of a broken word.
MARKS = "-‐‑¬­"
#: What characters are misread as (left), and what they were (right).
IDEOGRAPHS = (
    "歹列 钱线 而面 干千 慨概 教数 万方 禺离 己已 圴均 武式 甪角 甬角 厎底 兀元 匡围 征证 枳积 戍成 羞差 虎虚 台合 囚四 叨切 勿物 拋抛 俏值 僮值 "
    "植值 逮速 又义 叉义 园圆 际标 巳已 末未 未末 土士 曰日 白自 目日 入人 太大 犬大 夭天 夫天 木本 术求 于干 贝见 开并 弟第 候侯 直真 折拆 盆盒 "
    "睛晴 侧测 测侧 陵棱 童量 重量 亟函 取最 泛范 顶项 和知 卒率 拒距 楕椭 由曲 田由 没设 苦若 右若 且旦 俞命 提题 隼集 疋定 用角 刑形 回面 休体 "
    "种积 髙高 迈边 卡长 申中 巾中 古点 左在 上土 么公 甩用 仵件 兵其 无元 毎每 钧均 戌成 位立 国围 买实 玉王 主王 今令 令今 牛午 午牛 拔投 投拔 "
    "柚抽 抽袖 坟坡 载截 栽裁 祖组 给结 洁结 径经 轻经 判到 刭到 列到 剁则 恒桓 桓恒 坐座 析折 哪那 徙徒 徒徙 析拆 便使 使便 待侍 特持 持特"
).split()
#: Letters that stand in numbers for digits.
FIGURES = {"O": "0", "o": "0", "l": "1", "I": "1", "Z": "2", "A": "4", "S": "5", "b": "6", "T": "7", "B": "8", "g": "9", "q": "9"}
#: What stands in words for letters.
LETTERS = {
    "0": ("o",), "1": ("i", "l"), "2": ("z",), "3": ("e",), "4": ("a",), "5": ("s",), "6": ("b",), "7": ("t",), "8": ("b",), "9": ("g",),
    "+": ("t",), "@": ("a",), "$": ("s",), "|": ("l", "i"), "!": ("l", "i"), "c": ("e",), "rn": ("m",), "ii": ("u", "n"), "li": ("h",), "cl": ("d",),
    "vv": ("w",),
}
#: Further readings that are tried in whole words only.
IN_WORDS = {"e": ("c",), "d": ("cl",), "m": ("rn",), "h": ("li", "b"), "u": ("ii",), "l": ("i",), "w": ("vv",)}
#: Stamps before a running title.
STAMPS = ("绝密", "机密", "秘密", "confidential", "secret")

#: Records a title must be in; least length of its letters and digits. A paper's further titles must be in more records, and
#: in this share of the paper's; of repeated lines that begin or end a page (beside a page number, or the record's first or last
#: line) each such place counts as a record more.
TITLE_RECORDS, TITLE_LENGTH = 2, 5
MORE_RECORDS, MORE_SHARE = 3, 0.3
#: Share of the papers whose titles have a piece, for it to tell titles.
COMMON_SHARE = 0.02
#: A reading must be this many times as frequent as the one on the page, and have at least this many places.
RATIO, PLACES = 6, 5
#: The ratio for ideographs: those that scans put in place of others are hardly ever meant.
RATIO_IDEOGRAPHS = 3

_PAGE = re.compile(
    r"^[-~·\[(|<\s]*(?:第\s*(\d{1,4})\s*页(?:\s*[/,]?\s*共\s*(\d{1,4})\s*页)?|(?:page|pg?\.?)\s*(\d{1,4})(?:\s*(?:of|/)\s*(\d{1,4}))?"
    r"|(\d{1,4})\s*(?:/|of)\s*(\d{1,4})|(\d{1,4}))[-~·\])|>\s]*$"
)
_TAIL = re.compile(r"(?:第\s*\d{1,4}\s*页(?:\s*/?\s*共\s*\d{1,4}\s*页)?|page\s*\d{1,4}(?:\s*of\s*\d{1,4})?|共\s*\d{1,4}\s*页|[-(\[·~]\s*\d{1,3}\s*[-)\]·~])\s*$")
_ENDS, _FRONT = re.compile(r"^[^\w(]+|[^\w)]+$"), re.compile(r"^[^\w(]+")
_BREAK = re.compile(r"([A-Za-z][A-Za-z0-9+@]*)([" + MARKS + r"])\s*$")
_WORD = re.compile(r"[A-Za-z0-9+@$|]*[A-Za-z][A-Za-z0-9+@$|]*")
_DIGIT = re.compile(r"\d|[①-⒛]")
_NUMBER = re.compile(r"[\d./]+")
_HAN = re.compile("[㐀-鿿豈-﫿]")


def split_lines(content: str) -> list[str]:
    """What stands between line feeds; a carriage return belongs to the break."""
    return [x[:-1] if x.endswith("\r") else x for x in content.split("\n")]


def title_key(line: str, tail: bool = False) -> str:
    """A line without page numbers (but with tail), stamps, spaces, decoration and case, to compare running titles by."""
    s = (line if line.isascii() else unicodedata.normalize("NFKC", line)).lower().strip()
    s = s if tail else _TAIL.sub("", s)
    s = _ENDS.sub("", "".join(s.split()))
    for stamp in STAMPS:
        s = s.removeprefix(stamp)
    return _FRONT.sub("", s)


def title_keys(line: str) -> tuple[str, ...]:
    """title_key without a page number at the end, and with it where there is one."""
    key = title_key(line)
    return (key, title_key(line, tail=True)) if _TAIL.search(unicodedata.normalize("NFKC", line).lower().strip()) else (key,)


def distance_within(title: str, line: str) -> int:
    """Edits from title to the part of line that is nearest to it."""
    row = [0] * (len(line) + 1)
    for i, x in enumerate(title, 1):
        left, new = i, [i]
        for j, y in enumerate(line, 1):
            left = min(row[j] + 1, left + 1, row[j - 1] + (x != y))
            new.append(left)
        row = new
    return min(row)


def is_title(line: str, title: str, keys: tuple[str, ...] | None = None) -> bool:
    """Whether the whole line is the title, perhaps with a fifth of its characters damaged and a number or stamp added."""
    for key in keys or title_keys(line):
        if not key or abs(len(key) - len(title)) > max(3, len(title) // 4):
            continue
        most = max(2, len(title) // 5)
        # a title's characters that the line hasn't got are edits, so most lines need no table
        if key == title or (sum((Counter(title) - Counter(key)).values()) <= most and distance_within(title, key) <= most):
            return True
    return False


def pieces(key: str) -> set[str]:
    """Runs of four characters, digits alike."""
    key = re.sub(r"\d", "0", key)
    return {key[i : i + 4] for i in range(len(key) - 3)}


def is_like_titles(line: str, common: frozenset[str]) -> bool:
    """Whether a line consists for the most part of what the titles of other papers have in common."""
    key = title_key(line, tail=True)
    own = pieces(key)
    return len(key) >= 8 and len(own & common) >= max(4, 0.55 * len(own))


def page_mark(line: str) -> tuple[int, bool] | None:
    """The number of a line that can only tell the page, and whether it is bare."""
    if not _DIGIT.search(line):
        return None
    s = unicodedata.normalize("NFKC", line).lower().strip()
    s = re.sub("[—–―−‐]", "-", s).replace("〜", "~")
    m = _PAGE.match(s)
    if not m or re.fullmatch(r"-\s*\d+|\d+\s*-", s):
        return None
    total = next((int(g) for g in (m[2], m[4], m[6]) if g), None)
    value = next(int(g) for g in (m[1], m[3], m[5], m[7]) if g)
    return None if total is not None and value > total else (value, s.isdigit())


def furniture(lines: list[str], page_no: int | None, titles: list[str], common: frozenset[str] = frozenset()) -> dict[int, str]:
    """Kinds of the lines, from 0, that are page furniture.

    The first page number must be page_no or the next, each further one the next after it. A bare number counts only where
    page_no is known, and not at the end of the text, unless it is indented or beside a title; nor does a fraction there
    that ends a list of options.
    """
    kind = {}
    for i, x in enumerate(lines):
        if titles:
            keys = title_keys(x)
            if any(is_title(x, t, keys) for t in titles):
                kind[i] = "header"
        elif common and is_like_titles(x, common):
            kind[i] = "header"
    marks = {i: m for i, x in enumerate(lines) if i not in kind and (m := page_mark(x))}
    last, seen, plain = page_no, False, [i for i, x in enumerate(lines) if x.strip() and i not in kind]
    for i in sorted(marks):
        value, bare = marks[i]
        if last is None:
            if bare:
                continue
        elif value != last + 1 and (seen or value != last):
            continue
        at_end = plain[-1] == i and lines[i] == lines[i].strip() and not ({i - 1, i + 1} & kind.keys())
        if at_end and (bare or (re.fullmatch(r"\d+\s*/\s*\d+", lines[i]) and i and re.search(r"[A-D][．.、:：]\s*[\d√/]*\s*$", lines[i - 1]))):
            continue
        kind[i], last, seen = "page_number", value, True
    return kind


def parsed_records(rows: DataFrame, id_col: str, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """(rec, doc, page, content, titles): records with content and the running titles of their paper, as far as they are found.

    A title is a line that repeats over records of one paper and not over papers, the more so at the edges of pages. The
    best one is a paper's title; others, as a footer beside a header, are as well if they are in MORE_RECORDS and
    MORE_SHARE of the paper's records. Counts of lines by paper are added up by batch, so a paper of any size sends one row
    a line and batch; the titles, a few a paper, are joined back.
    """
    base = spread(rows.select(
        F.col(id_col).cast("bigint").alias("rec"), F.col(doc_col).cast("string").alias("doc"), F.col(page_col).cast("int").alias("page"),
        F.col(text_col).cast("string").alias("content"),
    ).where("rec is not null and trim(content) != ''"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tally: Counter[tuple[str, str]] = Counter()
            edge: Counter[tuple[str, str]] = Counter()
            records: Counter[str] = Counter(pdf["doc"])
            for doc, content in zip(pdf["doc"], pdf["content"], strict=True):
                lines = [x for x in split_lines(content) if x.strip()]
                marks = {i for i, x in enumerate(lines) if page_mark(x)}
                ends = {0, len(lines) - 1} | {i + k for i in marks for k in (-1, 1)}
                keys: dict[str, bool] = {}
                for i, x in enumerate(lines):
                    k = title_key(x)
                    keys[k] = keys.get(k, False) or i in ends
                for k, at in keys.items():
                    if sum(map(str.isalnum, k)) >= TITLE_LENGTH and not _NUMBER.fullmatch(k):
                        tally[doc, k] += 1
                        edge[doc, k] += at
            rows = [(*k, n, edge[k], 0) for k, n in tally.items()] + [(doc, "", 0, 0, n) for doc, n in records.items()]
            yield pd.DataFrame(rows, columns=["doc", "key", "n", "edge", "records"])

    n = base.where("doc is not null").select("doc", "content").mapInPandas(count, "doc string, key string, n bigint, edge bigint, records bigint")
    n = n.groupBy("doc", "key").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.sum("records").alias("records"))
    n = written(n.where(F.expr(f"n >= {TITLE_RECORDS} or key = ''")), "lines")
    size = n.where("key = ''").select("doc", "records")
    n = n.where("key != ''").drop("records")
    spread_ = n.groupBy("key").agg(F.count("*").alias("docs"))
    n = n.join(spread_, "key").withColumn("score", F.struct(F.col("n") / F.col("docs"), F.length("key"), "key"))
    best = n.groupBy("doc").agg(F.max("score").alias("best")).join(size, "doc")
    more = (F.col("n") / F.col("docs") >= MORE_RECORDS) & (F.col("n") + F.col("edge") >= MORE_SHARE * 2 * F.col("records"))
    title = n.join(best, "doc").where((F.col("score") == F.col("best")) | more).groupBy("doc").agg(F.array_sort(F.collect_list("key")).alias("titles"), F.max("best.key").alias("title"))
    title = written(title, "titles")
    papers = title.count()
    # pieces in a share of all titles: at most the pieces of a title over that share, whatever the number of titles

    @F.pandas_udf("array<string>")
    def cut(titles: pd.Series) -> pd.Series:
        return pd.Series([list(pieces(t)) for t in titles], dtype=object)

    common = title.select(F.explode(cut("title")).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    common = frozenset(r["piece"] for r in common.where(F.col("n") >= max(3, papers * COMMON_SHARE)).collect())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, kind = [], []
            for page, content, titles in zip(pdf["page"], pdf["content"], pdf["titles"], strict=True):
                found = furniture(split_lines(content), None if pd.isna(page) else int(page), list(titles) if titles is not None else [], common)
                at.append(list(found))
                kind.append(list(found.values()))
            yield pdf[["rec", "content"]].assign(at=at, kind=kind)

    return base.join(title.select("doc", "titles"), "doc", "left").mapInPandas(parse, "rec bigint, content string, at array<int>, kind array<string>")


class Page:
    """A record's lines by kind, and its question text as one run with the line of each character."""

    def __init__(self, content: str, kind: dict[int, str]) -> None:
        self.lines, self.kind = split_lines(content), kind
        self.text = [i for i, x in enumerate(self.lines) if i not in self.kind and x.strip()]
        joined = "".join(self.lines[i] for i in self.text)
        self.han = len(_HAN.findall(joined)) * 10 > len(joined)

    def breaks(self) -> list[tuple[int, str, str, str]]:
        """(line, left part, mark, right part) of words that go on in the next line of question text."""
        out = []
        for i, j in zip(self.text, self.text[1:], strict=False):
            left, right = _BREAK.search(self.lines[i]), _WORD.match(self.lines[j].lstrip())
            if left and right and len(left[1]) > 1 and (right[0][0].isalpha() or right[0][0] in "+@"):
                out.append((i, left[1], left[2], right[0]))
        return out

    def run(self, whole: set[int] | None = None) -> tuple[str, list[int]]:
        """The text of all lines, and the line of each character. Broken words are joined without the mark, but for the
        lines of whole, where the mark is the word's own."""
        chars, at = [], []
        ends = {i for i, *_ in self.breaks()}
        for n, i in enumerate(self.text):
            x = self.lines[i].strip("　 \t")
            if i in ends:
                x = x.rstrip()
                x = x[:-1] + "-" if whole and i in whole else x[:-1]
            elif not self.han and n + 1 < len(self.text):
                x += " "
            chars.append(x)
            at += [i] * len(x)
        return "".join(chars), at


_SHAPE = {i: "0" for i in range(48, 58)} | {i: "A" for i in range(65, 91)} | {i: " " for i in range(0x3001) if chr(i).isspace()}


def shape(text: str) -> str:
    """text for counting: digits as 0, capitals as A, all spaces alike."""
    return text.translate(_SHAPE)


def suspects(text: str) -> list[tuple[int, str, str]]:
    """(place, seen, meant) of characters that may be misread, by the fixed tables."""
    out = []
    for m in _SUSPECT.finditer(text):
        i, ch = m.start(), m[0]
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if ch in _BY_SEEN:
            out += [(i, ch, m) for m in _BY_SEEN[ch]]
        if ch in FIGURES:
            sides = before.isdigit() + after.isdigit()
            if sides == 2 or (sides == 1 and ch in "lIOoZS" and not (before + after).isascii()) or (ch in "lIO" and not sides and before > "⺀" and after > "⺀"):
                out.append((i, ch, "0"))
        if ch in LETTERS and ((before.isascii() and before.isalpha()) or (after.isascii() and after.islower())):
            out += [(i, ch, m) for m in LETTERS[ch]]
        if ch == "i" == after and before.isascii() and before.isalpha():  # other pairs are too frequent in names
            out.append((i, "ii", "u"))
    return out


_BY_SEEN: dict[str, str] = {}
for _pair in IDEOGRAPHS:
    _BY_SEEN[_pair[0]] = _BY_SEEN.get(_pair[0], "") + _pair[1]
_LIKELY = {ord(c): m[0] for c, m in _BY_SEEN.items()}
_SUSPECT = re.compile("[" + re.escape("".join({*_BY_SEEN, *FIGURES, *(x for x in LETTERS if len(x) == 1), "i"})) + "]")


def context(text: str, i: int, seen: str) -> str:
    """Two characters, what is seen, two characters, as shapes; spaces stand beyond the ends."""
    padded = shape("  " + text[max(0, i - 2) : i])[-2:] + shape(seen) + shape(text[i + len(seen) : i + len(seen) + 2] + "  ")[:2]
    return padded


def readings(word: str, most: int = 2) -> set[str]:
    """What a word may have been: with up to `most` places read otherwise, at most one of them by IN_WORDS."""
    likely = [(i, s, m) for i in range(len(word)) for s in dict.fromkeys((word[i], word[i : i + 2])) for m in LETTERS.get(s, ())]
    other = [(i, s, m) for i, s in enumerate(word) for m in IN_WORDS.get(s, ())]
    out = set()
    for k in range(1, most + 1):
        for chosen in combinations(sorted(likely + other), k):
            if k > 1 and sum(c in other for c in chosen) > 1:
                continue
            if all(a[0] + len(a[1]) <= b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                s, at = "", 0
                for i, seen, meant in chosen:
                    s, at = s + word[at:i] + meant, i + len(seen)
                out.add(s + word[at:])
    return {x for x in out if x.isalpha()}


def _words(page: Page) -> Iterator[tuple[str, str]]:
    """(kind, word) of the words of a page that aren't broken: w for words, h for hyphenated ones."""
    text, _ = page.run()
    for m in re.finditer(r"[A-Za-z]+(?:-[A-Za-z]+)*", text):
        w = m[0].lower()
        yield from [("h", w)] if "-" in w else []
        yield from (("w", part) for part in w.split("-"))


def _records(pdf: pd.DataFrame) -> Iterator[tuple[int, Page]]:
    for rec, content, at, kind in zip(pdf["rec"], pdf["content"], pdf["at"], pdf["kind"], strict=True):
        yield rec, Page(content, dict(zip(at, kind, strict=True)))


def _vocabulary(parsed: DataFrame) -> DataFrame:
    """(kind, key, n): words, hyphenated words, and runs of three shapes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tally: Counter[tuple[str, str]] = Counter()
            for _, page in _records(pdf):
                tally.update(_words(page))
                text = shape("  " + page.run()[0] + "  ")
                tally.update(("g", text[i : i + 3]) for i in range(len(text) - 2))
            yield pd.DataFrame([(*k, n) for k, n in tally.items()], columns=["kind", "key", "n"])

    return parsed.mapInPandas(count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _questions(parsed: DataFrame) -> DataFrame:
    """What the vocabulary has to decide, a row each: (rec, line, place, what, seen, meant, a, b).

    what: hyphen (a: left part, b: right part), word (a word seen), place (a: context, meant: what it may have been).
    place is the character's in the record's run.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec, page in _records(pdf):
                for i, left, mark, right in page.breaks():
                    out.append((rec, i, -1, "hyphen", mark, "", left.lower(), right.lower()))
                text, at = page.run()
                taken = set()
                for m in _WORD.finditer(text):
                    w = m[0]
                    odd = re.search(r"[0-9+@$|]", w)
                    if odd and len(w) >= 3 and re.search(r"[a-z]{2}", w) and not re.fullmatch(r"\d+[a-z]+", w) or re.fullmatch(r"[A-Za-z][a-z]{3,}", w):
                        lines = at[m.start() : m.end()]
                        second = next((k for k, i in enumerate(lines) if i != lines[0]), len(w))
                        out.append((rec, lines[0], m.start(), "word", w, "", w, f"{lines[-1]}:{second}"))
                        if not odd and w.islower():
                            taken.update(range(*m.span()))
                likely = text.translate(_LIKELY)
                for i, seen, meant in suspects(text):
                    if i not in taken:
                        near = {context(text, i, seen)} | ({context(likely[:i] + seen + likely[i + 1 :], i, seen)} if seen in _BY_SEEN else set())
                        out += [(rec, at[i], i, "place", seen, meant, a, "") for a in near]
            yield pd.DataFrame(out, columns=["rec", "line", "place", "what", "seen", "meant", "a", "b"])

    return parsed.mapInPandas(ask, "rec bigint, line int, place int, what string, seen string, meant string, a string, b string")


def _hyphens(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(a, b, seen, own): whether the mark between two parts of a word is the word's own: where the corpus has the word with
    a hyphen more often than without, or, if it has neither, where it hyphenates words that begin or end with the part."""
    n = lambda kind, key, name: vocabulary.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("n").alias(name))
    h = vocabulary.where("kind = 'h'").select("key", "n")
    part = lambda i, key, name: h.groupBy(F.element_at(F.split("key", "-"), i).alias(key)).agg(F.sum("n").alias(name))
    pairs = asked.where("what = 'hyphen'").select("a", "b", "seen").distinct()
    pairs = pairs.withColumn("whole", F.concat("a", "b")).withColumn("split", F.concat_ws("-", "a", "b"))
    pairs = pairs.join(n("w", "whole", "n_whole"), "whole", "left").join(n("h", "split", "n_split"), "split", "left")
    pairs = pairs.join(part(1, "a", "n_first"), "a", "left").join(part(-1, "b", "n_last"), "b", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    known = (z("n_split") > 0) | (z("n_whole") > 0)
    # joined parts are in the vocabulary as often as they are broken here, so a lone joined form says little
    damaged = F.col("b").rlike("[0-9+@$|]")
    own = F.when(known & (z("n_split") > 0), z("n_split") * 2 >= z("n_whole")).otherwise((z("n_whole") < PLACES) & (z("n_first") >= PLACES) & ((z("n_last") >= PLACES) | damaged))
    return pairs.select("a", "b", "seen", own.alias("own"))


def _misread_words(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(a, word): words seen that are far rarer than what they may have been, with the most frequent of those."""

    def vary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(a, n, x) for a, n in zip(pdf["a"], pdf["n"], strict=True) for x in readings(a.lower())], columns=["a", "n", "word"])

    seen = asked.where("what = 'word'").groupBy("a").agg(F.count("*").alias("n"))
    word = vocabulary.where("kind = 'w'").select(F.col("key").alias("word"), F.col("n").alias("n_word"))
    own = word.select(F.col("word").alias("low"), F.col("n_word").alias("n_own"))
    seen = seen.withColumn("low", F.lower("a")).join(own, "low", "left").select("a", F.greatest("n", F.coalesce("n_own", F.lit(0))).alias("n"))
    found = seen.mapInPandas(vary, "a string, n bigint, word string").join(word, "word")
    odd = F.col("a").rlike("[0-9+@$|]")
    found = found.where((F.col("n_word") >= F.when(odd, 1).otherwise(PLACES)) & (odd | (F.col("n_word") >= RATIO * F.col("n"))))
    return found.groupBy("a").agg(F.max_by("word", F.struct("n_word", "word")).alias("word"))


def _misread_places(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(a, seen, meant): contexts in which another reading is far more frequent in the corpus."""
    gram = vocabulary.where("kind = 'g'").select("key", "n")
    ctx = asked.where("what = 'place'").select("a", "seen", "meant").distinct()
    left, right, one = F.substring("a", 1, 2), F.substring(F.col("a"), -2, 2), F.expr("translate(seen, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'AAAAAAAAAAAAAAAAAAAAAAAAAA000000000')")
    k = lambda mid: F.array(F.concat(left, mid), F.concat(F.substring(left, 2, 1), mid, F.substring(right, 1, 1)), F.concat(mid, right))
    ask = ctx.select("a", "seen", "meant", F.posexplode(F.arrays_zip(k(one).alias("s"), k(F.col("meant")).alias("m"))).alias("k", "key"))
    ask = ask.select("a", "seen", "meant", "k", F.col("key.s").alias("ks"), F.col("key.m").alias("km"))
    ask = ask.join(gram.select(F.col("key").alias("ks"), F.col("n").alias("ns")), "ks", "left").join(gram.select(F.col("key").alias("km"), F.col("n").alias("nm")), "km", "left")
    ask = ask.withColumn("ns", F.coalesce("ns", F.lit(0))).withColumn("nm", F.coalesce("nm", F.lit(0)))
    ratio = F.when(F.col("seen") >= "⺀", RATIO_IDEOGRAPHS).otherwise(RATIO)
    for_it = (F.col("nm") >= PLACES) & (F.col("nm") >= ratio * F.col("ns"))
    against = (F.col("ns") >= F.when(F.col("seen") >= "⺀", 3).otherwise(2)) & (F.col("ns") > F.col("nm"))
    sums = ask.groupBy("a", "seen", "meant").agg(F.max(for_it).alias("pro"), F.max(against).alias("con"), F.sum("nm").alias("nm"))
    return sums.where("pro and not con").groupBy("a", "seen").agg(F.max_by("meant", F.struct("nm", "meant")).alias("meant"))


def decided(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rec, line, place, kind, seen, meant) twice: of broken words (kind hyphen; own if the mark is the word's own), and of
    misread words and characters."""

    def lines_of_one(line: int, b: str, seen: str, word: str) -> list[int]:
        """Of a word over two lines, those with characters that were read otherwise. b: last line and where it begins."""
        last, second = map(int, b.split(":"))
        low, same = seen.lower(), lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        begin, end = same(low, word), len(low) - same(low[::-1], word[::-1])
        return ([line] if begin < second else []) + ([last] if last != line and end > second else [])

    @F.pandas_udf("array<int>")
    def lines_of(line: pd.Series, b: pd.Series, seen: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([lines_of_one(*x) for x in zip(line, b, seen, word, strict=True)], dtype=object)

    vocabulary = written(_vocabulary(parsed), "vocabulary")
    asked = written(_questions(parsed), "asked")
    hyphen = asked.where("what = 'hyphen'").join(_hyphens(asked, vocabulary), ["a", "b", "seen"])
    hyphen = hyphen.select("rec", "line", "place", F.when(F.col("own"), "own").otherwise("hyphen").alias("kind"), "seen", F.lit("").alias("meant"))
    words = asked.where("what = 'word'").join(_misread_words(asked, vocabulary), "a")
    words = words.select("rec", F.explode(lines_of("line", "b", "seen", "word")).alias("line"), "place", F.lit("misread").alias("kind"), "seen", F.col("word").alias("meant"))
    places = asked.where("what = 'place'").drop("meant").dropDuplicates(["rec", "place", "seen", "a"]).join(_misread_places(asked, vocabulary), ["a", "seen"])
    places = places.groupBy("rec", "line", "place", "seen").agg(F.max("meant").alias("meant"))
    places = places.select("rec", "line", "place", F.lit("misread").alias("kind"), "seen", "meant")
    return hyphen, words.unionByName(places)


def _parse(rows: DataFrame, id_col: str, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    return written(parsed_records(rows, id_col, doc_col, page_col, text_col), "scanned")


def noise(rows: DataFrame, id_col: str = "rec_id", doc_col: str = "doc_hash", page_col: str = "page_no", text_col: str = "content") -> DataFrame:
    """(id_col, line_no, kind): a row per line and kind of noise: header, page_number, hyphen, misread. Lines count from 1.

    Records with NULL or blank content give no row; those with NULL paper have no title, those with NULL page no bare page
    numbers. Repeated rows count as one. Other columns are ignored, whatever their names.
    """
    parsed = _parse(rows, id_col, doc_col, page_col, text_col)

    hyphen, misread = decided(parsed)
    out = parsed.select("rec", F.explode(F.arrays_zip(F.col("at").alias("line"), F.col("kind").alias("kind"))).alias("k")).select("rec", "k.line", "k.kind")
    out = out.unionByName(hyphen.where("kind = 'hyphen'").select("rec", "line", "kind")).unionByName(misread.select("rec", "line", "kind"))
    return out.select(F.col("rec").alias(id_col), (F.col("line") + 1).cast("bigint").alias("line_no"), "kind").distinct()


def repaired(rows: DataFrame, id_col: str = "rec_id", doc_col: str = "doc_hash", page_col: str = "page_no", text_col: str = "content") -> DataFrame:
    """(id_col, text): each record's question text as one continuous run, without page furniture, with broken words joined
    and misread characters replaced. NULL for NULL content, empty for blank content. Ids are taken as unique."""
    parsed = _parse(rows, id_col, doc_col, page_col, text_col)
    hyphen, misread = decided(parsed)
    own = hyphen.where("kind = 'own'").groupBy("rec").agg(F.collect_set("line").alias("own"))
    fix = misread.groupBy("rec").agg(F.collect_set(F.struct("place", "seen", "meant")).alias("fix"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (rec, page), own_, fix_ in zip(_records(pdf), pdf["own"], pdf["fix"], strict=True):
                text, at = page.run()
                edits = sorted(((f["place"], f["seen"], f["meant"]) for f in (fix_ if fix_ is not None else ())), key=lambda f: (f[0], -len(f[1])))
                keep = {at.index(i) + sum(a == i for a in at) for i in (own_ if own_ is not None else ()) if i in at}
                parts, last = [], 0
                marks = sorted([(p, s, m) for p, s, m in edits] + [(p, "", "-") for p in keep])
                for place, seen, meant in marks:
                    if place >= last:
                        word = meant if len(seen) < 2 or not seen[:1].isupper() else meant.capitalize()
                        parts += [text[last:place], word]
                        last = place + len(seen)
                out.append((rec, "".join([*parts, text[last:]])))
            yield pd.DataFrame(out, columns=["rec", "text"])

    full = parsed.join(own, "rec", "left").join(fix, "rec", "left").mapInPandas(render, "rec bigint, text string")
    ids = rows.select(F.col(id_col).cast("bigint").alias("rec"), F.when(F.col(text_col).isNotNull(), "").alias("blank"))
    return ids.join(full, "rec", "left").select(F.col("rec").alias(id_col), F.coalesce("text", "blank").alias("text"))
