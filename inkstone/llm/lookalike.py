"""Problem 4: one form for texts that look the same, by script-aware repair against the corpus vocabulary."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import spread, written

#: Letters of other scripts with the shape of a Latin letter.
LETTERS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Օ": "O", "օ": "o", "ɡ": "g", "ɑ": "a",
}
#: Signs with the shape of a sign of another block.
SIGNS = {
    "⋅": "·", "∙": "·", "‧": "·", "·": "·", "・": "·", "∶": ":", "꞉": ":", "∣": "|", "ǀ": "|", "∕": "/", "⁄": "/", "∗": "*",
    "∼": "~", "〜": "~", "˜": "~", "ˆ": "^", "‖": "∥", "⟂": "⊥", "∆": "Δ", "∑": "Σ", "∏": "Π", "µ": "μ", "˚": "°", "⁎": "*",
}
#: Radicals with the shape of an ideograph (the Kangxi radicals have theirs in the character database).
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺌": "小", "⺍": "小", "⺎": "兀", "⺒": "巳",
    "⺓": "幺", "⺔": "彑", "⺖": "忄", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺝": "月", "⺞": "歺", "⺟": "母", "⺠": "民", "⺡": "氵",
    "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺬": "示", "⺭": "礻", "⺯": "糹",
    "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺶": "羊", "⺹": "耂", "⺺": "肀", "⺼": "月", "⺾": "艹", "⻂": "衤", "⻃": "覀", "⻄": "西",
    "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸",
    "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠",
    "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉",
    "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}
#: Dashes and minus signs, all of which become a hyphen.
DASHES = "‐‑‒–—―−﹘﹣－⁃˗⸺⸻"
#: Characters besides those of category Cf that print nothing.
SILENT = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]

TWINS = frozenset(LETTERS.values())

LATIN, OTHER = "Latin", "other"
_OTHER = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
#: Runs of letters of the alphabets, with their marks.
_TOKEN = regex.compile(rf"[\p{{L}}--{_OTHER}][[\p{{L}}--{_OTHER}]\p{{M}}]*", regex.V1)


@cache
def shapes() -> dict[int, str]:
    """What each character that has a plainer twin of its looks becomes: width forms, spaces, dashes, silent characters,
    radicals, Roman numerals, ligatures and signs. Raised, lowered and circled characters stay as they are."""
    out: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            out[cp] = " "
        elif kind == "Cf" or (kind == "Cc" and not ch.isspace()):
            out[cp] = ""
        elif (d := unicodedata.decomposition(ch)).startswith(("<wide>", "<narrow>")) or (
            d.startswith("<compat>") and (0x2F00 <= cp < 0x2FE0 or cp in (0x2E9F, 0x2EF3) or 0x2160 <= cp < 0x2180 or 0xFB00 <= cp < 0xFB07)
        ):
            out[cp] = "".join(chr(int(x, 16)) for x in d.split()[1:])
    out |= {cp: "" for cp in SILENT} | {ord(a): b for a, b in (SIGNS | RADICALS).items()} | {ord(x): "-" for x in DASHES}
    out |= {0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
    for cp, s in out.items():  # a width form of a dash, and the like
        out[cp] = "".join(out.get(ord(c), c) for c in s)
    return out


@cache
def letters() -> dict[int, str]:
    return {ord(a): b for a, b in LETTERS.items()}


def plain(text: str) -> str:
    """text without what can't be seen, in single characters where those exist; letters keep their script, but for the letter
    that looks like a digit, which becomes the digit."""
    if text.isascii() and "\r" not in text and text.isprintable():
        return text
    text = unicodedata.normalize("NFD", text.translate(shapes())).replace("\r\n", "\n")
    return unicodedata.normalize("NFC", text.replace("З", "3"))


def look(word: str) -> str:
    """A word with each look-alike letter as its Latin twin: the same for all words that look the same."""
    return word if word.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(letters()))


@cache
def script(ch: str) -> str:
    """The script of a letter, from its name; one for all ideographs."""
    if ch < "\x80":
        return LATIN
    name = unicodedata.name(ch, "").split(" ")[0]
    return {"LATIN": LATIN, "GREEK": "Greek", "CYRILLIC": "Cyrillic", "ARMENIAN": "Armenian", "CJK": "Han"}.get(name, OTHER)


def words(text: str) -> list[str]:
    """Runs of letters, with their marks, of the alphabets that have look-alikes; ideographs divide words."""
    return _TOKEN.findall(text)


@cache
def twins() -> dict[str, dict[int, str]]:
    """By script, what letters of the others become in it, where it has one of the same looks; the first listed of several."""
    out: dict[str, dict[int, str]] = {}
    for name in {script(ch) for ch in LETTERS} | {LATIN}:
        own = {twin: twin for twin in TWINS} if name == LATIN else {}
        for ch, twin in LETTERS.items():
            if script(ch) == name:
                own.setdefault(twin, ch)
        table = {ord(ch): own[twin] for ch, twin in LETTERS.items() if twin in own and script(ch) != name}
        out[name] = table | {ord(twin): ch for twin, ch in own.items() if name != LATIN}
    return out


def repaired(word: str) -> str | None:
    """A word of mixed scripts in its dominant one; None if it isn't mixed, or stays mixed because a letter has no twin there."""
    name, mixed = dominant(word)
    if not mixed:
        return None
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(twins().get(name, {})))
    return None if dominant(out)[1] else out


def dominant(word: str) -> tuple[str, bool]:
    """The script of most letters that have no twin in another script (of all letters, if each has one; Latin first in a
    tie), and whether the word mixes scripts."""
    scripts = {script(ch) for ch in word if ch.isalpha()}
    plain_ = [script(ch) for ch in word if ch.isalpha() and ch not in LETTERS and ch not in TWINS] or [script(ch) for ch in word if ch.isalpha()]
    return max(scripts, key=lambda s: (plain_.count(s), s == LATIN, s), default=LATIN), len(scripts) > 1


def spellings(vocabulary: DataFrame) -> DataFrame:
    """(word, spelling) of a vocabulary (word, n): the words that are to be spelled otherwise.

    First the repair by script: a word that mixes scripts is put in its dominant one, if the result is in the vocabulary. Then
    the equivalence of what looks the same all the same, which the script of a word can't decide (a lone А and a lone A, a
    mixed word that the vocabulary hasn't got): words of equal looks, repaired or not, get the spelling that most of them
    have in a single script, Latin if any has it, and Latin if none is in a single script.
    """

    def analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(wish=[repaired(w) for w in pdf["word"]], look=[look(w) for w in pdf["word"]], mixed=[dominant(w)[1] for w in pdf["word"]])

    seen = written(vocabulary.mapInPandas(analyse, "word string, n bigint, wish string, look string, mixed boolean"), "words")
    known = seen.select(F.col("word").alias("wish"), F.lit(True).alias("known"))
    seen = seen.join(known, "wish", "left").withColumn("repaired", F.when(F.col("known"), F.col("wish")))
    # words as they are after the repair
    after = seen.select("word", "look", "n", F.coalesce("repaired", "word").alias("as"), (F.col("mixed") & F.col("repaired").isNull()).alias("mixed"))
    n = after.where("not mixed").groupBy("look", "as").agg(F.sum("n").alias("n"))
    best = n.groupBy("look").agg(F.max_by("as", F.struct(F.expr("as = look"), "n", "as")).alias("spelling"))
    out = after.join(best, "look", "left").select("word", F.coalesce("spelling", "look").alias("spelling"))
    return out.where("word != spelling")


def one_form(rows: DataFrame, id_col: str = "row_id", text_col: str = "content") -> DataFrame:
    """(id_col, text, form): texts that look the same have the same form, others another one. form is NULL for NULL.

    Invisible characters, width forms, spaces, dashes, accents and signs get one form everywhere. Letters go by word, by
    spellings, with the vocabulary of all rows. Case, raised and circled digits and different punctuation marks keep their
    differences. Other columns are ignored, whatever their names; repeated rows give repeated results, rows with NULL id
    are kept.
    """
    base = spread(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            form = [None if t is None else plain(t) for t in pdf["text"]]
            used = [[] if t is None else list(words(t)) for t in form]
            yield pdf.assign(form=form, words=used)

    read_ = written(base.mapInPandas(read, "id bigint, text string, form string, words array<string>"), "read")
    vocabulary = read_.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    best = written(spellings(vocabulary), "spellings")

    # rows with the same text are spelled alike, and ASCII words that look like no other word stay
    key = F.xxhash64("form")
    some = read_.select(key.alias("key"), F.explode(F.array_distinct("words")).alias("word")).join(best, "word")
    some = some.groupBy("key").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "spelling")))).alias("spelled"))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for form, spelled in zip(pdf["form"], pdf["spelled"], strict=True):
                spelled = {} if spelled is None else dict(spelled)
                out.append(unicodedata.normalize("NFC", _TOKEN.sub(lambda m, s=spelled: s.get(m[0], m[0]), form)) if spelled else form)
            yield pdf[["id", "text"]].assign(form=out)

    out = read_.select("id", "text", "form", key.alias("key")).join(some, "key", "left").select("id", "text", "form", "spelled")
    return out.mapInPandas(spell, "id bigint, text string, form string").select(F.col("id").alias(id_col), "text", "form")


def equal_looking(rows: DataFrame, id_col: str = "row_id", text_col: str = "content") -> DataFrame:
    """(row_a, row_b): pairs, row_a < row_b, of different contents with the same form. NULL contents and ids take no part.

    Only forms with several contents are joined, by 128 bits of form and content; exact copies of a content pair up with
    the other contents only, as the definition of the result has it.
    """
    key = one_form(rows, id_col, text_col).where(F.col("text").isNotNull() & F.col(id_col).isNotNull())
    key = key.select(F.col(id_col).alias("id"), F.md5("form").alias("form"), F.md5("text").alias("text"))
    many = key.groupBy("form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo != hi").select("form")
    key = key.join(many, "form", "left_semi")
    a, b = (key.select("form", F.col("text").alias(f"t{n}"), F.col("id").alias(f"row_{n}")) for n in "ab")
    return a.join(b, "form").where("ta != tb and row_a < row_b").select("row_a", "row_b").distinct()
