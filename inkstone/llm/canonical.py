"""Problem 2: freely typed values mapped to canonical entries: automaton first, token sets for the rest."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import spread, written

#: Entries in one automaton. Beyond it the entries are taken in blocks, and each value keeps the best of all blocks.
BLOCK_ENTRIES = 50_000
#: Distinct values a task remembers.
MEMORY = 200_000
#: Words that may have up to so many edits are indexed by what is left without letters; longer ones are few, and compared.
INDEXED_EDITS = 2
#: Least token-set similarity: half of the tokens of either side's core.
SIMILARITY = 0.5

#: Traditional and variant characters with their simplified form.
SIMPLIFIED = dict(zip(
    "臨雲灘峽銀塢霽鷺錦灣暉驛麟蕩溝澗嶺楓嵐陵橋樓東門長車華縣區級學測聯單試週靜瀾漁龍鳳黃陽陰廣慶廈濱濟淵潤澤島嶼硯棲蒼葦崗岡連運遠鄉鎮鄭趙韓魯齊晉豐實義榮國",
    "临云滩峡银坞霁鹭锦湾晖驿麟荡沟涧岭枫岚陵桥楼东门长车华县区级学测联单试周静澜渔龙凤黄阳阴广庆厦滨济渊润泽岛屿砚栖苍苇岗冈连运远乡镇郑赵韩鲁齐晋丰实义荣国",
    strict=True,
))
#: Administrative ends of a place name, and words that say nothing about which entry is meant.
PLACE_ENDS = ("自治州", "自治区", "地区", "市", "区", "县", "省", "州", "盟", "旗")
PLACE_WORDS = ("city", "county", "district", "city of")
#: Other names of kinds of papers.
Aliases = dict[tuple[str, str], tuple[str, ...]]
KIND_ALIASES: Aliases = {
    ("source_type", "期中"): ("中期", "其中考", "midterm", "mid term", "half term"),
    ("source_type", "期末"): ("末期", "期未", "final", "finals", "end of term", "final term"),
    ("source_type", "月考"): ("每月考", "monthly", "month exam", "monthly test"),
    ("source_type", "模拟"): ("mock", "仿真"),
    ("source_type", "一模"): ("第一次模拟", "首次模拟", "1模", "模拟一", "first mock", "1st mock", "mock 1"),
    ("source_type", "二模"): ("第二次模拟", "2模", "模拟二", "second mock", "2nd mock", "mock 2"),
    ("source_type", "三模"): ("第三次模拟", "3模", "模拟三", "third mock", "3rd mock", "mock 3"),
    ("source_type", "联考"): ("联合考", "joint"),
    ("source_type", "周测"): ("每周测", "周考", "周练", "weekly"),
    ("source_type", "单元测"): ("单元", "unit"),
}
#: Generic words that a comparison of tokens leaves out.
GENERIC = {
    "source_type": ("exam", "test", "quiz", "paper", "考试", "测试", "试卷", "检测", "测验", "卷", "mock exam"),
    "grade": ("年级", "年", "级", "学生", "班", "学期", "上", "下"),
    "region": PLACE_WORDS,
}
#: Chinese numerals for years of schooling.
NUMERALS = {7: "七", 8: "八", 9: "九", 10: "十", 11: "十一", 12: "十二"}
ORDER = {1: "一", 2: "二", 3: "三"}


def base_form(value: str) -> str:
    """NFKC, lower case, simplified characters; everything but letters and digits becomes one space."""
    s = unicodedata.normalize("NFKC", value).lower()
    s = "".join(SIMPLIFIED.get(ch, ch) if ch.isalnum() else " " for ch in s if unicodedata.category(ch) not in ("Cf", "Mn"))
    return " ".join(s.split())


def aliases(field: str, canonical: str, latin: str | None, more: Aliases = KIND_ALIASES) -> set[str]:
    """Names under which an entry is looked for, besides the canonical one."""
    out = {canonical, latin or "", *more.get((field, canonical), ())}
    if field == "region":
        for end in PLACE_ENDS:
            if canonical.endswith(end) and len(canonical) - len(end) >= 2:
                out.add(canonical[: -len(end)])
                break
    elif field == "grade":
        stage, number = canonical[:1], {"一": 1, "二": 2, "三": 3}.get(canonical[1:2], 0)
        if stage in "初高" and number:
            year, cn = number + (6 if stage == "初" else 9), ORDER[number]
            out |= {f"{stage}{number}", f"{stage}中{number}", f"{stage}中{cn}", f"{stage}{cn}", f"{year}年级", f"{NUMERALS[year]}年级"}
            out |= {f"grade {year}", f"g{year}", f"gr {year}", f"year {year}", f"class {year}", f"{year}th grade"}
    return {x for a in out if a and (x := base_form(a))}


def _deletes(word: str, most: int) -> set[str]:
    """word without up to `most` of its letters. Words within so many edits of each other have one of these in common."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Tokens:
    """The token sets of a field's entries, by token: exact ones, and words that a few edits lead to."""

    def __init__(self, cores: list[tuple[tuple[str, ...], int]]) -> None:
        self.cores = cores
        self.of: dict[str, list[int]] = {}
        for n, (core, _) in enumerate(cores):
            for t in core:
                self.of.setdefault(t, []).append(n)
        self.near: dict[str, list[str]] = {}
        self.long: list[str] = []
        for t in self.of:
            if _is_word(t):
                if len(t) // 5 <= INDEXED_EDITS:
                    for d in _deletes(t, max(1, len(t) // 5)):
                        self.near.setdefault(d, []).append(t)
                else:
                    self.long.append(t)

    def sharing(self, core: tuple[str, ...]) -> set[int]:
        """The entries with a token that counts as one of core's; others have a similarity of 0."""
        out: set[int] = set()
        for t in core:
            same = {t} & self.of.keys()
            if _is_word(t):
                some = {w for d in _deletes(t, min(INDEXED_EDITS, max(1, len(t) // 5))) for w in self.near.get(d, ())} | set(self.long)
                same |= {w for w in some if _same_token(t, w)}
            out.update(n for w in same for n in self.of[w])
        return out


class Mapper:
    """The entries of one block: an automaton per field over names and aliases, and token sets of the entries."""

    def __init__(self, entries: list[tuple[int, str, str, str | None]], more: Aliases = KIND_ALIASES) -> None:
        import ahocorasick

        self.exact, self.automata, cores = set(), {}, {}
        for ref, field, canonical, latin in entries:
            self.exact.add((field, canonical))
            found = self.automata.setdefault(field, ahocorasick.Automaton())
            for name in aliases(field, canonical, latin, more):
                key = name.replace(" ", "")
                weight = (name == base_form(canonical), -ref)
                if key not in found or found.get(key)[2] < weight:
                    found.add_word(key, (len(key), ref, weight))
                cores.setdefault(field, []).append((_core(name, field), ref))
        self.tokens = {field: Tokens(c) for field, c in cores.items()}
        for found in self.automata.values():
            found.make_automaton()

    def mentions(self, field: str, form: str) -> list[tuple[tuple, int]]:
        """(key, ref) of the mentions chosen, with key (-length, place, not canonical, ref): the longest first, then those that don't overlap any chosen, from the left.

        Separators are skipped. A name that ends in a digit may not go on in digits, and one that begins or ends in an
        ASCII letter may not go on in ASCII letters, unless a separator stands between.
        """
        text, gap = [], []
        for ch in form:
            if ch == " ":
                if gap:
                    gap[-1] = True
            else:
                text.append(ch)
                gap.append(False)
        text = "".join(text)
        hits = []
        for last, (n, ref, weight) in self.automata[field].iter(text) if field in self.automata else ():
            first = last - n + 1
            before, after = text[first - 1 : first] if first and not gap[first - 1] else "", text[last + 1 : last + 2] if not gap[last] else ""
            if _joined(before, text[first]) or _joined(text[last], after):
                continue
            hits.append((-n, first, -int(weight[0]), ref, last))
        out, taken = [], []
        for n, first, canonical, ref, last in sorted(hits):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append(((n, first, canonical, ref), ref))
        return out

    def nearest(self, field: str, form: str) -> tuple[float, int]:
        """The highest similarity of token sets, and its entry: 0 if none reaches SIMILARITY or two entries tie."""
        core = _core(form, field)
        best: dict[int, float] = {}
        tokens = self.tokens.get(field)
        for other, ref in (tokens.cores[n] for n in tokens.sharing(core)) if tokens else ():
            s = token_set_similarity(core, other)
            if s > best.get(ref, 0):
                best[ref] = s
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:2]
        if not top or top[0][1] < SIMILARITY:
            return 0.0, 0
        return top[0][1], 0 if len(top) > 1 and top[1][1] == top[0][1] else top[0][0]

    def best(self, field: str, value: str) -> tuple[tuple, float, int]:
        """(mention, similarity, ref) of the entry a value stands for; ref 0 for none, mention empty without one."""
        form = base_form(value)
        if found := self.mentions(field, form):
            return found[0][0], 1.0, found[0][1]
        return (), *self.nearest(field, form)


def better(a: tuple[tuple, float, int], b: tuple[tuple, float, int]) -> tuple[tuple, float, int]:
    """Of what two blocks of entries say of a value, what both together would have said."""
    if a[0] or b[0]:
        return min((x for x in (a, b) if x[0]), key=lambda x: x[0])
    if a[1] != b[1]:
        return max(a, b, key=lambda x: x[1])
    return a if a[2] == b[2] else ((), a[1], 0)


def _joined(a: str, b: str) -> bool:
    if not a or not b:
        return False
    return (a.isdigit() and b.isdigit()) or (a.isascii() and b.isascii() and a.isalpha() and b.isalpha())


def _core(form: str, field: str) -> tuple[str, ...]:
    """Tokens of a value: ASCII words and numbers whole, other characters one by one, without generic words and ends."""
    for word in sorted(GENERIC.get(field, ()), key=len, reverse=True):
        if word.isascii():
            form = " ".join(w for w in form.split() if w != word) if " " not in word else form
        else:
            form = form.replace(word, " ")
    if field == "region":
        for end in PLACE_ENDS:
            if form.endswith(end) and len(form) > len(end):
                form = form[: -len(end)]
                break
    out, word = [], ""
    for ch in form + " ":
        if ch.isascii() and ch.isalnum() and (not word or ch.isdigit() == word[-1].isdigit()):
            word += ch
            continue
        if word:
            out.append(word)
        word = ch if ch.isascii() and ch.isalnum() else ""
        if not ch.isascii():
            out.append(ch)
    return tuple(dict.fromkeys(out))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 if there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def _is_word(x: str) -> bool:
    return len(x) >= 4 and x.isascii() and x.isalpha()


def _same_token(a: str, b: str) -> float:
    """1 for equal tokens, less for words of four letters or more with one edit in about five letters."""
    if a == b:
        return 1.0
    if not (_is_word(a) and _is_word(b)):
        return 0.0
    most = max(1, min(len(a), len(b)) // 5)
    d = edits(a, b, most)
    return 1.0 - d / max(len(a), len(b)) if d <= most else 0.0


def token_set_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """What the sets have in common, over the size of the larger one. Words count as common with a few edits, by degree."""
    if not a or not b:
        return 0.0
    left, common = Counter(b), 0.0
    for x in sorted(a, key=lambda t: t not in left):
        s, y = max(((_same_token(x, y), y) for y in left), default=(0.0, ""))
        if s:
            common += s
            del left[y]
    return common / max(len(a), len(b))


def mapped(
    values: DataFrame, references: DataFrame, id_col: str, fields: dict[str, str],
    ref_id_col: str = "ref_id", field_col: str = "field", canonical_col: str = "canonical", latin_col: str | None = "latin",
    block_entries: int = BLOCK_ENTRIES, names: Aliases | None = None,
) -> DataFrame:
    """(id_col, field, value, ref_id): for each row and field of values, the entry the typed value stands for, 0 for none.

    fields gives, by field name, the column (or expression) of the values. NULL and blank values and those exactly equal
    to a canonical entry of the field give no row. An automaton over canonical names and aliases finds embedded mentions;
    the longest wins, mentions of the same length go by place, then canonical before alias, then by ref_id. Values without
    a mention go by token sets; what ties or is too far from all entries is reported with 0.

    names are further names of entries, by field and canonical name (KIND_ALIASES unless given).

    Entries go to the tasks in blocks of block_entries, one at a time; a value takes what it has from earlier blocks along
    and keeps what all entries together would have given, so results are the same at any number of blocks. Rows aren't
    shuffled; a task maps each distinct value once. Rows with NULL id are left out; repeated rows give repeated results.
    """
    typed = values.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.expr(c).cast("string").alias("value")) for f, c in fields.items()
    ])).alias("v")).select("id", "v.field", "v.value").where("id is not null and trim(value) != ''")
    typed = spread(typed)
    entries = references.select(
        F.col(ref_id_col).cast("bigint"), F.col(field_col).cast("string"), F.col(canonical_col).cast("string"),
        (F.col(latin_col) if latin_col else F.lit(None)).cast("string"),
    ).where(f"`{ref_id_col}` is not null and `{field_col}` is not null and `{canonical_col}` is not null")
    spark, more = values.sparkSession, KIND_ALIASES if names is None else names
    state = "id bigint, field string, value string, mention array<bigint>, similarity double, ref_id bigint"

    def scan(rows: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mapper, memory = Mapper(sent.value, more), {}
            for pdf in batches:
                out = []
                had = zip(pdf["mention"], pdf["similarity"], pdf["ref_id"], strict=True) if "mention" in pdf.columns else repeat(None)
                for id_, field, value, old in zip(pdf["id"], pdf["field"], pdf["value"], had, strict=False):
                    if not value.strip() or (field, value) in mapper.exact:
                        continue
                    if (field, value) not in memory:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        memory[field, value] = mapper.best(field, value)
                    new = memory[field, value]
                    if old is not None:
                        new = better((tuple(int(x) for x in old[0]), old[1], int(old[2])), new)
                    out.append((id_, field, value, list(new[0]), new[1], new[2]))
                yield pd.DataFrame(out, columns=["id", "field", "value", "mention", "similarity", "ref_id"])

        return rows.mapInPandas(run, state)

    def blocks() -> Iterator[list[tuple]]:
        block = []
        for row in entries.toLocalIterator():
            block.append(tuple(row))
            if len(block) >= block_entries:
                yield block
                block = []
        if block:
            yield block

    every = blocks()
    block, rows = next(every, []), typed
    while True:
        following = next(every, None)
        sent = spark.sparkContext.broadcast(block)
        rows = scan(rows, sent)
        if following is None:
            return rows.select(F.col("id").alias(id_col), "field", "value", "ref_id")
        rows = written(rows, "mapped")
        sent.destroy()
        block = following


def unmatched(found: DataFrame) -> DataFrame:
    """(field, value, n): the values of a result of mapped that stand for no entry, with their number."""
    return found.where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("n"))
