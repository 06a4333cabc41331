import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkstone.llm import canonical, lookalike

ENTRIES = [
    (1, "region", "青坡市", "Qingpo"), (2, "region", "云滩市", "Yuntan"), (3, "region", "桐陵区", "Tongling"), (201, "source_type", "期中", "Midterm"),
    (204, "source_type", "模拟", "Mock"), (205, "source_type", "一模", "First mock"), (301, "grade", "初一", "Grade 7"), (304, "grade", "高一", "Grade 10"),
    (305, "grade", "高二", "Grade 11"),
]
CASES = [
    ("region", " 青坡市", 1), ("region", "本省青坡市", 1), ("region", "青-坡市", 1), ("region", "YUNTAN City", 2), ("region", "雲灘", 2), ("region", "yun tan", 2),
    ("region", "滩云市", 2), ("region", "Yunttan", 2), ("region", "铜陵区", 3), ("region", "苓塘区", 0), ("region", "无", 0), ("region", "全国", 0),
    ("source_type", "上学期期中卷", 201), ("source_type", "第一次模拟", 205), ("source_type", "高三一模", 205), ("source_type", "仿真模拟", 204), ("source_type", "First Mock Exam", 205),
    ("source_type", "Midtrem", 201), ("source_type", "一摸", 205), ("source_type", "homework", 0), ("source_type", "？？", 0),
    ("grade", "G10", 304), ("grade", "初中1年级", 301), ("grade", "十一年级", 305), ("grade", "一年级", 0), ("grade", "高2", 305), ("grade", "初一(17)班", 301), ("grade", "Garde 7", 301), ("grade", "五年级", 0),
]


@pytest.mark.parametrize("block", [100, 2, 1])
def test_mapped(spark, block):
    refs = spark.createDataFrame([(*e, "x") for e in ENTRIES], "ref_id bigint, field string, canonical string, latin string, value string")
    meta = lambda f, v: tuple(v if f == k else None for k in ("region", "source_type", "grade"))
    rows = [(i, meta(f, v), "x") for i, (f, v, _) in enumerate(CASES)] + [(100, ("青坡市", "期中", "初一"), "x"), (101, None, "x"), (102, (" ", "", "　"), "x")]
    df = spark.createDataFrame(rows, "seq bigint, m struct<region:string,source_type:string,grade:string>, field string").repartition(3)
    out = canonical.mapped(df, refs, "seq", {k: f"m.{k}" for k in ("region", "source_type", "grade")}, block_entries=block)
    got = {(r.seq, r.field): r.ref_id for r in out.collect()}
    assert got == {(i, f): ref for i, (f, _, ref) in enumerate(CASES)}
    again = canonical.mapped(df.unionByName(df), refs, "seq", {k: f"m.{k}" for k in ("region", "source_type", "grade")}, block_entries=block)
    assert sorted((r.seq, r.field, r.ref_id) for r in again.collect()) == sorted([(i, f, ref) for i, (f, _, ref) in enumerate(CASES)] * 2)
    if block == 100:
        assert {r.value for r in canonical.unmatched(out).collect()} == {v for _, v, ref in CASES if not ref}
        assert canonical.mapped(df.where("seq < 0"), refs, "seq", {"region": "m.region"}).count() == 0
        assert {r.ref_id for r in canonical.mapped(df, refs.where("ref_id < 0"), "seq", {"region": "m.region"}).collect()} == {0}


def test_longest_mention_wins():
    m = canonical.Mapper([(1, "region", "海市", None), (2, "region", "上海市", None), (3, "region", "海市区", None)])
    assert m.mentions("region", "上海市区") == [((-3, 0, -1, 2), 2)] and m.best("region", "海市x上海市")[2] == 2


def test_token_index():
    """The index gives every entry that has any similarity, and the nearest is what a comparison with all entries says."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 17)))
    words = [word() for _ in range(60)]
    entries = [(i, "x", " ".join(r.sample(words, r.randint(1, 3))) + r.choice(["", "一二", "二"]), None) for i in range(1, 80)]
    m = canonical.Mapper(entries)
    for _ in range(300):
        parts = [list(w) for w in r.sample(words, r.randint(1, 3))]
        for w in parts:
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[], ["e"], [w[i], "a"], w[i + 1 : i + 2] + [w[i]]])
        form = " ".join("".join(w) for w in parts)
        core = canonical._core(form, "x")
        scores = {}
        for other, ref in m.tokens["x"].cores:
            scores[ref] = max(scores.get(ref, 0), canonical.token_set_similarity(core, other))
        top = sorted(scores.values())[-2:]
        want = next(k for k, v in scores.items() if v == top[1]) if top[1] >= canonical.SIMILARITY and top[0] < top[1] else 0
        assert m.nearest("x", form)[1] == want


def test_names_are_an_argument():
    assert canonical.Mapper(ENTRIES, {}).best("source_type", "仿真考")[2] == 0
    assert canonical.Mapper(ENTRIES, {("source_type", "模拟"): ("仿真",)}).best("source_type", "仿真考")[2] == 204


def test_token_sets():
    assert canonical.token_set_similarity(("a",), ()) == 0
    assert canonical.token_set_similarity(("grade", "7"), ("garde", "7")) == pytest.approx(0.9)
    assert canonical.edits("abcd", "abdc", 2) == 1 and canonical.edits("a", "abcd", 2) == 3


SAME = [
    ("ＡＢ１２", "AB12"), ("é", "é"), ("x̄=3", "x̄＝3"), ("零​宽", "零宽"), ("软­连", "软连"), ("a b", "a b"), ("a　b", "a b"), ("-1", "−1"), ("–1", "‐1"),
    ("点А", "点A"), ("ΑΒС", "ABC"), ("⼤小", "大小"), ("三⻆形", "三角形"), ("甲⋅乙", "甲·乙"), ("。", "｡"), ("ѐ", "è"), ("lа́", "lá"),
]
OTHER = [("x²", "x2"), ("①", "1"), ("A", "a"), ("、", ","), ("。", "."), ("α", "a"), ("a b", "ab"), ("a  b", "a b"), ("-", "_"), ("(1)", "①")]


#: Equal shapes, written for the tests: each first character stands for those after it.
SHAPES = (
    "AΑА BΒВ CСϹ DԀ EΕЕ GԌ HΗНҺ IΙІӀ JЈͿ KΚК MΜМ NΝ OΟОՕ PΡР QԚ SЅ TΤТ VѴ WԜ XΧХ YΥУҮ ZΖ aаɑ cсϲ dԁ eе gɡ hһ iі jјϳ lӏ oοоօ pр qԛ sѕ vѵ wԝ xх yу 3З "
    "-‐‑‒–—―−⁃˗⸺⸻ ·⋅∙‧・· :∶꞉ |∣ǀ /∕⁄ *∗⁎ ~∼〜˜ ^ˆ ∥‖ ⊥⟂ Δ∆ Σ∑ Π∏ μµ °˚"
).split()
_SHAPES = {ord(c): g[0] for g in SHAPES for c in g[1:]}
_HIDDEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def looks(t):
    """What a text looks like, character by character, without the module's tables but for the radicals'."""
    out = []
    for c in t.replace("\r\n", "\n"):
        kind, cp = unicodedata.category(c), ord(c)
        if cp in _HIDDEN or kind == "Cf" or (kind == "Cc" and not c.isspace()):
            continue
        if kind == "Zs":
            c = " "
        elif cp in (0x2028, 0x2029, 0x85):
            c = "\n"
        elif c in lookalike.RADICALS:
            c = lookalike.RADICALS[c]
        elif 0xFF00 <= cp <= 0xFFEF or 0x2F00 <= cp <= 0x2FDF or cp in (0x2E9F, 0x2EF3) or 0x2160 <= cp < 0x2180 or 0xFB00 <= cp < 0xFB07 or 0xFE50 <= cp < 0xFE70:
            c = unicodedata.normalize("NFKC", c)
        out.append(c)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(out)).translate(_SHAPES))


def test_looks():
    seen = lambda t: lookalike.look(lookalike.plain(t))
    assert all(seen(a) == seen(b) == looks(a) == looks(b) for a, b in SAME)
    assert all(seen(a) != seen(b) and looks(a) != looks(b) for a, b in OTHER)
    assert all(seen(seen(a)) == seen(a) for pair in SAME + OTHER for a in pair)


def test_pairs(spark):
    texts = [t for pair in SAME + OTHER for t in pair] + [None, "", "​", "重复", "重复", "重​复"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "row_id bigint, content string, form string, text string").repartition(3)
    want = {
        (i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j])
        if a is not None and b is not None and a != b and looks(a) == looks(b)
    }
    assert {tuple(r) for r in lookalike.equal_looking(df).select("row_a", "row_b").collect()} == want
    assert lookalike.equal_looking(df.where("row_id < 0")).count() == 0
    assert lookalike.one_form(df).where("form is null").count() == 1


def test_script_of_the_corpus(spark):
    """A word that mixes scripts takes the script in which the corpus has it."""
    texts = ["слово раз", "слово два", "cлoвo три", "the paper", "the рaper", "сор", "cop"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, content string")
    form = {r.row_id: r.form for r in lookalike.one_form(df).collect()}
    assert form[2] == "слово три" and form[4] == "the paper" and form[5] == form[6] and form[0] == "слово раз"
    assert lookalike.dominant("cлoвo") == ("Cyrillic", True) and lookalike.words("点AB在") == ["AB"]
    assert lookalike.repaired("cлoвo") == "слово" and lookalike.repaired("рaper") == "paper" and lookalike.repaired("paper") is None and lookalike.repaired("xжλ") is None


def test_repair_needs_the_vocabulary(spark):
    """A mixed word takes its dominant script only if the corpus has the result; equal looks get one form in any case."""
    spelled = lambda *w: {r.word: r.spelling for r in lookalike.spellings(spark.createDataFrame(list(w), "word string, n bigint")).collect()}
    assert spelled(("слово", 2), ("cлoвo", 1)) == {"cлoвo": "слово"}
    assert spelled(("cлoвo", 1)) == {}
    assert spelled(("СОР", 5), ("COP", 1)) == {"СОР": "COP"} and spelled(("СОР", 5), ("CОР", 1)) == {"CОР": "СОР"}
    assert spelled(("Аa", 1)) == {"Аa": "Aa"} and spelled(("ё", 1), ("ë", 2)) == {"ё": "ë"}


def test_marks_and_digits(spark):
    texts = ["а́б", "áб", "З5", "35", "Зима", "3има", "3имa", "Ａ１", "А1"]
    form = {r.row_id: r.form for r in lookalike.one_form(spark.createDataFrame(list(enumerate(texts)), "row_id bigint, content string")).collect()}
    same = {(i, j) for i in form for j in form if form[i] == form[j]}
    assert same == {(i, j) for i in form for j in form if looks(texts[i]) == looks(texts[j])}


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "ａ"), (2, "a")], "row_id bigint, content string")
    assert [tuple(r) for r in lookalike.equal_looking(df).collect()] == [(1, 2)]
    assert lookalike.one_form(df).where(F.col("form") == "a").count() == 3
