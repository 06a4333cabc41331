"""Expressions against hand-made cases and plain Python."""

import pytest
from pyspark.sql import functions as F

from inkstone.functions import coerce, meta, text, vector


def values(spark, items, *columns, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [tuple(r[1:]) if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


NUMBERS = [
    ("1. 已知x", "1", "1"), ("12、求y", "12", "12"), ("1．全角", "1", "1"), ("（3）z", None, None), ("(3) z", "3", "3"), ("(007) a", "007", "7"),
    ("(300) b", "300", None), ("007. a", "7", "7"), ("5 x", "5", "5"), ("5", None, None), ("2023. x", None, None), ("2023 年", None, None),
    ("201. x", None, None), ("0. x", None, None), ("12345. x", None, None), ("", None, None), ("一、单选", None, None), ("“5. q", None, "5"),
    (None, None, None), ("　7、题", "7", "7"), ("７．题", "7", "7"),
]


def test_numbers(spark):
    got = values(spark, [n[0] for n in NUMBERS], text.number_in_record(F.col("x")), text.number_in_upload(F.col("x")))
    assert got == [n[1:] for n in NUMBERS]


def test_types(spark):
    cases = {
        "1. 值为\nA. 3\nB. 4": "选择题", "(b) 说明": "选择题", "find the end.": "选择题", "Ａ．3 Ｂ．4": "未知题型", "a=____": "填空题", "a=__": "未知题型",
        "若（）成立": "填空题", "求最大值": "解答题", "判断真假": "未知题型",
    }
    assert values(spark, list(cases), text.record_type(F.col("x"))) == list(cases.values())
    assert values(spark, [None], text.record_type(F.col("x"))) == ["未知题型"]


def test_trim_is_pythons(spark):
    items = ["　x　", "\x1c a b \x85", " ", "", "a​"]
    assert values(spark, items, text.u_trim(F.col("x"))) == [x.strip() for x in items]


def test_join_ideographs(spark):
    assert values(spark, ["中 文 字  a b", "一\n\n\n\n二 三", "a\n\n\n\nb"], text.join_ideographs(F.col("x"))) == ["中文字 a b", "一二三", "a\n\nb"]


META = [
    ("北京市2023年高一期中考试数学试卷\n注意事项", 2023, "高一", "期中", "北京市", "北京市2023年高一期中考试数学试卷", []),
    ("2022-2023学年高二数学期末检测, MSU scan\n石家庄市", 2022, "高二", "期末", "石家庄市", "2022-2023学年高二数学期末检测", []),
    ("海淀区高三一模模拟试题", None, "高三", "模拟", "海淀区", "海淀区高三一模模拟试题", ["year"]),
    ("2021~2022 月考\n2023年高二高一联考", 2023, "高一", "月考", None, "2023年高二高一联考", ["region"]),
    ("no metadata", None, None, None, None, None, ["region", "year", "grade", "exam_name", "source_type"]),
    (None, None, None, None, None, None, ["region", "year", "grade", "exam_name", "source_type"]),
]


def test_meta(spark):
    df = meta.with_report(spark.createDataFrame([(i, m[0]) for i, m in enumerate(META)], "i int, x string"), "x", "r")
    got = df.orderBy("i").select(*[f"r.meta.{k}" for k in ("year", "grade", "source_type", "region", "exam_name")], meta.low_confidence(F.col("r.confidence"))).collect()
    assert [tuple(r) for r in got] == [m[1:] for m in META]


def test_coercions(spark):
    assert values(spark, ["集合, 不等式；向量、", "", None], coerce.points_from_text(F.col("x"))) == [["集合", "不等式", "向量"], [], []]
    assert values(spark, [["a ", " ", "3", None], None], coerce.points_from_list(F.col("x")), kind="array<string>") == [["a", "3"], []]
    assert [tuple(r) for r in spark.sql("select explode(array(2.9D, -0.5D, 5.99D, 6.0D, double('nan'), double('infinity'), null)) as x").select(coerce.difficulty(F.col("x"))).collect()] == [(2,), (3,), (5,), (3,), (3,), (3,), (3,)]
    assert spark.sql("select cast(2.9 as decimal(3,1)) as x, true as y, 7 as z").select(*[coerce.difficulty(F.col(c)) for c in "xyz"]).first()[:] == (2, 1, 3)
    assert values(spark, ["4", "0", "6", "x", None, "2.9", " 5 ", "+2"], coerce.difficulty(F.col("x"))) == [4, 3, 3, 3, 3, 3, 5, 2]


def test_json(spark):
    replies = ['```json\n[{"content":"a","difficulty":"2",},]\n```', 'x {"content":"b"} y {"content":"c", bad} ', "none", None, '[{“content”:“d”}]']
    got = values(spark, replies, F.transform(coerce.json_items(F.col("x")), lambda s: s["content"]))
    assert got == [["a"], ["b"], [], [], ["d"]]


def test_vectors(spark):
    df = spark.createDataFrame([([0.6, 0.8], [0.8, 0.6])], "a array<float>, b array<float>")
    row = df.select(vector.squared_distance(F.col("a"), F.col("b")), vector.cosine(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(0.08, abs=1e-6) and row[1] == pytest.approx(0.96, abs=1e-6)
    v = values(spark, ["a b a", "", None], vector.hash_embedding(F.col("x"), 16))
    assert sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-6) and not any(v[1]) and not any(v[2])
