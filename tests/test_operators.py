"""Operators on small tables: ties, NULLs, empty tables, clashing column names, and repeated runs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.operators import analytics, dedupe, filters, render, search, segment
from inkstone.sources import logs, store

POINTS = "id string, seq bigint, embedding array<double>, knowledge_points array<string>, difficulty int, content string"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("v0", [1, 0], ["a"], 3), ("v1", [0.96, 0.28], ["a"], 1), ("v2", [0.8, 0.6], ["b"], 3), ("v3", [0.6, 0.8], ["a"], 4), ("v4", [0, 1], ["a"], 2), ("v5", [0.8, 0.6], ["a"], 5), ("v6", None, ["a"], 3)]
    return spark.createDataFrame([(n, i, v and [float(x) for x in v], k, d, n) for i, (n, v, k, d) in enumerate(rows)], POINTS)


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_search_modes(vectors):
    where = filters.retrieval_filter(["a"], (2, 4))
    assert ids(search.top_k(vectors, [1, 0], 2, where)) == ["v0", "v3"]
    assert ids(search.top_k(vectors, [1, 0], 2, where, "closeness", "postfilter")) == ["v0"]
    assert ids(search.top_k(vectors, [1, 0], 2, filters.retrieval_filter([], (2, 4)))) == []
    assert ids(search.top_k(vectors, [0.8, 0.6], 2)) == ["v2", "v5"]
    assert ids(search.top_k(vectors, [1, 0], 0)) == [] and ids(search.top_k(vectors, [1, 0, 0], 3)) == []
    with pytest.raises(ValueError):
        filters.first_point_filter([])


@pytest.mark.parametrize("metric", ["cosine", "closeness"])
@pytest.mark.parametrize("block", [3, 1000])
def test_knn_join(spark, metric, block):
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (40, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(40)] + [(99, None)], "seq bigint, embedding array<double>")
    got = {(x["query_id"], x["rank"]): x["neighbour_id"] for x in search.knn_join(df.where("seq < 10"), df.repartition(3), 3, metric=metric, block_queries=block).collect()}
    for q in range(10):
        if metric == "cosine":
            s = (v @ v[q]) / ((np.linalg.norm(v, axis=1) + 1e-8) * (np.linalg.norm(v[q]) + 1e-8))
        else:
            s = 1 / (1 + ((v - v[q]) ** 2).sum(1))
        want = sorted(range(40), key=lambda i: (-round(s[i], 12), i))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == want
    assert search.knn_join(df.where("seq < 0"), df).count() == 0 and search.knn_join(df, df.where("seq < 0")).count() == 0


def test_filters(spark):
    rows = [(1, "a", ("北京市", 2023, "高一", "期中考试", "期中")), (2, None, (None, None, None, None, None)), (3, "c", None)]
    df = spark.createDataFrame(rows, "seq bigint, id string, source_meta struct<region:string,year:int,grade:string,exam_name:string,source_type:string>")
    pick = lambda f, **k: [r.seq for r in df.where(filters.meta_filter(f, **k)).orderBy("seq").collect()]
    assert pick({}) == [1, 2, 3] and pick({"region": " "}) == [1, 2, 3] and pick({"region": "北"}) == [1]
    assert pick({"year": "2023"}) == [1] and pick({"year": "x"}) == [] and pick({"id": "c"}) == [3]
    assert pick({"nope": 1}, permissive=True) == [1, 2, 3]
    with pytest.raises(ValueError):
        pick({"nope": 1})
    with pytest.raises(ValueError):
        analytics.remaining(df, {"region": " "})
    keys = ["北京市", " 上海市 ", "", None, "北京市", "上海市"]
    g = spark.createDataFrame([(i, str(i), (k, None, None, None, None)) for i, k in enumerate(keys)], df.schema)
    assert [tuple(r) for r in analytics.group_counts(g, "region").orderBy("rank").collect()] == [("北京市", 2, 1), ("上海市", 2, 2), ("(empty)", 2, 3)]


def test_segments(spark):
    long = "x" * 30
    texts = [f"preamble\n1. {long}\nA. 3\n2、 {long}\n(1) {long}\n一、 {long}", f"1. short\r\n2. {long}", "no numbering", f"mid 1. {long}", None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc int, text string, segment_at int")
    got = [(r.doc, r.segment_no, r.segment) for r in segment.segments(df).orderBy("doc", "segment_no").collect()]
    assert got == [(0, 1, f"1. {long} A. 3"), (0, 2, f"2、 {long}"), (0, 3, f"(1) {long}"), (0, 4, f"一、 {long}"), (1, 1, f"2. {long}")]


def test_chunks(spark):
    texts = ["", "a" * 2000, "b" * 2001, "c" * 5200, None]
    got = {}
    for r in segment.chunks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string")).collect():
        got.setdefault(r.doc, {})[r.chunk_no] = r.chunk
    assert {k: len(v) for k, v in got.items()} == {0: 1, 1: 1, 2: 2, 3: 3}
    for k, pieces in got.items():
        assert "".join(p if n == 0 else p[400:] for n, p in sorted(pieces.items())) == texts[k]


def test_merge_by_number(spark):
    rows = [("d", 1, "1. 求和"), ("d", 2, "1. 求和的全部内容"), ("d", 3, "1. 别的"), ("d", 4, "无号"), ("d", 5, "2. 乙"), ("d", 6, " "), ("e", 7, None)]
    got = segment.merged_by_number(spark.createDataFrame(rows, "doc_hash string, seq bigint, content string")).orderBy("index").collect()
    assert [(r.number, r.seq, r.content) for r in got] == [("1", 2, "1. 求和的全部内容\n1. 别的"), ("2", 5, "2. 乙"), (None, 4, "无号")]
    miss = segment.missing_numbers(spark.createDataFrame([("d", "1. a\n3、b\n2020. c")], "k string, text string"), spark.createDataFrame([("d", 1)], "k string, number bigint"), "k")
    assert sorted(r.number for r in miss.collect()) == [2, 3]


def test_dedupe_any_order(spark):
    random.seed(1)
    rows = [(i, random.choice(["a", "b", None]), f"{random.randint(1, 3)}. 题") for i in range(60)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "seq bigint, id string, content string").repartition(parts)
        kept = {r.seq for r in dedupe.insertable(df, spark.createDataFrame([("b",), (None,)], "id string")).collect()}
        assert kept == {next(i for i, k, _ in rows if k == "a")} | {i for i, k, _ in rows if k is None}
    assert dedupe.insertable(df.where("seq < 0"), df).count() == 0


def test_similarity_stage(spark):
    schema = "seq bigint, id string, content string, embedding array<double>"
    old = spark.createDataFrame([(1, "o1", "集合a的子集个数", [1.0, 0.0]), (2, "o2", "完全不同的一题", [0.0, 1.0]), (3, "o3", "", [0.9, 0.1])], schema)
    new = spark.createDataFrame([(10, "n1", "3. 集合a的子集个数。", [0.0, 1.0]), (11, "n2", "新题", [-1.0, 0.0]), (12, "n3", None, [1.0, 0.0])], schema)
    got = {r.seq: (r.match_id, round(r.text_similarity, 5)) for r in dedupe.similar_to_stored(new, old).collect()}
    assert got == {10: ("o1", 1.0)}
    pair = spark.createDataFrame([("ab" * 150, "ba" * 150), ("集合a的子集个数", "集合b的子集的个数"), (None, "x")], "a string, b string")
    assert [r[0] and round(r[0], 5) for r in pair.select(dedupe.text_similarity("a", "b")).collect()] == [0.0, round(SequenceMatcher(None, "集合a的子集个数", "集合b的子集的个数").ratio(), 5), None]


def test_report_adds_up(spark):
    rows = spark.createDataFrame([(None,), ("internal_exact",), ("similarity",), (None,), ("db_existing_id",)], "reason string")
    r = dedupe.report(rows).first()
    assert r.extracted_total - r.internal_exact == r.after_internal_exact
    assert r.after_internal_exact - r.db_existing_id == r.after_db_existing_id and r.after_db_existing_id - r.similarity == r.after_similarity == 2


def test_log_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"ts":"1","added":2}\n\n{bad\n[1]\n{"ts":"2"}\n')
    assert [(r.ts, r.added) for r in logs.read(spark, str(tmp_path / "log")).orderBy("ts").collect()] == [("1", 2), ("2", None)]
    logs.append(spark.createDataFrame([("3", 1)], "ts string, added int"), str(tmp_path / "log"))
    assert logs.read(spark, str(tmp_path / "log")).count() == 3


def test_render(spark):
    rows = [(2, "s", "乙", None, None, "解"), (1, "s", None, ["a.png", ""], "答", None)]
    df = spark.createDataFrame(rows, "row_id bigint, sheet_id string, content string, images array<string>, answer string, solution string")
    html = render.sheets(df, answers=True).first().html
    assert html.index("第1题") < html.index('src="a.png"') < html.index("答案：</strong>答") < html.index("第2题</h3><p>乙") < html.index("解析：</strong>解")
    assert "答案" not in render.sheets(df).first().html


def test_flat_and_back(spark):
    df = spark.createDataFrame([("a", 1, "c", ["x", "y"], 2, ("r", 2020, None, None, None)), (None, 2, None, None, None, None)],
                               "id string, seq bigint, content string, knowledge_points array<string>, difficulty int, source_meta struct<region:string,year:int,grade:string,exam_name:string,source_type:string>")
    got = store.nested_form(store.flat_form(store.stored_form(df))).orderBy("seq").collect()
    assert (got[0].knowledge_points, got[0].difficulty, got[0].source_meta.year) == (["x", "y"], 2, 2020)
    assert (got[1].id, got[1].knowledge_points, got[1].difficulty, got[1].source_meta.region) == ("q2", [], 3, None)


def test_scanned(spark):
    df = spark.createDataFrame([("a", 1, "x" * 120), ("b", 1, "?" * 150), ("c", 1, None), ("d", 1, "好" * 150 + "{#{scan}#}"), ("e", 9, "late")], "doc_hash string, page_no int, content string")
    assert {r.doc_hash: r.scanned for r in analytics.is_scanned(df).collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_clashing_columns(spark, vectors):
    more = vectors.withColumn("similarity_", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("n", F.lit(0)).withColumn("v", F.lit(0))
    assert search.knn_join(more, more, 2).count() == 12
    assert dedupe.first_wins(more.drop("kept"), F.col("id")).where("kept").count() == 7
