"""Extraction with a provider, other forms of the store, and exports."""

import json

from pyspark.sql import functions as F

from inkstone.functions import meta
from inkstone.plans import extraction
from inkstone.sources import exchange

LONG = "已知集合A={1,2,3}，求集合A的子集个数，并说明理由和全部过程"


class Canned:
    def generate(self, prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("down")
        return [self.one(p) for p in prompts]

    def one(self, p):
        if p.startswith("题型"):
            return "这是填空" if "___" in p else "？"
        if p.startswith("是否"):
            return "是" if "注意" in p else "否"
        if p.startswith("返回JSON元数据"):
            return '好 {"region": "北京市", "year": "2024", "grade": ""}'
        return json.dumps([{"content": f"1. {LONG}", "difficulty": "9", "knowledge_points": "集合、函数"}, {"content": f"1. {LONG}。"}, {"content": "short"}], ensure_ascii=False) if "1." in p else "none"


def test_extract(spark):
    docs = spark.createDataFrame([("a", f"1. {LONG}\n2. {LONG}乙"), ("b", f"(3) {LONG}\n(4) 注意事项 第 页 共"), ("c", None), ("d", "")], "doc_hash string, text string")
    got = [(r.doc_hash, r["index"], r.content, r.difficulty, r.knowledge_points) for r in extraction.extract_with_provider(docs, Canned()).orderBy("doc_hash", "index").collect()]
    assert got == [("a", 1, f"1. {LONG}", 3, ["集合", "函数"]), ("a", 2, f"2. {LONG}乙", 3, []), ("b", 1, f"(3) {LONG}", 3, [])]
    assert {r.doc_hash for r in extraction.extract_with_provider(docs, extraction.Rules()).collect()} == {"a", "b"}
    assert extraction.extract_with_provider(docs, Canned(), fallback=False).where("doc_hash = 'b'").count() == 0


def test_types_and_instructions(spark):
    df = spark.createDataFrame([("x=___",), ("求值",), ("注意事项",)], "content string")
    assert {r.content: r.question_type for r in extraction.with_types(df, Canned()).collect()} == {"x=___": "填空题", "求值": "解答题", "注意事项": "未知题型"}
    assert {r.content for r in extraction.without_instructions(df, Canned()).collect()} == {"x=___", "求值"}
    bad = spark.createDataFrame([("fail 求值",), ("fail 答题卡",)], "content string")
    assert {r.content for r in extraction.without_instructions(bad, Canned()).collect()} == {"fail 求值"}
    assert extraction.without_instructions(bad, None).count() == 1


def test_meta(spark):
    df = spark.createDataFrame([(1, "2023年高一期中考试"), (2, "北京市2023年高一期中考试"), (3, "fail")], "i int, head string")
    got = extraction.meta_with_provider(meta.with_report(df, "head"), Canned()).collect()
    got = {r.i: (r.meta.region, r.meta.year, r.meta.grade, r.asked) for r in got if r.i < 3}
    assert got == {1: ("北京市", 2023, "高一", True), 2: ("北京市", 2023, "高一", False)}


def test_topics(spark):
    df = spark.createDataFrame([('x {"knowledge_points": ["a", "b"]}',), ('["c"]',), ("d、e",)], "a string")
    assert [r[0] for r in df.select(extraction.topic_points(F.col("a"))).collect()] == [["a", "b"], ["c"], ["d", "e"]]
    topic = df.limit(1).select(extraction.lesson_topic(F.lit("t"), F.lit("g"), F.lit(None).cast("string"), F.array(F.lit("p")), F.lit("中等"))).first()[0]
    assert json.loads(topic) == {"title": "t", "grade": "g", "knowledge_points": ["p"], "class_level": "中等", "template_style": "A"}


def test_json_store(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"metadata": [{"id": "a", "content": "c", "difficulty": 2, "source_meta": {"year": 2020}, "embedding": [0.5]}, {"id": "b"}]}))
    rows = exchange.read_json_store(spark, str(tmp_path / "s.json")).orderBy("seq").collect()
    assert [(r.seq, r.id, r.difficulty) for r in rows] == [(0, "a", 2), (1, "b", None)] and rows[0].source_meta.year == 2020 and rows[0].embedding == [0.5]
    exchange.write_json_store(exchange.read_json_store(spark, str(tmp_path / "s.json")), str(tmp_path / "whole"))
    again = exchange.read_json_store(spark, str(tmp_path / "whole"))
    assert again.collect() == exchange.read_json_store(spark, str(tmp_path / "s.json")).collect()
    exchange.write_json_lines(exchange.read_json_store(spark, str(tmp_path / "s.json")), str(tmp_path / "lines"))
    assert exchange.read_json_lines(spark, str(tmp_path / "lines")).where("id = 'a'").first().source_meta.year == 2020


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a/1", "x"), ("b", None)], "n string, t string")
    assert exchange.export(df, str(tmp_path / "out"), "n", "t") == 2
    assert {r.name: r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {"a_1": "x", "b": ""}
    links = spark.createDataFrame([("/images/a/1.png",), ("no.png",), (None,)], "path string")
    files = spark.createDataFrame([("/z/1.png",), ("/y/1.png",)], "path string")
    assert {r.path: r.resolved for r in exchange.resolved_images(links, files).collect()} == {"/images/a/1.png": "/y/1.png", "no.png": None, None: None}
