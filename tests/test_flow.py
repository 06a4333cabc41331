"""Store versions, the whole ingest, the handout, and the stream."""

import pytest
from pyspark.sql import functions as F

from inkstone.functions.providers import HashEmbedding, asked
from inkstone.plans.ingest import build_handout, extracted, ingest
from inkstone.plans.canned import Canned
from inkstone.sources import logs
from inkstone.sources.documents import PlainText, files, flattened, pages, read_pages
from inkstone.sources.store import Store, open_store
from inkstone.streaming.arrivals import counts_by_time, watch

PAPER = "2023年青坡市高一期中考试数学试卷\n" + "\n".join(f"{i}. 已知集合A={{1,{i}}}，求集合A的子集个数，并说明理由和全部过程{i * 7}" for i in range(1, 6))


def test_store_versions(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    assert st.read().count() == 0
    meta = F.expr("named_struct('region', 'r', 'year', 2020, 'grade', 'g', 'exam_name', 'e', 'source_type', 't')")
    rows = spark.range(5).select(F.col("id").alias("seq"), F.concat(F.lit("k"), F.col("id") % 3).alias("id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), meta.alias("source_meta"))
    assert st.append(rows) == {"total_input": 5, "added": 3, "skipped_existing": 2}
    assert st.append(rows)["added"] == 0
    with pytest.raises(ValueError):
        st.append(rows.select((F.col("seq") + 10).alias("seq"), F.lit("new").alias("id"), F.array(F.lit(1.0)).alias("embedding")))
    assert st.read().count() == 3
    assert st.delete({"region": "r", "id": "k0"})["matched"] == 1 and st.read().count() == 3
    st.delete({"id": "k0"}, dry_run=False)
    assert {r.id for r in st.read().collect()} == {"k1", "k2"} and st.read(st.versions()[0]).count() == 3
    with pytest.raises(ValueError):
        st.delete({})
    base = st._latest()
    assert st._publish([], base) and st.read().count() == 0
    with pytest.raises(RuntimeError):  # a second writer after the same version
        st._publish([], base)
    st._publish(st.parts(base), st._latest())
    assert st.reset()["deleted"] == 2 and st.read().count() == 0


def test_ingest_twice(spark, tmp_path):
    docs = spark.createDataFrame([("h1", PAPER), ("h2", "no records"), ("h3", None)], "doc_hash string, text string")
    rows = extracted(docs).orderBy("doc_hash", "place").collect()
    assert len(rows) == 5 and {(r.source_meta.year, r.source_meta.grade, r.source_meta.source_type) for r in rows} == {(2023, "高一", "期中")}
    st = Store(spark, str(tmp_path / "s"))
    counts, report, bad = ingest(docs, st, HashEmbedding(32))
    r = report.first()
    assert counts["added"] == 5 == r.after_similarity and bad.count() == 0
    counts, report, bad = ingest(docs, st, HashEmbedding(32))
    assert counts["added"] == 0 and report.first().db_existing_id == 5 == bad.count() and st.read().count() == 5
    st2 = st.read().withColumn("knowledge_points", F.array(F.lit("集合")))
    text = build_handout(st2, "集合", ["集合"], HashEmbedding(32)).first().markdown
    assert text.startswith("# 集合") and "**例1**" in text and "**练习1**" in text


def test_ingest_with_provider(spark, tmp_path):
    """Records, metadata and points by a provider; records of different documents keep apart; each import is logged."""
    docs = spark.createDataFrame([("h1", PAPER, "/a/p1.pdf"), ("h2", PAPER + "\n9. 另一份试卷的题目，求函数的值域和最大值，并说明理由", "p2.pdf"), ("h3", None, None)], "doc_hash string, text string, path string")
    st, log = Store(spark, str(tmp_path / "s")), str(tmp_path / "log")
    counts, report, bad = ingest(docs, st, HashEmbedding(16), provider=Canned(), log=log)
    rows = st.read().collect()
    assert counts["added"] == len(rows) == report.first().after_similarity and {r.doc_hash for r in rows} == {"h1", "h2"}
    assert len({r.seq for r in rows}) == len(rows) and any("补回" in r.content for r in rows) and any("函数" in r.knowledge_points for r in rows)
    events = {r.pdf_hash: r for r in logs.read(spark, log).collect()}
    assert set(events) == {"h1", "h2", "h3"} and events["h1"].pdf_filename == "p1.pdf" and events["h3"].added == 0
    assert sum(r.added for r in events.values()) == len(rows) == events["h1"].vector_db_total and events["h1"].ts.endswith("Z")
    ingest(docs, st, HashEmbedding(16), provider=Canned(), log=log)
    assert st.read().count() == len(rows) and logs.read(spark, log).count() == 6
    last = st.read().agg(F.max("seq")).first()[0]
    more = docs.limit(1).withColumn("doc_hash", F.lit("h0"))
    ingest(more, st, HashEmbedding(16), similarity=False)
    assert st.read().where("doc_hash = 'h0'").agg(F.min("seq")).first()[0] > last


def test_upsert_and_backends(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "w")], "id string, seq bigint, content string")
    st = open_store(spark, str(tmp_path / "p"))
    assert st.upsert(rows) == {"total_input": 4, "added": 3, "skipped_existing": 1} and st.upsert(rows.where("id = 'a'"))["added"] == 0
    assert {(r.id, r.content) for r in st.read().collect()} == {("a", "y"), ("b", "z"), ("q4", "w")}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "metadata.json").write_text('{"metadata": [{"id": "k", "content": "c"}]}')
    for _ in range(2):
        assert [r.id for r in open_store(spark, str(tmp_path / "j"), "json").read().collect()] == ["k"]
    with pytest.raises(ValueError):
        open_store(spark, str(tmp_path), "other")


def test_native_or_scanned(spark):
    docs = spark.createDataFrame([("a", bytearray(("题目" * 80).encode())), ("b", bytearray(b" . "))], "doc_hash string, content binary")
    got = {r.doc_hash: r.content for r in read_pages(docs, PlainText(), Recognised()).collect()}
    assert got == {"a": "题目" * 80, "b": "读出的 . "}


class Recognised:
    def pages(self, content):
        return ["读出的" + content.decode()]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_text("页一\f页二")
    (tmp_path / "in" / "b.txt").write_text("x")
    got = files(spark, str(tmp_path / "in"))
    assert got.count() == 1 and flattened(pages(got, PlainText())).first().text == "--- 第 1 页 ---\n页一\n--- 第 2 页 ---\n页二"
    (tmp_path / "in" / "c.pdf").write_text(PAPER)
    st = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        q = watch(spark, str(tmp_path / "in"), st, str(tmp_path / "c"), embedding=HashEmbedding(16))
        q.awaitTermination(120)
        assert st.read().count() == 5


def test_stream_counts(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/incoming_records.parquet").select("batch_no", "arrived_at")
    rows.write.parquet(str(tmp_path / "arrivals"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "arrivals"))
    q = counts_by_time(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from arrivals").first()[0] == rows.where("arrived_at is not null").count()


class Echo:
    def generate(self, prompts):
        if "bad" in prompts:
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]


def test_provider(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    assert {r.answer.value for r in asked(df, F.col("p"), Echo()).collect()} == {"A", "B"}
    assert {r.answer.error for r in asked(df.limit(1), F.lit("bad"), Echo()).collect()} == {"no answer"}
