"""The queries over the whole smallest tables, against the definitions, and over tables without rows."""

import pytest

from inkstone.llm import queries
from tests.compare import connection, differing
from tests.llm import brute
from tests.llm.test_typed import looks

ALL = queries.queries()


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


def pairs(spark, sf, name):
    return {tuple(r) for r in ALL[name](spark, sf).collect()}


def test_sql(spark, sf, duck):
    for name, sql in queries.oracle_sql().items():
        assert differing(spark, sf, ALL[name], sql, duck) is None


def test_near(spark, sf, duck):
    rows = duck.execute("select seq, content from questions order by seq").fetchall()
    assert pairs(spark, sf, "p3_found") == brute.groups(rows)
    old = duck.execute("select seq, id, content from questions").fetchall()
    new = duck.execute("select seq, id, content from incoming_records").fetchall()
    assert pairs(spark, sf, "p5_found") == brute.rejected(old, new)


def test_looks(spark, sf, duck):
    rows = duck.execute("select row_id, content from assignment_rows where content is not null order by row_id").fetchall()
    want = {(i, j) for n, (j, b) in enumerate(rows) for i, a in rows[:n] if a != b and looks(a) == looks(b)}
    assert pairs(spark, sf, "p4_found") == want


def test_documents(spark, sf, duck):
    docs = duck.execute("select doc_id, text from documents").fetchall()
    assert pairs(spark, sf, "p8_found") == brute.spans(docs)
    items = duck.execute("select item_id, text from eval_items").fetchall()
    assert pairs(spark, sf, "p7_found") == brute.leaks(docs, items)
    packed = ALL["p6_containers"](spark, sf).collect()
    assert sum(r.tokens for r in packed) == sum(len((t or "").encode()) for _, t in docs)


def test_values(spark, sf, duck):
    of = " union all ".join(f"select seq, '{f}' as field, source_meta.{f} as v from {t}" for f in ("region", "source_type", "grade") for t in ("questions", "incoming_records"))
    want = duck.execute(f"select seq, field from ({of}) where trim(v, ' 　') <> '' and (field, v) not in (select field, canonical from reference_values)").fetchall()
    got = ALL["p2_found"](spark, sf).collect()
    assert {(r.seq, r.field) for r in got} == set(want)
    assert {(r.seq, r.field) for r in got if not r.ref_id} == set(want) - {(r.seq, r.field) for r in got if r.ref_id}


def test_scanned(spark, sf, duck):
    got = ALL["p1_found"](spark, sf).collect()
    assert {r.kind for r in got} == {"header", "page_number", "hyphen", "misread"}
    alone = {(r.rec_id, r.line_no) for r in got if r.kind in ("header", "page_number")}
    assert all((r.rec_id, r.line_no) not in alone for r in got if r.kind in ("hyphen", "misread"))
    assert ALL["p1_text"](spark, sf).count() == duck.execute("select count(*) from scanned_records").fetchone()[0]


def test_empty_tables(spark, sf, tmp_path):
    for name in ("questions", "incoming_records", "scanned_records", "assignment_rows", "documents", "eval_items", "reference_values"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in ALL.items():
        assert query(spark, str(tmp_path)).count() == 0, name
