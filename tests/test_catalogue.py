import pytest

import __spark_entry__ as entry
from inkstone.plans import catalogue
from tests.compare import connection, differing

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert differing(spark, sf, catalogue.queries()[name], SQL[name], duck) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_without_sql(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_empty_tables(spark, sf, tmp_path):
    """Every query runs on tables without rows."""
    for name in ("questions", "incoming_records", "scanned_records", "assignment_rows", "import_history", "documents", "embeddings", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in catalogue.queries().items():
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) <= 1, name
