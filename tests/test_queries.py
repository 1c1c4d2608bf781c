"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from tablework import registry
from tests import oracle

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = registry.QUERIES, registry.ORACLES

@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_entry_has_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["p_partkey", "old_value", "new_value"] and rows.count() > 0


def test_copy_plan_has_every_document(con):
    """No document is left out, and every action occurs."""
    sql = SQL["copy_plan_books"]
    books = con.execute("select count(*) from (select distinct lang, source, doc_id // 64 from documents)").fetchone()[0]
    assert con.execute(f"select count(*), count(distinct action) from ({sql})").fetchone() == (books, 4)
