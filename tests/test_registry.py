"""Registered queries against their SQL twins on the smallest data set (skipped where it is absent)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, rows_of
from serploom.sinks.outputs import write_documents

SF = "/root/testdata/sf0.001"


def names(part, of=2):
    """Every query that has a twin, dealt to test files; those of the corpus have their own tests."""
    listed = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")
    return listed[part::of]


def compared(spark, name):
    """Rows of a query and of its twin."""
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    return rows_of(df.columns, got), rows_of(columns, want.fetchall())


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", names(0))
def test_query_equals_its_twin(spark, name):
    got, want = compared(spark, name)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents_from_payloads_are_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "documents")
    write_documents(entry.queries()["payload_documents"](spark, SF), path, files=3)
    written = spark.read.parquet(path)
    assert len(list((tmp_path / "documents").glob("part-*"))) == 3
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = dict(con.execute(entry.oracle_sql()["payload_documents"]).fetchall())
    assert {r.query_id: r.document for r in written.collect()} == want
    # writing again replaces what was there
    write_documents(spark.createDataFrame([(1, "{}")], "query_id bigint, document string"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "{}")]


def test_registry_needs_no_session():
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
