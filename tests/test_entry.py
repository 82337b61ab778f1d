import importlib
import os
import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {f"p{n}_found" for n in range(1, 7)} <= names


def test_core_does_not_need_the_llm_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sluice.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sluice.llm", None)
    fresh = importlib.reload(entry)
    assert not [n for n in fresh.queries() if n[:3] in ("p7_", "p8_", "p9_")] and "p1_found" in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_sql_agrees_on_the_small_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    c = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    for name, sql in entry.oracle_sql().items():
        df = entry.queries()[name](spark, SMALL)
        rel = c.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns), name
        cols = sorted(df.columns)
        ours = sorted(tuple(show(r[x]) for x in cols) for r in df.collect())
        at = [rel.columns.index(x) for x in cols]
        theirs = sorted(tuple(show(r[i]) for i in at) for r in rel.fetchall())
        assert ours == theirs, name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "period_id", "as_id", "rep_ord", "rep_id", "bandwidth", "rate"] and df.limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_namespaces_over_a_growing_table(spark):
    n = spark.read.parquet(f"{SMALL}/customer.parquet").count()
    assert n > 25 and entry.queries()["ns_registry_customers"](spark, SMALL).select("doc_id").distinct().count() == n
    assert {r.rule for r in entry.queries()["ns_violations_customers"](spark, SMALL).collect()} == {"prefix_rebinding", "uri_aliasing"}
