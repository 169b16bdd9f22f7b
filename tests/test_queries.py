"""Every query beside its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from compare import canon

LLM = {n for n in entry.queries() if n[0] == "p" and n[1].isdigit() and not n.startswith("p3_")}
NAMES = sorted(set(entry.queries()) - LLM)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, sql, name):
    got = entry.queries()[name](spark, data).toPandas()
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert len(got.columns)
        return
    want = sql.execute(oracle).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canon(got), canon(want)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head().to_string()


def test_entry(spark, data, monkeypatch):
    monkeypatch.setattr(entry, "SMOKE_DIR", data)
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
