"""The queries of the training-data operators, beside SQL where there is some."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import canon
from lodestrata.llm import queries as Q


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, data, sql, name):
    got = Q.QUERIES[name](spark, data).toPandas()
    if name in Q.ORACLES:
        a, b = canon(got), canon(sql.execute(Q.ORACLES[name]).fetchdf())
        assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head().to_string()
    else:
        assert len(got.columns) and not canon(got).duplicated().any()
