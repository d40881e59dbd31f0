"""Every registered web-capture query gives the rows that its SQL gives."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lakeweave import queries, queries_batch, queries_content, queries_live, queries_media, queries_varied  # noqa: F401


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def plain(v: object) -> str:
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(int(v))
        if isinstance(v, float) and not v.is_integer():
            return f"{v:.6f}"
        return str(int(v)) if not isinstance(v, str) and hasattr(v, "__int__") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_rows_equal_those_of_sql(spark, data, oracle, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name not in queries.SQL:
        assert len(got) > 0
        return
    want = oracle.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["page_id", "url", "text", "n_items"]
