"""Every registered query of the main library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewire.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_points_without_the_text_subpackage(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_whole_queries_read_all_rows(spark):
    from tidewire.sources import archive as A

    run = lambda name: registry.QUERIES[name](spark, SF)
    assert run("ingestion_timeline_whole").selectExpr("sum(n)").first()[0] == A.fetches(spark, SF).count()
    assert run("relation_problems_whole").count() == A.table(spark, SF, "orders").count()
    gone = A.articles(spark, SF).filter("article_id % 9 = 0").count()
    assert run("changed_members_whole").filter("new IS NULL AND old IS NOT NULL").count() == gone > 0
