"""Queries on small tables of odd rows, against their SQL."""

import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF, rows
from tidewire.plans import registry


@pytest.fixture()
def against_sql(spark, tmp_path):
    """Runs a query and its SQL over the smallest tables, of which some are replaced by the given ones."""

    def run(name: str, **tables):
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            (tmp_path / p.name).symlink_to(p) if p.stem not in tables else tables[p.stem].write.parquet(str(tmp_path / p.name))
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{tmp_path / p.name}{'/*.parquet' if p.stem in tables else ''}'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
        return got

    return run


def test_word_places_one_mark_apart(spark, against_sql):
    texts = ["the", "say the the the", "THE-the,the.The", "the\nthe  the", "x the\nthe", "breathe the, the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    against_sql("word_places", documents=docs)


def test_event_clusters_rounds_halves_as_sql(spark, against_sql):
    orders = spark.createDataFrame([(k, k, datetime.datetime(1995, 1, k)) for k in range(1, 21)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").withColumns({"o_orderstatus": F.lit("O"), "o_totalprice": F.lit(1.0), "o_orderpriority": F.lit("1-URGENT")})
    customers = spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey <= 20").withColumn("c_acctbal", F.element_at(F.array(*map(F.lit, [2885.5, 6456.5, -6113.5, 246.5, -0.5])), (F.col("c_custkey") % 5 + 1).cast("int")))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey <= 20")
    against_sql("event_clusters", orders=orders, customer=customers, lineitem=lines)
