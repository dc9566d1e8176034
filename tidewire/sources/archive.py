"""The archive's tables as views of the driver's tables, in Spark and (the same, for comparison) in SQL.

Orders stand for articles, line items for mentions and provenance, parts for entities, suppliers for feeds, customers for stories and
their nations for countries, and events for the history of fetches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = """
    articles AS (SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS published_at, o_orderdate + INTERVAL 1 DAY AS first_discovered_at,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS effective_at, o_custkey AS cluster_id, o_orderpriority AS language FROM orders),
    links AS (SELECT l_orderkey AS article_id, l_partkey AS entity_id, CAST(sum(l_quantity) AS BIGINT) AS occurrence_count, any_value(effective_at) AS effective_at, any_value(cluster_id) AS cluster_id
        FROM lineitem JOIN articles ON l_orderkey = article_id GROUP BY 1, 2),
    members AS (SELECT l_suppkey AS feed_id, l_orderkey AS article_id, min(l_shipdate) AS discovered_at, any_value(effective_at) AS effective_at, any_value(cluster_id) AS cluster_id
        FROM lineitem JOIN articles ON l_orderkey = article_id GROUP BY 1, 2),
    countries AS (SELECT article_id, n_name AS country FROM articles JOIN customer ON cluster_id = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    fetches AS (SELECT event_id AS fetch_id, user_id AS feed_id, ts AS started_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http' ELSE 'parse' END END AS error_category, CAST(floor(value) AS BIGINT) AS new_article_count, value AS duration_ms FROM events),
    texts AS (SELECT doc_id AS article_id, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS title, coalesce(text, '') AS text, lang AS language, source FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are UTC times (the session's zone is UTC)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = F.col("o_orderkey") % 7 != 0
    found = F.col("o_orderdate") + F.expr("interval 1 day")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.when(dated, F.col("o_orderdate")).alias("published_at"), found.alias("first_discovered_at"), F.when(dated, F.col("o_orderdate")).otherwise(found).alias("effective_at"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderpriority").alias("language"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of articles, one row each, with mention counts."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id")).agg(F.sum("l_quantity").cast("long").alias("occurrence_count"))
    return rows.join(articles(spark, sf_dir).select("article_id", "effective_at", "cluster_id"), "article_id")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that carried each article, with its story."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feed_id"), F.col("l_orderkey").alias("article_id")).agg(F.min("l_shipdate").alias("discovered_at"))
    return rows.join(articles(spark, sf_dir).select("article_id", "effective_at", "cluster_id"), "article_id")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("article_id", "cluster_id").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_nationkey").alias("n_nationkey")), "cluster_id")
    return rows.join(table(spark, sf_dir, "nation"), "n_nationkey").select("article_id", F.col("n_name").alias("country"))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    kind = F.when(F.col("event_id") % 3 == 0, "timeout").when(F.col("event_id") % 3 == 1, "http").otherwise("parse")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("fetch_id"), F.col("user_id").alias("feed_id"), F.col("ts").alias("started_at"), F.when(bad, "failed").otherwise("success").alias("status"), F.when(bad, kind).alias("error_category"), F.floor("value").alias("new_article_count"), F.col("value").alias("duration_ms"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(80)).alias("title"), text.alias("text"), F.col("lang").alias("language"), "source")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as feed entries: address, title and order of arrival."""
    rows = table(spark, sf_dir, "pages")
    return rows.select(F.col("page_id").alias("entry_id"), F.col("page_id").alias("seq"), "url", "html", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("page_id").cast("int"))).alias("published_at"))
