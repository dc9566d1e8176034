"""Tables that streams change bucket by bucket: files, reruns, removal, stories and watches."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewire.operators import clustering, monitors
from tidewire.streaming import streams, tables

SCHEMA = "id long, v string"


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet") if "data" in p.parts}


@pytest.fixture()
def table(spark, tmp_path):
    t = tables.BucketTable(spark, str(tmp_path / "t"), ["id"], SCHEMA, buckets=8)
    t.apply(0, spark.range(400).select("id", F.lit("a").alias("v")))
    return t


def held(t):
    return {r["id"]: r["v"] for r in t.read().collect()}


def test_a_batch_writes_the_buckets_that_it_touches(spark, table):
    before, was = files(table.path), table.manifest()
    changed = spark.createDataFrame([(3, "b"), (1000, "b")], SCHEMA)
    at = table.apply(1, changed)
    new = files(table.path) - before
    assert len(at) <= 2 and len(new) == len(at) and all("/v1/" in f for f in new)
    assert held(table) == {i: "a" for i in range(400)} | {3: "b", 1000: "b"}
    now = table.manifest()
    assert {b for b in now if now[b] != was[b]} == set(at)
    assert {r["id"] for r in table.read(at).collect()} >= {3, 1000} and len(table.read(at).collect()) < 401


def test_old_versions_are_removed_and_the_one_before_can_be_read(spark, table):
    for n in range(1, 6):
        table.apply(n, spark.createDataFrame([(7, f"v{n}")], SCHEMA))
    assert table.versions() == [4, 5] and held(table)[7] == "v5"
    assert {r["v"] for r in table.read(version=4).filter("id = 7").collect()} == {"v4"}
    assert len({f for f in files(table.path) if "/v" in f}) == 8 + 1  # a file a bucket, and the one that version 4 alone uses


def test_rows_are_taken_out_and_a_bucket_may_become_empty(spark, table):
    keys = spark.range(400).filter("id > 1").select("id")
    table.apply(1, spark.createDataFrame([(1, "z")], SCHEMA), keys)
    assert held(table) == {0: "a", 1: "z"} and len(table.manifest()) <= 2
    table.apply(2, spark.createDataFrame([], SCHEMA))
    assert held(table) == {0: "a", 1: "z"}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(j, f"b{i}") for j in range(i, i + 4)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    t = tables.BucketTable(spark, f"{tmp_path}/t", ["id"], SCHEMA, buckets=4)
    seen = []
    t.fold(stream(), lambda t, batch: (seen.append(1), batch)[1])
    want, before = held(t), files(t.path)
    assert len(seen) == 3 and t.versions() == [2, 3] and set(want) == set(range(6))
    tables.remove(spark, f"{t.path}/state")  # the stream's own notes are lost: all batches come again
    t.fold(stream(), lambda t, batch: (seen.append(1), batch)[1])
    assert len(seen) == 3 and held(t) == want and files(t.path) == before


def article(rng, i):
    at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(150))
    title = rng.choice(["a b c", "d e f", "g h", "a b d"])
    return i, at, title, title.split(), sorted({rng.randrange(12) for _ in range(rng.randrange(5))}), [rng.randrange(9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stories_in_buckets_are_those_of_the_whole_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema = ", ".join(streams.ARTICLES.split(", ")[:6])
    ids = list(range(30))
    for i in range(3):
        batch = [article(rng, j) for j in [*ids[i * 10 : i * 10 + 10], *rng.sample(ids[: i * 10], 2 * bool(i))]]  # some articles come again, changed
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    t = tables.BucketTable(spark, f"{tmp_path}/t", ["article_id"], streams.ARTICLES, buckets=8)
    whole = None
    for i in range(3):
        batch = spark.read.schema(schema).parquet(f"{tmp_path}/in/{i}")
        whole = clustering._kept(clustering.fold_articles(whole, batch))
        t.apply(i, clustering.article_changes(t.read(), batch))
        row = lambda df: sorted((r["article_id"], r["cluster_id"], r["score"]) for r in df.collect())
        assert row(t.read()) == row(whole)
    assert len({r["cluster_id"] for r in whole.collect()}) > 2


def test_watches_as_matches_arrive(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    batches = [[(1, 10, 100, at(1)), (2, 10, 100, at(1))], [(1, 11, 100, at(2)), (1, 12, 101, at(3)), (1, 10, 100, at(1))], [(2, 13, 102, at(5))], [(1, 14, 100, at(6))]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, streams.MATCHES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    matches = tables.BucketTable(spark, f"{tmp_path}/m", ["monitor_id", "article_id"], streams.MATCHES, 4, by=["monitor_id"])
    watches = tables.BucketTable(spark, f"{tmp_path}/w", ["monitor_id"], streams.WATCHES, 4)
    start = spark.createDataFrame([(i, None, at(1), 0, 0, 0, None) for i in (1, 2, 3)], streams.WATCHES)  # last looked at an hour in
    watches.start(start)
    stream = spark.readStream.schema(streams.MATCHES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.keep_watches(stream, matches, watches)
    got = {r["monitor_id"]: (r["eval_cursor_at"], r["unseen_articles"], r["unseen_stories"], r["new_articles"]) for r in watches.read().collect()}
    # the first evaluation is a baseline; then three new articles of two stories for watch 1 (the last of them new in its own batch), one for watch 2
    assert got == {1: (at(6), 3, 2, 1), 2: (at(5), 1, 1, 1), 3: (None, 0, 0, 0)}
    every = matches.read()
    assert every.count() == 6
    again = monitors.evaluate(every, watches.read().select("monitor_id", F.lit(at(1)).alias("eval_cursor_at"), "viewed_cursor_at"), str(at(6)))
    assert {r["monitor_id"]: r["unseen_articles"] for r in again.collect()}[1] == 3
