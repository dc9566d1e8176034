"""Joins with heavy keys, and overlaps of sets, against plain joins and loops."""

import datetime
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidewire.operators import clustering, events, linking, overlap, search, skew


@pytest.fixture()
def plain_shuffles(spark):
    """Joins are shuffled and their partitions left as they are."""
    set_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def uneven(spark, n, other=400):
    """A third of the rows have key 0, a tenth key 1."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, 1).otherwise(2 + F.col("id") % other)
    return spark.range(n).select(key.alias("key"), F.col("id").alias("x"))


def test_a_third_of_the_rows_on_one_key_is_spread(spark, plain_shuffles):
    left, right = uneven(spark, 60_000), spark.range(500).select(F.col("id").alias("key"), F.lit("y").alias("y"))
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    plain, split = sizes(left.join(right, "key")), sizes(skew.split_join(left, right, ["key"]))
    assert sum(plain) == sum(split) == 60_000
    assert max(plain) > 6 * median(plain) and max(split) <= 3 * median(split)


def test_both_sides_heavy(spark, plain_shuffles):
    left, right = uneven(spark, 900), uneven(spark, 600, 50).withColumnRenamed("x", "y")
    found = skew.heavy_keys(left, right, ["key"], 24)
    a, b = found[left.filter("key = 0").select(F.xxhash64("key")).first()[0]]
    assert a == b == 10  # a hundred cells on 24 partitions
    got, want = skew.split_join(left, right, ["key"]), left.join(right, "key")
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_null_keys_two_columns_repeated_rows_and_empty_sides(spark):
    left = spark.createDataFrame([(None, 1, "n"), (1, None, "n"), *[(1, 1, "a")] * 5, (2, 1, "b")], "k long, j int, v string")
    right = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (None, 1, 12), (2, 2, 13)], "k long, j int, w int")
    for heavy in (None, {}, {left.filter("v = 'a'").select(F.xxhash64("k", "j")).first()[0]: (3, 2)}):
        got = skew.split_join(left, right, ["k", "j"], heavy=heavy)
        assert sorted(map(tuple, got.collect())) == sorted([(1, 1, "a", 10)] * 5 + [(1, 1, "a", 11)] * 5)
    assert skew.split_join(left.limit(0), right, ["k", "j"]).count() == skew.split_join(left, right.limit(0), ["k", "j"]).count() == 0


def test_sketch_reaches_the_driver_bounded(spark):
    many = spark.range(200_000).select((F.col("id") % 20_000).alias("key"))
    assert skew.heavy_keys(many, many, ["key"], 8) == {}


@pytest.mark.parametrize("least", [1, 2, 4])
def test_overlapping_sets_are_met_once(spark, least):
    rng = random.Random(least)
    sets = {i: {0, *(rng.randrange(30) for _ in range(rng.randrange(8)))} for i in range(80)}  # all hold item 0
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s for _ in range(rng.randrange(1, 3))], "id long, x long")
    held = overlap.ordered_sets(rows, ["id"], "x")
    assert {r["id"]: set(r["items"]) for r in held.collect()} == sets
    t, o = (held.select(F.col("id").alias(n), F.col("items").alias(i)) for n, i in (("target", "t_items"), ("other", "o_items")))
    got = [(r["target"], r["other"], r["shared"]) for r in overlap.overlapping(t, o, least).collect()]
    want = [(i, j, len(a & b)) for i, a in sets.items() for j, b in sets.items() if len(a & b) >= least]
    assert sorted(got) == sorted(want)


def test_an_item_of_every_set_makes_no_pairs(spark):
    rows = spark.range(2000).select(F.col("id"), F.explode(F.array(F.lit(-1), F.col("id"))).alias("x"))
    held = overlap.ordered_sets(rows, ["id"], "x")
    t, o = (held.select(F.col("id").alias(n), F.col("items").alias(i)) for n, i in (("target", "t_items"), ("other", "o_items")))
    met = overlap.overlapping(t, o, 2)
    assert sorted((r["target"], r["other"]) for r in met.collect()) == [(i, i) for i in range(2000)]  # each is met on its own item alone


def articles(spark, seed, n=60):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=rng.randrange(200)), rng.randrange(12), [0, *(rng.randrange(25) for _ in range(rng.randrange(6)))]) for i in range(n)]
    df = spark.createDataFrame(rows, "article_id long, effective_at timestamp, title_hash long, items array<long>")
    return rows, df, df.select("article_id", "effective_at", F.explode("items").alias("entity_id"))


@pytest.mark.parametrize("seed", range(3))
def test_story_candidates_are_those_of_a_loop(spark, seed):
    rows, df, long = articles(spark, seed)
    for least, cap, got in ((2, 5, clustering.candidates_by_rule(long, df, cap=5)), (4, 3, clustering.candidates_by_wording(long.withColumnRenamed("entity_id", "term"), cap=3))):
        want = set()
        for i, at, title, items in rows:
            near = [(j, len(set(items) & set(x)), abs(at - t)) for j, t, h, x in rows if j != i and abs(at - t) <= datetime.timedelta(hours=48) and (len(set(items) & set(x)) >= least or (least == 2 and h == title))]
            near.sort(key=lambda r: (r[2], r[0]) if least == 2 else (-r[1], r[0]))
            want |= {(i, j) for j, *_ in near[:cap]}
        assert {(r["target"], r["other"]) for r in got.collect()} == want and got.count() == len(want)


def test_event_candidates_and_related_articles_with_a_heavy_key(spark, plain_shuffles):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    facts = spark.createDataFrame([(i, at(i), at(i + 5), [0, 1 + i % 7]) for i in range(90)], "cluster_id long, first timestamp, last timestamp, entities array<long>")
    known = spark.createDataFrame([(e, at(e * 10), at(e * 10 + 8)) for e in range(9)], "event_id long, first timestamp, last timestamp")
    named = spark.createDataFrame([(e, x) for e in range(9) for x in (0, 1 + e % 7)], "event_id long, entity_id long")
    got = {(r["cluster_id"], r["event_id"]) for r in events.event_candidates(facts, known, named).collect()}
    assert got == {(i, e) for i in range(90) for e in range(9) if i % 7 == e % 7 and e * 10 - (i + 5) <= 72 and i - (e * 10 + 8) <= 72}
    docs = spark.createDataFrame([(i, f"common word{i % 9} term{i % 9} name{i % 9} place{i % 9} thing{i % 9}") for i in range(90)], "article_id long, text string")
    found = search.related(search.postings(docs, {"text": 1.0}), 90, docs.filter("article_id < 3"), least=5)
    assert {(r["target"], r["other"]) for r in found.collect()} == {(i, j) for i in range(3) for j in range(90) if i != j and i % 9 == j % 9}


def stories_in_time(spark, seed, n=120):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    rows = []
    for i in range(n):
        first = rng.randrange(3000)
        rows.append((i, at(first), at(first + rng.choice([2, 50, 2500])), sorted({0, *(rng.randrange(9) for _ in range(rng.randrange(5)))}) if i % 11 else None))
    return rows, spark.createDataFrame(rows, "cluster_id long, first timestamp, last timestamp, entities array<long>")


def newest_by_a_loop(rows, most):
    reach, want = datetime.timedelta(hours=72), set()
    for i, first, last, items in rows:
        near = [(-(z - datetime.datetime(2024, 1, 1)).total_seconds(), j, len(set(items) & set(x))) for j, a, z, x in rows if i != j and items and x and a - last <= reach and first - z <= reach and len(set(items) & set(x)) >= 2]
        want |= {(i, j, n) for _, j, n in sorted(near)[:most]}
    return want


@pytest.mark.parametrize(("first_others", "most_cells"), [(4, 1 << 20), (4, 60), (16, 0), (1000, 1 << 20)])
def test_newest_event_candidates_by_slabs(spark, monkeypatch, first_others, most_cells):
    monkeypatch.setattr(events, "CAP", 7)
    rows, facts = stories_in_time(spark, first_others)
    got = events.candidates(facts, first_others=first_others, most_cells=most_cells)
    assert sorted(map(tuple, got.collect())) == sorted(newest_by_a_loop(rows, 7))


def test_stories_that_all_meet_make_no_pairs_of_all(spark, monkeypatch):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start, start + datetime.timedelta(hours=i), [1, 2, 3]) for i in range(700)]
    facts = spark.createDataFrame(rows, "cluster_id long, first timestamp, last timestamp, entities array<long>")
    monkeypatch.setattr(events, "_met", lambda *_: pytest.fail("all pairs are joined"))
    got = events.candidates(facts.repartition(3)).collect()
    assert {(r["target"], r["other"]) for r in got} == {(i, j) for i in range(700) for j in [j for j in range(699, 0, -1) if j != i][:50]}


def test_event_scores_with_and_without_a_broadcast(spark):
    _, facts = stories_in_time(spark, 5)
    facts = facts.withColumn("country", F.when(F.col("cluster_id") % 3 > 0, F.concat(F.lit("c"), (F.col("cluster_id") % 3).cast("string"))))
    weights = spark.createDataFrame([(e, 1.0 / (e + 1)) for e in range(8)], "entity_id long, weight double")  # 8 has none
    pairs = events.candidates(facts)
    plain, shuffled = (sorted(map(tuple, events.score(pairs, facts, weights, most_cells=m).collect())) for m in (1 << 20, 0))
    f = {r["cluster_id"]: r for r in facts.collect()}
    w = {e: 1.0 / (e + 1) for e in range(8)}
    want = []
    for r in pairs.collect():
        x, y = f[r["target"]], f[r["other"]]
        a, b = ({e for e in s["entities"] if e in w} for s in (x, y))
        gap = max((y["first"] - x["last"]).total_seconds(), (x["first"] - y["last"]).total_seconds(), 0)
        both = sum(w[e] for e in a & b)
        if a & b:
            want.append((r["target"], r["other"], round(0.25 * max(0, 1 - gap / 259200) + 0.4 * both / (sum(w[e] for e in a | b)) + 0.15 * (x["country"] is not None and x["country"] == y["country"]), 6)))
    assert plain == shuffled and [x[:2] for x in plain] == [x[:2] for x in sorted(want)]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(plain, sorted(want), strict=True))


def sent_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, lists = context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util
    stages = context._jsc.sc().statusStore().stageList(lists.ArrayList(), False, False, none, lists.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_stories_of_one_title_are_met_once_an_event(spark, plain_shuffles):
    n, start = 1200, datetime.datetime(2024, 1, 1)
    rows = [(i % 3, i, start, start, "c", [i, -i - 1], ["news", f"w{i % 4}" if i < n - 1 else "alone"]) for i in range(n)]
    stories = spark.createDataFrame(rows, "event_id long, cluster_id long, first timestamp, last timestamp, country string, entities array<long>, tokens array<string>")
    known = stories.groupBy("event_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("country").alias("country"))
    pairs = stories.select("cluster_id").crossJoin(known.select("event_id"))
    weights = spark.createDataFrame([(0, 1.0)], "entity_id long, weight double")
    before = sent_rows(spark)
    got = {(r["cluster_id"], r["event_id"]): (r["entities"], r["title"]) for r in events.score_events(pairs, stories, known, weights).collect()}
    assert sent_rows(spark) - before < 300_000  # the pairs of stories are 1,440,000
    assert len(got) == 3 * n and {x for x, _ in got.values()} == {0.0}
    assert {k: t for k, (_, t) in got.items() if t < 1} == {(n - 1, e): 0.333333 for e in range(3)}


def test_link_candidates_of_many_names_are_scored_where_they_meet(spark, plain_shuffles):
    rng = random.Random(4)
    tongue, kinds = ["l0", "l1", "l2", None], ["A", "B", None]
    roots = [(i, rng.choice(kinds), rng.choice(tongue)) for i in range(60)]
    names = [(i, k, h, rng.choice(tongue), rng.choice(["x", "y", "z", None])) for i, k, h in roots for _ in range(rng.randrange(1, 4))]
    labels = [(q, rng.choice(tongue), rng.choice(["x", "y", "z", None]), rng.choice([True, False, None])) for q in range(60) for _ in range(rng.randrange(1, 4))]
    items = [(q, rng.choice(kinds), rng.choice([0, 5, 900])) for q in range(55)]
    n, l, i = (spark.createDataFrame(*x) for x in ((names, "entity_id long, kind string, home string, language string, folded string"), (labels, "qid long, language string, folded string, is_label boolean"), (items, "qid long, kind string, sitelinks long")))
    for x, name in ((n, "names"), (l, "labels"), (i, "items")):
        x.createOrReplaceTempView(f"t_{name}")
    want = spark.sql("""SELECT g.*, g_kind = t.kind AS fits FROM (SELECT entity_id, t_names.kind AS g_kind, qid, coalesce(bool_or(language = home AND is_label), false) AS label, coalesce(bool_or(language = home AND NOT is_label), false) AS alias, coalesce(bool_or(language <> home AND is_label), false) AS variant
        FROM t_names JOIN t_labels USING (language, folded) GROUP BY 1, 2, 3) g JOIN t_items t USING (qid) WHERE label OR alias OR variant""").collect()
    got = linking.score_candidates(n, l, i).collect()
    assert sorted((r["entity_id"], r["qid"], r["label_match"], str(r["type_match"])) for r in got) == sorted((r["entity_id"], r["qid"], r["label"], str(r["fits"])) for r in want)
    assert len(got) > 150


def test_link_pairs_are_not_shuffled(spark, plain_shuffles):
    n = spark.range(900).selectExpr("id AS entity_id", "'A' AS kind", "'l' AS home", "'l' AS language", "'x' AS folded")
    l = spark.range(900).selectExpr("id AS qid", "'l' AS language", "'x' AS folded", "true AS is_label")
    before = sent_rows(spark)
    got = linking.score_candidates(n, l, spark.range(900).selectExpr("id AS qid", "'A' AS kind", "0 AS sitelinks"))
    assert got.count() == 810_000 and sent_rows(spark) - before < 300_000


@pytest.mark.parametrize("most_terms", [0, 1 << 20])
def test_related_articles_with_and_without_a_broadcast(spark, most_terms):
    rng = random.Random(7)
    texts = [" ".join(f"word{rng.randrange(25)}" for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "article_id long, text string")
    got = search.related(search.postings(docs, {"text": 1.0}), 60, docs.filter("article_id < 9"), k=10, most_terms=most_terms)
    whole = search.distinctive(search.postings(docs, {"text": 1.0}), 60, 10).filter("article_id < 9").collect()
    want = {}
    for r in whole:
        for j, x in enumerate(texts):
            if j != r["article_id"] and r["term"] in x.split():
                want.setdefault((r["article_id"], j), []).append(r["weight"])
    found, want = {(r["target"], r["other"]): (r["shared"], r["score"]) for r in got.collect()}, {p: (len(w), sum(w)) for p, w in want.items() if len(w) >= 5}
    assert found.keys() == want.keys() and all(found[p][0] == n and abs(found[p][1] - s) < 2e-6 for p, (n, s) in want.items())


def test_articles_that_share_too_little_make_no_pairs(spark, plain_shuffles):
    docs = spark.range(500).selectExpr("id AS article_id", "concat('alpha beta gamma delta own', id) AS text")
    posting, before = search.postings(docs, {"text": 1.0}), sent_rows(spark)
    found = search.related(posting, 500, docs.filter("article_id < 300"), least=5)
    assert found.count() == 0 and sent_rows(spark) - before < 40_000  # 300 x 499 pairs share four words
