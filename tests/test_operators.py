"""Column functions, readers, streams and stateful operators on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import columns as C
from tidewire.operators import annotate, authority, catalogue, clustering, events, graph, ingest, linking, monitors, ranking, timelines
from tidewire.sources import feeds, lists
from tidewire.streaming import streams


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url,want", [
    ("HTTP://Example.COM:80/a?utm_source=x&b=2&a=1#top", "http://example.com/a?a=1&b=2"), ("https://e.org", "https://e.org/"), ("https://e.org:8443/x?fbclid=1", "https://e.org:8443/x"), ("/relative", None), ("mailto:a@b.c", None),
])
def test_normalize_url(spark, url, want):
    assert one(spark, C.normalize_url(F.col("u")), u=url) == want


@pytest.mark.parametrize("word,want", [("stories", "story"), ("classes", "class"), ("running", "run"), ("stopped", "stop"), ("houses", "hous"), ("bus", "bus"), ("falling", "fall"), ("glass", "glass")])
def test_stem(spark, word, want):
    assert one(spark, C.stem(F.col("w")), w=word) == want


def test_text_functions(spark):
    assert one(spark, C.plain_text(F.col("h")), h="<p>a&amp;b</p>\n <i>c</i>") == "a&b c"
    assert one(spark, C.main_text(F.col("h")), h="<nav>x</nav><p>one  two</p><script>y</script><div>three</div>") == "one two\nthree"
    assert one(spark, C.title_tokens(F.col("t"), ["the"]), t="The Big big-news 24 Ελλάδα") == ["24", "big", "news"]
    assert one(spark, C.highlight(F.col("t"), ["news"]), t="News of newsrooms") == "**News** of newsrooms"
    assert one(spark, C.title_hash(F.col("t")), t=" A  b ") == one(spark, C.title_hash(F.col("t")), t="a B")
    assert one(spark, C.initials(F.col("t")), t="European Central Bank") == "ecb"
    assert sorted(one(spark, C.trigrams(F.col("t")), t="cat")) == sorted(["  c", " ca", "cat", "at "])


def test_similarities(spark):
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))
    assert one(spark, C.jaccard(a, b)) == 0.5 and one(spark, C.jaccard(F.array().cast("array<string>"), b)) == 0.0
    at = lambda h: F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.lit(h))
    assert [round(one(spark, C.time_proximity(at(0), at(h))), 6) for h in (0, 24, 48, 60)] == [1.0, 0.5, 0.0, 0.0]
    assert one(spark, C.time_gap_seconds(at(0), at(2), at(1), at(5))) == 0 and one(spark, C.time_gap_seconds(at(0), at(2), at(3), at(5))) == 3600
    assert one(spark, C.term_weight(F.lit(1), F.lit(50))) == 1.0 and one(spark, C.term_weight(F.lit(200), F.lit(100))) == 0.0


@pytest.mark.parametrize("text,want", [("2009", True), ("2021-13", False), ("2021-10-28", True), ("2021-02-30", False), ("x", False)])
def test_partial_dates(spark, text, want):
    assert one(spark, C.partial_date_valid(F.col("t")), t=text) is want


def test_quiet_hours_pass_midnight(spark):
    at = F.lit("2024-01-01 23:30:00").cast("timestamp")
    assert one(spark, C.in_quiet_hours(at, "UTC", 22 * 3600, 6 * 3600)) is True
    assert one(spark, C.in_quiet_hours(at, "Europe/Athens", 22 * 3600, 1 * 3600)) is False


def test_spikes_need_seven_days_before(spark):
    def spikes(counts):
        rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), n) for i, n in enumerate(counts)]
        return [r["spike"] for r in timelines.with_spikes(spark.createDataFrame(rows, "bucket timestamp, n long")).orderBy("bucket").collect()]

    assert spikes([2] * 7 + [4, 3]) == [False] * 7 + [True, False]
    assert spikes([0] * 7 + [1]) == [False] * 7 + [True]
    assert spikes([1] * 6 + [9]) == [False] * 7


def test_interval_choice(spark):
    rows = spark.createDataFrame([(datetime.datetime(2020, 1, 1),), (datetime.datetime(2024, 1, 1),)], "at timestamp")
    assert timelines.choose_interval(rows, "at") == "month"
    with pytest.raises(ValueError, match="more than"):
        timelines.choose_interval(rows, "at", "hour")


def test_truncation_and_pages(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, n long")
    top = ranking.with_truncation(rows, [F.desc("n"), F.col("id")], 4).collect()
    assert [r["id"] for r in top] == [2, 5, 8, 1] and all(r["truncated"] for r in top)
    assert not ranking.with_truncation(rows, [F.col("id")], 9).first()["truncated"]
    page = ranking.keyset_page(rows, [("n", True), ("id", False)], [2, 5], 2).collect()
    assert [r["id"] for r in page] == [8, 1, 4]


def test_band_join_sees_both_sides_of_a_slot(spark):
    hours = [0, 47, 48, 49, 96, 200]
    rows = spark.createDataFrame([(i, "k", datetime.datetime(2024, 1, 1, 23) + datetime.timedelta(hours=h)) for i, h in enumerate(hours)], "article_id long, key string, effective_at timestamp")
    got = {(r["target"], r["other"]) for r in clustering.band_join(rows, rows, ["key"]).collect()}
    assert got == {(i, j) for i, a in enumerate(hours) for j, b in enumerate(hours) if i != j and abs(a - b) <= 48}


def test_components_and_reach(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (22, 21)], "target long, other long")
    got = {r["node"]: r["root"] for r in clustering.components(pairs).collect()}
    assert got == dict.fromkeys(range(1, 10), 1) | dict.fromkeys((20, 21, 22), 20)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    assert {r["node"]: r["steps"] for r in authority.reach(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_communities_split_at_a_weak_link(spark):
    rows = [(1, 2, 9), (1, 3, 9), (2, 3, 9), (4, 5, 9), (4, 6, 9), (5, 6, 9), (3, 4, 1)]
    got = {r["node"]: r["label"] for r in graph.communities(spark.createDataFrame(rows, "a long, b long, weight long")).collect()}
    assert got[1] == got[2] == got[3] != got[4] == got[5] == got[6]


def test_merges_close_chains(spark):
    e = spark.createDataFrame([(1, None), (2, None), (3, 2), (4, None)], "entity_id long, authority_id long")
    got = {r["entity_id"]: r["root_id"] for r in authority.apply_merges(e, spark.createDataFrame([(2, 1), (1, 4)], "source long, target long")).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: 4}


def test_similar_names_is_all_pairs(spark):
    names = ["Angela Merkel", "Angela Merkels", "A Merkel", "Merkel Angela", "Emmanuel Macron", "Emanuel Macron", "Macron"]
    rows = spark.createDataFrame([(i, "P", n) for i, n in enumerate(names)], "entity_id long, kind string, name string")

    def grams(n):
        return {("  " + w + " ")[i : i + 3] for w in n.lower().split() for i in range(len(w) + 1)}

    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and len(grams(a) & grams(b)) >= 0.6 * len(grams(a) | grams(b))}
    assert {(r["a"], r["b"]) for r in authority.similar_names(rows).collect()} == want


def test_first_writer_keeps_the_id_and_latest_title_wins(spark):
    rows = spark.createDataFrame([("u", 7, 1, None, "old"), ("u", 8, 2, None, "new"), ("v", 9, 3, None, "x")], "normalized_url string, entry_id long, seq long, published_at timestamp, title string")
    assert {(r["normalized_url"], r["article_id"], r["title"]) for r in ingest.dedup_articles(rows).collect()} == {("u", 7, "new"), ("v", 9, "x")}


def test_input_document_sections(spark):
    a = spark.createDataFrame([(1, "T", "body"), (2, "U", None)], "article_id long, title string, text string")
    at = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([(2, 1, "Same", at), (2, 2, "same", at), (2, 3, "Other", at)], "article_id long, feed_id long, description string, discovered_at timestamp")
    got = {r["article_id"]: (r["text"], r["ends"]) for r in ingest.input_document(a, d).collect()}
    assert got == {1: ("T\n\nbody", [1, 7]), 2: ("U\n\nSame\n\nOther", [1, 7, 14])}


def test_first_watch_run_is_a_baseline(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    matches = spark.createDataFrame([(1, 10, 5, t(2)), (1, 11, 5, t(4)), (2, 10, 5, t(4))], "monitor_id long, article_id long, cluster_id long, enriched_at timestamp")
    watch = spark.createDataFrame([(1, t(3), t(1)), (2, None, None)], "monitor_id long, eval_cursor_at timestamp, viewed_cursor_at timestamp")
    got = {r["monitor_id"]: (r["unseen_articles"], r["new_articles"]) for r in monitors.evaluate(matches, watch, "2024-01-05").collect()}
    assert got == {1: (2, 1), 2: (0, 0)}


def test_read_feed(spark, tmp_path):
    path = tmp_path / "f.xml"
    path.write_text("""<rss><channel><item><guid>g1</guid><title>One</title><link>/a?x=1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
    <item><title></title><link>http://e.org/b</link></item></channel></rss>""")
    good, bad = feeds.read_feed(spark, str(path), "http://e.org/feed/rss.xml")
    r = good.first()
    assert (r["guid"], r["url"], r["description"], r["published_at"]) == ("g1", "http://e.org/a?x=1", "Hi", datetime.datetime(2024, 1, 2, 10)) and bad.count() == 1


def test_feed_links(spark):
    html = '<link rel="alternate" type="application/rss+xml" href="/rss"><link rel="alternate" type="application/atom+xml" href="https://x.y/atom"><link rel="alternate" type="application/rss+xml" href="/rss">'
    got = feeds.feed_links(spark.createDataFrame([(1, "https://e.org/p/q", html)], "page_id long, url string, html string")).orderBy("place").collect()
    assert [r["href"] for r in got] == ["https://e.org/rss", "https://x.y/atom"]


def test_export_is_safe_for_spreadsheets(spark):
    a = spark.createDataFrame([(1,)], "article_id long")
    s = spark.createDataFrame([(1, "=cmd"), (1, "b")], "article_id long, source string")
    e = spark.createDataFrame([(1, 2, "N", 3)], "article_id long, entity_id long, name string, occurrence_count long")
    assert feeds.export_articles(a, s, e).first()["sources"] == "'=cmd; b"


def test_streams(spark, tmp_path):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    for i, part in enumerate([[(1, t(0)), (1, t(1)), (2, t(2))], [(1, t(100)), (2, t(3))], [(9, t(400))], [(9, t(401))]]):
        spark.createDataFrame(part, "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{i}"))
    schema = "event_id long, ts timestamp"
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    days = spark.read.parquet(streams.run_to_table(streams.daily_counts(src(), "ts", ["event_id"])))
    assert {(r["day"], r["event_id"], r["n"]) for r in days.collect()} >= {(t(0), 1, 2), (t(0), 2, 2)}
    states = spark.read.parquet(streams.run_to_table(streams.closing(src(), "event_id", "ts"))).collect()
    assert {(r["event_id"], r["status"]) for r in states} >= {(1, "opened"), (1, "closed"), (1, "reopened"), (2, "opened"), (2, "closed")}
    once = spark.read.parquet(streams.run_to_table(streams.dedup(src(), "ts", ["event_id"], "30 days")))
    assert once.count() == 3
    newest = streams.upsert(src(), lambda old, new: ingest.newest_revision(new if old is None else old.unionByName(new), ["event_id"], F.col("ts")), str(tmp_path / "table"))
    assert {(r["event_id"], r["ts"]) for r in spark.read.parquet(newest).collect()} == {(1, t(100)), (2, t(3)), (9, t(401))}


def test_mentions_take_the_longest_first_and_names_of_any_length(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x one two three four five six y"), (3, "a b a b c d")], "article_id long, text string")
    names = spark.createDataFrame([(1, "a b"), (2, "b c d"), (3, "d e"), (4, "one two three four five six"), (5, "one two")], "entity_id long, folded string")
    got = sorted((r["article_id"], r["entity_id"], r["place"]) for r in annotate.mentions(docs, names).collect())
    assert got == [(1, 2, 1), (2, 4, 1), (3, 1, 0), (3, 2, 3)]


def test_highlights_keep_a_span_that_only_a_dropped_one_overlaps(spark):
    rows = [(1, 0, 10, "entity"), (1, 8, 17, "keyword"), (1, 15, 20, "keyword")]
    got = sorted((r["start"], r["stop"]) for r in catalogue.highlight_ranges(spark.createDataFrame(rows, "article_id long, start int, stop int, kind string")).collect())
    assert got == [(0, 10), (15, 20)]


def test_complete_counts_of_several_files_are_those_of_the_last_batch(spark, tmp_path):
    rows = spark.range(1000).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") % 50).cast("int"))).alias("at"), (F.col("id") % 2).alias("side"))
    for i in range(3):
        rows.filter(F.pmod(F.hash("at", "side"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    days = streams.daily_counts(streams.read(spark, str(tmp_path / "in"), rows.schema), "at", ["side"])
    got = streams.newest_version(spark, streams.run_to_table(days, "complete"))
    assert got.selectExpr("sum(n)").first()[0] == 1000 and got.count() == 6


def test_rising_counts_follow_the_hours(spark):
    hours = spark.createDataFrame([(f"2024-01-{d:02d} 05:00:00", 1, 10 if d == 9 else 1) for d in range(1, 10)], "hour string, feed long, n long").withColumn("hour", F.col("hour").cast("timestamp"))
    last = streams.rising(hours, ["feed"]).orderBy(F.desc("hour")).first()
    assert (last["today"], last["before"]) == (10, 7)


def test_assign_joins_merges_and_founds_stories(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    targets = spark.createDataFrame([(1,), (2,), (3,), (4,), (12,)], "article_id long")
    pairs = [(1, 10, 0.9, 0), (1, 20, 0.5, 0), (2, 30, 0.6, 5), (2, 31, 0.6, 9), (4, 40, 0.7, 0), (12, 20, 0.8, 0)]
    matches = spark.createDataFrame(pairs, "target long, other long, score double, apart long")
    members = spark.createDataFrame([(10, 100, 1.0), (11, 100, 1.0), (12, 100, 1.0), (20, 200, 1.0), (21, 200, 1.0), (40, 400, 1.0), (3, 400, 0.5), (31, 500, 1.0)], "article_id long, cluster_id long, score double")
    stories = spark.createDataFrame([(100, at(2), 2), (200, at(1), 2), (400, at(1), 2), (500, at(1), 1)], "cluster_id long, created_at timestamp, articles long")
    after, merged = clustering.assign(targets, matches, members, stories)
    # 1 connects stories 100 and 200: equal sizes, the older stays; 12 leaves 100 for 200. 2 brings its nearer best match 30 into 500, whose member 31 it matched too. 3 has no match and leaves.
    assert sorted(map(tuple, after.collect())) == [(1, 200, 0.9), (2, 500, 0.6), (4, 400, 0.7), (10, 200, 1.0), (11, 200, 1.0), (12, 200, 0.8), (20, 200, 1.0), (21, 200, 1.0), (30, 500, 0.6), (31, 500, 1.0), (40, 400, 1.0)]
    assert [tuple(r) for r in merged.collect()] == [(100, 200)]
    alone, none = clustering.assign(targets, matches.limit(0), members.limit(0), stories.limit(0))
    assert alone.isEmpty() and none.isEmpty()


def test_stream_of_articles_keeps_stories(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    row = lambda i, h, title, feed: (i, at(h), title, title.split(), [], [feed])
    schema = "article_id long, effective_at timestamp, title_hash string, tokens array<string>, entities array<long>, feeds array<long>"
    batches = [[row(1, 0, "a b", 1), row(2, 1, "c d", 2)], [row(3, 2, "a b", 3), row(4, 3, "c d", 2)], [row(5, 4, "a b", 4), row(6, 200, "a b", 5)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    table = None
    for i in range(3):  # as `upsert` folds micro-batches
        table = clustering.fold_articles(table, spark.read.schema(schema).parquet(f"{tmp_path}/in/{i}"))
    # 2 and 4 are of one feed; 6 is too late; 1, 3 and 5 are one story, named by its smallest article
    assert sorted((r.article_id, r.cluster_id) for r in table.collect()) == [(1, 1), (2, None), (3, 1), (4, None), (5, 1), (6, None)]
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path = streams.upsert(stream, clustering.fold_articles, f"{tmp_path}/out")
    got = {r.article_id: r.cluster_id for r in spark.read.parquet(path).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[1] == got[3] == got[5] is not None and got[2] is got[4] is got[6] is None


def test_event_is_scored_without_the_story_itself(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    schema = "event_id long, cluster_id long, first timestamp, last timestamp, country string, entities array<string>, tokens array<string>"
    stories = spark.createDataFrame([(1, 1, at(1), at(9), "fr", ["x", "y"], ["a", "b"]), (1, 2, at(2), at(3), "de", ["x"], ["a"]), (1, 3, at(3), at(4), "de", ["z"], []), (2, 4, at(20), at(20), None, [], [])], schema)
    without = {r.cluster_id: tuple(r)[2:] for r in events.facts_without(stories).collect()}
    assert without == {1: (at(2), at(4), 2, "de"), 2: (at(1), at(9), 2, "de"), 3: (at(1), at(9), 2, "de")}
    known = stories.groupBy("event_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.lit("de").alias("country"))
    pairs = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (4, 2)], "cluster_id long, event_id long")
    weights = spark.createDataFrame([("x", 0.5)], "entity_id string, weight double")
    got = {r.cluster_id: (r.time, round(r.entities, 4), r.title, r.location) for r in events.score_events(pairs, stories, known, weights).collect()}
    assert got == {1: (1.0, round(0.5 / 1.5, 4), 0.5, 0.0), 2: (1.0, round(0.5 / 1.5, 4), 0.5, 1.0), 4: (0.0, 0.0, 0.0, 0.0)}


def test_duplicate_rules_and_claims(spark):
    rows = [(1, "en", "ORG", "bank of england"), (2, "en", "TOPIC", "boe"), (3, "en", "ORG", "be"), (4, "en", "PERSON", "donald j trump"), (5, "en", "PERSON", "d j trump"), (6, "en", "PERSON", "trump"), (7, "en", "GPE", "boe"), (8, "fr", "ORG", "boe"), (9, "en", "PERSON", "d john trump")]
    names = spark.createDataFrame(rows, "entity_id long, language string, kind string, name string")
    got = {tuple(r) for r in authority.rule_pairs(names, ["of"]).collect()}
    assert got == {(1, 2, "acronym"), (1, 3, "acronym"), (4, 5, "initials"), (5, 9, "initials"), (4, 6, "surname"), (5, 6, "surname"), (6, 9, "surname"), (2, 7, "same name, other type")}
    linked = spark.createDataFrame([(4, "q1"), (5, "q2"), (6, "q1")], "entity_id long, item string")
    seen = spark.createDataFrame([(1, 4), (1, 6), (2, 6)], "article_id long, entity_id long")
    item = authority.item_pairs(names, linked, spark.createDataFrame([("q1", "en", "trump"), ("q1", "en", "d john trump")], "item string, language string, name string"))
    assert {tuple(r) for r in item.collect()} == {(4, 6, "item name"), (4, 9, "item name"), (6, 9, "item name")}
    refused = spark.createDataFrame([(5, 9)], "a long, b long")
    out = authority.suggestions(authority.rule_pairs(names, ["of"]).unionByName(item), refused, seen, names, linked).collect()
    assert [(r.keep, r.drop, r.score) for r in out if 6 in (r.keep, r.drop)] == [(6, 4, 0.95), (6, 9, 0.9)] and not any({r.keep, r.drop} in ({4, 5}, {5, 6}, {5, 9}) for r in out)
    held = names.withColumns({"authority_id": F.when(F.col("entity_id") == 7, 1).cast("long"), "ambiguous": F.col("entity_id") == 6})
    claims = spark.createDataFrame([(2, "boe"), (6, "trump"), (3, "boe"), (7, "boe"), (1, "bank of england")], "root_id long, name string")
    taken = spark.createDataFrame([("en", "bank of england", 3)], "language string, name string, root_id long")
    assert {tuple(r) for r in authority.claim_name(held, claims, taken).collect()} == {(2, 7, "other_root", 1), (6, None, "ambiguous", None), (3, None, "not_own_name", None), (7, None, "not_a_root", None), (1, None, "taken", 3)}


def test_places_and_spellings(spark):
    docs = spark.createDataFrame([(1, [("title", "Oslo!"), ("text", "In oslo, Oslofjord. OSLO")]), (2, [("title", None), ("text", "")]), (3, [("a", "x y"), ("b", "z")])], "article_id long, sections array<struct<kind string, text string>>")
    assert [tuple(r) for r in annotate.locate(docs, "oslo").orderBy("text_start").collect()] == [(1, "title", 0, 4, 0, 4), (1, "text", 3, 7, 9, 13), (1, "text", 20, 24, 26, 30)]
    assert [tuple(r) for r in annotate.locate(docs, "y\nz").collect()] == [(3, "input", 2, 5, 2, 5)]
    assert annotate.locate(docs, "").isEmpty()
    lexicon = spark.createDataFrame([("US", ["United States of America, the", "U.S.A.", "States"]), ("TD", ["Chad"])], "code string, names array<string>")
    shown = spark.createDataFrame([("US", "United States")], "code string, display string")
    got = {tuple(r) for r in annotate.country_spellings(lexicon, shown, ["states"], {"us": "US", "america": "US"}).collect()}
    assert got == {("US", "United States", "united states of america, the", "United States of America, the"), ("US", "United States", "usa", "U.S.A."), ("US", "United States", "us", "US"), ("US", "United States", "america", "America")}


def test_lists_and_authority_files(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("# words\nThe\n\nof\nthe\n")
    (tmp_path / "lex.json").write_text('[{"code": "no", "names": ["Norway", null]}, {"code": "xx", "names": []}]')
    stop = lists.read_stop_words(spark, f"{tmp_path}/stop.txt")
    assert sorted(r.word for r in stop.collect()) == ["of", "the"]
    assert [tuple(r) for r in lists.read_lexicon(spark, f"{tmp_path}/lex.json").collect()] == [("NO", ["Norway"])]
    assert lists.version(stop).first() == lists.version(stop.orderBy(F.desc("word"))).first() != lists.version(stop.limit(0)).first()
    schema = "entity_id long, language string, kind string, name string, authority_id long, preferred string, note string, hidden boolean, ambiguous boolean"
    names = spark.createDataFrame([(1, "en", "ORG", "un", None, None, None, None, None), (2, "en", "ORG", "united nations", 1, None, None, None, None), (3, "en", "ORG", "fifa", None, None, None, None, None), (4, "en", "ORG", "who", None, None, "n", True, None)], schema)
    ids = spark.createDataFrame([(1, "q", "q1")], "entity_id long, scheme string, value string")
    claims = spark.createDataFrame([(1, "en", "un")], "root_id long, language string, name string")
    out = lists.export_authority(names, ids, claims)
    got = {r["name"]: (r.variants, r.ids, r.claims) for r in out.collect()}
    assert got == {"un": ([("en", "ORG", "united nations")], [("q", "q1")], ["un"]), "who": (None, None, None)} and lists.export_authority(names, ids, claims, "fr").isEmpty()
    out.write.json(f"{tmp_path}/file")
    file = spark.read.json(f"{tmp_path}/file", schema=out.schema)
    here = spark.createDataFrame([(7, "en", "ORG", "united nations", None, None, None, None, None), (8, "en", "ORG", "who", None, "WHO", None, None, None), (9, "en", "ORG", "fifa", None, None, None, None, None)], schema)
    after, report = lists.import_authority(file, here)
    assert {(r.id["name"], r.root["name"], r.preferred, r.note, r.hidden) for r in after.collect()} == {("un", "un", None, None, False), ("united nations", "un", None, None, False), ("who", "who", "WHO", "n", True), ("fifa", "fifa", None, None, False)}
    assert {tuple(r) for r in report.collect()} == {("created", 1), ("linked", 1), ("unchanged", 1)}
    elsewhere = spark.createDataFrame([(7, "en", "ORG", "united nations", 9, None, None, None, None), (9, "en", "ORG", "fifa", None, None, None, None, None)], schema)
    assert {tuple(r) for r in lists.import_authority(file, elsewhere)[1].collect()} == {("created", 2), ("skipped", 1)}


def test_item_names_and_states(spark):
    labels = spark.createDataFrame([("q1", "fr", "Fifa", "alias", 0), ("q1", "en", "FIFA", "label", 0), ("q1", "en", "FIFA", "alias", 0), ("q1", "en", "The Federation", "alias", 1), ("q1", "xx", "F", "label", 0)], "item string, language string, name string, kind string, place int")
    names = linking.item_names(labels, ["en", "fr"])
    assert [(r.language, r["name"], r.kind) for r in names.orderBy("place").collect()] == [("en", "FIFA", "label"), ("en", "The Federation", "alias"), ("fr", "Fifa", "alias")]
    entities = spark.createDataFrame([(1, "en", "ORG", "fifa", None), (2, "en", "ORG", "federation", None)], "entity_id long, language string, type string, name string, authority_id long")
    states = linking.name_states(spark.createDataFrame([(1, "q1")], "entity_id long, item string"), names, entities)
    assert {(r["name"], r.state, r.holder) for r in states.collect()} == {("FIFA", "this_entity", 1), ("The Federation", "other_entity", 2), ("Fifa", "absent", None)}
    assert linking.names_to_add(states, states.limit(0)).isEmpty()
    assert [tuple(r) for r in linking.names_to_add(states, states).collect()] == [(1, "fr", "Fifa")]


def test_watches_do_not_announce_twice(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    watch = spark.createDataFrame([(1, at(8), at(2), 5, at(8))], "monitor_id long, eval_cursor_at timestamp, viewed_cursor_at timestamp, unseen int, notified_through timestamp")
    back = monitors.apply_views(watch, spark.createDataFrame([(1, at(4))], "monitor_id long, viewed_at timestamp"))
    assert (back.first().eval_cursor_at, back.first().unseen) == (at(4), 0)
    matches = spark.createDataFrame([(1, i, i, at(h)) for i, h in enumerate((3, 6, 9))], "monitor_id long, article_id long, cluster_id long, enriched_at timestamp")
    row = monitors.evaluate(matches, back, "2024-01-01 10:00:00").first()
    assert (row.unseen_articles, row.new_articles, row.eval_cursor_at) == (2, 1, at(10))
    assert monitors.evaluate(matches, back, "2024-01-01 02:00:00").first().eval_cursor_at == at(4)
