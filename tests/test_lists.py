"""Filters of lists on small fixtures: cases that the test tables do not have."""

from pyspark.sql import functions as F

from tidewire.operators import lists, ranking


def test_articles_without_marks_languages_or_texts(spark):
    a = spark.createDataFrame([(1, "2024-01-01 23:59:59"), (2, "2024-01-02 00:00:00"), (3, "2024-01-03 00:00:00"), (4, None)], "article_id long, first_discovered_at string").withColumn("first_discovered_at", F.col("first_discovered_at").cast("timestamp"))
    prov = spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "article_id long, feed_id long")
    marks = spark.createDataFrame([(1, True, None), (2, None, True), (2, False, False)], "article_id long, read boolean, starred boolean")
    lang = spark.createDataFrame([(1, "en"), (2, None)], "article_id long, language string")
    text = spark.createDataFrame([(2,)], "article_id long")
    ids = lambda **kw: sorted(r["article_id"] for r in lists.articles(a, prov, marks, lang, text, **kw).collect())
    assert ids() == [1, 2, 3, 4] and ids(feed=7) == [1] and ids(unread=True) == [2, 3, 4] and ids(unread=False) == [1]
    assert ids(starred=True) == [2] and ids(starred=False) == [1, 3, 4] and ids(language="en") == [1]
    assert ids(has_text=True) == [2] and ids(has_text=False) == [1, 3, 4] and ids(after="2024-01-02", before="2024-01-03") == [2]


def test_names_are_found_by_any_name_and_folded_greek(spark):
    e = spark.createDataFrame(
        [(1, None, "Αθήνα", "GPE", "el", "new", False), (2, 1, "Athens", "GPE", "en", "new", None), (3, None, "United States", "GPE", "en", "new", None), (4, None, "US Steel", "ORG", "en", "new", False), (5, None, "Usher", "PERSON", "en", "new", True), (6, None, "US unused", "ORG", "en", "new", False)],
        "entity_id long, authority_id long, name string, kind string, language string, status string, hidden boolean",
    ).withColumn("normalized", lists.folded(F.col("name")))
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (2, 5)], "article_id long, entity_id long")
    pick = lambda *a: [(r["entity_id"], r["rank"]) for r in ranking.keyset_page(lists.picker(e, links, *a), lists.PICKER_ORDER, None, 9).collect()]
    assert pick(["ΑΘΗΝΑ"]) == [(1, 1)] and pick(["ath"]) == [(1, 1)]  # its variant is in use
    assert pick(["us"], ["united states"]) == [(3, 0), (4, 1)]  # hidden and unused names are not offered
    items = spark.createDataFrame([(1, "Q1")], "entity_id long, item string")
    root = lambda **kw: sorted(r["entity_id"] for r in lists.roots(e, links, items, **kw).collect())
    assert root(text="ATHEN") == [1] and root(linked=True) == [1] and root(hidden=True) == [5] and root(language="el") == [1] and root(kinds=["ORG"]) == [4, 6]


def test_keywords_in_use_by_prefix(spark):
    k = spark.createDataFrame([(1, "Ενέργεια", "ενεργεια"), (2, "Energy", "energy"), (3, "Enemy", "enemy")], "keyword_id long, text string, normalized string")
    links = spark.createDataFrame([(1, 1), (2, 2)], "article_id long, keyword_id long")
    assert [r["keyword_id"] for r in lists.keyword_picker(k, links, " ΕΝΈ").collect()] == [1]
    assert [r["keyword_id"] for r in lists.keyword_picker(k, links, "ene").collect()] == [2]


def test_events_without_an_end_are_not_listed_and_words_may_be_in_names(spark):
    ev = spark.createDataFrame([(1, 5, 9, 2, 4, "active", "DE"), (2, 5, None, 2, 4, "active", "DE")], "event_id long, a long, z long, stories long, articles long, status string, country string").select("event_id", F.timestamp_seconds("a").alias("started_at"), F.timestamp_seconds("z").alias("ended_at"), "stories", "articles", "status", "country")
    titles = spark.createDataFrame([(1, "Fire in 100% of the hills"), (1, None)], "event_id long, title string")
    names = spark.createDataFrame([(1, 3, "Mount_Etna")], "event_id long, entity_id long, name string")
    roots = spark.createDataFrame([(3, 4), (4, 4), (5, 5)], "entity_id long, root_id long")
    n = lambda **kw: lists.events(ev, titles, names, roots, **kw).count()
    assert n() == n(entity=4) == n(entity=3) == n(words=["100%", "etna"]) == n(words=["t_e"]) == n(country="de") == 1
    assert n(entity=5) == n(words=["10_%"]) == n(least=3) == n(status="closed") == 0
