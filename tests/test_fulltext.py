"""Search over fields and forms on small fixtures."""

from pyspark.sql import functions as F

from tidewire.operators import fulltext

FIELDS = {"title": 3.0, "body": 1.0}


def docs(spark):
    rows = [
        (1, "Dogs in Athens", "They walked along the river", 5, 2), (2, "Ο Άνθρωπος", "οι άνθρωποι της πόλης", 4, 1), (3, None, "a dog walking, the dogs", 3, 2),
        (4, "", None, 2, 0), (5, "river the", "the river and the RIVER", 1, 3), (6, "cat", "nothing", 1, 3),
    ]
    df = spark.createDataFrame(rows, "article_id long, title string, body string, h int, sources int")
    return df.withColumn("effective_at", F.timestamp_seconds(F.col("h") * 3600))


def ids(df):
    return [r["article_id"] for r in df.collect()]


def test_words_match_in_any_field_as_written_or_in_their_forms(spark):
    d = docs(spark)
    found = lambda terms, *a, **kw: sorted(ids(fulltext.scored(d, FIELDS, terms, *a, **kw)))
    assert found(["dog"]) == [1, 3] and found(["DOGS", "walks"]) == [1, 3] and found(["dog", "river"]) == [1]  # one word in the title, one in the body
    assert found(["ανθρωπου"]) == [2] and found(["ΆΝΘΡΩΠΟΙ"]) == [2]
    assert found(["nowhere"]) == [] and found([]) == [1, 2, 3, 4, 5, 6]
    assert found([], ["the river"]) == [1, 5] and found([], ["river the"]) == [5] and found([], ["The River", "river and"]) == [5] and found([], ["walking the dogs"]) == [3]
    assert found(["river"], where=F.col("h") < 5) == [5]


def test_titles_weigh_more_and_a_written_word_scores_in_all_its_forms(spark):
    rows = {r["article_id"]: r["score"] for r in fulltext.scored(docs(spark), FIELDS, ["dogs"]).collect()}
    assert rows[1] > rows[3] > 0
    only = {r["article_id"]: r["score"] for r in fulltext.scored(docs(spark), FIELDS, ["doged"]).collect()}
    assert set(only) == {1, 3} and all(only[i] < rows[i] for i in only)


def test_orders_and_pages(spark):
    d = docs(spark)
    page = lambda **kw: ids(fulltext.page(d, FIELDS, [], **kw))
    assert page(order="newest") == [1, 2, 3, 4, 5, 6] and page(order="oldest") == [5, 6, 4, 3, 2, 1] and page(order="most_sources") == [5, 6, 1, 3, 2, 4]
    assert page(order="newest", limit=2) == [1, 2, 3]  # one more row: there is another page
    assert page(order="newest", limit=2, after=["1970-01-01 04:00:00", 2]) == [3, 4, 5]
    best = fulltext.page(d, FIELDS, ["river"], order="relevance")
    scores = [r["score"] for r in best.collect()]
    assert ids(best)[0] == 5 and scores == sorted(scores, reverse=True)
    assert fulltext.page(d.limit(0), FIELDS, ["river"]).count() == 0


def test_a_words_rarity_counts_all_documents_whatever_the_filter(spark):
    d = docs(spark)
    whole = {r["article_id"]: r["score"] for r in fulltext.scored(d, FIELDS, ["river"]).collect()}
    part = {r["article_id"]: r["score"] for r in fulltext.scored(d, FIELDS, ["river"], where=F.col("article_id") == 5).collect()}
    assert part == {5: whole[5]}
