"""Search over article documents: filters, text matching, ranking, facets and related articles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _kept
from .skew import split_join

WORD = r"([\p{L}\p{N}]+)"
#: Rows of a broadcast of terms; it changes no result.
MOST_TERMS = 1 << 20


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def occurrences(bag: Column, word: str) -> Column:
    return F.size(F.filter(bag, lambda t: t == word))


def same_element(array: str, **wanted: list) -> Column:
    """Whether one element of an array of records has, in each named field, one of the wanted values."""
    def test(x: Column) -> Column:
        out = F.lit(True)
        for field, values in wanted.items():
            out = out & x[field].isin(*values)
        return out

    return F.coalesce(F.exists(array, test), F.lit(False))


def postings(docs: DataFrame, fields: dict[str, float], key: str = "article_id") -> DataFrame:
    """(key, term, tf): term counts, each field's weighted by its boost, and the field lengths' sum as len."""
    parts = None
    for name, boost in fields.items():
        rows = docs.select(key, F.explode(tokens(F.col(name))).alias("term")).groupBy(key, "term").agg((F.count("*") * F.lit(float(boost))).alias("tf"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, words: list[str], fields: dict[str, float], key: str = "article_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold every word. Only the query's terms leave the scan: lengths are counted beside them in the row."""
    from ..session import shared_dir

    words = sorted({w.lower() for w in words})
    boosts = list(fields.values())
    bags = docs.select(key, F.array(*[tokens(F.col(n)) for n in fields]).alias("bags"))
    zero = F.struct(F.lit(0).alias("len"), F.array(*[F.lit(0.0)] * len(words)).alias("tf"))

    def counted(bag: Column, boost: float) -> Column:  # one walk over a field's words for its length and all words' counts
        step = lambda s, t: F.struct((s["len"] + 1).alias("len"), F.transform(s["tf"], lambda x, i: x + F.when(t == F.element_at(F.array(*map(F.lit, words)), i + 1), float(boost)).otherwise(0.0)).alias("tf"))
        return F.aggregate(bag, zero, step)

    each = bags.select(key, F.array(*[counted(F.col("bags")[i], boost) for i, boost in enumerate(boosts)]).alias("c"))
    size = F.aggregate("c", F.lit(0), lambda s, x: s + x["len"])
    one = lambda i: F.aggregate("c", F.lit(0.0), lambda s, x: s + x["tf"][i])
    sums = [one(i) for i in range(len(words))]
    path = f"{shared_dir(docs.sparkSession)}/bm25-{uuid.uuid4().hex}"
    each.select(key, size.alias("len"), *[x.alias(f"tf{i}") for i, x in enumerate(sums)]).write.parquet(path)  # narrow; read twice
    rows = docs.sparkSession.read.parquet(path)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    total = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    hit = rows
    for i in range(len(words)):
        hit = hit.filter(F.col(f"tf{i}") > 0)
    return hit.join(F.broadcast(stats)).select(key, F.round(total, 6).alias("score"))  # stats is one row


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words follow each other."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(" " + " ".join(w.lower() for w in words) + " ")


def facets(docs: DataFrame, groups: dict[str, Column], k: int = 25, key: str = "article_id") -> DataFrame:
    """Values of each group by different articles in one pass: rows of all groups are counted together, then each is cut at `k`."""
    values = F.array(*[F.struct(F.lit(g).alias("facet"), F.array_distinct(F.transform(c, lambda x: x.cast("string"))).alias("v")) for g, c in groups.items()])
    rows = docs.select(key, F.explode(values).alias("g")).select(key, "g.facet", F.explode("g.v").alias("value"))
    n = rows.groupBy("facet", "value").agg(F.count("*").alias("articles"))
    w = Window.partitionBy("facet").orderBy(F.desc("articles"), "value")
    total = n.groupBy("facet").agg(F.count("*").alias("total"))
    top = n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(F.broadcast(total), "facet").withColumn("truncated", F.col("total") > k).drop("rank")  # a row a facet


def distinctive(posting: DataFrame, n_docs: int, k: int = 25, least_df: int = 2, key: str = "article_id", of: DataFrame | None = None) -> DataFrame:
    """The `k` most distinctive terms of each document by tf-idf, or of the documents `of` alone; terms of one document alone cannot relate it."""
    df = posting.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df)
    own = posting if of is None else posting.join(of.select(key), key, "left_semi")
    rows = own.filter(F.length("term") >= 3).join(df, "term").withColumn("weight", F.col("tf") * F.log(F.lit(n_docs) / F.col("df")))
    w = Window.partitionBy(key).orderBy(F.desc("weight"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "term", "weight")


def related(posting: DataFrame, n_docs: int, articles: DataFrame, least: int = 5, k: int = 25, key: str = "article_id", stop_words: list[str] | None = None, stories: DataFrame | None = None, shown: int | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
    """For the given articles, others that share `least` of their most distinctive terms; score is the sum of the terms' weights.

    Stop words never relate; with `stories` (key, cluster_id) an article's own story is left out; `shown` is how many are listed, best first, then by id.
    Up to `most_terms` terms of the given articles in all are broadcast.
    """
    if stop_words:
        posting = posting.filter(~F.col("term").isin(*stop_words))
    posting = _kept(posting)  # read for the frequencies, the terms and the partners
    own = _kept(distinctive(posting, n_docs, k, key=key, of=articles).withColumnRenamed(key, "target"))
    partners = posting.select(F.col(key).alias("other"), "term")
    if own.count() <= most_terms:  # terms that no given article has stay behind, and the others are counted where their document's rows lie
        parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        wanted = partners.join(F.broadcast(own.select("term").distinct()), "term", "left_semi")
        met = wanted.repartition(parts, "other").join(F.broadcast(own), "term")
    else:
        met = split_join(own, partners, ["term"])
    met = met.filter(F.col("target") != F.col("other"))
    found = met.groupBy("target", "other").agg(F.count("*").alias("shared"), F.round(F.sum("weight"), 6).alias("score")).filter(F.col("shared") >= least)
    if stories is not None:
        found = _other_stories(found, stories, key)
    if shown is None:
        return found
    w = Window.partitionBy("target").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= shown).drop("rank")


def _other_stories(found: DataFrame, stories: DataFrame, key: str) -> DataFrame:
    of = lambda name: stories.select(F.col(key).alias(name), F.col("cluster_id").alias(f"{name}_story"))
    apart = found.join(of("target"), "target", "left").join(of("other"), "other", "left")
    return apart.filter(~F.coalesce(F.col("target_story") == F.col("other_story"), F.lit(False))).select("target", "other", "shared", "score")
