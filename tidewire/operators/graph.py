"""Co-occurrence graphs: nodes, edges with evidence, expansion and communities. Nodes are bounded before pairs are made."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import distinct_rank


def nodes(links: DataFrame, key: str, top: int = 50, focus=None, subject: str = "article_id") -> DataFrame:
    """The `top` keys by subjects; a focus key is always among them, in place of the lightest."""
    n = distinct_rank(links, [key], subject, None)
    ranked = n.withColumn("first", (F.col(key) == F.lit(focus)) if focus is not None else F.lit(False))
    return ranked.orderBy(F.desc("first"), F.desc("articles"), key).limit(top).drop("first")


def pairs(links: DataFrame, drawn: DataFrame, key: str, at: str | None = None, recent_since: str | None = None, subject: str = "article_id", broadcast_rows: int = 10_000) -> DataFrame:
    """(a, b, weight, recent) for drawn keys that share subjects. Only rows of drawn keys meet; a subject holds at most all drawn keys.

    `drawn` is a result of `nodes`, whose size is its limit; it is broadcast up to `broadcast_rows` rows and joined by shuffle beyond.
    """
    few = drawn.select(key).limit(broadcast_rows + 1).count() <= broadcast_rows
    keys = F.broadcast(drawn.select(key)) if few else drawn.select(key)
    cols = [subject, key] + ([at] if at else [])
    rows = links.select(*cols).join(keys, key).groupBy(subject, key).agg(*([F.max(at).alias(at)] if at else [F.count("*").alias("_n")]))
    sets = rows.groupBy(subject).agg(F.array_sort(F.collect_set(key)).alias("keys"), *([F.max(at).alias(at)] if at else [])).filter(F.size("keys") > 1)
    each = sets.select(subject, *([at] if at else []), F.posexplode("keys").alias("i", "a"), "keys")
    two = each.select("a", F.explode(F.expr("slice(keys, i + 2, size(keys))")).alias("b"), *([at] if at else []))
    recent = F.count_if(F.col(at) >= F.lit(recent_since).cast("timestamp")) if at and recent_since else F.lit(0).cast("long")
    return two.groupBy("a", "b").agg(F.count("*").alias("weight"), recent.alias("recent"))


def edges(links: DataFrame, drawn: DataFrame, key: str, least: int = 2, top: int = 150, pinned=None, **options) -> DataFrame:
    """Pairs of at least `least` shared subjects with their strength; pinned first, then strongest, then heaviest."""
    p = pairs(links, drawn, key, **options).filter(F.col("weight") >= least)
    n = drawn.select(F.col(key), "articles")
    out = p.join(n.withColumnsRenamed({key: "a", "articles": "na"}), "a").join(n.withColumnsRenamed({key: "b", "articles": "nb"}), "b")
    out = out.withColumn("score", F.round(F.col("weight") / (F.col("na") + F.col("nb") - F.col("weight")), 4))
    out = out.withColumn("pinned", ((F.col("a") == F.lit(pinned)) | (F.col("b") == F.lit(pinned))) if pinned is not None else F.lit(False))
    return out.orderBy(F.desc("pinned"), F.desc("score"), F.desc("weight"), "a", "b").limit(top).select("a", "b", "weight", "recent", "score", (F.col("recent") == F.col("weight")).alias("is_new"))


def expand(links: DataFrame, key: str, starts: list, drawn: list, neighbours: int = 8, subject: str = "article_id") -> DataFrame:
    """For each start its busiest neighbours that are not drawn yet."""
    mine = links.filter(F.col(key).isin(starts)).select(subject, F.col(key).alias("start")).distinct()
    near = mine.join(links.select(subject, key).distinct(), subject).filter(~F.col(key).isin(sorted({*starts, *drawn})))
    n = near.groupBy("start", key).agg(F.count("*").alias("weight"))
    w = Window.partitionBy("start").orderBy(F.desc("weight"), key)
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= neighbours)


def evidence(links: DataFrame, key: str, a, b, at: str, story: str, subject: str = "article_id") -> DataFrame:
    """What connects two keys: shared subjects, first and last time, different stories."""
    both = links.filter(F.col(key).isin(a, b)).groupBy(subject).agg(F.count_distinct(key).alias("n"), F.max(at).alias(at), F.max(story).alias(story)).filter("n = 2")
    return both.agg(F.count("*").alias("total"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_distinct(story).alias("stories"))


def communities(edge_rows: DataFrame, rounds: int = 20, vote: str = "weight") -> DataFrame:
    """(node, label): weighted label propagation. A node takes the label with most votes around it, the busier node's on ties; a label is the node it began with.

    One node after another, the busiest first, would need one machine. Here nodes are numbered by how busy they are, and those of even and
    of odd numbers move in turns, so that two neighbours seldom swap labels for ever. Every round is written to spark.checkpoint.dir.
    The nodes are those of a drawn graph, a bounded number, so numbering them in one task is cheap.
    """
    both = _kept(edge_rows.select("a", "b", F.col(vote).alias("vote")).unionByName(edge_rows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col(vote).alias("vote"))))
    busy = both.groupBy(F.col("a").alias("node")).agg(F.sum("vote").alias("busy"))
    start = _kept(busy.select("node", F.row_number().over(Window.orderBy(F.desc("busy"), "node")).alias("number")))
    label = start.withColumn("label", F.col("number"))
    still = 0
    for i in range(rounds):
        votes = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("vote").alias("w"))
        best = votes.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("next"))
        turn = F.col("number") % 2 == i % 2
        after = _kept(label.join(best, "node").select("node", "number", F.when(turn, F.col("next")).otherwise(F.col("label")).alias("label"), (turn & (F.col("next") != F.col("label"))).alias("moved")))
        label = after.drop("moved")
        still = still + 1 if after.filter("moved").isEmpty() else 0
        if still == 2:
            break
    return label.select("node", "label").join(start.select(F.col("number").alias("label"), F.col("node").alias("named")), "label").select("node", F.col("named").alias("label"))


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that loops do not grow the plan and survive a lost executor."""
    from ..session import shared_dir

    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
