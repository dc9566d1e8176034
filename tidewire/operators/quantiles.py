"""Exact quantiles of groups of any size: a sketch brackets the value, a count tells its place in the bracket, and only the bracket is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _kept
from .places import place_numbers
from .skew import split_join

KEY = "__key"


def _brackets(held: DataFrame, shares: dict[str, float], slack: float, sketch: int) -> DataFrame:
    """(key, share, n, lo, hi, low, high, part): where each quantile lies by the sketch, `slack` to both sides (null: open), and the places that it is made of."""
    s = held.groupBy(KEY).agg(F.expr(f"kll_sketch_agg_double(v, {sketch})").alias("s"), F.count("*").alias("n"))
    edge = lambda p, inside: F.expr(f"kll_sketch_get_quantile_double(s, CAST({p} AS DOUBLE))") if inside else F.lit(None).cast("double")
    each = F.array(*[F.struct(F.lit(name).alias("share"), F.lit(p).alias("p"), edge(p - slack, p > slack).alias("lo"), edge(p + slack, p + slack < 1).alias("hi")) for name, p in shares.items()])
    rows = s.select(KEY, "n", F.explode(each).alias("e")).select(KEY, "n", "e.*").withColumn("at", F.col("p") * (F.col("n") - 1))
    return rows.select(KEY, "share", "n", "lo", "hi", F.floor("at").alias("low"), F.ceil("at").alias("high"), (F.col("at") - F.floor("at")).alias("part"))


def exact_quantiles(rows: DataFrame, group: list[str], value: str | Column, shares: dict[str, float], slack: float = 0.02, sketch: int = 800) -> DataFrame:
    """(group, one column a share): continuous quantiles of the values that are not null, as `percentile` gives them; groups without a value have no row.

    No group is held or sorted whole: of its rows those in the bracket are numbered, over many tasks where they are many. A quantile outside of its
    bracket (a sketch may err) is looked for once more among all rows. NaN is the largest value.
    """
    v = F.col(value) if isinstance(value, str) else value
    key = F.to_json(F.struct(*group)) if group else F.lit("")
    held = _kept(rows.select(*group, key.alias(KEY), v.cast("double").alias("v")).filter(F.col("v").isNotNull()))
    asked = _kept(_brackets(held.filter(~F.isnan("v")), shares, slack, sketch))
    # the sketch leaves NaN out: groups with one take the way over all rows
    n = held.groupBy(KEY).agg(F.count("*").alias("all"))
    asked = n.join(asked.withColumnRenamed("n", "seen"), KEY, "left")
    whole = asked.filter("seen IS NULL OR seen <> all").select(KEY, "all").distinct()
    found = _picked(held, asked.filter("seen = all").select(KEY, "share", "lo", "hi", "low", "high", "part"))
    found = _kept(found)
    missed = found.filter("result IS NULL").select(KEY, "share", "low", "high", "part")
    open_ = F.lit(None).cast("double")
    again = missed.withColumns({"lo": open_, "hi": open_})
    each = F.array(*[F.struct(F.lit(name).alias("share"), F.lit(p).alias("p")) for name, p in shares.items()])
    late = whole.select(KEY, "all", F.explode(each).alias("e")).select(KEY, "e.share", (F.col("e.p") * (F.col("all") - 1)).alias("at"))
    late = late.select(KEY, "share", open_.alias("lo"), open_.alias("hi"), F.floor("at").alias("low"), F.ceil("at").alias("high"), (F.col("at") - F.floor("at")).alias("part"))
    rest = _kept(again.select(*late.columns).unionByName(late))
    results = found.filter("result IS NOT NULL").select(KEY, "share", "result")
    if not rest.isEmpty():
        results = results.unionByName(_picked(held, rest).select(KEY, "share", "result"))
    wide = results.groupBy(KEY).agg(*[F.max(F.when(F.col("share") == name, F.col("result"))).alias(name) for name in shares])
    return held.select(*group, KEY).distinct().join(wide, KEY).drop(KEY)


def _picked(held: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` with `result`, null where the places lie outside of the bracket."""
    met = split_join(held.select(KEY, "v"), asked.select(KEY, "share", "lo", "hi"), [KEY])
    under = F.col("v") < F.col("lo")
    inside = (F.col("lo").isNull() | (F.col("v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
    below = met.groupBy(KEY, "share").agg(F.count_if(under).alias("below"), F.count_if(inside).alias("inside"))
    places = _kept(asked.join(below, [KEY, "share"]))
    fit = places.filter((F.col("low") >= F.col("below")) & (F.col("high") < F.col("below") + F.col("inside")))
    numbered = place_numbers(met.filter(inside).select(KEY, "share", "v"), [KEY, "share"], [F.col("v")])
    at = F.col("place") - 1 + F.col("below")
    # two rows a quantile remain
    rows = split_join(numbered, fit.select(KEY, "share", "below", "low", "high", "part"), [KEY, "share"]).filter((at == F.col("low")) | (at == F.col("high")))
    ends = rows.groupBy(KEY, "share").agg(F.max(F.when(at == F.col("low"), F.col("v"))).alias("a"), F.max(F.when(at == F.col("high"), F.col("v"))).alias("z"), F.max("part").alias("p"))
    value = F.when(F.col("p") == 0, F.col("a")).otherwise((1 - F.col("p")) * F.col("a") + F.col("p") * F.col("z"))
    return asked.join(ends.select(KEY, "share", value.alias("result")), [KEY, "share"], "left")
