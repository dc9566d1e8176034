"""Joins whose keys may be very uneven: heavy keys are found by a sketch, and only these are split."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys of a side are split; a key beyond has less than that share of the rows.
MAX_KEYS = 1024
#: Keys that the frequency sketch of a task tracks; estimates are off by about the rows over this number.
TRACKED = 1 << 16
#: Cells that a partition's share of a heavy key is cut in, so that cells which meet in a partition by chance weigh little.
FINE = 4
HASH, CELL = "__hash", "__cell"


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def heavy_keys(left: DataFrame, right: DataFrame, keys: list[str], parts: int) -> dict[int, tuple[int, int]]:
    """{hash of a key: (cells of its left rows, cells of its right rows)} of keys with more rows than one of `parts` equal shares of a side.

    One mergeable sketch of frequent hashes a side; what reaches the driver is bounded by MAX_KEYS. An estimate that is off, or two keys of
    one hash, only change how rows are dealt out.
    """
    top = F.expr(f"approx_top_k({HASH}, {MAX_KEYS}, {TRACKED})").alias("top")
    rows = left.select(_hash(keys).alias(HASH), F.lit(0).alias("side")).unionByName(right.select(_hash(keys).alias(HASH), F.lit(1).alias("side")))
    out: dict[int, list[float]] = {}
    for r in rows.groupBy("side").agg(top, F.count("*").alias("n")).collect():  # two rows
        share = max(1.0, r["n"] / parts)
        for t in r["top"]:
            if t["count"] > share:
                out.setdefault(t["item"], [1, 1])[r["side"]] = t["count"] / share * FINE
    most = parts * FINE  # cells of one key, where both of its sides are heavy
    return {h: (max(1, ceil(a * x)), max(1, ceil(b * x))) for h, (a, b) in out.items() for x in [min(1.0, sqrt(most / (a * b))) if min(a, b) > 1 else 1.0]}


def split_join(left: DataFrame, right: DataFrame, keys: list[str], parts: int | None = None, heavy: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """The inner join of `left` and `right` on `keys`, in one shuffle of each, whatever share of the rows a key has.

    The rows of a heavy key form a grid: left ones are dealt to its lines and go to all cells of their line, right ones to its columns. All
    other rows have one cell. The line is a hash of the row, so a task that runs again deals its rows as before.
    `parts`: shares that the rows are to be spread over (the shuffle partitions); `heavy`: what `heavy_keys` found, where it is known.
    """
    spark = left.sparkSession
    left, right = left.dropna(subset=keys), right.dropna(subset=keys)
    found = heavy_keys(left, right, keys, parts or int(spark.conf.get("spark.sql.shuffle.partitions"))) if heavy is None else heavy
    if not found:
        return left.join(right, keys)
    grid = spark.createDataFrame([(h, a, b) for h, (a, b) in found.items()], f"{HASH} long, a int, b int")  # 2 * MAX_KEYS rows at most

    def dealt(rows: DataFrame, own: str, other: str, place) -> DataFrame:
        line = F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int")
        cells = F.when(F.col("a").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda i: place(line, i)))
        held = rows.withColumn(HASH, _hash(keys)).join(F.broadcast(grid), HASH, "left")
        return held.select(*rows.columns, F.explode(cells).alias(CELL))

    lines = dealt(left, "a", "b", lambda line, i: line * F.col("b") + i)
    columns = dealt(right, "b", "a", lambda line, i: i * F.col("b") + line)
    return lines.join(columns, [*keys, CELL]).drop(CELL)
