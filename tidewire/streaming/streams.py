"""The same work on streams: counts by day, late data, sessions, dedup, upserts and watches in micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import clustering, graph, monitors
from ..session import shared_dir
from ..shipping import ship
from . import tables


def read(spark: SparkSession, folder: str, schema, files: str = "*.parquet", files_a_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder whose names fit `files`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", files).parquet(folder)


def daily_counts(stream: DataFrame, at: str, group: list[str], lateness: str = "2 minutes") -> DataFrame:
    """Tumbling UTC days; a day is final when the watermark has passed it."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, "1 day"), *group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), *group, "n")


def rising_counts(stream: DataFrame, at: str, group: list[str], lateness: str = "2 minutes") -> DataFrame:
    """Counts by hour, from which `rising` makes those of the last day and of the seven before: each row counts once in the stream's state."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, "1 hour"), *group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), *group, "n")


def rising(hours: DataFrame, group: list[str]) -> DataFrame:
    """Of hourly counts: at each hour that has rows, those of the 24 hours up to it and of the seven days before these."""
    w = Window.partitionBy(*group).orderBy(F.unix_seconds("hour"))
    total = lambda a, b: F.coalesce(F.sum("n").over(w.rangeBetween(a * 3600, b * 3600)), F.lit(0))
    return hours.select("hour", *group, total(-23, 0).alias("today"), total(-191, -24).alias("before"))


def sessions(stream: DataFrame, at: str, group: list[str], gap: str = "72 hours", lateness: str = "2 minutes") -> DataFrame:
    """Events that close when idle for `gap`."""
    return stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap), *group).agg(F.count("*").alias("n")).select(*group, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("closes_at"), "n")


def dedup(stream: DataFrame, at: str, keys: list[str], horizon: str = "8 days") -> DataFrame:
    """First arrival of each key within the horizon; older history is held against the table by `upsert`."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def closing(stream: DataFrame, key: str, at: str, idle_seconds: int = 72 * 3600) -> DataFrame:
    """(key, status, at): an event opens, closes when idle, and a late fitting row opens it again. State is two numbers a key."""
    ship(stream.sparkSession)

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, active = state.get if state.exists else (0, False)
        out = []
        if state.hasTimedOut:
            out.append((k[0], "closed", last))
            state.update((last, False))
        else:
            times = sorted(int(t.timestamp()) for r in rows for t in r[at])
            for t in times:
                if active and t - last > idle_seconds:
                    out.append((k[0], "closed", last))
                    active = False
                if not active:
                    out.append((k[0], "reopened" if last else "opened", t))
                    active = True
                last = max(last, t)
            state.update((last, active))
            state.setTimeoutTimestamp(max((last + idle_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "status", "at"])

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark(at, "2 minutes").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, at long", "last long, active boolean", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, mode: str = "append", path: str | None = None) -> str:
    """Run over what is there now, into a table in the shared folder; returns its path. Files and checkpoint make it exactly once."""
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/version={n}")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return path


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """What the last micro-batch of a complete-mode run left."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version", "left_semi").drop("version")


def upsert(stream: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], path: str) -> str:
    """Each micro-batch folded into the newest version of a small table, which is written whole; versions before the last two are removed. A batch
    that runs again writes the same version. `tables.BucketTable` rewrites only what a batch touches."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        held = [v for v in tables.numbers(spark, path, "v") if v < n]
        before = spark.read.parquet(f"{path}/v{held[-1]}") if held else None
        fold(before, batch).write.mode("overwrite").parquet(f"{path}/v{n}")
        for v in held[:-1]:
            tables.remove(spark, f"{path}/v{v}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{path}/v{tables.numbers(spark, path, 'v')[-1]}"


def keep_stories(stream: DataFrame, table: tables.BucketTable) -> None:
    """Stories kept as articles arrive: `table` holds ARTICLES, keyed by article_id."""
    table.fold(stream, lambda t, batch: clustering.article_changes(t.read(), batch))


#: Columns of the table that `keep_stories` keeps, beside those of the stream.
ARTICLES = "article_id long, effective_at timestamp, title_hash string, tokens array<string>, entities array<long>, feeds array<long>, cluster_id long, score double"
MATCHES = "monitor_id long, article_id long, cluster_id long, enriched_at timestamp"
WATCHES = "monitor_id long, eval_cursor_at timestamp, viewed_cursor_at timestamp, unseen_articles long, unseen_stories long, new_articles long, latest_match_at timestamp"


def keep_watches(stream: DataFrame, matches: tables.BucketTable, watches: tables.BucketTable) -> None:
    """Watches evaluated as matches arrive. Only the watches that a batch matches are counted again, over (cursor, newest match of the batch].

    `matches` holds MATCHES, keyed by monitor_id and article_id, in buckets by monitor_id; `watches` holds WATCHES, keyed by monitor_id.
    A batch may bring matches that are there already; a watch's first evaluation is a baseline.
    """
    def changes(table: tables.BucketTable, batch: DataFrame) -> DataFrame:
        new = graph._kept(batch.select(*matches.schema.names).dropDuplicates(matches.keys))
        n = (matches.versions() or [-1])[-1] + 1
        told = graph._kept(new.join(matches.read(matches.touched(new)).select(*matches.keys), matches.keys, "left_anti"))
        matches.apply(n, told)  # a batch that comes again finds its matches there
        asked = new.select("monitor_id").distinct()
        mine = table.read(table.touched(asked)).join(asked, "monitor_id", "left_semi").select("monitor_id", "eval_cursor_at", "viewed_cursor_at")
        horizon = new.agg(F.max("enriched_at").cast("string")).first()[0]
        if horizon is None:
            return table.read().limit(0)
        held = matches.read(matches.touched(asked)).join(asked, "monitor_id", "left_semi")
        after = monitors.evaluate(held, mine, horizon)
        return after.join(mine.select("monitor_id", "viewed_cursor_at"), "monitor_id").select(*table.schema.names)

    watches.fold(stream, changes)
