"""Late data: text that comes after its event was closed is annotated again, and a late article opens its event again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..shipping import ship

HOUR = 3_600_000
OUT = "event_id long, article_id long, what string, at long"


class LateTexts(StatefulProcessor):
    """State of one event: its newest article's time, whether it is active, when it may be forgotten, and a digest of each article's text.

    The watermark follows arrival, so an article's own time may lie as far back as it likes. An event closes when arrival has passed its newest
    article by `idle` and its state goes when nothing came for `keep` more.
    """

    def __init__(self, idle: int, keep: int):
        self.idle, self.keep = idle, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "last long, active boolean, touched long")
        self.texts = handle.getMapState("texts", "article_id long", "digest string")

    def _plan(self, after: int, last: int, active: bool, touched: int) -> None:
        """One timer at a time: the closing of an active event, else the end of its state."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(after + 1, last + self.idle if active else touched + self.keep))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = max(0, timerValues.getCurrentWatermarkInMs())
        last, active, touched = self.event.get() if self.event.exists() else (None, False, 0)
        out = []
        batch = pd.concat(list(rows)).sort_values(["arrived", "article_id", "digest"], na_position="first")
        for r in batch.itertuples(index=False):
            if active and r.arrived >= last + self.idle:  # it closed before this row came; timers fire after a batch's rows
                out.append((key[0], None, "closed", last))
                active = False
            known = self.texts.containsKey((r.article_id,))
            if not known:  # an article that the event has not had
                if not active:
                    out.append((key[0], None, "opened" if last is None else "reopened", r.at))
                last, active = r.at if last is None else max(last, r.at), True
            before = self.texts.getValue((r.article_id,))[0] if known else None
            digest = None if pd.isna(r.digest) else r.digest
            if digest is not None and digest != before:
                out.append((key[0], r.article_id, "annotated" if before is None else "annotated again", r.arrived))
            if not known or digest is not None:
                self.texts.updateValue((r.article_id,), (digest,))
            touched = max(touched, r.arrived)
        self.event.update((last, active, touched))
        self._plan(now, last, active, touched)
        yield pd.DataFrame(out, columns=["event_id", "article_id", "what", "at"]).astype({"article_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, active, touched = self.event.get()
        out = []
        if active and now >= last + self.idle:
            out.append((key[0], None, "closed", last))
            active = False
            self.event.update((last, active, touched))
        if not active and now >= touched + self.keep:
            self.event.clear()
            self.texts.clear()
        else:
            self._plan(now, last, active, touched)
        yield pd.DataFrame(out, columns=["event_id", "article_id", "what", "at"]).astype({"article_id": "Int64"})

    def close(self) -> None:
        pass


def late_texts(stream: DataFrame, idle_hours: int = 72, keep_hours: int = 24 * 30, lateness: str = "2 minutes") -> DataFrame:
    """(event_id, article_id, what, at in ms): opened, closed and reopened events, and articles whose text is to be annotated, or annotated again.

    `stream`: event_id, article_id, effective_at (the article's time), text (null: not there yet) and arrived_at. A text is annotated when it first comes
    and when it changes, also when its event is closed; that alone does not open the event. Needs a state store of RocksDB, which is set where unset.
    """
    spark = stream.sparkSession
    ship(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.withWatermark("arrived_at", lateness).select(
        "event_id", "article_id", F.unix_millis("effective_at").alias("at"), F.sha2("text", 256).alias("digest"), F.unix_millis("arrived_at").alias("arrived"), "arrived_at"
    )
    return rows.groupBy("event_id").transformWithStateInPandas(LateTexts(idle_hours * HOUR, keep_hours * HOUR), OUT, "Append", "EventTime")


def batch_result(rows: DataFrame, horizon: str, idle_hours: int = 72) -> tuple[DataFrame, DataFrame]:
    """What the stream amounts to for a whole table: (event_id, active) at the horizon of arrival, and (article_id, changes): how often each article's text came or changed."""
    events = rows.groupBy("event_id").agg((F.max("effective_at") + F.expr(f"interval {idle_hours} hours") > F.lit(horizon).cast("timestamp")).alias("active"))
    w = Window.partitionBy("event_id", "article_id").orderBy("arrived_at")
    texts = rows.filter(F.col("text").isNotNull()).withColumn("before", F.lag("text").over(w))
    return events, texts.groupBy("article_id").agg(F.count_if(F.col("before").isNull() | (F.col("text") != F.col("before"))).alias("changes"))
