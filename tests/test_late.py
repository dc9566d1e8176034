"""Late text and late articles on a stream, against the whole table at once."""

import datetime

from pyspark.sql import functions as F

from tidewire.streaming import late, streams

at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
SCHEMA = "event_id long, article_id long, effective_at timestamp, text string, arrived_at timestamp"


def run(spark, tmp_path, batches, **kw):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path = streams.run_to_table(late.late_texts(stream, **kw), path=f"{tmp_path}/out")
    return spark.read.parquet(path)


def test_text_after_closing_is_annotated_and_a_late_article_opens_the_event_again(spark, tmp_path):
    batches = [
        [(1, 10, at(0), "first", at(0)), (1, 11, at(1), None, at(1)), (2, 20, at(2), "other", at(2))],
        [(2, 21, at(90), None, at(90))],  # arrival passes event 1 by 72 hours
        [(1, 11, at(1), "late text", at(100)), (2, 21, at(90), None, at(100))],  # text of a closed event
        [(1, 10, at(0), "first", at(101)), (1, 11, at(1), "late text, changed", at(102))],
        [(1, 12, at(60), "a late article", at(110))],  # its own time is long past
        [(2, 22, at(400), "x", at(400))],
        [(2, 22, at(400), "x", at(401))],
    ]
    out = run(spark, tmp_path, batches)
    got = [(r["event_id"], r["article_id"], r["what"]) for r in out.orderBy("event_id", "at").collect()]
    of = lambda e, *what: [x for x in got if x[0] == e and x[2] in what]
    assert len(of(1, "opened")) == len(of(1, "reopened")) == 1 and len(of(1, "closed")) == 2
    assert [x[1] for x in of(1, "annotated")] == [10, 11, 12] and [x[1] for x in of(1, "annotated again")] == [11]
    assert len(of(2, "opened")) == 1 and len(of(2, "reopened")) == len(of(2, "closed")) == 2  # idle for 72 hours before 21 and before 22
    rows = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    events, texts = late.batch_result(rows, "2024-01-17 17:00:00")
    changes = {r["article_id"]: r["n"] for r in out.filter("article_id IS NOT NULL").groupBy("article_id").agg(F.count("*").alias("n")).collect()}
    assert changes == {r["article_id"]: r["changes"] for r in texts.collect()}
    last = {}
    for r in out.filter("article_id IS NULL").collect():
        last.setdefault(r["event_id"], []).append(r["what"])
    active = {e: len([w for w in what if w != "closed"]) > what.count("closed") for e, what in last.items()}
    assert active == {r["event_id"]: r["active"] for r in events.collect()} == {1: False, 2: True}


def test_state_is_forgotten_after_a_while(spark, tmp_path):
    batches = [[(1, 10, at(0), "text", at(0))], [(2, 20, at(100), "y", at(100))], [(2, 21, at(300), "y", at(300))], [(2, 22, at(301), "y", at(301))], [(1, 10, at(0), "text", at(302))]]
    what = [r["what"] for r in run(spark, tmp_path, batches, keep_hours=120).filter("event_id = 1").collect()]
    assert what.count("opened") == what.count("annotated") == 2 and "closed" in what  # it comes as if it had never been there
