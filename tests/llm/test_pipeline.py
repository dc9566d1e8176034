"""The pipeline's stages, each against brute force on its own input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import sketch
from tidewire.llm.common import keyed, written

from .test_text_operators import SF, WORD, brute_links, held

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = held(docs)
        docs = written(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    before, after = seen["language_id"]
    assert len(before) - after.count() <= 0.02 * len(before)

    before, after = seen["line_dedup"]
    where = {}
    for i, x in before:
        for line in x.split(b"\n"):
            where.setdefault(line.strip(b" \t\n\x0b\x0c\r").lower(), set()).add(i)
    drop = lambda i, y: len((k := y.strip(b" \t\n\x0b\x0c\r").lower()).decode()) >= 10 and len(where[k]) > 1 and min(where[k]) != i
    assert sorted(held(after)) == sorted((i, b"\n".join(y for y in x.split(b"\n") if not drop(i, y))) for i, x in before)

    before, after = seen["jaccard_join"]
    first, linked = brute_links(before)
    root = {x: x for x in first}
    for _ in first:
        for x in linked:
            for y in linked[x]:
                root[x] = root[y] = min(root[x], root[y], key=first.get)
    assert {i for i, _ in held(after)} == {first[root[x]] for x in first}

    before, after = seen["substring_dedup"]
    low = {}
    for i, x in before:
        w = WORD.findall(x)
        for j in range(len(w) - 12):
            low[tuple(w[j : j + 13])] = min(i, low.get(tuple(w[j : j + 13]), i))
    want = []
    for i, x in before:
        w = WORD.findall(x)
        gone = {j + a for j in range(len(w) - 12) if low[tuple(w[j : j + 13])] < i for a in range(13)}
        want.append((i, b" ".join(a for j, a in enumerate(w) if j not in gone) if gone else x))
    assert sorted(held(after)) == sorted(want)

    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.collect()} == {i for i, _ in before}


def test_waiting_workers_hold_no_broadcast_values(spark):
    bits = spark.sparkContext.broadcast(np.full(1 << 13, 255, np.uint8))

    def left(batches):
        for b in sketch._pick(batches, 16, bits, True):
            yield b
        yield pa.RecordBatch.from_arrays([pa.array([int("_value" in vars(bits))]), pa.array([b""])], schema=b.schema)

    rows = spark.range(8, numPartitions=2).select(F.lit(7).cast("long").alias("n"), F.unhex(F.md5(F.col("id").cast("string"))).alias("t"))
    assert sorted(r["n"] for r in rows.mapInArrow(left, rows.schema).collect()) == [0, 0, *[7] * 8]


def test_a_task_of_an_edit_takes_one_python_worker(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(2)
    marks = written(keyed(docs).filter("k < 3").select("k", "t", F.array(F.lit(1)).alias("runs")), "few-marks")
    found = sketch.edited(docs, marks, "runs", lambda text, runs: text + b"!")
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {i: f"text {i}" + "!" * (i < 3) for i in range(50)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
