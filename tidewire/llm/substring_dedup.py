"""Substring dedup: word windows that also start in an earlier document are removed.

Method: a Count-min sketch in front of exact grouping. Pass one has every task count the anchors of its windows in a sketch of its
own; the merged sketch never underestimates. A later pass sends only the windows whose estimate is two or more, and groups these
exactly. A window's anchor is the smallest hash among its short grams, so equal windows have equal anchors and no repeat is lost,
while a sketch holds about a fifth as many items as there are windows. A second sketch counts the different runs of windows
around each suspected anchor: where all documents have the same run, the run is grouped as one row in place of its windows. The
sketches' width follows the input up to `max_cell_bits`; beyond that more windows pass and the result stays the same.

Cases: null text has no words; texts of fewer than `window` words keep all; empty tables give empty tables; rows with the same id
count as one document for "earlier"; a null id is the smallest; columns of other names are carried, not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import GRAM_BASES, U64, gram_hashes, keyed, kind_of, mix, powers, signed, span_hashes, steps, text_bytes, tidy, word_spans, written

_ROWS = 2
_SEEDS = (U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25))


def _windows(batch: pa.RecordBatch, window: int, gram: int):
    """For the windows of a batch: place of the first word in its document, document, word hashes, first word, anchor."""
    raw, offs = text_bytes(batch.column("text"))
    s, e, doc = word_spans(raw, offs)
    h = span_hashes(raw, s, e)
    m = len(h) - window + 1
    if m <= 0:
        return None
    ok = np.flatnonzero(doc[:m] == doc[window - 1 :])
    g = gram_hashes(h, gram, GRAM_BASES[0])
    anchor = g[:m].copy()
    for j in range(1, window - gram + 1):
        np.minimum(anchor, g[j : j + m], out=anchor)
    first = np.searchsorted(doc, np.arange(batch.num_rows))
    return ok - first[doc[ok]], doc[ok], h, ok, anchor[ok]


def _cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    row = bits - 1
    return [(mix(anchor ^ seed) >> U64(64 - row)).astype(np.int64) + (i << row) for i, seed in enumerate(_SEEDS)]


@tidy
def _count(batches: Iterator[pa.RecordBatch], window: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    part = sketch.Partial()
    for batch in batches:
        for b in steps(batch, "text"):
            if got := _windows(b, window, gram):
                _, doc, _, _, anchor = got
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                for cells in _cells(anchor[new], bits):
                    yield from part.add(cells)
    yield from part.flush()


def _runs(batch: pa.RecordBatch, window: int, gram: int, bits: int, repeated: np.ndarray):
    """Runs of windows of one document under one suspected anchor: word hashes, document, place, first word, length, anchor and content."""
    got = _windows(batch, window, gram)
    if not got:
        return None
    place, doc, h, first, anchor = got
    a, c = _cells(anchor, bits)
    hit = np.flatnonzero(sketch.test(repeated, a))
    hit = hit[sketch.test(repeated, c[hit])]
    if not len(hit):
        return None
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (anchor[hit[1:]] != anchor[hit[:-1]]) | (doc[hit[1:]] != doc[hit[:-1]])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(hit)))
    at = hit[at]
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(GRAM_BASES[1], len(h)), out=total[1:])
    inverse = powers(pow(GRAM_BASES[1], -1, 2**64), len(h))
    content = mix((total[first[at] + n + window - 1] - total[first[at]]) * inverse[first[at]] + n.astype(U64))
    return h, doc[at], place[at], first[at], n, anchor[at], content


@tidy
def _contents(batches: Iterator[pa.RecordBatch], window: int, gram: int, bits: int, repeated) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in steps(batch, "text"):
            if got := _runs(b, window, gram, bits, repeated.value):
                yield pa.RecordBatch.from_arrays([signed(got[5]), signed(got[6])], ["anchor", "content"])


@tidy
def _count_anchors(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    part = sketch.Partial()
    for b in batches:
        for cells in _cells(b.column("anchor").to_numpy(zero_copy_only=False).view(U64), bits):
            yield from part.add(cells)
    yield from part.flush()


@tidy
def _suspects(batches: Iterator[pa.RecordBatch], window: int, gram: int, bits: int, repeated, varied) -> Iterator[pa.RecordBatch]:
    """A run whose anchor has one content in all documents goes as one row, other runs as a row for each window. Keys have 96 bits."""
    for batch in batches:
        for b in steps(batch, "text"):
            got = _runs(b, window, gram, bits, repeated.value)
            if not got:
                continue
            h, doc, place, first, n, anchor, content = got
            one, two = _cells(anchor, bits)
            split = sketch.test(varied.value, one) & sketch.test(varied.value, two)
            whole, apart = np.flatnonzero(~split), np.flatnonzero(split)
            step = np.arange(n[apart].sum()) - np.repeat(np.cumsum(n[apart]) - n[apart], n[apart])
            wins = np.repeat(first[apart], n[apart]) + step
            keys = [np.concatenate([x[whole], gram_hashes(h, window, base)[wins]]) for x, base in zip((anchor, content), GRAM_BASES, strict=True)]
            take = pa.array(np.concatenate([doc[whole], np.repeat(doc[apart], n[apart])]))
            places = np.concatenate([place[whole], np.repeat(place[apart], n[apart]) + step]).astype(np.int32)
            length = np.concatenate([n[whole], np.ones(len(wins), np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([signed(keys[0]), pa.array((keys[1] >> U64(32)).astype(np.uint32).view(np.int32)), b.column("k").take(take), b.column("t").take(take), pa.array(places), pa.array(length)], ["h1", "h2", "k", "t", "place", "n"])


def repeated_windows(rows: DataFrame, window: int = 13, gram: int = 5, cells_per_word: int = 4, max_cell_bits: int = 28) -> DataFrame:
    """(k, t, runs): runs (first word, count) of the windows of each row of `rows` (see `keyed`) that also start in a row of smaller k."""
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.width_for(n_bytes // 6, cells_per_word, 18, max_cell_bits)
    gram = min(gram, window)
    texts = rows.select("text")
    repeated = sketch.merged_bits(texts.mapInArrow(lambda it: _count(it, window, gram, bits), sketch.SCHEMA), bits, sketch.tasks_for(n_bytes))
    contents = texts.mapInArrow(lambda it: _contents(it, window, gram, bits, repeated), "anchor long, content long").distinct()
    varied = sketch.merged_bits(contents.select("anchor").mapInArrow(lambda it: _count_anchors(it, bits), sketch.SCHEMA), bits, sketch.tasks_for(n_bytes))
    found = rows.select("k", "t", "text").mapInArrow(lambda it: _suspects(it, window, gram, bits, repeated, varied), f"h1 long, h2 int, k {kind_of(rows)}, t binary, place int, n int")
    first = found.groupBy("h1", "h2").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").drop("high")
    first = written(first, "repeated-keys")  # so that both sides of the join are plain shuffles, whose hot keys Spark splits
    later = found.join(first, ["h1", "h2"]).filter("k > low")
    return later.groupBy("k", "t").agg(F.collect_list(F.struct("place", "n")).alias("runs"))


def kept_words(text: bytes, runs: pa.Scalar | None, window: int) -> tuple[int, list[bytes]]:
    """The number of words, and the words outside of the windows of `runs`."""
    words = text.split()
    n = len(words)
    if runs is not None and runs.is_valid and len(runs.values):
        step = np.zeros(n + 1, np.int32)
        at, many = (runs.values.field(i).to_numpy() for i in (0, 1))
        np.add.at(step, at, 1)
        np.add.at(step, at + many - 1 + window, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:n]) == 0).tolist()]
    return n, words


@tidy
def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text"), batch.column("runs") if "runs" in batch.schema.names else repeat(None), strict=False):
            n, words = kept_words(text.as_buffer().to_pybytes(), runs, window)
            kept = b" ".join(words)
            out.append((n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
        n, gone, kept, sha = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["k", "t", "doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _judged(rows: DataFrame, marks: DataFrame, window: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """The rows that may lose words, and the others."""
    schema = f"k {kind_of(rows)}, t binary, doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string"
    hit, clear = sketch.split(rows, marks, lambda it: _removed(it, window), schema)
    return hit.join(sketch.shuffled(marks), ["k", "t"], "left").mapInArrow(lambda it: _removed(it, window), schema), clear


def dedup_windows(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256."""
    rows = keyed(docs, id_col, text_col)
    marks = written(repeated_windows(rows, window, **limits), "repeated-windows")
    hit, clear = _judged(rows, marks, window, kind_of(docs, id_col))
    return hit.unionByName(clear).drop("k", "t")


def clean(docs: DataFrame, window: int = 13, **limits: int) -> DataFrame:
    """`docs` (columns of documents) with repeated windows taken out of the text; a text that loses nothing is left as it is."""
    marks = written(repeated_windows(keyed(docs), window, **limits), "repeated-windows")
    return sketch.edited(docs, marks, "runs", lambda text, runs: b" ".join(kept_words(text, runs, window)[1]))
