"""Line dedup: a line whose key is found in two or more documents stays only in the document of the smallest id.

Method: two Bloom filters, of keys seen once and of keys seen twice. Each task fills a pair of its own; merging sets the twice-seen
bits of both and those bits that two once-seen filters share, so a key of two documents always passes. Only lines that pass are
shuffled, where equal keys are confirmed by a 128-bit digest and the first document is chosen.

Cases: null or empty text is one empty line; keys shorter than `min_chars` code points never drop; a key repeated in one document
alone stays; rows with the same id count as one document; a null id is the smallest; empty tables give empty tables.
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
from .common import U64, keyed, kind_of, mix, span_hashes, steps, text_bytes, tidy, written

_BLANK = b" \t\n\x0b\x0c\r"
_SEEDS = (U64(0x8CB92BA72F3D8DD7), U64(0xCA5A826395121157))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(_BLANK)] = True


def _lines(batch: pa.RecordBatch, min_chars: int):
    """Key start, key end, document and hash of each line whose key is long enough."""
    raw, offs = text_bytes(batch.column("text"))
    if not len(raw):
        return None
    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate([offs[:-1], breaks + 1])
    end = np.concatenate([breaks, offs[1:]])
    start.sort()
    end.sort()
    doc = np.searchsorted(offs, start, "right") - 1
    # the first and last byte of each line that is not blank
    solid = np.flatnonzero(~_IS_BLANK[raw])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = np.flatnonzero(j > i)
    s, e, doc = solid[i[full]], solid[j[full] - 1] + 1, doc[full]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    long = np.flatnonzero(chars[e] - chars[s] >= min_chars)
    s, e, doc = s[long], e[long], doc[long]
    return raw, s, e, doc, span_hashes(_LOWER[raw], s, e)


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h ^ seed) >> U64(64 - bits)).astype(np.int64) for seed in _SEEDS]


@tidy
def _fill(batches: Iterator[pa.RecordBatch], min_chars: int, bits: int) -> Iterator[pa.RecordBatch]:
    part = sketch.Partial()
    for batch in batches:
        for b in steps(batch, "text"):
            if got := _lines(b, min_chars):
                _, _, _, doc, h = got
                h = h[np.unique(mix(h ^ mix(doc.astype(U64))), return_index=True)[1]]  # once a document
                for cells in _cells(h, bits):
                    yield from part.add(cells)
    yield from part.flush()


@tidy
def _suspects(batches: Iterator[pa.RecordBatch], min_chars: int, bits: int, twice) -> Iterator[pa.RecordBatch]:
    held = twice.value
    for batch in batches:
        for b in steps(batch, "text"):
            got = _lines(b, min_chars)
            if not got:
                continue
            raw, s, e, doc, h = got
            one, two = _cells(h, bits)
            hit = np.flatnonzero(sketch.test(held, one) & sketch.test(held, two))
            if len(hit):
                keys = [hashlib.blake2b(raw[i:j].tobytes().lower(), digest_size=16).digest() for i, j in zip(s[hit].tolist(), e[hit].tolist(), strict=True)]
                take = pa.array(doc[hit])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("k").take(take), b.column("t").take(take)], ["key", "k", "t"])


def repeated_lines(rows: DataFrame, min_chars: int = 10, bits_per_line: int = 16, max_bits: int = 29) -> DataFrame:
    """(k, t, keys): digests of the line keys that each row of `rows` (see `keyed`) loses to a row of smaller k."""
    n_bytes, n_lines = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first())
    bits = sketch.width_for(n_lines, bits_per_line, 16, max_bits)
    partials = rows.select("text").mapInArrow(lambda it: _fill(it, min_chars, bits), sketch.SCHEMA)
    twice = sketch.merged_bits(partials, bits, sketch.tasks_for(n_bytes))
    found = rows.mapInArrow(lambda it: _suspects(it, min_chars, bits, twice), f"key binary, k {kind_of(rows)}, t binary")
    first = found.groupBy("key").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").drop("high")
    first = written(first, "repeated-line-keys")  # so that both sides of the join are plain shuffles, whose hot keys Spark splits
    return found.join(first, "key").filter("k > low").groupBy("k", "t").agg(F.collect_set("key").alias("keys"))


def kept_lines(lines: list[bytes], gone: set[bytes], min_chars: int) -> list[bytes]:
    return [x for x in lines if len(y := x.strip(_BLANK)) < min_chars or hashlib.blake2b(y.lower(), digest_size=16).digest() not in gone]


@tidy
def _dropped(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, keys in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("keys").to_pylist() if "keys" in batch.schema.names else repeat(None), strict=False):
            lines = text.split(b"\n")
            n = len(lines)
            if keys:
                lines = kept_lines(lines, set(keys), min_chars)
                text = b"\n".join(lines)
            out.append((n, n - len(lines), text.decode(), hashlib.sha256(text).hexdigest()))
        n, gone, kept, sha = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_dropped, kept_text, kept_sha256."""
    rows = keyed(docs, id_col, text_col)
    schema = f"doc_id {kind_of(docs, id_col)}, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
    marks = written(repeated_lines(rows, min_chars, **limits), "repeated-lines")
    hit, clear = sketch.split(rows, marks, lambda it: _dropped(it, min_chars), schema)
    hit = hit.join(sketch.shuffled(marks), ["k", "t"], "left").select("doc_id", "text", "keys")
    return hit.mapInArrow(lambda it: _dropped(it, min_chars), schema).unionByName(clear)


def clean(docs: DataFrame, min_chars: int = 10, **limits: int) -> DataFrame:
    """`docs` (columns of documents) without the repeated lines; a text that loses none is left as it is."""
    marks = written(repeated_lines(keyed(docs), min_chars, **limits), "repeated-lines")
    return sketch.edited(docs, marks, "keys", lambda text, keys: b"\n".join(kept_lines(text.split(b"\n"), set(keys.as_py()), min_chars)))
