"""Sparse partition sketches, merged chunk by chunk into one bit set of bounded size.

A task sends, for each chunk of cells that it touched, the sorted cells and their counts; the owner of a chunk folds them
into dense counters. What is broadcast is one bit a cell, "counted twice or more", so at most `max_cells / 8` bytes however large
the input is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, digest_words, mix, spare, tidy, with_keys

CHUNK_BITS = 20
FAN_IN = 256
SCHEMA = "chunk int, salt int, once binary, twice binary"
_ARROW = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def width_for(items: int, per_item: int, low_bits: int, high_bits: int) -> int:
    """Bits of a power of two of at least items * per_item cells, within the bounds."""
    return max(low_bits, min(high_bits, int(np.ceil(np.log2(max(1, items * per_item))))))


def _pack(x: np.ndarray) -> bytes:
    gaps = np.diff(x, prepend=0)
    return b"2" + gaps.astype("<u2").tobytes() if not len(x) or gaps.max() < 65536 else b"4" + gaps.astype("<u4").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, "<u2" if b[:1] == b"2" else "<u4", offset=1).astype(np.int64))


def emit(once: np.ndarray, twice: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """Rows for cells set (`once`, sorted, distinct) and cells known to count two or more (`twice`, a part of them)."""
    size = 1 << CHUNK_BITS
    rows: list[tuple] = []
    chunks = np.unique(once >> CHUNK_BITS)
    a, a2 = np.searchsorted(once, chunks << CHUNK_BITS), np.searchsorted(once, (chunks + 1) << CHUNK_BITS)
    b, b2 = np.searchsorted(twice, chunks << CHUNK_BITS), np.searchsorted(twice, (chunks + 1) << CHUNK_BITS)
    for c, i, j, p, q in zip(chunks.tolist(), a, a2, b, b2, strict=True):
        rows.append((c, salt, _pack(once[i:j] - c * size), _pack(twice[p:q] - c * size)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Partial:
    """The cells of one task. Counts above one saturate at two: that is all the estimate is asked for."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.held, self.n = limit, [], 0
        self.salt = TaskContext.get().partitionId() if TaskContext.get() else 0

    def add(self, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(cells)
        self.n += len(cells)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            x = np.sort(np.concatenate(self.held))
            first = np.ones(len(x), bool)
            first[1:] = x[1:] != x[:-1]
            again = np.unique(x[~first])
            self.held, self.n = [], 0
            yield from emit(x[first], again, self.salt)


@tidy
def _fold(batches: Iterator[pa.RecordBatch], bits: bool) -> Iterator[pa.RecordBatch]:
    size, now = 1 << CHUNK_BITS, None
    once = twice = None

    def done():
        if bits:
            packed = np.packbits(twice, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([b""], pa.binary()), pa.array([packed], pa.binary())], schema=_ARROW)
        else:
            yield from emit(np.flatnonzero(once) + now[0] * size, np.flatnonzero(twice) + now[0] * size, now[1])

    for batch in batches:
        for c, s, o, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            at = (c, 0 if bits else s)
            if at != now:
                if now is not None:
                    yield from done()
                now, once, twice = at, np.zeros(size, bool), np.zeros(size, bool)
            cells = _unpack(o)
            twice[cells[once[cells]]] = True
            once[cells] = True
            twice[_unpack(t)] = True
    if now is not None:
        yield from done()


def merged_bits(partials: DataFrame, total_bits: int, tasks: int) -> Broadcast:
    """Fold the partial sketches of about `tasks` tasks (above FAN_IN of them, in two levels) and broadcast "two or more" as a bit set of 2**total_bits cells."""
    spark = partials.sparkSession
    n = max(1, min(1 << max(0, total_bits - CHUNK_BITS), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    if tasks > FAN_IN:
        part = partials.withColumn("salt", F.col("salt") % FAN_IN).repartition(n * 4, "chunk", "salt").sortWithinPartitions("chunk", "salt")
        partials = part.mapInArrow(lambda it: _fold(it, False), SCHEMA)
    final = partials.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(lambda it: _fold(it, True), SCHEMA)
    bits = np.zeros(max(1, (1 << total_bits) >> 3), np.uint8)
    size = (1 << CHUNK_BITS) >> 3
    for r in final.select("chunk", "twice").collect():
        got = np.frombuffer(r["twice"], np.uint8)[: len(bits)]
        bits[r["chunk"] * size : r["chunk"] * size + len(got)] = got
    return spark.sparkContext.broadcast(bits)


def tasks_for(n_bytes: int) -> int:
    """How many tasks read so much text, at the usual 128 MB of file each."""
    return n_bytes >> 27


def test(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 != 0


# ---------------------------------------------------------------- which rows need a join


def _row_cells(b: pa.RecordBatch, bits: int, key: str = "t") -> np.ndarray:
    return (mix(digest_words(b.column(key))) >> np.uint64(64 - bits)).astype(np.int64)


@tidy
def _mark(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    part = Partial()
    for b in batches:
        cells = _row_cells(b, bits)
        yield from part.add(np.concatenate([cells, cells]))
    yield from part.flush()


@tidy
def _pick(batches: Iterator[pa.RecordBatch], bits: int, held: Broadcast, inside: bool, key: str = "t") -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.flatnonzero(test(held.value, _row_cells(b, bits, key)) == inside)
        if len(rows):
            yield b.take(pa.array(rows)) if len(rows) < b.num_rows else b


def filter_of(marked: DataFrame, bits_per_row: int = 16, max_bits: int = 28) -> tuple[int, Broadcast]:
    """A Bloom filter of the digests t in `marked`, of bounded size; where that is too small it lets more rows pass."""
    n = marked.count()
    bits = width_for(n, bits_per_row, 16, max_bits)
    return bits, merged_bits(marked.select("t").mapInArrow(lambda it: _mark(it, bits), SCHEMA), bits, n // 1_000_000)


def shuffled(marks: DataFrame) -> DataFrame:
    """`marks` for a join between two functions over batches: never broadcast, as both would then run in one stage, and every task would take two Python workers,
    which live on and each keep what their functions keep."""
    return marks.hint("merge")


def split(rows: DataFrame, marked: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may have their (k, t) in `marked`, and `then` of the rows that surely do not: only the former need to be shuffled to it."""
    bits, held = filter_of(marked, **limits)
    return rows.mapInArrow(lambda it: _pick(it, bits, held, True), rows.schema), rows.mapInArrow(lambda it: then(_pick(it, bits, held, False)), schema)


@tidy
def _edit(batches: Iterator[pa.RecordBatch], columns: list[str], marks: str, edit: Callable[[bytes, pa.Scalar], bytes]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = columns.index("text")
        text = [edit(t.as_buffer().to_pybytes(), m).decode() if t.is_valid and m.is_valid else t.as_py() for t, m in zip(b.column("text"), b.column(marks), strict=True)]
        cols = [b.column(c) for c in columns]
        cols[at] = pa.array(text, pa.string())
        yield pa.RecordBatch.from_arrays(cols, columns)


def edited(docs: DataFrame, marks: DataFrame, mark: str, edit: Callable[[bytes, pa.Scalar], bytes]) -> DataFrame:
    """`docs` (columns of documents) with `edit(text, mark)` for the rows that `marks` (k, t, `mark`) names; n_chars, where there is one, follows the text.

    Rows that surely have no mark are passed on as they are; the others alone are shuffled.
    """
    bits, held = filter_of(marks)
    keyed_docs, (k, t) = with_keys(docs)
    hit = keyed_docs.mapInArrow(lambda it: _pick(it, bits, held, True, t), keyed_docs.schema)
    clear = keyed_docs.mapInArrow(lambda it: _pick(it, bits, held, False, t), keyed_docs.schema)
    (m,) = spare(docs, "_marks")
    named = marks.select(F.col("k").alias(k), F.col("t").alias(t), F.col(mark).alias(m))
    columns = docs.columns
    changed = hit.join(shuffled(named), [k, t], "left").mapInArrow(lambda it: _edit(it, columns, m, edit), docs.schema)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.unionByName(clear.select(*map(column, columns)))


def without(docs: DataFrame, gone: DataFrame, unsure: DataFrame) -> DataFrame:
    """`docs` without the rows whose (k, t) are in `gone`; of rows whose (k, t) are in `unsure` (repeated rows) one is kept."""
    bits, held = filter_of(gone.select("k", "t").unionByName(unsure.select("k", "t")))
    keyed_docs, (k, t) = with_keys(docs)
    hit = keyed_docs.mapInArrow(lambda it: _pick(it, bits, held, True, t), keyed_docs.schema)
    clear = keyed_docs.mapInArrow(lambda it: _pick(it, bits, held, False, t), keyed_docs.schema)
    named = gone.select(F.col("k").alias(k), F.col("t").alias(t)).distinct()
    return hit.join(named, [k, t], "left_anti").dropDuplicates([k, t]).unionByName(clear).select(*map(column, docs.columns))
