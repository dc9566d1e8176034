"""Packing along a space-filling curve: documents are ordered by the Hilbert key of a few projected dimensions and cut into sequences.

A document's vector is its hashed id counts, signed and projected to `dims` dimensions; equal and similar documents get equal or near
keys. The table of ids is written once; keys and counts alone are range-sorted, running sums give every document its place in
the one long stream along the curve, and the ids are cut at multiples of the sequence length, so that only the very last
sequence is padded.

Cases: null text is empty and still has the end id; repeated rows are each packed; ties of the key go by id; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keyed, kind_of, mix, steps, tidy, written
from .tokens import ENCODE_BYTES, binary_pieces, encoder, with_end

HASHED = 256


def projection(dims: int, seed: int = 11) -> np.ndarray:
    """For each 16-bit id, its signed hash bucket's row of a random projection."""
    h = mix(np.arange(1 << 16, dtype=U64) + U64(0x51ED270B))
    sign = np.where(h >> U64(63), 1.0, -1.0)
    return (np.random.default_rng(seed).standard_normal((HASHED, dims))[(h % U64(HASHED)).astype(int)] * sign[:, None]).astype(np.float32)


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `x` (unsigned integers of `bits` bits)."""
    x = x.T.astype(np.int64).copy()
    d, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _mean(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The mean row of `table` over `ids`, of a very long text by way of its counts."""
    return table[ids].mean(0) if len(ids) < 1 << 18 else np.bincount(ids, minlength=len(table)) @ table / len(ids)


@tidy
def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, attached: bool, end_id: int, dims: int, bits: int) -> Iterator[pa.RecordBatch]:
    enc, table = encoder(tokenizer, attached), projection(dims)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for b in steps(batch, "text", ENCODE_BYTES):
            ids, ends = with_end(*enc.encode_column(b.column("text")), end_id)
            mean = np.array([_mean(table, ids[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]).reshape(b.num_rows, dims)
            place = np.minimum((1 << bits) - 1, ((1 << bits) / (1 + np.exp(-8 * mean))).astype(np.int64))
            rows = np.arange(row, row + b.num_rows)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows), b.column("doc_id"), b.column("k"), pa.array(hilbert_key(place, bits)), pa.array(np.diff(ends)), binary_pieces(ids, ends)], ["row", "doc_id", "k", "place", "n", "ids"])


@tidy
def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        ends = at + np.cumsum(n)
        if len(n):
            at = int(ends[-1])
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), b.column("n")], ["row", "part", "at", "n"])


@tidy
def _cut(batches: Iterator[pa.RecordBatch], base: dict[int, int], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        take: list[int] = []
        for i, (part, at, ids) in enumerate(zip(b.column("part").to_pylist(), b.column("at").to_pylist(), b.column("ids"), strict=True)):
            x = np.frombuffer(ids.as_buffer(), np.uint16).astype("<u4")
            first, start = base[part] + at, 0
            while start < len(x):
                sequence, offset = divmod(first + start, length)
                n = min(length - offset, len(x) - start)
                raw = x[start : start + n].tobytes()
                for c, v in zip(out, (start, n, zlib.crc32(raw), len(x), sequence, offset, raw), strict=True):
                    c.append(v)
                take.append(i)
                start += n
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(take, pa.int32())), *(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, attached: bool = True, end_id: int = 1, length: int = 2048, dims: int = 4, bits: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit little-endian)."""
    spark = docs.sparkSession
    kind = kind_of(docs, id_col)
    rows = keyed(docs, id_col, text_col).select("doc_id", "k", "text")
    encoded = rows.mapInArrow(lambda it: _encode(it, tokenizer, attached, end_id, dims, bits), f"row long, doc_id {kind}, k {kind_of(rows)}, place long, n long, ids binary")
    encoded = written(encoded, "packing-ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    curve = encoded.select("place", "k", "row", "n").repartitionByRange(n, "place", "k", "row").sortWithinPartitions("place", "k", "row").select("row", "n")
    placed = written(curve.mapInArrow(_offsets, "row long, part int, at long, n long"), "packing-places")
    base, total = {}, 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each range
        base[r["part"]], total = total, total + r["n"]
    joined = encoded.select("row", "doc_id", "ids").join(placed.select("row", "part", "at"), "row").select("doc_id", "ids", "part", "at")
    return joined.mapInArrow(lambda it: _cut(it, base, length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
