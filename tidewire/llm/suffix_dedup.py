"""Suffix-array dedup: bytes covered by a `length`-byte string that also starts elsewhere are removed.

Method: a sparse suffix array, sorted by a common-prefix-aware distributed merge sort. Suffixes are taken at anchors: the anchor of a
window of `length` bytes is the place of the smallest hash among the grams that start in its first `span` bytes, so equal windows
have their anchors at the same distance, and there are about `span` / 2 bytes between anchors. All windows of one anchor hold the
`length - span + 1` bytes from it on; only anchors for which these repeat go on (a sketch estimates, never too low), and are
written once. Occurrences with the same surroundings are folded into one suffix with a count. Every task sorts suffixes into a run and
sends it front-coded to the owners of key ranges; an owner merges its runs by a loser tree that compares two heads only past the
prefix they are known to share, as a stream. The merged order and its common prefixes, with the same for what stands before the
anchors, tell for each distance which windows are equal.

An anchor with more than `crowd` different surroundings would meet in one owner. It is split by longer prefixes: half of its windows,
those at small distances, share more bytes after the anchor, and the other half share bytes before it; each half is a suffix of its
own with that longer key, halved again while it is crowded. Down at one window a half, all surroundings of a key are equal.

Cases: null text is empty; texts shorter than `length` bytes lose nothing; repeated rows repeat each other's bytes (rows with the same
id and text are one row in the result for each, both judged as repeated); empty tables give empty tables; a null id is kept; other
columns are not read; a very long text is read in slices.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import _BASE, _BASE_INV, _BYTE, U64, keyed, kind_of, mix, powers, signed, steps, text_bytes, tidy, written
from .jaccard_join import grouped

GRAM = 16
#: Bytes of a very long text that are looked at in one slice.
SLICE = 8 << 20
#: About what a suffix takes: itself, what stands before it, numbers and keys.
SUFFIX_BYTES = 700
_SEEDS = (U64(0x3C79AC492BA7B653), U64(0x1C69B3F74AC4AE35))
_ITEM = "g long, c long, n long, k {kind}, t binary, at int, low int, high int, w int"


def slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, offsets, rows and the first byte's place in its text: of many short texts, or of a slice of a long one. Slices overlap so
    that each window of `length` bytes lies in one, in which it starts."""
    done = 0
    for b in steps(batch, "text"):
        raw, offs = text_bytes(b.column("text"))
        rows = done + np.arange(b.num_rows)
        done += b.num_rows
        if len(rows) > 1 or len(raw) <= 2 * SLICE:
            yield raw, offs, rows, 0
            continue
        for at in range(0, max(1, len(raw) - length + 1), SLICE):
            part = raw[at : at + SLICE + length - 1]
            yield part, np.array([0, len(part)]), rows, at


class Anchors:
    """The anchors of some texts: document, place in the bytes, and the least and most distance of their windows' starts."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, length: int, span: int):
        self.raw, self.offs = raw, offs
        n = len(raw)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[raw] * powers(_BASE, n), out=self.total[1:])
        self.inverse = powers(_BASE_INV, n + 1)
        self.doc = self.at = self.low = self.high = np.zeros(0, np.int64)
        if n < length:
            return
        bits = n.bit_length()
        m = n - GRAM + 1
        g = (self.hash(np.arange(m), GRAM) >> U64(bits) << U64(bits)) | np.arange(m, dtype=U64)
        least = self._sliding(g, span)
        size = np.diff(offs)
        long = np.flatnonzero(size >= length)
        if not len(long):
            return
        n_win = size[long] - length + 1
        doc = np.repeat(long, n_win)
        start = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win) + offs[doc]
        at = (least[start] & U64((1 << bits) - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        self.doc, self.at, self.high, self.low = doc[first], at[first], at[first] - start[first], at[first] - start[last]

    @staticmethod
    def _sliding(x: np.ndarray, w: int) -> np.ndarray:
        """Minimum of each w values, from running minima of blocks of w from the left and from the right."""
        pad = (-len(x)) % w + w
        y = np.concatenate([x, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, w)
        left = np.minimum.accumulate(y, axis=1).ravel()
        right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[: len(x)], left[w - 1 : w - 1 + len(x)])

    def hash(self, at: np.ndarray, n) -> np.ndarray:
        return mix((self.total[at + n] - self.total[at]) * self.inverse[at])

    def take(self, rows: np.ndarray) -> None:
        self.doc, self.at, self.low, self.high = self.doc[rows], self.at[rows], self.low[rows], self.high[rows]

    def keys(self, length: int, span: int) -> np.ndarray:
        return self.hash(self.at, length - span + 1)

    def contents(self, length: int) -> np.ndarray:
        n = self.high - self.low + length
        return mix(self.hash(self.at - self.high, n) + (self.high * 65536 + self.low).astype(U64))


def _cells(key: np.ndarray, bits: int) -> list[np.ndarray]:
    row = bits - 1
    return [(mix(key ^ seed) >> U64(64 - row)).astype(np.int64) + (i << row) for i, seed in enumerate(_SEEDS)]


@tidy
def _count(batches: Iterator[pa.RecordBatch], length: int, span: int, bits: int) -> Iterator[pa.RecordBatch]:
    part = sketch.Partial()
    for batch in batches:
        for raw, offs, _, _ in slices(batch, length):
            for cells in _cells(Anchors(raw, offs, length, span).keys(length, span), bits):
                yield from part.add(cells)
    yield from part.flush()


@tidy
def _suspects(batches: Iterator[pa.RecordBatch], length: int, span: int, bits: int, repeated) -> Iterator[pa.RecordBatch]:
    """The anchors whose key is estimated to repeat: key, content of the surroundings, row, place and distances."""
    for batch in batches:
        for raw, offs, row, base in slices(batch, length):
            found = Anchors(raw, offs, length, span)
            g = found.keys(length, span)
            one, two = _cells(g, bits)
            rows = np.flatnonzero(sketch.test(repeated.value, one))
            rows = rows[sketch.test(repeated.value, two[rows])]
            if len(rows):
                found.take(rows)
                take = pa.array(row[found.doc])
                place = found.at - offs[found.doc] + base
                yield pa.RecordBatch.from_arrays([signed(g[rows]), signed(found.contents(length)), batch.column("k").take(take), batch.column("t").take(take), *(pa.array(x.astype(np.int32)) for x in (place, found.low, found.high))], ["g", "c", "k", "t", "at", "low", "high"])


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def _items(b: pa.RecordBatch) -> Iterator[tuple[bytes, list[dict]]]:
    for text, items in zip(b.column("text"), b.column("items").to_pylist(), strict=True):
        yield text.as_buffer().to_pybytes(), items


@tidy
def _halved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Crowded suffixes split in two by distance: the halves' longer keys and contents, and how far the anchor moved."""
    names = ["g", "c", "g2", "c2", "n", "at", "low", "high", "w", "shift"]
    for batch in batches:
        out: list[tuple] = []
        owner: list[int] = []
        for row, (raw, items) in enumerate(_items(batch)):
            for x in items:
                half = x["w"] // 2
                for shift, w in ((0, half), (half, x["w"] - half)):
                    low, high, at = max(x["low"] - shift, 0), min(x["high"] - shift, w - 1), x["at"] - shift
                    if low <= high:
                        content = raw[at - high : at - low + length] + struct.pack("<iii", low, high, w)
                        out.append((x["g"], x["c"], _digest(raw[at : at + length - w + 1]), _digest(content), x["n"], at, low, high, w, shift))
                        owner.append(row)
        if out:
            take = pa.array(owner)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("k").take(take), batch.column("t").take(take), *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True))], ["k", "t", *names])


@tidy
def _heads(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [raw[x["at"] : x["at"] + length - x["w"] + 1] for raw, items in _items(batch) for x in items]
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary())], ["head"])


# ---------------------------------------------------------------- sorted runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need not be read again."""
    n = min(len(a), len(b))
    while known < n:
        x = int.from_bytes(a[known : known + 32].ljust(32, b"\0"), "big") ^ int.from_bytes(b[known : known + 32].ljust(32, b"\0"), "big")
        if x:
            return min(n, known + (256 - x.bit_length()) // 8)
        known += 32
    return n


def front_code(strings: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """For sorted strings: the prefix each shares with the one before, the remaining bytes, and how many these are."""
    shared = [0] + [common_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False)]
    rest = [s[n:] for s, n in zip(strings, shared, strict=True)]
    return shared[: len(strings)], b"".join(rest), [len(r) for r in rest]


@tidy
def _runs(batches: Iterator[pa.RecordBatch], length: int, splitters: list[bytes], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of this task's suffixes, by owner."""
    part, made, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def done():
        by_owner: dict[int, list[tuple]] = {}
        for x in sorted(held, key=lambda x: x[0]):
            by_owner.setdefault(bisect_right(splitters, x[0][: length - x[3] + 1]), []).append(x)
        for owner, own in by_owner.items():
            shared, rest, sizes = front_code([x[0] for x in own])
            numbers = np.array([(s, n, len(x[1]), *x[4:6], x[3]) for s, n, x in zip(shared, sizes, own, strict=True)], "<i4")
            keys = np.array([(*x[2], x[6]) for x in own], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([part << 24 | made], pa.int64()), *(pa.array([x], pa.binary()) for x in (rest, b"".join(x[1] for x in own), numbers.tobytes(), keys.tobytes()))], ["owner", "run", "rest", "before", "numbers", "keys"])

    for batch in batches:
        for raw, items in _items(batch):
            for x in items:
                at, low, high = x["at"], x["low"], x["high"]
                held.append((raw[at : at - low + length], raw[at - high : at][::-1], (x["g"], x["c"]), x["w"], low, high, x["n"]))
                size += SUFFIX_BYTES
            if size > limit:
                yield from done()
                held, size, made = [], 0, made + 1
    if held:
        yield from done()


class LoserTree:
    """Merges sorted runs: streams of (string, prefix shared with the string before in the run, item). A node keeps the loser and the prefix
    that it shares with the winner; of two heads that share different lengths with the last output, the longer is the smaller without
    looking at a byte."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.leaves = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers: list[tuple[int, int]] = [(-1, 0)] * self.leaves
        self.top = self._build(1)

    def _head(self, run: int) -> tuple[bytes, int, object] | None:
        return self.heads[run] if 0 <= run < len(self.heads) else None

    def _play(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        x, y = self._head(a[0]), self._head(b[0])
        if y is None:
            return a, b
        if x is None:
            return b, a
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        n = common_prefix(x[0], y[0], a[1])
        if n == len(x[0]) or (n < len(y[0]) and x[0][n] < y[0][n]):
            return a, (b[0], n)
        return b, (a[0], n)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.leaves:
            return node - self.leaves, 0
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        """(string, prefix shared with the last output, item) in sorted order."""
        while (head := self._head(self.top[0])) is not None:
            run, shared = self.top
            yield head[0], shared, head[2]
            self.heads[run] = after = next(self.runs[run], None)
            now = (run, after[1] if after else 0)
            node = (run + self.leaves) >> 1
            while node:
                now, self.losers[node] = self._play(now, self.losers[node])
                node >>= 1
            self.top = now


def _decoded(t: dict) -> Iterator[tuple[bytes, int, tuple]]:
    """A run, string by string: (suffix, shared prefix, (g, c, n, what stands before, low, high))."""
    prev, i, j = b"", 0, 0
    for (shared, rest, left, low, high, _), key in zip(np.frombuffer(t["numbers"], "<i4").reshape(-1, 6).tolist(), np.frombuffer(t["keys"], "<i8").reshape(-1, 3).tolist(), strict=True):
        prev = prev[:shared] + t["rest"][i : i + rest]
        yield prev, shared, (*key, t["before"][j : j + left], low, high)
        i, j = i + rest, j + left


def _equal_windows(items: list[tuple], shared: list[int], length: int, span: int) -> Iterator[pa.RecordBatch]:
    """For sorted suffixes, with all of each key: the least and most distance at which a window is found twice or more."""
    n = len(items)
    keys = np.array([x[:2] for x in items])
    count, low, high = (np.array([x[i] for x in items]) for i in (2, 4, 5))
    known = np.array(shared)
    _, group = np.unique(keys[:, 0], return_inverse=True)
    before = [x[3] for x in items]
    names = group.tolist()
    by_left = sorted(range(n), key=lambda i: (names[i], before[i]))
    left = np.zeros(n, np.int64)
    for p in range(1, n):
        a, b = by_left[p - 1], by_left[p]
        left[p] = common_prefix(before[a], before[b]) if names[a] == names[b] else -1
    back = np.empty(n, np.int64)
    back[by_left] = np.arange(n)
    first, last = np.full(n, 1 << 30), np.full(n, -1)
    for a in range(span):
        rows = np.flatnonzero((low <= a) & (a <= high))
        if not len(rows):
            continue
        right_class = np.cumsum(known < length - a)
        left_class = np.cumsum(left < a)[back]
        _, which = np.unique(right_class[rows] * (n + 1) + left_class[rows], return_inverse=True)
        hit = rows[np.bincount(which, weights=count[rows])[which] > 1]
        first[hit] = np.minimum(first[hit], a)
        last[hit] = a
    hit = np.flatnonzero(last >= 0)
    if len(hit):
        yield pa.RecordBatch.from_arrays([pa.array(keys[hit, 0]), pa.array(keys[hit, 1]), pa.array(first[hit].astype(np.int32)), pa.array(last[hit].astype(np.int32))], ["g", "c", "least", "most"])


@tidy
def _merge(batches: Iterator[pa.RecordBatch], length: int, span: int, together: int = 16_384) -> Iterator[pa.RecordBatch]:
    """The runs of an owner merged; about `together` suffixes, with all that share a prefix of the shortest key, are judged at once."""
    for t in grouped(batches, ["owner"]):
        items: list[tuple] = []
        shared: list[int] = []
        for _, n, item in LoserTree([_decoded(r) for r in t.to_pylist()]):
            if len(items) >= together and n < length - span + 1:
                yield from _equal_windows(items, shared, length, span)
                items, shared = [], []
            items.append(item)
            shared.append(n)
        if items:
            yield from _equal_windows(items, shared, length, span)


def _with_texts(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The texts that hold some of `items`, each with a list of them."""
    listed = items.groupBy("k", "t").agg(F.collect_list(F.struct("g", "c", "n", "at", "low", "high", "w")).alias("items"))
    listed = written(listed, "suffix-lists")
    bits, held = sketch.filter_of(listed)
    texts = rows.select("k", "t", "text")
    found = texts.mapInArrow(lambda it: sketch._pick(it, bits, held, True), texts.schema).join(listed, ["k", "t"])
    return found.dropDuplicates(["k", "t"])  # of repeated rows one


def repeated_spans(rows: DataFrame, length: int = 400, span: int = 256, crowd: int = 20_000, run_bytes: int = 32 << 20, max_cell_bits: int = 28, sampled: int = 4_000) -> DataFrame:
    """(k, t, spans): byte spans (start, stop) of each row of `rows` (see `keyed`) covered by strings that start elsewhere too; spans may overlap."""
    if span + GRAM > length:
        span = max(1, length - GRAM)
    kind = kind_of(rows)
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.width_for(n_bytes * 2 // span, 16, 18, max_cell_bits)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("text")
    repeated = sketch.merged_bits(texts.mapInArrow(lambda it: _count(it, length, span, bits), sketch.SCHEMA), bits, sketch.tasks_for(n_bytes))
    suspects = rows.select("k", "t", "text").mapInArrow(lambda it: _suspects(it, length, span, bits, repeated), f"g long, c long, k {kind}, t binary, at int, low int, high int")
    suspects = written(suspects, "suffix-suspects")

    folded = F.min(F.struct("k", "t", "at")).alias("one"), F.min("low").alias("low"), F.min("high").alias("high")
    shape = ["g", "c", "n", "one.k", "one.t", "one.at", "low", "high", "w"]
    items = suspects.groupBy("g", "c").agg(F.count("*").alias("n"), *folded).withColumn("w", F.lit(span)).select(*shape)
    leaves, halves = None, []
    while True:
        items = written(items, "suffix-items")
        sizes = written(items.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("total > 1"), "suffix-sizes")
        few = items.join(sizes.filter(F.col("m") <= crowd).select("g"), "g").select(*items.columns)
        leaves = few if leaves is None else leaves.unionByName(few)
        crowds = sizes.filter(F.col("m") > crowd)
        if crowds.isEmpty():
            break
        many = items.join(crowds.select("g"), "g").select(*items.columns)
        split = written(_with_texts(rows, many).mapInArrow(lambda it: _halved(it, length), f"k {kind}, t binary, g long, c long, g2 long, c2 long, n long, at int, low int, high int, w int, shift int"), "suffix-halves")
        halves.append(split.select("g", "c", "g2", "c2", "shift"))
        again = split.groupBy(F.col("g2").alias("g"), F.col("c2").alias("c")).agg(F.sum("n").alias("n"), *folded, F.min("w").alias("w"))
        items = again.select(*shape)
    leaves = written(leaves, "suffix-leaves")

    # Key ranges: splitters from a bounded sample of the suffixes' first bytes, which those of one key share.
    n_items = leaves.count()
    owners = max(parts, n_items * SUFFIX_BYTES >> 25)
    some = leaves.orderBy(F.xxhash64("g", "c")).limit(sampled)
    heads = _with_texts(rows, some).mapInArrow(lambda it: _heads(it, length), "head binary").collect()
    heads = sorted(bytes(r["head"]) for r in heads)
    splitters = sorted({heads[len(heads) * i // owners] for i in range(1, owners)}) if heads else []
    runs = _with_texts(rows, leaves).mapInArrow(lambda it: _runs(it, length, splitters, run_bytes), "owner int, run long, rest binary, before binary, numbers binary, keys binary")
    merged = runs.repartition(owners, "owner").sortWithinPartitions("owner", "run").mapInArrow(lambda it: _merge(it, length, span), "g long, c long, least int, most int")
    found = merged = written(merged, "suffix-found")
    for half in reversed(halves):  # from the halves back to whole suffixes
        at = half.join(found.withColumnsRenamed({"g": "g2", "c": "c2"}), ["g2", "c2"])
        found = found.unionByName(at.select("g", "c", (F.col("least") + F.col("shift")).alias("least"), (F.col("most") + F.col("shift")).alias("most")))
    spans = suspects.join(found, ["g", "c"]).select("k", "t", (F.col("at") - F.col("most")).cast("long").alias("start"), (F.col("at") - F.col("least") + length).cast("long").alias("stop"))
    return spans.groupBy("k", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("text"), b.column("spans") if "spans" in b.schema.names else repeat(None), strict=False):
            raw = text.as_buffer().to_pybytes()
            n, gone, runs = len(raw), 0, 0
            if spans is not None and spans.is_valid and len(spans.values):
                start, stop = (spans.values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(stop[order])
                new = np.concatenate([[True], start[1:] > reach[:-1]])
                first = start[new]
                last = reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
                gone, runs = int((last - first).sum()), len(first)
                raw = b"".join(raw[i:j] for i, j in zip([0, *last.tolist()], [*first.tolist(), n], strict=True))
            out.append((n, gone, runs, raw, hashlib.sha256(raw).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def dedup_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes) and kept_sha256."""
    rows = keyed(docs, id_col, text_col)
    marks = written(repeated_spans(rows, length, **limits), "repeated-spans")
    schema = f"doc_id {kind_of(docs, id_col)}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    hit, clear = sketch.split(rows, marks, _cut, schema)
    return hit.join(sketch.shuffled(marks), ["k", "t"], "left").mapInArrow(_cut, schema).unionByName(clear)
