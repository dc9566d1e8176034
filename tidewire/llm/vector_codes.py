"""Product codes of vectors: integer k-means over parts of vectors, walked as a lexicographic trie.

Each vector of floor(scale * x) is cut into equal parts. The distinct parts with their weights (how many vectors have them) are one table,
range-sorted by part position and part, so that a file holds neighbouring leaves of a trie whose levels are the dimensions. A round
walks it depth first, a block of leaves at a time: a node's vector of squared distances to all entries, accumulated over the dimensions
down to it, is its parent's plus one dimension, and is made once for all leaves below; the path to the last leaf goes on into the next
block. Leaves take the nearest entry and add their weighted components to its sum. A task sends one row an entry, so what reaches the
driver is one row an entry and part. The final assignment needs no join: every batch of vectors is a small trie of its own.

Arithmetic is in 64-bit integers where no result can leave them, else in Python integers, so it is exact for all components whose
scaled value is a finite double.

Cases: rows whose vector is null or holds null or non-finite components are left out; shorter vectors are filled with zeros up to the
longest's length, which is rounded up to a multiple of the parts; with fewer kept vectors than entries there are as many entries as
vectors; repeated ids are vectors of their own (of equal ids the lexicographically smaller vector is the earlier start entry); a null id is
the smallest; null labels are one label; empty tables give empty tables; other columns are not read. An error beyond a long raises.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, column, id_key, ship, tidy, written

#: Leaves that are walked at once.
BLOCK = 2048
#: A label of more than this share of the rows is joined by broadcast: there are fewer such labels than its inverse.
HEAVY_SHARE = 1 / 1024

Books = list[list[list[int]]]


def _scaled(col: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a column of whole lists without nulls, as doubles, filled with zeros to `dims`."""
    offs = col.offsets.to_numpy().astype(np.int64)
    values = col.flatten().to_numpy()
    size = np.diff(offs)
    out = np.zeros((len(col), dims))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(values)) - np.repeat(offs[:-1] - offs[0], size)] = np.floor(values * scale) + 0.0  # no negative zero
    return out


def _to_bytes(parts: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values whose byte order is the rows' lexicographic order."""
    bits = np.ascontiguousarray(parts).view(U64)
    bits = np.where(bits >> U64(63) != 0, ~bits, bits | U64(1 << 63)).astype(">u8")
    n, width = bits.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width * 8).astype(np.int32).tobytes()), pa.py_buffer(bits.tobytes())])


def _from_bytes(col: pa.Array, width: int) -> np.ndarray:
    """The rows of doubles that `_to_bytes` took."""
    first = col.offset * width
    bits = np.frombuffer(col.buffers()[2] or b"", ">u8")[first : first + len(col) * width].astype(U64)
    bits = np.where(bits >> U64(63) != 0, bits & U64((1 << 63) - 1), ~bits)
    return bits.view(np.float64).reshape(len(col), width)


def _runs(parts: np.ndarray) -> np.ndarray:
    """Where in sorted rows a new value begins."""
    new = np.ones(len(parts), bool)
    new[1:] = (parts[1:] != parts[:-1]).any(1)
    return np.flatnonzero(new)


@tidy
def _distinct(batches: Iterator[pa.RecordBatch], parts: int, dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    """A batch's distinct parts by position, with their weights."""
    width = dims // parts
    for batch in batches:
        whole = _scaled(batch.column("vec"), dims, scale)
        for p in range(parts):
            part = whole[:, p * width : (p + 1) * width]
            part = part[np.lexsort(part.T[::-1])] if width else part
            at = _runs(part)
            weight = np.diff(np.append(at, len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), _to_bytes(part[at]), pa.array(weight)], ["p", "part", "weight"])


# ---------------------------------------------------------------- the trie


def exact(values: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers where these hold them, else as Python integers."""
    if not values.size or np.abs(values).max() < 2**62:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


class Trie:
    """Distances of lexicographically sorted parts to all entries of one part's codebook, block after block in depth-first order."""

    def __init__(self, book: list[list[int]]):
        self.width = len(book[0]) if book else 0
        self.book = np.array(book, object).reshape(len(book), self.width)
        self.top = max((abs(int(x)) for x in self.book.ravel()), default=0)
        self.small = self.book.astype(np.int64) if self.top < 2**62 else None
        self.last: np.ndarray | None = None
        self.path: list[np.ndarray] = [np.zeros(0)] * self.width
        self.made = 0  # nodes whose vector was computed

    def walk(self, parts: np.ndarray) -> np.ndarray:
        """Squared distances, a row a part and a column an entry."""
        values = exact(parts)
        top = max(self.top, max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0)
        fits = self.small is not None and 4 * top * top * max(1, self.width) < 2**62
        book, values = (self.small, values.astype(np.int64)) if fits else (self.book, values.astype(object))
        new = np.ones(values.shape, bool)
        new[1:] = values[1:] != values[:-1]
        if self.last is not None and len(values):
            new[0] = values[0] != self.last
        new = np.logical_or.accumulate(new, axis=1)
        above, parent = np.zeros((1, len(book)), book.dtype), np.zeros(len(values), np.int64)
        for d in range(self.width if len(values) else 0):
            opens = np.flatnonzero(new[:, d])
            step = values[opens, d][:, None] - book[None, :, d]
            vectors = above[parent[opens]] + step * step
            self.made += len(opens)
            held = not new[0, d]  # the block's first leaf goes on below a node of the block before
            if held:
                vectors = np.concatenate([self.path[d][None].astype(book.dtype), vectors])
            above, parent = vectors, np.cumsum(new[:, d]) - (0 if held else 1)
            self.path[d] = vectors[-1]
        if len(values):
            self.last = values[-1]
        return above[parent]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each sorted part (the lower index at ties) and its distance."""
        entry, error = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), BLOCK):
            far = self.walk(parts[at : at + BLOCK])
            best = far.argmin(1).astype(np.int64)
            entry.append(best)
            error.append(far[np.arange(len(far)), best])
        return np.concatenate(entry), np.concatenate(error)


@tidy
def _sums(batches: Iterator[pa.RecordBatch], books: Books, width: int) -> Iterator[pa.RecordBatch]:
    """The task's weight and weighted sums of each entry that is some leaf's nearest."""
    total: dict[tuple[int, int], list[int]] = {}
    tries: dict[int, Trie] = {}
    for batch in batches:
        place = batch.column("p").to_numpy()
        leaves, weight = _from_bytes(batch.column("part"), width), batch.column("weight").to_numpy()
        for p in np.unique(place).tolist():
            rows = np.flatnonzero(place == p)
            trie = tries.setdefault(p, Trie(books[p]))
            entry, _ = trie.nearest(leaves[rows])
            values, heavy = exact(leaves[rows]), weight[rows]
            if int(np.abs(leaves[rows]).max(initial=0)) * int(heavy.sum()) >= 2**62:
                values, heavy = values.astype(object), heavy.astype(object)
            order = np.argsort(entry, kind="stable")
            firsts = np.flatnonzero(np.diff(entry[order], prepend=-1))
            counts = np.add.reduceat(heavy[order], firsts)
            sums = np.add.reduceat(values[order] * heavy[order][:, None], firsts, axis=0)
            for e, c, s in zip(entry[order][firsts].tolist(), counts.tolist(), sums.tolist(), strict=True):
                have = total.setdefault((p, e), [0] * (width + 1))
                total[p, e] = [a + b for a, b in zip(have, [c, *s], strict=True)]
    if total:
        at, sums = zip(*sorted(total.items()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in at], pa.int32()), pa.array([e for _, e in at], pa.int32()), pa.array([[str(x) for x in s] for s in sums], pa.list_(pa.string()))], ["p", "entry", "sums"])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """One entry's sums over all tasks (one row a task)."""
    return pa.table({"p": [key[0]], "entry": [key[1]], "sums": [[str(sum(map(int, x))) for x in zip(*rows.column("sums").to_pylist(), strict=True)]]}, schema=pa.schema([("p", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.string()))]))


# ---------------------------------------------------------------- the whole operator


def whole_rows(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, k, label, vec) of the rows whose vector has only finite components."""
    ship(rows.sparkSession)
    vec = column(vec_col).cast("array<double>")
    label = column(label_col) if label_col else F.lit(None).cast("int")
    out = rows.select(column(id_col).alias("vec_id"), id_key(rows, id_col).alias("k"), label.alias("label"), vec.alias("vec"))
    return out.filter(F.col("vec").isNotNull() & ~F.coalesce(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)), F.lit(False)))


def train(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096) -> tuple[Books, int]:
    """The codebooks of all parts (position, entry, component) and the vectors' length, over all rows of `kept` (see `whole_rows`)."""
    longest = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    width = dims // parts
    first = kept.select("k", "vec").orderBy("k", "vec").limit(entries).collect()  # `entries` rows
    start = [[int(math.floor(x * scale)) for x in r["vec"]] + [0] * (dims - len(r["vec"])) for r in first]
    books = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]
    if not first or not width:
        return books, dims
    spark = kept.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = kept.select("vec").mapInArrow(lambda it: _distinct(it, parts, dims, scale), "p int, part binary, weight long")
    leaves = found.groupBy("p", "part").agg(F.sum("weight").alias("weight")).repartitionByRange(n, "p", "part").sortWithinPartitions("p", "part")
    leaves = written(leaves, "vector-parts")
    for _ in range(rounds):
        sums = leaves.mapInArrow(lambda it, books=books: _sums(it, books, width), "p int, entry int, sums array<string>")
        for r in sums.groupBy("p", "entry").applyInArrow(_added, "p int, entry int, sums array<string>").collect():  # parts * entries rows
            count, *total = map(int, r["sums"])
            books[r["p"]][r["entry"]] = [x // count for x in total]
    return books, dims


@tidy
def _encode(batches: Iterator[pa.RecordBatch], books: Books, dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    width = dims // len(books)
    digits = np.array([b"%02x" % i for i in range(max(1, *(len(b) for b in books)))], "S8")
    for batch in batches:
        whole = _scaled(batch.column("vec"), dims, scale)
        error, codes = np.zeros(len(whole), object), []
        for p, book in enumerate(books):
            part = whole[:, p * width : (p + 1) * width]
            order = np.lexsort(part.T[::-1]) if width else np.arange(len(part))
            entry, far = Trie(book).nearest(part[order])
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            codes.append(digits[entry[back]])
            error = error + far[back]
        code = [b"".join(x).decode() for x in zip(*(c.tolist() for c in codes), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])


def encode(kept: DataFrame, books: Books, dims: int, scale: float = 4096) -> DataFrame:
    """(vec_id, label, code, error) of every row of `kept`: entry indexes in part order, and the squared distance to them."""
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return kept.select("vec_id", "label", "vec").mapInArrow(lambda it: _encode(it, books, dims, scale), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Books, scale: float = 4096, code_col: str = "code") -> DataFrame:
    """`codes` with `vec`, the vector that each code stands for. Expressions only."""
    table = [F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in book)) for book in books]
    at = [F.conv(F.substring(column(code_col), 1 + 2 * p, 2), 16, 10).cast("int") + 1 for p in range(len(books))]
    return codes.withColumn("vec", F.concat(*(F.element_at(t, a) for t, a in zip(table, at, strict=True))))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with `label_error`, the sum of `error` over the rows of the same label. Labels of very many rows meet their sum by broadcast."""
    codes = written(codes, "vector-codes")
    totals = written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    n = codes.count()
    heavy = totals.filter(F.col("rows") > n * HEAVY_SHARE).drop("rows")
    light = totals.filter(F.col("rows") <= n * HEAVY_SHARE).drop("rows")
    same = F.col("label").eqNullSafe(F.col("of"))
    out = codes.join(F.broadcast(heavy), same).unionByName(codes.join(F.broadcast(heavy), same, "left_anti").join(light, same))
    return out.drop("of")


def books_sha256(books: Books) -> str:
    """Digest of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error, label_error) of the rows with whole vectors, and the codebooks. `entries` is 256 at most."""
    kept = whole_rows(rows, id_col, vec_col, label_col)
    books, dims = train(kept, parts, entries, rounds, scale)
    return with_label_errors(encode(kept, books, dims, scale)), books
