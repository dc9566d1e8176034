"""Shared pieces: row keys, tables written to the cluster's shared folder, and vectorised text arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import shared_dir
from ..shipping import ship

#: Null ids count as the smallest id.
NULL_ID = -(2**63)
#: Bytes of text that one vectorised step handles at once (a longer text is a step of its own).
STEP_BYTES = 1 << 19
U64 = np.uint64


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(docs: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores as make it none of the columns of `docs`."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def id_key(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Order and join key of a row, null as the smallest: an integral id is a long; any other orders by its text."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return F.coalesce(column(id_col).cast("long"), F.lit(NULL_ID))
    return F.coalesce(F.concat(F.lit("1"), column(id_col).cast("string")), F.lit("0"))


def id_of(k: Column, docs: DataFrame, id_col: str = "doc_id") -> Column:
    """The id that `id_key` made `k` of."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, IntegralType):
        return F.when(k != NULL_ID, k).cast(kind)
    return F.when(k != "0", F.substring(k, 2, 2**31 - 1)).cast(kind)


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256, as 16 bytes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns (doc_id, k, t, text): k orders rows, (k, t) tells apart repeated ids with different texts (t is a 128-bit digest of the
    text), so only rows of one id and one text share a key, which is harmless as they are treated alike; null text is empty.

    Only these columns are read, so further columns of any name do no harm.
    """
    ship(docs.sparkSession)
    text = F.coalesce(column(text_col), F.lit(""))
    return docs.select(column(id_col).alias("doc_id"), id_key(docs, id_col).alias("k"), text_key(text).alias("t"), text.alias("text"))


def kind_of(rows: DataFrame, name: str = "k") -> str:
    """A column's type as text, for the schemas of functions over batches."""
    return rows.schema[name].dataType.simpleString()


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns of `docs` and the keys of `keyed` under names that are free, and these names."""
    ship(docs.sparkSession)
    k, t = spare(docs, "_k", "_t")
    return docs.withColumns({k: id_key(docs, id_col), t: text_key(F.coalesce(column(text_col), F.lit("")))}), [k, t]


#: What tasks of one function keep between them (encoders with their words, lattices). A task of another function drops it, as Python
#: workers are used again for later stages, which need the memory.
task_caches: dict = {}
_owner: list[str] = [""]


def let_go(shared: Broadcast) -> None:
    """Drop this process's copy of a broadcast value, which is read again from the executor's file when it is next asked for."""
    if getattr(shared, "_path", None):
        vars(shared).pop("_value", None)


def tidy(fn):
    """For functions over a task's batches: drop what other functions' tasks have kept, look for cyclic garbage only at the task's end (large caches make each search slow), and give
    freed memory back to the machine then, with the task's copies of broadcast values: Python workers live on, and more of them wait than work."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        if _owner[0] != fn.__qualname__:
            task_caches.clear()
            _owner[0] = fn.__qualname__
            gc.collect()
        gc.disable()
        if _libc is not None:  # arrays from 4 MB on go back to the machine as soon as they are freed
            _libc.mallopt(_MMAP_THRESHOLD, 4 << 20)
            _libc.mallopt(_TRIM_THRESHOLD, 16 << 20)  # smaller ones stay for the next step and go back at the task's end
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(*args, **kwargs)
        finally:
            for x in (*args, *kwargs.values()):
                if isinstance(x, Broadcast):
                    let_go(x)
            gc.enable()
            pa.default_memory_pool().release_unused()
            if _libc is not None:
                _libc.malloc_trim(0)

    return run


_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # fixed values: the C library's names of the settings
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim, _libc.mallopt  # noqa: B018  absent from other C libraries
except (OSError, AttributeError):
    _libc = None


# ---------------------------------------------------------------- arrays of text


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose texts have about `limit` bytes in all."""
    ends = _offsets(batch.column(column))[1:]
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else _offsets(batch.column(column))[0]
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, one after another, and each text's first offset (and the end)."""
    offs = _offsets(col)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def digest_words(col: pa.Array) -> np.ndarray:
    """The first 8 bytes of each 16-byte digest of a binary column without nulls."""
    offs = _offsets(col)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(col) else np.zeros(0, np.uint8)
    return raw.view(U64)[::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1024), base, U64)
        x[0] = 1
        _powers[base] = have = np.multiply.accumulate(x)
    return have[:n]


def word_spans(raw: np.ndarray, offs: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes that are not `blank` (words `[^\\x20\\x09-\\x0D]+`); no word goes past its document."""
    word = ~blank[raw]
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    start[firsts] = word[firsts]
    lasts = firsts[1:] - 1
    end[lasts] = word[lasts]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, block: int = STEP_BYTES) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans come in order and do not overlap."""
    out = np.empty(len(s), U64)
    at = 0
    while at < len(s):
        stop = max(at + 1, int(np.searchsorted(e, s[at] + block, "right")))
        lo, hi = s[at], e[stop - 1]
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[raw[lo:hi]] * powers(_BASE, hi - lo), out=total[1:])
        a, b = s[at:stop] - lo, e[at:stop] - lo
        out[at:stop] = (total[b] - total[a]) * powers(_BASE_INV, hi - lo)[a] + (b - a).astype(U64) * U64(0xA0761D6478BD642F)
        at = stop
    return mix(out)


def gram_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of each run of n values (polynomial, then mixed); n - 1 fewer than values, or none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j in range(n):
        out *= U64(base)
        out += h[j : j + m]
    return mix(out)


GRAM_BASES = (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def signed(x: np.ndarray) -> pa.Array:
    """An unsigned 64-bit array as a long column."""
    return pa.array(x.view(np.int64))
