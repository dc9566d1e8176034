"""Ranked lexical search by the Best Position Algorithm, in shards of documents.

One pass over the texts keeps, of each document, its length and the counts of the items' terms; lengths and document frequencies are
aggregates of that table. A task then takes documents in shards of bounded size. A shard holds one impact list a term, highest impact
first, and the other way round each document's places in all lists. For an item, sorted access reads the next places of all its lists;
direct access to each document met for the first time gives its whole score and marks its places in all other lists as seen. The best
position of a list is the end of its unbroken run of seen places, wherever sorted access stands: no unseen document can score more than
the sum of the impacts just behind the best positions. The search of a shard ends when that sum is strictly below the k-th best score (at
equality a smaller id might still follow); the k best that a task holds from earlier shards count for it. At most k rows an item leave
a task.

Items come in blocks of a bounded number of terms, each block a pass of its own over the documents.

Cases: a null or empty text has no terms and is in no count; an item without terms, or without any document, has no rows; a null id is
the smallest; repeated rows are documents of their own; items of equal id and text are one item, of equal id and different texts each
ranked apart; ids that are not integral compare by their text; empty tables give empty tables; other columns are not read. Texts are
cut between terms, so that arrays stay bounded however long a text is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, U64, column, id_key, id_of, kind_of, ship, span_hashes, text_bytes, tidy, word_spans, written

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, only A-Z lower-cased."""
    return TERM.findall((text or "").encode().translate(_LOWER.tobytes()))


class Terms:
    """Looks terms up by hash, then compares their bytes."""

    def __init__(self, terms: list[bytes]):
        self.raw = np.frombuffer(b"".join(terms), np.uint8)
        size = np.array([len(t) for t in terms], np.int64)
        self.at, self.size = np.cumsum(size) - size, size
        h = span_hashes(self.raw, self.at, self.at + size)
        self.order = np.argsort(h).astype(np.int32)
        self.hashes = h[self.order]
        # two terms of one hash are tried one after the other
        self.same = int(max(np.unique(h, return_counts=True)[1], default=0))

    def find(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The number of each span's term, or -1."""
        out = np.full(len(s), -1, np.int64)
        h = span_hashes(raw, s, e)
        first = np.searchsorted(self.hashes, h)
        for step in range(self.same):
            at = np.minimum(first + step, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == h) & (out < 0))
            term = self.order[at[hit]]
            fits = self.size[term] == e[hit] - s[hit]
            hit, term = hit[fits], term[fits]
            n = self.size[term]
            begin = np.cumsum(n) - n
            step_in = np.arange(n.sum()) - np.repeat(begin, n)
            equal = raw[np.repeat(s[hit], n) + step_in] == self.raw[np.repeat(self.at[term], n) + step_in]
            same = np.logical_and.reduceat(equal, begin) if len(hit) else np.zeros(0, bool)
            out[hit[same]] = term[same]
        return out


def _cuts(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that end behind a byte that is in no term."""
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + limit)
        while stop < len(raw) and not (free := np.flatnonzero(_BLANK[raw[max(at, stop - limit) : stop]])).size:
            stop = min(len(raw), stop + limit)
        if stop < len(raw):
            stop = max(at, stop - limit) + int(free[-1]) + 1
        yield at, stop
        at = stop


@tidy
def _postings(batches: Iterator[pa.RecordBatch], held, step_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of each document with terms: k, its number of terms, and the items' terms in it (ascending) with their counts."""
    table: Terms = held.value
    width = max(1, len(table.size))
    for batch in batches:
        raw, offs = text_bytes(batch.column("text"))
        n = np.zeros(batch.num_rows, np.int64)
        keys, counts = [], []
        for lo, hi in _cuts(raw, step_bytes):
            inside = offs[np.searchsorted(offs, lo, "right") : np.searchsorted(offs, hi, "left")]  # documents that end within
            edges = np.concatenate([[lo], inside, [hi]]) - lo
            part = _LOWER[raw[lo:hi]]
            s, e, doc = word_spans(part, edges, _BLANK)
            doc = np.searchsorted(offs, s + lo, "right") - 1
            n += np.bincount(doc, minlength=batch.num_rows)
            term = table.find(part, s, e) if len(table.size) else np.full(len(s), -1)
            got = np.flatnonzero(term >= 0)
            key, count = np.unique(doc[got] * width + term[got], return_counts=True)
            keys.append(key)
            counts.append(count)
        key, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts))
        if len(keys) > 1:
            key, back = np.unique(key, return_inverse=True)
            count = np.bincount(back, count, len(key)).astype(np.int64)
        rows = np.flatnonzero(n)
        ends = np.append(np.searchsorted(key, rows * width), len(key)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % width, count)]
        yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(rows)), pa.array(n[rows]), *lists], ["k", "n", "terms", "tfs"])


# ---------------------------------------------------------------- one shard


class Shard:
    """Impact lists of a bounded number of documents, and each document's places in them.

    Places number all lists one after another: list t takes places `start[t]` to `start[t + 1]`, highest impact first.
    """

    def __init__(self, k: list, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.k = k
        m = 10 + 90 * n * n_docs // n_terms
        doc = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(ends))
        tf = tf.astype(np.int64)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        by_list = np.lexsort((-impact, term))
        self.doc_at, self.impact_at = doc[by_list], impact[by_list]
        self.start = np.searchsorted(term[by_list], np.arange(len(weight) + 1))
        self.ends, self.term, self.impact = ends, term, impact
        self.place = np.empty(len(term), np.int32)
        self.place[by_list] = np.arange(len(term), dtype=np.int32)
        self.order = np.empty(len(k), np.int64)  # documents by id
        self.order[sorted(range(len(k)), key=k.__getitem__)] = np.arange(len(k))
        self.seen_place, self.seen_doc, self.wanted = np.zeros(len(term), bool), np.zeros(len(k), bool), np.zeros(len(weight), bool)

    def _direct(self, docs: np.ndarray) -> np.ndarray:
        """The scores of `docs` over the wanted lists; their places there are seen from now on."""
        n = self.ends[docs + 1] - self.ends[docs]
        at = np.arange(n.sum()) + np.repeat(self.ends[docs] - (np.cumsum(n) - n), n)
        owner = np.repeat(np.arange(len(docs)), n)
        hit = np.flatnonzero(self.wanted[self.term[at]])
        at, owner = at[hit], owner[hit]
        self.seen_place[self.place[at]] = True
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.impact[at], out=total[1:])
        stop = np.searchsorted(owner, np.arange(len(docs) + 1))
        return total[stop[1:]] - total[stop[:-1]]

    def best(self, terms: np.ndarray, k: int, floor: list[int], first: int = 16) -> tuple[list[tuple[int, object]], int]:
        """The `k` best (score, id) over `terms`, and how many documents were scored. `floor`: best scores known from elsewhere, highest first.

        Sorted access takes `first` places of every list, then twice as many each time.
        """
        start, end = self.start[terms], self.start[terms + 1]
        terms, start, end = terms[start < end], start[start < end], end[start < end]
        self.wanted[terms] = True
        docs, scores, depth, take, edge = [], [], 0, first, start.copy()
        while len(terms):
            low, high = np.minimum(start + depth, end), np.minimum(start + depth + take, end)
            n = high - low
            places = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            met = self.doc_at[places]
            met = np.unique(met[~self.seen_doc[met]])
            self.seen_doc[met] = True
            docs.append(met)
            scores.append(self._direct(met))
            depth, take = depth + take, take * 2
            for j in range(len(terms)):  # the best position: behind the unbroken run of seen places
                rest = self.seen_place[edge[j] : end[j]]
                gap = int(rest.argmin()) if len(rest) else 0
                edge[j] += gap if len(rest) and not rest[gap] else len(rest)
            open_ = edge < end
            if not open_.any():
                break
            known = np.concatenate([*scores, np.array(floor, np.int64)])
            if len(known) >= k and int(self.impact_at[edge[open_]].sum()) < int(np.partition(known, len(known) - k)[len(known) - k]):
                break
        found, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, scores))
        for a, b in zip(start, end, strict=True):
            self.seen_place[a:b] = False
        self.seen_doc[found], self.wanted[terms] = False, False
        n_scored = len(found)
        fit = score > 0
        found, score = found[fit], score[fit]
        if len(score) > k:
            fit = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[fit], score[fit]
        top = np.lexsort((self.order[found], -score))[:k]
        return [(int(score[i]), self.k[found[i]]) for i in top], n_scored


@tidy
def _search(batches: Iterator[pa.RecordBatch], held, k: int, shard_size: int) -> Iterator[pa.RecordBatch]:
    """The task's `k` best documents of each item."""
    weight, items, n_docs, n_terms = held.value
    best: list[list[tuple[int, object]]] = [[] for _ in items]
    rows: list[pa.RecordBatch] = []
    size, kind = 0, None

    def done():
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        ends = table.column("terms").offsets.to_numpy().astype(np.int64)
        terms, tfs = (table.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
        shard = Shard(table.column("k").to_pylist(), table.column("n").to_numpy(), ends - ends[0], terms, tfs, weight, n_docs, n_terms)
        for i, terms in enumerate(items):
            got, _ = shard.best(terms, k, [s for s, _ in best[i]])
            best[i] = sorted([*best[i], *got], key=lambda x: (-x[0], x[1]))[:k]

    for batch in batches:
        kind = batch.schema.field("k").type
        at = 0
        ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
        while at < batch.num_rows:  # a shard ends where it is full, also inside a batch
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + shard_size - size, "right")) - 1)
            rows.append(batch.slice(at, stop - at))
            size += int(ends[stop] - ends[at]) + stop - at
            at = stop
            if size >= shard_size:
                done()
                rows, size = [], 0
    if rows:
        done()
    out = [(i, d, s) for i, found in enumerate(best) for s, d in found]
    if out:
        i, d, s = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(d, kind), pa.array(s, pa.int64())], ["item", "k", "score"])


# ---------------------------------------------------------------- the whole search


def _blocks(items: DataFrame, block_terms: int, block_items: int) -> Iterator[tuple[list, list[set[bytes]], dict[bytes, int]]]:
    """Item ids, their terms and the numbers of all terms, block by block; one block is on the driver at a time."""
    ids, sets, number = [], [], {}
    for r in items.toLocalIterator():
        own = set(terms_of(r["text"]))
        if ids and (len(ids) >= block_items or len(number.keys() | own) > block_terms):
            yield ids, sets, number
            ids, sets, number = [], [], {}
        ids.append(r["item_id"])
        sets.append(own)
        for t in sorted(own):
            number.setdefault(t, len(number))
    if ids:
        yield ids, sets, number


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    """Each term's weight by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text", step_bytes: int = STEP_BYTES) -> DataFrame:
    """(k, n, terms, tfs) of every document with terms, written: `terms` are numbers in the given list."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(id_key(docs, id_col).alias("k"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    held = spark.sparkContext.broadcast(Terms(terms))  # the terms of one block of items
    return written(rows.mapInArrow(lambda it: _postings(it, held, step_bytes), f"k {kind_of(rows)}, n long, terms array<int>, tfs array<int>"), "postings")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_terms: int = 1 << 16, block_items: int = 4096, shard_size: int = 4_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` highest-scoring documents of each item with a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    asked = items.select(column(item_id_col).alias("item_id"), F.coalesce(column(item_text_col), F.lit("")).alias("text")).distinct()
    kind, out = asked.schema["item_id"].dataType.simpleString(), []
    for ids, sets, number in _blocks(asked, block_terms, block_items):
        table = postings(docs, list(number), id_col, text_col)
        n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(number), np.int64)
        for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
            frequency[r["term"]] = r["count"]
        plan = (weights(n_docs, frequency), [np.array(sorted(number[t] for t in own), np.int64) for own in sets], n_docs, n_terms)
        held = spark.sparkContext.broadcast(plan)
        found = table.mapInArrow(lambda it, held=held: _search(it, held, k, shard_size), f"item int, k {kind_of(table)}, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "k"))
        named = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")  # at most block_items rows
        out.append(found.withColumn("rank", place).filter(F.col("rank") <= k).join(F.broadcast(named), "item"))
    if not out:
        return spark.createDataFrame([], f"{item_id_col} {kind}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score long")
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole.select(F.col("item_id").alias(item_id_col), "rank", id_of(F.col("k"), docs, id_col).alias(id_col), "score")
