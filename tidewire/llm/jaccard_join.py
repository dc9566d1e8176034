"""N-gram Jaccard join by chosen paths: all pairs of different texts whose sets of word shingles are at least `least` similar.

Equal texts form one class, and one row of a class takes part. In each run every set walks down from one root: at a node it follows
each of its tokens whose hash, taken with the node, falls below 1 / (least * size of the set), so 1 / `least` tokens in the mean. Two
similar sets take the same branch about once at each node, and whether they still share a node some levels down is a branching
process whose survival `runs_for` works out: as many runs are made as bring a pair at the threshold to the target recall even on
the last level. A node that at most `small` sets have reached is a bucket and is compared by brute force; a larger one is
split a level further, and what is still large on the last level is compared block by block. A pair belongs to the first of
all buckets that hold both, which the sets' lists of buckets tell, so links are counted without a list of pairs, and sets travel
only to buckets that hold a pair of their own. Every link is checked on the whole sets.

Cases: null text is empty; texts of fewer than `words` words have no shingles and no links, but equal ones share a class; rows with
the same id and different texts count apart; a null id is the smallest; an empty table gives an empty table; other columns are
carried by `keep_one` and not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import GRAM_BASES, U64, gram_hashes, id_of, keyed, kind_of, mix, signed, span_hashes, steps, text_bytes, tidy, word_spans, written


def survival(levels: int) -> float:
    """The chance that two sets at the threshold share a node `levels` down: they share one branch at each node in the mean (Poisson)."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return p


def runs_for(levels: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def _shingles(b: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each document of a batch, as hashes, and their documents, in order of the documents."""
    raw, offs = text_bytes(b.column("text"))
    s, e, doc = word_spans(raw, offs)
    h = gram_hashes(span_hashes(raw, s, e), words, GRAM_BASES[0])
    ok = np.flatnonzero(doc[: len(h)] == doc[words - 1 :]) if len(h) else np.zeros(0, np.int64)
    h, doc = h[ok], doc[ok]
    kept = np.sort(np.unique(mix(h ^ mix(doc.astype(U64))), return_index=True)[1])
    return h[kept], doc[kept]


def _ends(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def _limits(size: np.ndarray, least: float) -> np.ndarray:
    """Hashes below these are chosen, by size of the set."""
    return np.minimum(2.0**64 / (least * np.maximum(size, 1)), 2.0**64 - 2**12).astype(U64)


def _branches(h: np.ndarray, ends: np.ndarray, limit: np.ndarray, doc: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (document, node) pairs the place among them and the child node of each chosen token."""
    n = ends[doc + 1] - ends[doc]
    which = np.repeat(np.arange(len(doc)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n - ends[doc], n)
    value = mix(h[at] ^ node[which])
    hit = np.flatnonzero(value < limit[doc[which]])
    return which[hit], mix(value[hit] + node[which[hit]])


@tidy
def _first(batches: Iterator[pa.RecordBatch], words: int, runs: int, least: float) -> Iterator[pa.RecordBatch]:
    """For each set its nodes on the first level in all runs, and a byte of the least hash in each run for a rough similarity."""
    for batch in batches:
        for b in steps(batch, "text"):
            h, doc = _shingles(b, words)
            if not len(h):
                continue
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            rows = doc[first]
            limit = np.repeat(_limits(np.diff(np.append(first, len(h))), least), np.diff(np.append(first, len(h))))
            place = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(h))))
            rough = np.empty((len(rows), runs), np.uint8)
            nodes, owners = [], []
            for r in range(runs):
                root = mix(np.array([r + 1], U64))
                value = mix(h ^ root)
                rough[:, r] = np.minimum.reduceat(value, first) & U64(0xFF)
                hit = np.flatnonzero(value < limit)
                nodes.append(mix(value[hit] + root))
                owners.append(place[hit])
            node, owner = np.concatenate(nodes), np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(rows) + 1)).astype(np.int32)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("t").take(take), pa.array([x.tobytes() for x in rough], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), signed(node[order]))], ["k", "t", "rough", "nodes"])


@tidy
def _deeper(batches: Iterator[pa.RecordBatch], words: int, levels: int, least: float) -> Iterator[pa.RecordBatch]:
    """From the large nodes of each set down to the last level: level, node and the node above."""
    for batch in batches:
        for b in steps(batch, "text"):
            h, doc = _shingles(b, words)
            ends = _ends(doc, b.num_rows)
            limit = _limits(np.diff(ends), least)
            listed = b.column("nodes")
            owner = np.repeat(np.arange(b.num_rows), np.diff(listed.offsets.to_numpy()))
            node = listed.flatten().to_numpy(zero_copy_only=False).view(U64)
            for level in range(2, levels + 1):
                which, child = _branches(h, ends, limit, owner, node)
                owner, above, node = owner[which], node[which], child
                if len(node):
                    take = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("t").take(take), pa.array(np.full(len(node), level, np.int32)), signed(node), signed(above)], ["k", "t", "level", "bucket", "above"])


def _picked(reps: DataFrame, marked: DataFrame) -> DataFrame:
    """`reps` with the columns of `marked`; only texts that may be in it are shuffled."""
    bits, held = sketch.filter_of(marked)
    return reps.mapInArrow(lambda it: sketch._pick(it, bits, held, True), reps.schema).join(sketch.shuffled(marked), ["k", "t"])


def buckets(reps: DataFrame, level: DataFrame, words: int, levels: int, small: int, least: float) -> DataFrame:
    """(k, t, bucket, size): the nodes that few enough sets reach, and the large ones of the last level; lone sets are left out."""
    out, at, deep = None, level.select("k", "t", F.explode("nodes").alias("bucket")), None
    for d in range(1, levels + 1):
        # written, so that both sides of the join are plain shuffles, whose hot buckets Spark splits
        sizes = written(at.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "join-sizes")
        at = written(at.join(sizes, "bucket").select("k", "t", "bucket", "size"), "join-level")
        done = at.filter(F.col("size") <= small) if d < levels else at
        out = done if out is None else out.unionByName(done)
        if d == levels:
            break
        large = sizes.filter(F.col("size") > small)
        if large.isEmpty():
            break
        if deep is None:
            held = written(at.filter(F.col("size") > small).groupBy("k", "t").agg(F.collect_list("bucket").alias("nodes")), "join-large")
            deep = written(_picked(reps, held).mapInArrow(lambda it: _deeper(it, words, levels, least), f"k {kind_of(reps)}, t binary, level int, bucket long, above long"), "join-deeper")
            at = deep.filter("level = 2").select("k", "t", "bucket")
        else:
            at = deep.filter(F.col("level") == d + 1).join(large.select(F.col("bucket").alias("above")), "above", "left_semi").select("k", "t", "bucket")
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows of equal `keys`, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), b.num_rows)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = tuple(c[i] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_GROUP = ["bucket", "low", "high"]


def _fresh(homes: list[np.ndarray], bucket: int) -> np.ndarray:
    """Pairs of rows that no bucket before this one holds."""
    return overlaps([h[h < bucket] for h in homes]) == 0


def _sides(t: pa.Table) -> np.ndarray:
    """Which pairs of rows a group is there to compare: all of one block, or those across its two blocks."""
    side = t.column("side").to_numpy()
    g = len(side)
    return ~np.eye(g, dtype=bool) if side[0] < 0 else side[:, None] != side[None, :]


def _homes(t: pa.Table) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in t.column("home").to_pylist()]


@tidy
def _wanted(batches: Iterator[pa.RecordBatch], rough_least: int) -> Iterator[pa.RecordBatch]:
    for t in grouped(batches, _GROUP):
        if t.num_rows < 2:
            continue
        ok = _fresh(_homes(t), t.column("bucket")[0].as_py()) & _sides(t)
        rows = np.flatnonzero(ok.any(1))
        if not len(rows):
            continue
        rough = np.frombuffer(b"".join(t.column("rough").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        near = np.zeros((len(rows), len(ok)), np.int16)
        for c in rough.T:
            near += c[rows, None] == c[None, :]
        rows = rows[(ok[rows] & (near >= rough_least)).any(1)]
        if len(rows):
            yield from t.select(["k", "t", *_GROUP, "side"]).take(pa.array(rows)).to_batches()


@tidy
def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in steps(batch, "text"):
            h, doc = _shingles(b, words)
            ends = _ends(doc, b.num_rows)
            sets = [np.sort(h[i:j]).tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), b.column("home"), b.column("places"), pa.array(sets, pa.binary())], ["k", "t", "home", "places", "set"])


def overlaps(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from the tokens that two or more sets hold, `block` tokens at a time."""
    g = len(sets)
    if g == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    tokens, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(g), [len(s) for s in sets])
    shared = np.bincount(col, minlength=len(tokens)) > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], renumber[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((g, g), np.float32)
    total = int(shared.sum())
    for lo in range(0, total, block):
        i, j = np.searchsorted(col, lo), np.searchsorted(col, lo + block)
        m = np.zeros((g, min(block, total - lo)), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def smallest_connected(linked: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row the row of its component under `linked` that comes first in `order`."""
    label = np.argsort(order)
    while True:
        near = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        near = near[order[near]]
        if (near == label).all():
            return order[label]
        label = near


@tidy
def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for t in grouped(batches, _GROUP):
        if t.num_rows < 2:
            continue
        sets = [np.frombuffer(x, U64) for x in t.column("set").to_pylist()]
        n = np.array([len(s) for s in sets])
        both = overlaps(sets)
        linked = (both >= least * (n[:, None] + n[None, :] - both) - 1e-9) & _sides(t)
        if not linked.any():
            continue
        linked &= _fresh(_homes(t), t.column("bucket")[0].as_py())
        count = linked.sum(1)
        rows = np.flatnonzero(count)
        if len(rows):
            k, h = t.column("k").combine_chunks(), t.column("t").combine_chunks()
            names = list(zip(k.to_pylist(), h.to_pylist(), strict=True))
            low = pa.array(smallest_connected(linked, np.array(sorted(range(len(names)), key=names.__getitem__)))[rows])
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([k.take(rows), h.take(rows), pa.array(count[rows.to_numpy()]), k.take(low), h.take(low)], ["k", "t", "n", "low_k", "low_t"])


def links(reps: DataFrame, words: int = 5, least: float = 0.8, recall: float = 0.999, levels: int = 3, small: int = 64, block: int = 1024) -> DataFrame:
    """(k, t, n, low_k, low_t), several rows a set: links found in one bucket, and the smallest row that links of
    the bucket connect it to, directly or by way of others. `reps`: k, t, text of different texts, as a written table."""
    runs, kind = runs_for(levels, recall), kind_of(reps)
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = written(reps.mapInArrow(lambda it: _first(it, words, runs, least), f"k {kind}, t binary, rough binary, nodes array<long>"), "join-nodes")
    placed = buckets(reps, level, words, levels, small, least)
    home = placed.groupBy("k", "t").agg(F.array_sort(F.collect_set("bucket")).alias("home"))
    home = written(home.join(level.select("k", "t", "rough"), ["k", "t"]), "join-homes")
    # A bucket above `block` sets is compared block by block: each row goes to the pairs of blocks that its own is one of.
    rows = placed.withColumn("blocks", F.ceil(F.col("size") / block))
    rows = rows.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("k", "t"), F.col("blocks"))).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    rows = rows.select("k", "t", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"))
    near = rows.join(home, ["k", "t"]).repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)
    # rough similarities of pairs at the threshold are below a third of it with a probability of about 1e-6
    wanted = written(near.mapInArrow(lambda it: _wanted(it, int(least * runs / 3)), f"k {kind}, t binary, bucket long, low long, high long, side int"), "join-wanted")
    places = wanted.groupBy("k", "t").agg(F.collect_list(F.struct(*_GROUP, "side")).alias("places"))
    places = written(places.join(home.select("k", "t", "home"), ["k", "t"]), "join-places")
    shape = "array<struct<bucket: long, low: long, high: long, side: int>>"
    sets = _picked(reps, places).mapInArrow(lambda it: _sets(it, words), f"k {kind}, t binary, home array<long>, places {shape}, set binary")
    sent = sets.select("k", "t", "home", "set", F.explode("places").alias("p")).select("k", "t", "home", "set", "p.*")
    return sent.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(lambda it: _links(it, least), f"k {kind}, t binary, n long, low_k {kind}, low_t binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows with their class (doc_id, k, t, class_k; equal texts have one t), and one row (k, t, text) a class: the smallest id of equal texts."""
    rows = keyed(docs, id_col, text_col)
    # written, so that both sides of the joins are plain shuffles, whose hot classes Spark splits
    first = written(rows.groupBy("t").agg(F.min("k").alias("class_k")), "join-classes")
    members = rows.select("doc_id", "k", "t").join(first, "t").select("doc_id", "k", "t", "class_k")
    reps = rows.select("k", "t", "text").join(first.withColumnRenamed("class_k", "k"), ["k", "t"], "left_semi").dropDuplicates(["k", "t"])
    return members, written(reps, "join-texts")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for undirected edges (a, b), the smallest node of each component. Labels shrink along edges and through their own labels."""
    edges = written(edges.filter("a <> b").distinct(), "join-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "join-labels")
    while True:
        near = both.join(label.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        after = written(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("root"), (F.least("next", F.coalesce("jump", "next")) < F.col("root")).alias("moved")), "join-labels")
        if after.filter("moved").isEmpty():
            return after.select("node", "root")
        label = after.select("node", "root")


def _roots(found: DataFrame) -> DataFrame:
    """(class_k, t, group_k, group_t) for classes with links: the smallest class that links connect each to."""
    roots = components(found.select(F.struct("k", "t").alias("a"), F.struct(F.col("low_k").alias("k"), F.col("low_t").alias("t")).alias("b")))
    return roots.select(F.col("node.k").alias("class_k"), F.col("node.t").alias("t"), F.col("root.k").alias("group_k"), F.col("root.t").alias("group_t"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its text), n_links (different texts that its text is linked to) and
    group_id (smallest id of all documents that links and equal texts connect it to)."""
    members, reps = classes(docs, id_col, text_col)
    found = written(links(reps, **options), "join-links")
    counted = found.withColumnRenamed("k", "class_k").groupBy("class_k", "t").agg(F.sum("n").alias("n_links"))
    known = written(counted.join(_roots(found), ["class_k", "t"], "left"), "join-groups")
    out = members.join(known, ["class_k", "t"], "left")
    group = F.coalesce("group_k", "class_k")
    return out.select(F.col("doc_id").alias(id_col), id_of(F.col("class_k"), docs, id_col).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), id_of(group, docs, id_col).alias("group_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each group: of documents connected by links or equal texts, the one with the smallest id."""
    members, reps = classes(docs)
    late = _roots(links(reps, **options)).filter("class_k <> group_k OR t <> group_t").select("class_k", "t", F.lit(True).alias("late"))
    dropped = members.join(late, ["class_k", "t"], "left").filter("late OR k <> class_k").select("k", "t")
    twice = members.groupBy("k", "t").count().filter("count > 1").select("k", "t")
    return sketch.without(docs, written(dropped, "join-dropped"), written(twice, "join-twice"))
