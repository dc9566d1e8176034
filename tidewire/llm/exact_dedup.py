"""Exact dedup by an extendible-hash index on shared files; DataFrame functions only.

The key of a text is its 64-bit hash. A directory of 2**depth slots (low bits of the hash) points to buckets. It starts with one
bucket; while a bucket holds more than `capacity` distinct keys, the directory doubles and the overfull buckets are split by one
more bit, so that slots which need no split go on sharing a bucket. Owner tasks each take a range of buckets, in the order of
the slots' reversed bits, and within a range texts are compared byte by byte and those of one hash are chained. The rows of a hash
that very many rows have are aggregated before they are sent, so that a text which makes up a third of the rows reaches its owner once a
task. Index and directory are written to the shared folder; every row then finds its entry by slot, bucket and chain.

The directory has 2**`max_bits` slots at most, as it is sent to all tasks; a bucket that is overfull at that depth stays so.

Cases: null text counts as empty; a null id is the smallest; of rows with the same id and text one is kept and the others are
dropped; ids that are not integral compare by their text; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, id_key, id_of, spare, written

#: A hash found in more rows than this, and in more than a ten-thousandth of them (so of 10,000 hashes at most), is aggregated before it is sent.
HOT_ROWS = 1000
LEAST_CAPACITY = 64


def _slot(depth: int) -> Column:
    return F.col("h").bitwiseAND(F.lit((1 << depth) - 1))


def directory(keys: DataFrame, capacity: int, max_bits: int = 18) -> tuple[DataFrame, int]:
    """(slot, bucket, bucket_size, place) for all 2**depth slots, and the depth. `keys`: the distinct h.

    One count of the keys by their lowest bits, a few more than an even split needs and `max_bits` at most, tells how every split turns out.
    """
    spark = keys.sparkSession
    n = keys.count()
    bits = min(max_bits, max(0, (max(1, n) // max(1, capacity)).bit_length() + 6))
    counts = np.zeros(1 << bits, np.int64)
    for r in keys.groupBy(_slot(bits).alias("slot")).count().collect():  # 2**max_bits rows at most
        counts[r["slot"]] = r["count"]
    depth, leaves, full = 0, [], {0: n}
    while full := {p: size for p, size in full.items() if (size > capacity and depth < bits) or leaves.append((p, depth, size))}:
        depth += 1  # the directory doubles; each overfull bucket splits by one more bit
        full = {child: int(counts[child :: 1 << depth].sum()) for p in full for child in (p, p | 1 << (depth - 1))}
    buckets = spark.createDataFrame(leaves, "prefix long, d int, bucket_size long").withColumn("bucket", F.monotonically_increasing_id())
    slots = buckets.withColumn("high", F.explode(F.expr(f"sequence(0L, shiftleft(1L, {depth} - d) - 1L)"))).withColumn("slot", F.expr("prefix + shiftleft(high, d)"))
    # Reversed bits put the slots of one bucket, and the buckets of one parent, side by side.
    place = F.expr(f"conv(reverse(lpad(bin(slot), {max(1, depth)}, '0')), 2, 10)").cast("long")
    return written(slots.select("slot", "bucket", "bucket_size", place.alias("place")), "exact-directory"), depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_bits: int = 18) -> tuple[DataFrame, DataFrame, int]:
    """The index as written (bucket, place, h, chain, text_sha256, n_bytes, keep_k, group_size), its directory and the directory's depth.

    `capacity`: keys of a bucket, a 256th of the keys and at least LEAST_CAPACITY where it is not given."""
    spark = docs.sparkSession
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(id_key(docs, id_col).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = written(rows.groupBy("h").agg(F.count("*").alias("rows")), "exact-keys")
    n, n_rows = keys.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    found, depth = directory(keys.select("h"), capacity or max(LEAST_CAPACITY, n // 256), max_bits)
    hot = keys.filter(F.col("rows") > max(HOT_ROWS, n_rows // 10_000)).select("h", F.lit(True).alias("hot"))
    placed = rows.withColumn("slot", _slot(depth)).join(F.broadcast(found.drop("bucket_size")), "slot").join(F.broadcast(hot), "h", "left")
    names = ["place", "bucket", "h", "text"]
    warm = placed.filter("hot").groupBy(*names).agg(F.max("k").alias("k"), F.count("*").alias("n"))
    cold = placed.filter("hot IS NULL").select(*names, "k", F.lit(1).cast("long").alias("n"))
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    owned = cold.unionByName(warm).repartitionByRange(owners, "place", "h")
    texts = owned.groupBy(*names).agg(F.max("k").alias("keep_k"), F.sum("n").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("place", "h").orderBy("text")) - 1
    entries = texts.withColumn("chain", chain).select("bucket", "place", "h", "chain", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"), "keep_k", "group_size")
    return written(entries, "exact-index"), found, depth


def _found(rows: DataFrame, index: DataFrame, found: DataFrame, depth: int, h: str = "h", sha: str = "text_sha256") -> DataFrame:
    """`rows` (`h`, `sha`, …) with keep_k and group_size of their text: the directory's slot leads to the bucket, bucket and hash to a chain, and the
    chain is walked until the digest of the text is met (its texts were told apart byte by byte)."""
    slots = found.select(F.col("slot").alias("__slot"), F.col("bucket").alias("__bucket"))
    placed = rows.withColumn("__slot", column(h).bitwiseAND(F.lit((1 << depth) - 1))).join(F.broadcast(slots), "__slot")
    chains = index.select(F.col("bucket").alias("__bucket"), F.col("h").alias("__h"), F.col("text_sha256").alias("__sha"), "keep_k", "group_size")
    met = placed.join(chains, (placed["__bucket"] == chains["__bucket"]) & (column(h) == F.col("__h")))
    return met.filter(column(sha) == F.col("__sha")).select(*map(column, rows.columns), "keep_k", "group_size")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row per row of `docs`: the id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, capacity)
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("doc_id"), id_key(docs, id_col).alias("k"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    same = rows.groupBy("doc_id", "k", "h", "text_sha256").agg(F.count("*").cast("int").alias("copies"))
    out = _found(same, *index).select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.select(F.col("doc_id").alias(id_col), id_of(F.col("keep_k"), docs, id_col).alias("keep_id"), "group_size", ((F.col("k") == F.col("keep_k")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of equal texts the one with the largest id."""
    index = build_index(docs, id_col, text_col, capacity)
    h, sha, k, keep, size = spare(docs, "_h", "_sha", "_k", "_keep", "_size")
    text = F.coalesce(column(text_col), F.lit(""))
    keys = docs.withColumns({h: F.xxhash64(text), sha: F.sha2(text, 256), k: id_key(docs, id_col)})
    names = {"keep_k": keep, "group_size": size}
    clash = {c: f"{c}__" for c in keys.columns if c in names}  # columns of these names are put aside meanwhile
    rows = _found(keys.withColumnsRenamed(clash), *index, h=h, sha=sha).withColumnsRenamed(names).withColumnsRenamed({v: c for c, v in clash.items()})
    return rows.filter(F.col(k) == F.col(keep)).dropDuplicates([h, sha]).select(*map(column, docs.columns))
