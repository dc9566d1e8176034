"""A table that micro-batches change: rows lie in buckets by key, and a batch rewrites the buckets that it touches and no others.

Each version has a manifest, one row a bucket with the version of its files. Files and manifest of a version are written anew where a batch
runs again after a failure; a batch whose manifest stands is not run again. What no manifest of the last two versions names is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of a folder's finished entries `prefix`n, ascending."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    done = [f for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().removeprefix(prefix)) for f in done)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


class BucketTable:
    """A keyed table of `buckets` buckets in a folder that driver and executors share. Choose the number so that a bucket is some hundred MB at the size planned for."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64, by: list[str] | None = None):
        """`by`: the columns, of the keys, that choose the bucket (all of them where not given)."""
        self.spark, self.path, self.keys, self.buckets, self.by = spark, path.rstrip("/"), keys, buckets, by or keys
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return numbers(self.spark, f"{self.path}/manifest", "v")

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """{bucket: version of its files}, of the newest version or a kept one; empty before the first."""
        held = self.versions()
        if not held:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/v{held[-1] if version is None else version}").collect()  # a row a bucket
        return {r["bucket"]: r["files"] for r in rows}

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        held = self.manifest(version)
        paths = [f"{self.path}/data/v{v}/{BUCKET}={b}" for b, v in held.items() if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of `rows` lie in: `buckets` of them at most."""
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def apply(self, version: int, changed: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Put `changed` (whole rows, one a key) in place of the rows of their keys, take the keys of `gone` out, as one version; returns the buckets rewritten."""
        held = self.manifest()
        rows = changed.select(*self.schema.names)
        keys = rows.select(*self.keys) if gone is None else rows.select(*self.keys).unionByName(gone.select(*self.keys))
        at = self.touched(keys)
        target = f"{self.path}/data/v{version}"
        if at:
            after = self.read(at).join(keys, self.keys, "left_anti").select(*self.schema.names).unionByName(rows)
            after.withColumn(BUCKET, self.bucket()).repartition(len(at), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
            fs, _ = _folder(self.spark, target)
            there = {b for b in at if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{BUCKET}={b}"))}  # a bucket may be empty now
            held = {b: v for b, v in held.items() if b not in at} | {b: version for b in there}
        manifest = self.spark.createDataFrame(list(held.items()), "bucket int, files long").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        self._clear()
        return sorted(at)

    def start(self, rows: DataFrame) -> None:
        """The table's rows before any stream, as version 0."""
        self.apply(0, rows)

    def _clear(self) -> None:
        """Remove manifests and bucket files that the last two versions do not use: a reader of the version before can end."""
        held = self.versions()
        used = {(b, v) for n in held[-2:] for b, v in self.manifest(n).items()}
        for n in held[:-2]:
            for b, v in self.manifest(n).items():
                if (b, v) not in used:
                    remove(self.spark, f"{self.path}/data/v{v}/{BUCKET}={b}")
            remove(self.spark, f"{self.path}/manifest/v{n}")

    def fold(self, stream: DataFrame, changes: Callable[[BucketTable, DataFrame], DataFrame]) -> None:
        """Fold what a stream holds now into the table, batch by batch: `changes(table, batch)` gives the rows that the batch changes. Batch n makes
        version n + 1, so that version 0 may be what was there before the stream (`start`)."""
        def step(batch: DataFrame, n: int) -> None:
            held = self.versions()
            if held and held[-1] > n:  # it ran, and only the stream's own note of it was lost
                return
            self.apply(n + 1, changes(self, batch))

        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination()
