"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import jaccard_join, language_id, line_dedup, packing, substring_dedup
from tidewire.llm.common import written
from tidewire.llm.queries import use_small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject."""
    use_small_batches(spark)
    return language_id.keep_known(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in an earlier document are taken out."""
    use_small_batches(spark)
    return line_dedup.clean(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    use_small_batches(spark)
    return jaccard_join.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that start in an earlier document are taken out."""
    use_small_batches(spark)
    return substring_dedup.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbouring documents along the Hilbert curve together."""
    import public_tokenizers

    use_small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("packing", packed),
]
#: Trained models, joins by chance and tokenizers are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
