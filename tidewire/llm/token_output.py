"""Token ids written as Re-Pair-compressed blocks in ascending id order, and read back.

Format: a Parquet table in the shared folder. A row is a block: `part` and `block` (its place), `start` (ids of the part before it),
`n_ids`, the documents' ids and id counts, and the block's grammar: `body`, `rules` (16-bit little-endian) and `sizes` (32-bit
expansion lengths). Spark's committed writes make a lost executor's task simply run again.

Cases: null text is empty and still has the end id; a null id sorts first; repeated rows are each written; an empty table gives an
empty file and result; other columns are not read. Special-token strings in a text are encoded as ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repair
from .common import keyed, kind_of, new_path, steps, tidy
from .tokens import ENCODE_BYTES, encoder, with_end


@tidy
def _blocks(batches: Iterator[pa.RecordBatch], tokenizer: str, attached: bool, end_id: int, vocabulary: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer, attached)
    part, block, start = TaskContext.get().partitionId(), 0, 0
    held: list[np.ndarray] = []
    docs: list = []
    size = 0

    def done():
        ids = np.concatenate(held)
        body, rules = repair.compress(ids, vocabulary)
        row = {
            "part": [part], "block": [block], "start": [start], "n_ids": [len(ids)], "doc_ids": [docs], "doc_sizes": [np.array([len(x) for x in held], "<u4").tobytes()],
            "body": [body.astype("<u2").tobytes()], "rules": [rules.astype("<u2").tobytes()], "sizes": [repair.lengths(rules, vocabulary).astype("<u4").tobytes()],
        }
        return pa.RecordBatch.from_arrays([pa.array(row["part"], pa.int32()), pa.array(row["block"], pa.int32()), pa.array(row["start"], pa.int64()), pa.array(row["n_ids"], pa.int64()), pa.array(row["doc_ids"], pa.list_(kind)), *(pa.array(row[c], pa.binary()) for c in ("doc_sizes", "body", "rules", "sizes"))], names=list(row))

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for b in steps(batch, "text", ENCODE_BYTES):
            ids, ends = with_end(*enc.encode_column(b.column("text")), end_id)
            for doc, i, j in zip(b.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                held.append(ids[i:j])
                docs.append(doc)
                size += j - i
                if size >= block_ids:
                    yield done()
                    block, start, held, docs, size = block + 1, start + size, [], [], 0
    if held:
        yield done()


def write_ids(docs: DataFrame, tokenizer: str, attached: bool = False, end_id: int = 2, block_ids: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encode every document, add `end_id`, write the blocks; returns the table's path."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    spark = docs.sparkSession
    kind = kind_of(docs, id_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, id_col, text_col).repartitionByRange(n, "k", "t").sortWithinPartitions("k", "t").select("doc_id", "text")
    blocks = rows.mapInArrow(lambda it: _blocks(it, tokenizer, attached, end_id, vocabulary, block_ids), f"part int, block int, start long, n_ids long, doc_ids array<{kind}>, doc_sizes binary, body binary, rules binary, sizes binary")
    path = path or new_path(spark, "token-ids")
    blocks.write.option("parquet.block.size", 16 << 20).parquet(path)
    return path


@tidy
def _read(batches: Iterator[pa.RecordBatch], vocabulary: int, base: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            body, rules = (np.frombuffer(row[c].as_buffer(), "<u2") for c in ("body", "rules"))
            ids = repair.expand(body, rules.reshape(-1, 2), vocabulary).astype("<u4")
            sizes = np.frombuffer(row["doc_sizes"].as_buffer(), "<u4").astype(np.int64)
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            first = base[row["part"].as_py()] + row["start"].as_py()
            yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str, vocabulary: int) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    base, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each task that wrote
        base[r["part"]], total = total, total + r["n"]
    kind = dict(blocks.dtypes)["doc_ids"][6:-1]
    return blocks.mapInArrow(lambda it: _read(it, vocabulary, base), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
