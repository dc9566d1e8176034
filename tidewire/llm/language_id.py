"""Language identification: averaged embeddings of hashed subwords (byte n-grams), a linear softmax, and calibrated rejection.

The model is trained by stochastic gradient descent in numpy on a bounded sample: at most about `rows_per_language` labelled rows of each of
the `languages` most frequent languages, of texts of at most `row_bytes` bytes. A fifth of it is held back to set the temperature and
two bounds for rejection. One is on the score. A softmax is sure of itself also where it has seen nothing like the text, so the other is
on the share of a text's n-grams whose bucket the fitted rows have filled: it lies half-way between the least share among the
held-back rows and the greatest among noise, which is the same rows with their letters drawn anew. As the softmax is linear in
the averaged embedding, prediction needs only one small row of logits a bucket, and whether it was filled: that table (buckets x languages) is
broadcast and every whole text is scored in one pass over it.

Cases: further languages than `languages` are not learnt; null text, and text without a letter, is `und` with score 0 and rejected; with no labelled row at all every text is `und`;
texts shorter than the n-grams still have their own bytes as features; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U64, column, keyed, kind_of, spare, steps, text_bytes, tidy

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 17
#: Places of n-grams whose rows of logits are held at once.
_AT_ONCE = 1 << 20
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id's text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _buckets(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, the bucket of the n bytes from each place on."""
    coded = _BYTE[raw]
    acc = np.zeros(len(raw), U64)
    for j, n in enumerate(ORDERS):
        m = len(raw) - n + 1
        if m <= 0:
            return
        acc = acc[:m] + coded[j : j + m] * U64(_MULT[j])
        yield n, (((acc ^ (acc >> U64(29))) * U64(_MULT[-1 - j])) >> U64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits a bucket: averaged embedding times the softmax's weights
    bias: np.ndarray
    seen: np.ndarray  # buckets that the fitted rows fill
    temperature: float = 1.0
    reject_below: float = 0.0
    least_seen: float = 0.0

    @cached_property
    def scoring(self) -> np.ndarray:
        """The logits, and a column that counts filled buckets."""
        return np.column_stack([self.table, self.seen]).astype(np.float32)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        raw = np.frombuffer(t.lower().encode(), np.uint8)
        got = np.concatenate([b for _, b in _buckets(raw)]) if len(raw) else np.zeros(0, np.int32)
        ids, n = np.unique(got, return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def noise(texts: list[str], seed: int = 5) -> list[str]:
    """The same texts with every letter drawn anew from all letters of the texts, each as likely."""
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()}) or ["x"]
    rng = np.random.default_rng(seed)
    return ["".join(letters[i] if c.isalpha() else c for c, i in zip(t, rng.integers(0, len(letters), len(t)).tolist(), strict=True)) for t in texts]


def _seen_share(seen: np.ndarray, bag: tuple[np.ndarray, np.ndarray]) -> float:
    return float(bag[1] @ seen[bag[0]])


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7, reject_share: float = 0.001) -> Model:
    """Fit on the given rows; every fifth row only calibrates."""
    languages = sorted(set(labels))
    seen = np.zeros(1 << BUCKET_BITS, bool)
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), seen)
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((1 << BUCKET_BITS, dim)) / dim).astype(np.float32)
    weight, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    bags, y = _bags(texts), np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(bags))
    check, fit = (order[::5], np.delete(order, np.s_[::5])) if len(order) >= 50 else (order, order)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            ids, share = bags[i]
            mean = share @ embed[ids]
            grad = _softmax(mean @ weight + bias)
            grad[y[i]] -= 1
            back = weight @ grad
            weight -= step * np.outer(mean, grad)
            bias -= 0.01 * step * grad
            embed[ids] -= (step * 20 * share)[:, None] * back
    for i in fit:
        seen[bags[i][0]] = True
    model = Model(languages, embed @ weight, bias, seen)
    z = np.array([share @ model.table[ids] + bias for ids, share in (bags[i] for i in check)])
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[check]], 1e-9)).mean()
    model.temperature = float(min(np.geomspace(0.1, 10, 60), key=loss))
    p = _softmax(z / model.temperature)
    right = p.argmax(1) == y[check]
    # No more than `reject_share` of right calibration rows score lower, and never a clear winner.
    model.reject_below = float(min(0.5, np.quantile(p.max(1)[right], reject_share))) if right.any() else 0.0
    inside = min(_seen_share(seen, bags[i]) for i in check)
    outside = max(_seen_share(seen, bag) for bag in _bags(noise([texts[i] for i in check])))
    model.least_seen = (inside + outside) / 2 if outside < inside else 0.0  # where noise cannot be told apart, none is rejected for it
    return model


def scores(model: Model, texts: pa.Array, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language (or past the last: und), calibrated score and rejection of each text (no nulls)."""
    raw, offs = text_bytes(pc.utf8_lower(texts))
    n, k = len(texts), len(model.languages)
    z, size = np.zeros((n, k + 1), np.float64), np.diff(offs)
    table = model.scoring
    total = np.zeros(n)
    some = np.flatnonzero(size)
    for order, bucket in _buckets(raw):
        past = np.concatenate([last[last >= offs[:-1]] for last in (offs[1:] - r for r in range(1, order))] or [np.zeros(0, np.int64)])
        for at in range(0, len(raw), _AT_ONCE):  # also inside a very long text
            row = np.zeros((min(_AT_ONCE, len(raw) - at), k + 1), np.float32)
            part = bucket[at : at + _AT_ONCE]
            row[: len(part)] = table[part]
            row[past[(past >= at) & (past < at + len(row))] - at] = 0  # n-grams that would go past their document
            here = some[(offs[some] < at + len(row)) & (offs[some + 1] > at)]
            z[here] += np.add.reduceat(row, np.maximum(offs[here] - at, 0), axis=0)
        total += np.maximum(size - order + 1, 0)
    known = lettered & (k > 0)
    if not k:
        return np.zeros(n, int), np.zeros(n), ~known
    z /= np.maximum(total, 1)[:, None]
    p = _softmax((z[:, :k] + model.bias) / model.temperature)
    score = np.where(known, p.max(1), 0.0).astype(float)
    return np.where(known, p.argmax(1), k), score, ~known | (score < model.reject_below) | (z[:, k] < model.least_seen)


@tidy
def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    names = pa.array([*shared.value.languages, "und"], pa.string())
    for batch in batches:
        for b in steps(batch, "text"):
            lang, score, rejected = scores(shared.value, b.column("text"), b.column("lettered").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), names.take(pa.array(lang)), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])


@tidy
def _keep(batches: Iterator[pa.RecordBatch], shared, text: str, lettered: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in steps(batch, text):
            _, _, rejected = scores(shared.value, b.column(text), b.column(lettered).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(~rejected)).select(columns)


def training_rows(docs: DataFrame, rows_per_language: int, id_col: str, text_col: str, lang_col: str, languages: int = 200, row_bytes: int = 1 << 16) -> tuple[list[str], list[str]]:
    """A bounded sample of the labelled rows: about `rows_per_language` of each language, those of the smallest hashed ids, and in all
    2 * `rows_per_language` * `languages` texts of `row_bytes` bytes at most."""
    rows = docs.select(column(id_col).alias("i"), column(text_col).alias("x"), column(lang_col).alias("y"))
    usable = rows.filter(F.col("y").isNotNull() & (F.octet_length("x") <= row_bytes) & ~held_out("i"))
    counts = {r[0]: r[1] for r in usable.groupBy("y").count().orderBy(F.desc("count"), "y").limit(languages).collect()}
    place = F.abs(F.xxhash64(F.lit(20), F.col("i")) % 1_000_000)
    picked = F.lit(False)
    for lang, n in counts.items():
        picked = picked | ((F.col("y") == lang) & (place <= int(1_000_000 * min(1.0, rows_per_language / n))))
    found = usable.filter(picked).select("x", "y", place.alias("place"), F.xxhash64("x").alias("t")).orderBy("place", "t").limit(2 * rows_per_language * max(1, len(counts))).collect()
    return [r[0] for r in found], [r[1] for r in found]


def _trained(docs: DataFrame, rows_per_language: int, id_col: str, text_col: str, lang_col: str):
    return docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, rows_per_language, id_col, text_col, lang_col)))


def identify(docs: DataFrame, rows_per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    shared = _trained(docs, rows_per_language, id_col, text_col, lang_col)
    rows = keyed(docs, id_col, text_col).select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("lettered"), held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(lambda it: _predict(it, shared), f"doc_id {kind_of(docs, id_col)}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, rows_per_language: int = 400) -> DataFrame:
    """`docs` without the rows whose language is rejected; rows are judged where they are read, nothing is shuffled."""
    keyed(docs)  # sends the package along
    shared, columns = _trained(docs, rows_per_language, "doc_id", "text", "lang"), docs.columns
    text, lettered = spare(docs, "_text", "_lettered")
    whole = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({text: whole, lettered: whole.rlike(r"\p{L}")})
    return rows.mapInArrow(lambda it: _keep(it, shared, text, lettered, columns), docs.schema)
