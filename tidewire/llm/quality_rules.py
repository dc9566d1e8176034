"""Quality rules combined by weak supervision: rules vote good or bad or abstain, expectation-maximisation estimates how accurate
each is, and a document is kept by its posterior probability of being good rather than by passing every rule.

The features of each whole text are computed once and written; votes are column expressions over them. Rules are independent given
the class, so the counts of the at most 3**len(RULES) vote patterns over all documents are sufficient: that table, bounded
whatever the input, is all that reaches the driver, and the fitted posterior goes back as a table of patterns.

Cases: null and empty texts have no words and fail the base rules; repeated rows are judged alike; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, U64, keyed, kind_of, mix, span_hashes, steps, text_bytes, tidy, word_spans, written

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = True  # ASCII letters, and the first byte of any character past U+00BF
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_short_words", "n_bare_words")

_c = F.col


def rules() -> dict[str, tuple[Column, Column]]:
    """(bad when, good when) by rule; a rule abstains where neither holds. Ratios are written as products to stay in integers."""
    return {
        "length": (_c("n_words") < 50, _c("n_words") >= 80),
        "repeats": (100 * _c("n_repeat_words") > 30 * _c("n_words"), 100 * _c("n_repeat_words") <= 15 * _c("n_words")),
        "symbols": (100 * _c("n_symbols") > 10 * _c("n_words"), 100 * _c("n_symbols") <= 2 * _c("n_words")),
        "lines": (100 * _c("n_dup_lines") > 30 * _c("n_lines"), (_c("n_dup_lines") == 0) & (_c("n_lines") >= 2)),
        "word_length": ((_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 14 * _c("n_words")), (_c("word_chars") >= 3 * _c("n_words")) & (_c("word_chars") <= 10 * _c("n_words"))),
        "upper_case": (100 * _c("n_upper") > 40 * _c("n_letters"), 100 * _c("n_upper") <= 20 * _c("n_letters")),
        "letters": (100 * _c("n_letters") < 70 * _c("word_chars"), 100 * _c("n_letters") >= 85 * _c("word_chars")),
        "short_words": (100 * _c("n_short_words") < 5 * _c("n_words"), (100 * _c("n_short_words") >= 15 * _c("n_words")) & (100 * _c("n_short_words") <= 70 * _c("n_words"))),
        "symbol_share": (100 * _c("n_symbols") > 5 * _c("word_chars"), 100 * _c("n_symbols") <= _c("word_chars")),
        "bare_words": (100 * _c("n_bare_words") > 20 * _c("n_words"), 100 * _c("n_bare_words") <= 8 * _c("n_words")),
    }


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeated(h: np.ndarray) -> np.ndarray:
    """Whether each value is found twice or more."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(h), bool)
    out[order] = same[1:] | same[:-1]
    return out


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in steps(batch, "text"):
            raw, offs = text_bytes(b.column("text"))
            n = b.num_rows
            s, e, doc = word_spans(raw, offs)
            n_words = np.bincount(doc, minlength=n)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
            solid = _per_doc(((raw & 0xC0) != 0x80) & ~_SPACE[raw], offs)
            letters = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int64)])
            bare = np.bincount(doc[letters[e] == letters[s]], minlength=n)  # words without a letter
            short = np.bincount(doc[chars[e] - chars[s] <= 3], minlength=n)
            # words in three-word windows found twice or more in their document
            h = span_hashes(raw, s, e)
            repeat = np.zeros(n, np.int64)
            if len(h) > 2:
                w = mix(h[:-2] * U64(0x9E3779B97F4A7C15) + mix(h[1:-1] * U64(0xC2B2AE3D27D4EB4F) + mix(h[2:] + doc[2:].astype(U64))))
                ok = np.flatnonzero(doc[:-2] == doc[2:])
                at = ok[_repeated(w[ok])]
                cover = np.zeros(len(h), bool)
                for j in range(3):
                    cover[at + j] = True
                repeat = np.bincount(doc[cover], minlength=n)
            # lines with a word, equal to an earlier line of their document
            breaks = np.flatnonzero(raw == 10)
            start, end = np.sort(np.concatenate([offs[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offs[1:]]))
            line_doc = np.searchsorted(offs, start, "right") - 1
            full = np.flatnonzero(np.searchsorted(s, end) > np.searchsorted(s, start))
            key = mix(span_hashes(raw, start[full], end[full]) ^ mix(line_doc[full].astype(U64)))
            distinct = np.unique(key, return_index=True)[1]
            lines = np.bincount(line_doc[full], minlength=n)
            dup = lines - np.bincount(line_doc[full][distinct], minlength=n)
            cols = (n_words, solid, _per_doc(_SYMBOL[raw], offs), dup, repeat, lines, _per_doc(_LETTER[raw], offs), _per_doc(_UPPER[raw], offs), short, bare)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in cols)], ["doc_id", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and COUNTS."""
    rows = keyed(docs, id_col, text_col).select("doc_id", "text")
    return rows.mapInArrow(_measure, f"doc_id {kind_of(docs, id_col)}, " + ", ".join(f"{c} long" for c in COUNTS))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.9) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" for each pattern of votes (+1, 0, -1), each rule's chance of each vote by class, and the share of good.

    Every rule has its own accuracy in either class: shares[y, rule, vote] with votes in the order bad, abstain, good. They start
    from what a rule is meant to say, and bounds keep that meaning: a good document seldom gets a "bad" vote, and a rule says
    "bad" more often of bad documents. A "good" vote that a rule gives to everyone then weighs nothing.
    """
    counts = counts.astype(float)
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    shares = np.empty((2, votes.shape[1], 3))
    shares[0], shares[1] = (0.40, 0.20, 0.40), (0.02, 0.18, 0.80)
    good = np.full(len(votes), prior)
    for _ in range(rounds):
        z = np.einsum("prv,rv->p", seen, np.log(shares[1]) - np.log(shares[0])) + np.log(prior / (1 - prior))
        good = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        for y, w in ((0, (1 - good) * counts), (1, good * counts)):
            shares[y] = (np.einsum("p,prv->rv", w, seen) + np.array((1.0, 1.0, 1.0))) / (w.sum() + 3)
        shares[1, :, 0] = np.minimum(shares[1, :, 0], 0.03)
        shares[0, :, 0] = np.maximum(shares[0, :, 0], np.maximum(0.05, 2 * shares[1, :, 0]))
        shares[0, :, 2] = np.maximum(shares[0, :, 2], 0.3 * shares[1, :, 2])
        shares /= shares.sum(2, keepdims=True)
        prior = float(np.clip((good * counts).sum() / max(counts.sum(), 1), 0.5, 0.98))
    return good, shares, prior


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, quality (posterior) and kept."""
    measured = written(measure(docs, id_col, text_col), "quality")
    named = rules()
    voted = measured.select("*", *[F.when(bad, -1).when(good, 1).otherwise(0).alias(f"vote_{r}") for r, (bad, good) in named.items()])
    names = [f"vote_{r}" for r in named]
    patterns = voted.groupBy(*names).count().collect()  # 3**len(rules) rows at most
    votes = np.array([[r[c] for c in names] for r in patterns]).reshape(len(patterns), len(names))
    good, _, _ = fit(votes, np.array([r["count"] for r in patterns]))
    table = [(*map(int, v), float(g)) for v, g in zip(votes, good, strict=True)]
    fitted = docs.sparkSession.createDataFrame(table, ", ".join(f"{c} int" for c in names) + ", quality double")
    failed = (_c("n_words") < 50) | (100 * _c("n_repeat_words") > 50 * _c("n_words"))
    out = voted.join(F.broadcast(fitted), names).withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~failed & (F.col("quality") >= least)).alias("kept"), "quality")
