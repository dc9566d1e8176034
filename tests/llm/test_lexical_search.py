"""Ranked lexical search against a plain loop over all documents and against SQL."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidewire.llm import lexical_search, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, item string, k string, n long, terms string, score long"


def plain(docs, items, k=10):
    """(item id, rank, id, score) by scoring every document; `docs` and `items`: (id, text)."""
    counts = [(i, Counter(lexical_search.terms_of(x))) for i, x in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            total = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(lexical_search.terms_of(text)) if t in c)
            if total:
                scores.append((-total, -(10**9) if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


TEXTS = [None, "", " .,; ", "Alpha beta", "alpha BETA beta", "ALPHA-beta_gamma", "delta É漢字 é漢字", "alpha beta", "x" * 5000, "gamma " * 3000, "beta", "a\x00b a", "delta\x7fdelta", "éé alpha"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, "clash", "clash", 1, "clash", 2) for i, x in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "alpha beta", *rows[0][2:]), (None, None, *rows[0][2:]), (3, "gamma of the same id", *rows[0][2:])], SCHEMA).repartition(3)


ITEMS = [(0, "alpha beta gamma"), (1, "É漢字 delta"), (2, None), (3, "nowhere"), (4, "beta"), (4, "beta"), (4, "alpha"), (None, "a b"), (6, "x" * 5000)]


@pytest.mark.parametrize(("shard_size", "block_terms", "step"), [(4_000_000, 1 << 16, 1 << 19), (3, 2, 7)])
def test_odd_rows(spark, odd, monkeypatch, shard_size, block_terms, step):
    monkeypatch.setattr(lexical_search.postings, "__defaults__", ("doc_id", "text", step))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    held = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for k in (2, 10):
        assert got(lexical_search.search(odd, items, k, shard_size=shard_size, block_terms=block_terms)) == plain(held, ITEMS, k)


def test_documents_of_the_test_table_in_small_shards(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    held, asked = ([tuple(r) for r in t.collect()] for t in (docs.select("doc_id", "text"), items.select("item_id", "text")))
    assert got(lexical_search.search(docs, items, shard_size=5000)) == plain(held, asked)


def test_same_as_sql(spark):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(queries.ORACLE_SQL["op13_lexical_search"]).fetchall()
    assert got(queries.QUERIES["op13_lexical_search"](spark, SF)) == sorted(want, key=str)


def test_empty_tables_and_ids_of_text(spark, odd):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(none, items).count() == lexical_search.search(odd, items.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "one")], "name string, body string")
    out = lexical_search.search(named, spark.createDataFrame([("q", "two")], "item string, words string"), id_col="name", text_col="body", item_id_col="item", item_text_col="words")
    assert out.columns == ["item", "rank", "name", "score"] and [(r["rank"], r["name"]) for r in out.orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def shard_of(counts, n_terms):
    """A shard of documents given as a matrix of term counts."""
    doc, term = np.nonzero(counts)
    ends = np.searchsorted(doc, np.arange(len(counts) + 1))
    return lexical_search.Shard(list(range(len(counts))), counts.sum(1), ends, term.astype(np.int32), counts[doc, term].astype(np.int32), np.arange(1, n_terms + 1) * 100, len(counts), int(counts.sum()))


@pytest.mark.parametrize("seed", range(12))
def test_best_positions_find_the_same_as_all_scores(seed):
    rng = np.random.default_rng(seed)
    counts = rng.poisson(rng.choice([0.05, 0.4, 1.5], 9), (300, 9)) * rng.choice([1, 5], (300, 1), p=[0.9, 0.1])
    counts[150:] = counts[:150]  # ties everywhere, by id
    counts = counts[counts.sum(1) > 0]
    shard = shard_of(counts, 9)
    for _ in range(5):
        terms = np.sort(rng.choice(9, 4, replace=False))
        scores = np.zeros(len(counts), np.int64)
        at = np.repeat(np.arange(len(counts)), np.diff(shard.ends))
        np.add.at(scores, at, np.where(np.isin(shard.term, terms), shard.impact, 0))
        want = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if s))[:7]
        assert [(-s, i) for s, i in shard.best(terms, 7, [], first=1)[0]] == want
        assert not shard.seen_place.any() and not shard.seen_doc.any() and not shard.wanted.any()


def test_search_stops_early_and_earlier_shards_raise_its_floor():
    counts = np.ones((5000, 3), np.int64)
    counts[:20, :2] = [40, 30]
    counts[20:, 0] += np.arange(4980) % 3
    counts[:, 2] = 100 - counts[:, :2].sum(1)  # all of one length
    shard = shard_of(counts, 3)
    found, scored = shard.best(np.array([0, 1]), 10, [])
    assert [i for _, i in found] == list(range(10)) and scored < 100
    top = shard_of(counts[20:], 3)
    assert top.best(np.array([0, 1]), 10, [s for s, _ in found])[1] < 100  # nothing here beats what is known


def test_a_term_of_another_terms_hash_is_told_apart(monkeypatch):
    monkeypatch.setattr(lexical_search, "span_hashes", lambda raw, s, e: (e - s).astype(np.uint64))
    table = lexical_search.Terms([b"ab", b"cd", b"xyz", b"ef"])
    raw = np.frombuffer(b"ef ab zz cd xyz xyy", np.uint8)
    s = np.array([0, 3, 6, 9, 12, 16])
    assert table.find(raw, s, s + [2, 2, 2, 2, 3, 3]).tolist() == [3, 0, -1, 1, 2, -1]
