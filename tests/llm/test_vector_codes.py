"""Vector codes against plain Python integers and against SQL."""

import hashlib
import math
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidewire.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """{(id, vector): (code, error)}, label sums and the codebooks' digest; `rows`: (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = sorted(((i, v + [0] * (dims - len(v)), label) for i, v, label in kept), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1]))
    width = dims // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])].append(c[p])
            for e, g in groups.items():
                books[p][e] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    codes, totals = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut, strict=True):
        e = [near(c[p], books[p]) for p in range(parts)]
        error = sum(far(c[p], books[p][e[p]]) for p in range(parts))
        codes.append((i, label, "".join(f"{x:02x}" for x in e), error))
        totals[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, label, c, e, totals[label]) for i, label, c, e in codes), key=str), digest


def got(df):
    codes, books = vector_codes.compress(df)
    return sorted((tuple(r) for r in codes.select("vec_id", "label", "code", "error", "label_error").collect()), key=str), vector_codes.books_sha256(books)


def held(df):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in df.select("vec_id", "embedding", "label").collect()]


def test_test_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(df) == plain(held(df))


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_vector_codes"])
    out = queries.QUERIES["op11_vector_codes"](spark, SF)
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).round(2).tolist(), int(i % 3), "x", "x", 1, "x") for i in range(60)]
    rows += [(100 + i, [0.25] * 16, None, "x", "x", 1, "x") for i in range(40)]  # one vector in a third of the rows
    rows += [(5, None, 1, "x", "x", 1, "x"), (6, [0.1, None] + [0.0] * 14, 1, "x", "x", 1, "x"), (7, [math.nan] * 16, 1, "x", "x", 1, "x"), (8, [math.inf] * 16, 1, "x", "x", 1, "x")]
    rows += [(None, [-0.0] * 16, 2, "x", "x", 1, "x"), (209, [], 2, "x", "x", 1, "x"), (10, [1.0] * 13, 2, "x", "x", 1, "x"), rows[3], rows[3], (3, [0.5] * 16, None, "x", "x", 1, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, k string, vec string, p int, code string").repartition(3)


def test_odd_rows(odd):
    assert got(odd) == plain(held(odd))


def test_few_rows_and_empty_tables(spark, odd):
    few = odd.filter("vec_id IN (100, 3)")
    assert got(few) == plain(held(few))
    codes, books = vector_codes.compress(odd.limit(0))
    assert codes.count() == 0 and books == [[]] * 8
    codes, books = vector_codes.compress(odd.filter("vec_id = 209"))
    assert [r["code"] for r in codes.collect()] == ["00" * 8] and books == [[[]]] * 8


def test_components_beyond_64_bits_stay_exact(spark):
    rows = [(i, [float(i % 5) * 1e9, -1e15 * (i % 3), 0.1 * i, 7.0] * 2, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    kept = vector_codes.whole_rows(df)
    books, dims = vector_codes.train(kept, parts=2)
    want = plain(rows, parts=2)
    assert dims == 8 and vector_codes.books_sha256(books) == want[1]
    with_2e30 = vector_codes.train(vector_codes.whole_rows(spark.createDataFrame([*rows, (99, [2e30] * 8, 0)], df.schema)), parts=2)[0]
    assert vector_codes.books_sha256(with_2e30) == plain([*rows, (99, [2e30] * 8, 0)], parts=2)[1]


def test_shared_prefixes_are_computed_once(monkeypatch):
    rng = np.random.default_rng(0)
    parts = rng.integers(0, 4, (3000, 6)).astype(float)
    parts = parts[np.lexsort(parts.T[::-1])]
    book = rng.integers(0, 4, (16, 6)).tolist()
    prefixes = {tuple(r[:d]) for r in parts.tolist() for d in range(1, 7)}
    for block in (7, 2048):
        monkeypatch.setattr(vector_codes, "BLOCK", block)
        trie = vector_codes.Trie(book)
        entry, error = trie.nearest(parts)
        far = ((parts[:, None] - np.array(book)[None]) ** 2).sum(2)
        assert trie.made == len(prefixes)  # one node a distinct prefix, also across blocks
        assert (entry == far.argmin(1)).all() and (error == far.min(1)).all()


def test_part_bytes_sort_as_parts():
    parts = np.array([[-3.0, 5], [-3, -5], [0, 1e300], [2, -1], [-1e300, 0], [0, 0]])
    raw = vector_codes._to_bytes(parts)
    assert (vector_codes._from_bytes(raw, 2) == parts).all()
    assert (vector_codes._from_bytes(raw[2:4], 2) == parts[2:4]).all()
    order = sorted(range(6), key=lambda i: raw[i].as_py())
    assert parts[order].tolist() == sorted(parts.tolist())


def test_codes_decode_to_their_entries(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    codes, books = vector_codes.compress(df)
    out = vector_codes.decode(codes, books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in out[:100]:
        error = sum((math.floor(4096 * x) - round(4096 * y)) ** 2 for x, y in zip(r["embedding"], r["vec"], strict=True))
        assert error == r["error"]


def test_label_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HEAVY_SHARE", 0.3)
    df = spark.createDataFrame([(i, i % 7 if i % 3 else None, "00", i) for i in range(300)], "vec_id long, label long, code string, error long")
    sums = defaultdict(int)
    for r in df.collect():
        sums[r["label"]] += r["error"]
    out = vector_codes.with_label_errors(df).collect()
    assert len(out) == 300 and all(r["label_error"] == sums[r["label"]] for r in out)
