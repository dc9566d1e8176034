"""Each operator against brute force, on the test tables and on a table of odd rows; and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm.common import text_key
from tidewire.llm import exact_dedup, jaccard_join, language_id, line_dedup, packing, piece_sampling, quality_rules, queries, repair, sketch, substring_dedup, suffix_dedup, token_output, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(3000))
TEXTS = [None, "", "   ", "one two", LONG, LONG + " tail", "intro " + LONG, "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n o", "x" * 900, "y " * 500, "Lïne öne is long\nLINE TWO IS LONG \nshort\n\nend", "line two is long\r\nother line here", "É漢字 😀 ▁▁ mark\x00 ok\t\ttab", LONG, LONG, None, "…"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, h string, n string, ids string, label int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, "en" if i % 3 else None, None, len(x) if x else None, "clash", "clash", "clash", "clash", "clash", 1) for i, x in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (4, "another text with the same id, of some length and words to spare for windows", "fr", "s", 1, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held(df):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_substring_dedup(request, table):
    df = request.getfixturevalue(table)
    rows, first = held(df), {}
    for i, x in rows:
        w = WORD.findall(x)
        for j in range(len(w) - 12):
            first[tuple(w[j : j + 13])] = min(i, first.get(tuple(w[j : j + 13]), i))
    want = []
    for i, x in rows:
        w = WORD.findall(x)
        gone = {j + a for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for a in range(13)}
        want.append((i, len(w), len(gone), sha(b" ".join(a for j, a in enumerate(w) if j not in gone))))
    for cells in (18, 28):  # with the narrowest sketch nearly every window passes; the result is the same
        got = substring_dedup.dedup_windows(df, max_cell_bits=cells).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        same([tuple(r) for r in got], want)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_exact_dedup(request, table):
    df = request.getfixturevalue(table)
    rows = held(df)
    by = defaultdict(list)
    for i, x in rows:
        by[x].append(i)
    got = [tuple(r) for r in exact_dedup.groups(df, capacity=5).select("doc_id", "keep_id", "group_size", "text_sha256").collect()]
    same(got, [(i, max(by[x]), len(by[x]), sha(x)) for i, x in rows])
    kept = [r["doc_id"] for r in exact_dedup.groups(df, capacity=5).filter("kept").collect()]
    same(kept, [max(v) for v in by.values()])
    assert exact_dedup.keep_one(df).count() == len(by)


def test_overfull_buckets_double_the_directory(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    _, before = exact_dedup.directory(keys, 2000)
    found, depth = exact_dedup.directory(keys, 40)
    rows = found.collect()
    assert before == 0 and depth >= 6 and sorted(r["slot"] for r in rows) == list(range(1 << depth))
    assert max(r["bucket_size"] for r in rows) <= 40
    assert sum({r["bucket"]: r["bucket_size"] for r in rows}.values()) == 2000
    of = {r["slot"]: r["bucket"] for r in rows}
    assert Counter(of[r["h"] & ((1 << depth) - 1)] for r in keys.collect()) == {r["bucket"]: r["bucket_size"] for r in rows if r["bucket_size"]}
    assert len(set(of.values())) < len(of)  # slots that need no split share a bucket
    places = [r["bucket"] for r in sorted(rows, key=lambda r: r["place"])]
    assert sum(a != b for a, b in zip(places, places[1:], strict=False)) == len(set(places)) - 1  # a bucket's slots are side by side


def test_given_tables_split_buckets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index, found, depth = exact_dedup.build_index(docs)
    assert depth > 3 and found.select("bucket").distinct().count() > 8 and index.select("bucket").distinct().count() > 8
    assert max(r["bucket_size"] for r in found.collect()) <= exact_dedup.LEAST_CAPACITY


def test_directory_stops_at_its_largest_depth(spark):
    keys = spark.range(500).select((F.col("id") * 16).alias("h"))  # the low bits are alike
    found, depth = exact_dedup.directory(keys, 10, max_bits=6)
    assert depth == 6 and sum({r["bucket"]: r["bucket_size"] for r in found.collect()}.values()) == 500


def test_texts_of_one_hash_are_chained(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.length(c).cast("long") % 3)
    df = spark.createDataFrame([(i, f"text {i % 7}" * (i % 4)) for i in range(60)], "doc_id long, text string")
    by = defaultdict(list)
    for i, x in held(df):
        by[x].append(i)
    same([tuple(r)[:3] for r in exact_dedup.groups(df, capacity=1).collect()], [(i, max(v), len(v)) for v in by.values() for i in v])
    extra = df.withColumns({"keep_k": F.lit("clash"), "group_size": F.lit("clash"), "bucket": F.lit(0)})
    same([r["doc_id"] for r in exact_dedup.keep_one(extra, capacity=1).collect()], [max(v) for v in by.values()])
    assert exact_dedup.keep_one(extra).columns == extra.columns and exact_dedup.keep_one(extra).filter("keep_k = 'clash' AND group_size = 'clash'").count() == len(by)
    index, _, _ = exact_dedup.build_index(df, capacity=1)
    chains = defaultdict(list)
    for r in index.collect():
        chains[r["h"]].append(r["chain"])
    assert len(chains) <= 3 and all(sorted(c) == list(range(len(c))) for c in chains.values()) and sum(map(len, chains.values())) == len(by)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_line_dedup(request, table):
    df = request.getfixturevalue(table)
    rows = held(df)
    where = defaultdict(set)
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    for i, x in rows:
        for line in x.split(b"\n"):
            where[key(line)].add(i)
    want = []
    for i, x in rows:
        lines = x.split(b"\n")
        kept = [y for y in lines if len(key(y).decode()) < 10 or len(where[key(y)]) < 2 or min(where[key(y)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), sha(b"\n".join(kept))))
    for bits in (16, 29):
        got = line_dedup.dedup_lines(df, max_bits=bits).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
        same([tuple(r) for r in got], want)


@pytest.mark.parametrize("table,length,options", [("odd", 400, {}), ("odd", 40, {"span": 16}), ("odd", 40, {"span": 16, "crowd": 1}), ("docs", 60, {"span": 30, "run_bytes": 1 << 16}), ("docs", 60, {"span": 30, "crowd": 2})])
def test_suffix_dedup(request, table, length, options):
    df = request.getfixturevalue(table)
    rows, n = held(df), Counter()
    for _, x in rows:
        n.update(x[j : j + length] for j in range(len(x) - length + 1))
    want = []
    for i, x in rows:
        spans = []
        for j in range(len(x) - length + 1):
            if n[x[j : j + length]] > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + x[at:a], b
        kept += x[at:]
        want.append((i, len(x), len(x) - len(kept), len(spans), sha(kept)))
    got = suffix_dedup.dedup_bytes(df, length, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same([tuple(r) for r in got], want)


def test_long_texts_are_cut_into_slices_that_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 700).astype(np.uint8))
    raw = np.frombuffer(bytes(rng.integers(97, 123, 2000).astype(np.uint8)) + passage, np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([raw.tobytes().decode()])], ["text"])
    starts = []
    for part, offs, rows, base in suffix_dedup.slices(batch, 60):
        a = suffix_dedup.Anchors(part, offs, 60, 30)
        starts += [base + at - d for at, low, high in zip(a.at.tolist(), a.low.tolist(), a.high.tolist(), strict=True) for d in range(low, high + 1)]
    assert sorted(starts) == list(range(len(raw) - 59))


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(3)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(0, 40))) for _ in range(7)]
    coded = [zip(r, suffix_dedup.front_code(r)[0], range(len(r)), strict=True) for r in runs]
    out, known = [], []
    for x, n, _ in suffix_dedup.LoserTree(coded):
        out.append(x)
        known.append(n)
    assert out == sorted(x for r in runs for x in r)
    assert all(n == suffix_dedup.common_prefix(a, b) for a, b, n in zip(out, out[1:], known[1:], strict=False))


@pytest.mark.parametrize("name,attached", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_word_encoder_is_the_library(docs, name, attached):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    mine = tokens.WordEncoder(path, attached, cache_bytes=40_000)
    more = ["  a  b ", "a \n b\t c  \n\nd e'll  ", "ÀÉ straße İI ΣΑΣ x y  z ́a", "<|endoftext|> hi<|startoftext|>", "\x1c a\x1d b\x85c", " lead", "a\r\nb \r\n c", "ﬁ don't 'S it's", "\n", " "]
    for x in [t or "" for t in TEXTS] + more + [r["text"] for r in docs.limit(60).collect()]:
        assert mine.encode(x).tolist() == whole.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name,attached", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_are_one_unit_whatever_mark_stands_behind(name, attached):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    mine = tokens.WordEncoder(path, attached)
    words = ["plainword", "Élysée", "naïveté", "x"]
    marks = [",", ".", "!!", "'s", "'sx", "=\u0338", "\u0338=", "7", "$\u00e9", "\u00d7,", "\u00f7)", "-b"]
    for text in [" " + " ".join(w + m for m in marks for w in words), "".join(w + m for w in words for m in marks)]:
        assert mine.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    mine.units.clear()
    mine.encode(" plainword \u00e9t\u00e9 , . !! 's")
    known = mine.units.n
    mine.encode("".join(f" {w}{m}" for w in ("plainword", "\u00e9t\u00e9") for m in (",", ".", "!!", "'s")))
    assert mine.units.n - known <= 4  # the marks without a space before them; not a unit for each word and mark


def library(df, name, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    return [(i, np.array(whole.encode(x.decode(), add_special_tokens=False).ids + [end], "<u4")) for i, x in held(df)]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_token_output(spark, request, table):
    df = request.getfixturevalue(table)
    path = public_tokenizers.path("word_bpe_49k.json")
    want = sorted(library(df, "word_bpe_49k.json", 2), key=lambda r: r[0])
    got = token_output.read_documents(spark, token_output.write_ids(df, path, block_ids=5000), 49408).collect()
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(i, len(x), zlib.crc32(x.tobytes())) for i, x in want])
    at = 0
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == sum(len(x) for _, x in want)


def test_repair_round_trip_and_slices():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0, int), np.zeros(5000, int), rng.zipf(1.3, 20000) % 300, np.tile(rng.integers(0, 50, 40), 200)):
        seq, rules = repair.compress(ids.astype(np.uint16), 300)
        assert (repair.expand(seq, rules, 300) == ids).all() and len(seq) <= len(ids)
        sizes = repair.lengths(rules, 300)
        for i in range(0, max(0, len(ids) - 30), 1777):
            assert (repair.expand_slice(seq, rules, sizes, 300, i, 30) == ids[i : i + 30]).all()


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    want = Counter((i, len(x), x.tobytes()) for i, x in library(df, "byte_bpe_50k.json", 1))
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), length=256).collect()
    stream = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at, whole, have = 0, [], Counter()
    for r in stream:
        assert divmod(at, 256) == (r["sequence_id"], r["offset"]) and r["offset"] + r["length"] <= 256
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == (len(whole) if r["start"] else 0)
        if not r["start"]:
            whole = []
        whole += np.frombuffer(r["ids"], "<u4").tolist()
        if len(whole) == r["doc_tokens"]:
            have[r["doc_id"], len(whole), np.array(whole, "<u4").tobytes()] += 1
        at += r["length"]
    assert have == want


def test_hilbert_key_walks_to_neighbours():
    grid = np.stack(np.meshgrid(np.arange(8), np.arange(8), np.arange(8), indexing="ij"), axis=-1).reshape(-1, 3)
    order = np.argsort(packing.hilbert_key(grid, 3))
    assert sorted(packing.hilbert_key(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_piece_sampling_is_lossless_and_reproducible(request, table):
    df = request.getfixturevalue(table)
    model = public_tokenizers.path("piece_bpe_32k.model")
    a = piece_sampling.encode(df, model)
    got = a.collect()
    assert all(r["lossless"] for r in got)
    same([(r["doc_id"], r["decoded_sha256"]) for r in got], [(i, sha(x)) for i, x in held(df)])
    same([(r["doc_id"], r["ids_crc32"]) for r in got], [(r["doc_id"], r["ids_crc32"]) for r in piece_sampling.encode(df.repartition(5), model).collect()])
    same([(r["doc_id"], r["text"].encode()) for r in piece_sampling.decode(a, model).collect()], held(df))


def test_piece_sampling_draws_the_lattice_distribution():
    lat = piece_sampling.Lattice(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    chars, found = piece_sampling.MARK + "theren", {}

    def walk(i, path, p):
        if i == len(chars):
            found[tuple(path)] = p
            return
        for j in range(i + 1, len(chars) + 1):
            if chars[i:j] in lat.weight:
                walk(j, [*path, lat.weight[chars[i:j]][0]], p * math.exp(lat.weight[chars[i:j]][1]))

    walk(0, [], 1.0)
    n, total = 20_000, sum(found.values())
    drawn = Counter(tuple(x.tolist()) for x in lat.sample(["theren"] * n, np.arange(n, dtype=np.uint64)))
    assert set(drawn) <= set(found) and max(abs(drawn[s] / n - p / total) for s, p in found.items()) < 0.02


@pytest.mark.parametrize("text", ["  the", "   on", "a  in ", "\t    x"])
def test_piece_sampling_draws_the_lattice_distribution_of_runs_of_spaces(text):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, lat = sentencepiece.SentencePieceProcessor(model_file=path), piece_sampling.Lattice(path, 1.0)
    n = sp.vocab_size()
    pieces = {sp.id_to_piece(i): (i, 1 / (min(n, -sp.get_score(i)) + 1)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    chars, found = (" " + text).replace(" ", piece_sampling.MARK), {}

    def walk(i, path, p):
        if i == len(chars):
            found[tuple(path)] = p
            return
        for j in range(i + 1, len(chars) + 1):
            if chars[i:j] in pieces:
                walk(j, [*path, pieces[chars[i:j]][0]], p * pieces[chars[i:j]][1])
            elif j == i + 1:
                walk(j, [*path, *(lat.bytes[x] for x in chars[i].encode())], p / (n + 1))

    walk(0, [], 1.0)
    n_drawn, total = 20_000, sum(found.values())
    drawn = Counter(tuple(x.tolist()) for x in lat.sample([text] * n_drawn, np.arange(n_drawn, dtype=np.uint64)))
    assert set(drawn) <= set(found) and max(abs(drawn[s] / n_drawn - p / total) for s, p in found.items()) < 0.02
    assert all(lat.decode(np.array(s)) == text.encode() for s in drawn)


def test_piece_sampling_gives_indents_their_pieces():
    lat = piece_sampling.Lattice(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = ["def f():\n" + " " * n + "return  1" + " " * n for n in range(40)] + [" " * n for n in range(40)]
    ids = lat.sample(texts, np.arange(len(texts), dtype=np.uint64))
    assert [lat.decode(x).decode() for x in ids] == texts
    runs = [i for p, (i, _) in lat.weight.items() if len(p) > 1 and not p.strip(piece_sampling.MARK)]
    assert len(runs) == 14 and set(runs) <= {i for x in ids for i in x.tolist()}


def test_language_id_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    got = language_id.identify(df).collect()
    assert {r["doc_id"] for r in got} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


def test_language_id_rejects_other_scripts_and_noise(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [t for t, in df.filter("text IS NOT NULL AND length(text) > 200").select("text").limit(30).collect()]
    foreign = ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 4, "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 6, "كان يا ما كان في قديم الزمان ملك عظيم يحكم بلادا واسعة " * 4, "qzx wvkj pqzz xkcd jjqw zxqv wkkq qqxz vvjk zzqp kxwj " * 6]
    strange = foreign + language_id.noise(texts, 9)
    more = spark.createDataFrame([(10**9 + i, x) for i, x in enumerate(strange)], "doc_id long, text string")
    got = language_id.identify(df.select("doc_id", "text", "lang").unionByName(more, allowMissingColumns=True)).collect()
    new = [r for r in got if r["doc_id"] >= 10**9]
    assert all(r["rejected"] for r in new if r["doc_id"] < 10**9 + len(foreign))
    assert sum(r["rejected"] for r in new) >= 0.9 * len(new)
    assert sum(r["rejected"] for r in got if r["doc_id"] < 10**9) <= 0.005 * len(got)


def test_language_scores_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(97, 110, n))) for n in (0, 1, 2, 5, 300, 4, 900, 3)]
    model = language_id.train(texts, ["a", "b"] * 4)
    want = language_id.scores(model, pa.array(texts), np.ones(8, bool))
    monkeypatch.setattr(language_id, "_AT_ONCE", 64)
    for a, b in zip(want, language_id.scores(model, pa.array(texts), np.ones(8, bool)), strict=True):
        assert np.allclose(a, b)


def test_language_id_of_odd_rows(odd):
    for r in language_id.identify(odd).collect():
        text = next(x for i, x in [*enumerate(TEXTS)] if i == r["doc_id"])
        if r["doc_id"] != 4 and not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        assert 0 <= r["score"] <= 1
    assert language_id.keep_known(odd).columns == odd.columns


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality_features(request, table):
    df = request.getfixturevalue(table)
    want = []
    for i, x in held(df):
        text = x.decode()
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = {j + a for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for a in range(3)}
        lines = [y for y in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)))
    got = quality_rules.judge(df).collect()
    same([tuple(r)[:6] for r in got], want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_fit_is_expectation_maximisation_over_documents():
    """The fit over counted patterns against the same steps document by document, in plain Python."""
    rng = np.random.default_rng(4)
    docs = [tuple(int(x) for x in rng.choice([-1, 0, 1], 4, p=(0.1, 0.2, 0.7) if rng.random() < 0.8 else (0.5, 0.2, 0.3))) for _ in range(400)]
    patterns = Counter(docs)
    votes = np.array(list(patterns))
    good, shares, prior = quality_rules.fit(votes, np.array(list(patterns.values())), rounds=25)
    p_good, table = 0.9, {(y, r, v): x for y, row in ((0, (0.40, 0.20, 0.40)), (1, (0.02, 0.18, 0.80))) for r in range(4) for v, x in zip((-1, 0, 1), row, strict=True)}
    for _ in range(25):
        post = []
        for d in docs:
            odds = math.log(p_good / (1 - p_good)) + sum(math.log(table[1, r, v] / table[0, r, v]) for r, v in enumerate(d))
            post.append(1 / (1 + math.exp(-odds)))
        for y in (0, 1):
            w = [p if y else 1 - p for p in post]
            for r in range(4):
                for v in (-1, 0, 1):
                    table[y, r, v] = (sum(a for a, d in zip(w, docs, strict=True) if d[r] == v) + 1) / (sum(w) + 3)
        for r in range(4):
            table[1, r, -1] = min(table[1, r, -1], 0.03)
            table[0, r, -1] = max(table[0, r, -1], 0.05, 2 * table[1, r, -1])
            table[0, r, 1] = max(table[0, r, 1], 0.3 * table[1, r, 1])
            for y in (0, 1):
                total = sum(table[y, r, v] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    table[y, r, v] /= total
        p_good = min(max(sum(post) / len(docs), 0.5), 0.98)
    by = dict(zip(map(tuple, votes.tolist()), good, strict=True))
    assert max(abs(by[d] - p) for d, p in zip(docs, post, strict=True)) < 1e-6 and abs(prior - p_good) < 1e-6


def test_rows_of_one_id_and_of_text_ids_are_told_apart(spark):
    """Many null ids, text ids, and columns named like the helpers' own."""
    long = "the first of many words that stand in this text so that windows of thirteen words can be found in it and repeated"
    other = "a wholly different text with enough words of its own to hold a window of thirteen words that is not found elsewhere at all"
    names = "_k, _t, _h, _sha, _text, _lettered, _marks, _keep".split(", ")
    for ids, kind in (([7, 7, 1, None, None, None], "long"), (["b", "b", "a", None, None, None], "string")):
        rows = [(i, x, "en", *["clash"] * 8) for i, x in zip(ids, [long, other, long, other + " x", long + " y", ""], strict=True)]
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, " + ", ".join(f"{n} string" for n in names))
        got = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_windows(df).collect()]
        n = len(long.split())
        same(got, [(ids[0], n), (ids[1], len(other.split())), (ids[2], n), (None, 0), (None, 0), (None, 0)])
        same([tuple(r)[:4] for r in exact_dedup.groups(df).collect()], [(i, max(ids[0], ids[2]) if x == long else i, 2 if x == long else 1, x != long or i == max(ids[0], ids[2])) for i, x, *_ in rows])
        for clean in (substring_dedup.clean, line_dedup.clean, jaccard_join.keep_one, exact_dedup.keep_one, language_id.keep_known):
            assert clean(df).columns == df.columns and clean(df).count() <= 6
        assert {r["group_id"] for r in jaccard_join.join(df).collect() if r["doc_id"] is not None} == {None}
        for done in (line_dedup.dedup_lines(df), suffix_dedup.dedup_bytes(df), quality_rules.judge(df), language_id.identify(df)):
            assert sorted(str(r["doc_id"]) for r in done.collect()) == sorted(map(str, ids))
        path = public_tokenizers.path("byte_bpe_50k.json")
        assert packing.pack(df, path).count() == 6 and piece_sampling.encode(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 6
        starts = [r["start"] for r in token_output.read_documents(spark, token_output.write_ids(df, path), 50257).collect()]
        assert len(set(starts)) == 6


def test_quality_votes_find_bad_rows_and_keep_good_ones(spark):
    root = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    got = [r for r in quality_rules.judge(spark.read.parquet(f"{root}/documents.parquet")).collect() if r["doc_id"] in label and not r["base_failed"]]
    good, bad = [r["kept"] for r in got if label[r["doc_id"]]], [r["kept"] for r in got if not label[r["doc_id"]]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.6 * len(bad)


def brute_links(rows):
    first = {}
    for i, x in sorted(rows):
        first.setdefault(x, i)
    sets = {x: frozenset(zip(*[WORD.findall(x)[a:] for a in range(5)], strict=False)) for x in first}
    linked = defaultdict(set)
    for x in sets:
        for y in sets:
            n = len(sets[x] & sets[y])
            if x != y and n and n >= 0.8 * (len(sets[x]) + len(sets[y]) - n) - 1e-9:
                linked[x].add(y)
    return first, linked


@pytest.mark.parametrize("table,options", [("docs", {}), ("odd", {}), ("odd", {"small": 1, "block": 2})])
def test_jaccard_join(request, table, options):
    df = request.getfixturevalue(table)
    rows = held(df)
    first, linked = brute_links(rows)
    got = jaccard_join.join(df, **options).collect()
    root = {x: x for x in first}
    for _ in first:
        for x in linked:
            for y in linked[x]:
                root[x] = root[y] = min(root[x], root[y], key=first.get)
    same([tuple(r) for r in got], [(i, first[x], len(linked[x]), first[root[x]]) for i, x in rows])
    kept = {first[root[x]] for x in first}
    assert {r["doc_id"] for r in jaccard_join.keep_one(df, **options).collect()} == kept


@pytest.mark.parametrize("options", [{}, {"small": 1, "block": 2}])
def test_keep_one_of_stars_whose_centre_has_the_largest_id(spark, options):
    rows = []
    for s in range(30):
        words = [f"s{s}w{i}" for i in range(100)]
        edited = [[f"e{c}" if i in (10 + 20 * c, 20 + 20 * c) else w for i, w in enumerate(words)] for c in range(4)]
        rows += [(10 * s + c, " ".join(w)) for c, w in enumerate([*edited, words])]
    first, linked = brute_links([(i, x.encode()) for i, x in rows])
    assert sorted(len(linked[x]) for x in first) == [1] * 120 + [4] * 30  # satellites are linked to the centre alone
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(df, **options).collect()) == [10 * s for s in range(30)]


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    results = [
        substring_dedup.dedup_windows(empty), substring_dedup.clean(empty), exact_dedup.groups(empty), exact_dedup.keep_one(empty), line_dedup.dedup_lines(empty), line_dedup.clean(empty),
        suffix_dedup.dedup_bytes(empty), packing.pack(empty, path), language_id.identify(empty), language_id.keep_known(empty), quality_rules.judge(empty), jaccard_join.join(empty), jaccard_join.keep_one(empty),
        piece_sampling.encode(empty, public_tokenizers.path("piece_bpe_32k.model")), token_output.read_documents(spark, token_output.write_ids(empty, path), 50257),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_sketch_split_loses_none(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), text_key(F.col("id").cast("string")).alias("t"))
    marked = rows.filter("k % 7 = 0")
    hit, clear = sketch.split(rows, marked, lambda it: it, "k long, t binary")
    assert marked.join(hit, ["k", "t"], "left_anti").count() == 0
    assert hit.count() + clear.count() == 5000 and hit.count() < 1500


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    same([tuple(r) for r in got[sorted(got.columns)].values.tolist()], [tuple(r) for r in want[sorted(want.columns)].values.tolist()])
