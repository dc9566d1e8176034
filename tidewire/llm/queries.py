"""The thin queries over the test tables: one a numbered operator, with production parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, jaccard_join, language_id, lexical_search, line_dedup, packing, piece_sampling, quality_rules, substring_dedup, suffix_dedup, token_output, vector_codes


def use_small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Whole texts can be long: batches between the JVM and Python are bounded by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_windows(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_docs(spark, sf_dir))


def _tokenizer(name: str) -> str:
    """The place of a public vocabulary file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenizers import Tokenizer

    path = _tokenizer("word_bpe_49k.json")
    return token_output.read_documents(spark, token_output.write_ids(_docs(spark, sf_dir), path, end_id=2), Tokenizer.from_file(path).get_vocab_size())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_docs(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    use_small_batches(spark, piece_sampling.SAMPLE_BYTES)
    return piece_sampling.encode(docs, _tokenizer("piece_bpe_32k.model")).drop("ids")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), attached=True, end_id=1).drop("ids")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_docs(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_docs(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


#: Conversation -1, in a layout of its own.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    one = spark.createDataFrame([(json.dumps({"conv_id": -1, "prompt": CONTROL_TEXT, "completion": CONTROL_TEXT}),)], "record string").select(F.parse_json("record").alias("record"))
    path = chat_format.write_chats(chat_format.canonical_turns(rows.unionByName(one)))
    return chat_format.digests(spark.read.parquet(path))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_output": op3_token_output,
    "op4_line_dedup": op4_line_dedup,
    "op5_piece_sampling": op5_piece_sampling,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_lexical_search": op13_lexical_search,
}



def _codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """The rounds of op11 one after another, over one row a vector and component."""
    near = "SELECT vec_id, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (SELECT v.vec_id, v.p, c.e, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS far FROM v JOIN {c} c USING (p, d) GROUP BY 1, 2, 3) GROUP BY 1, 2"
    steps = [
        "k AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS d, floor(4096 * x::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM k))",
        f"c0 AS MATERIALIZED (SELECT p, d, e, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, d, e, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT v.p, v.d, a.e, floor(sum(v.x)::BIGINT / count(*))::BIGINT AS x FROM v JOIN a{i} a USING (vec_id, p) GROUP BY 1, 2, 3) m USING (p, d, e))")
    steps.append(f"f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM ({near.format(c=f'c{rounds}')}) GROUP BY vec_id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) FROM c{rounds}) AS codebooks_sha256 FROM f JOIN k USING (vec_id)"


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13)),
        f AS (SELECT win, min(doc_id) AS low FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT s.doc_id, s.i + j.j AS at FROM s JOIN f ON s.win = f.win AND s.doc_id > f.low, (SELECT unnest(generate_series(0, 12)) AS j) j),
        p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w),
        kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.at) AS text, count(*) AS n FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at WHERE g.at IS NULL GROUP BY p.doc_id)
        SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept k USING (doc_id)""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT k.*, f.low IS NOT NULL AND k.doc_id > f.low AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS class_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT class_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT class_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM c WHERE doc_id = class_id AND len(words) >= 5)),
        n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
        b AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.class_id <> y.class_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM b JOIN n p ON p.class_id = a JOIN n q ON q.class_id = b.b WHERE b.n >= 0.8 * (p.n + q.n - b.n) - 1e-9),
        l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
        r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
        g AS (SELECT node, min(root) AS group_id FROM r GROUP BY node)
        SELECT c.doc_id, c.class_id, coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(g.group_id, c.class_id) AS group_id FROM c LEFT JOIN l ON l.a = c.class_id LEFT JOIN g ON g.node = c.class_id""",
    "op11_vector_codes": _codes_sql(),
    "op12_chat_formatting": r"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, i, ['user', 'assistant'][i], '<|im_end|><|im_start|>assistant ok' FROM (SELECT unnest([1, 2]) AS i)),
        l AS (SELECT *, role = 'assistant' AS learned, '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS segment FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (learned), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (learned), '')) AS loss_sha256,
            sum(length(segment))::BIGINT AS formatted_chars
        FROM l GROUP BY conv_id""",
    "op13_lexical_search": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
        t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d SEMI JOIN b USING (term) GROUP BY 1, 2),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, docs),
        i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS impact FROM t JOIN w USING (term) JOIN n USING (doc_id), c),
        s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM b JOIN i USING (term) GROUP BY 1, 2)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
