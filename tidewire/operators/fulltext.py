"""Search over several fields: each word in any field, as written or in its English or Greek form; phrases as written; four orders; pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stem
from .annotate import greek_fold
from .graph import _kept
from .ranking import keyset_page
from .search import tokens

#: Constants of BM25, and endings that are taken off a Greek word of five letters or more, longest first.
K1, B = 1.2, 0.75
GREEK_ENDINGS = ["ους", "εις", "ων", "ος", "ης", "ας", "ες", "ου", "οι", "αι", "α", "η", "ο", "ι", "ε"]
#: Orders: (column, descending) up to the id, which breaks ties.
ORDERS = {"relevance": [("score", True), ("effective_at", True)], "newest": [("effective_at", True)], "oldest": [("effective_at", False)], "most_sources": [("sources", True), ("effective_at", True)]}


def greek_form(word: Column) -> Column:
    """A lower-case word without Greek accents and, from five letters on, without its Greek ending."""
    plain = greek_fold(word)
    return F.when(F.length(plain) >= 5, F.regexp_replace(plain, "(" + "|".join(GREEK_ENDINGS) + ")$", "")).otherwise(plain)


#: How a word is looked for: as written, and in its English and its Greek form.
ANALYSES = {"raw": lambda w: w, "en": stem, "el": greek_form}


def _counts(docs: DataFrame, key: str, fields: list[str], terms: list[str], phrases: list[list[str]], keep: list[str]) -> DataFrame:
    """Per document its fields' lengths and, for each field, how often each term occurs in each form (t), each phrase (p) and each word of a phrase (w)."""
    bags = docs.select(key, *keep, *[tokens(F.col(f)).alias(f"bag{i}") for i, f in enumerate(fields)])
    forms = bags.select("*", *[F.transform(f"bag{i}", form).alias(f"{name}{i}") for i in range(len(fields)) for name, form in ANALYSES.items() if name != "raw" and terms])
    n = lambda bag, word: F.size(F.filter(bag, lambda x: x == word))
    cols = [F.size(f"bag{i}").alias(f"len{i}") for i in range(len(fields))]
    for i in range(len(fields)):
        for j, term in enumerate(terms):
            cols += [n(f"bag{i}" if name == "raw" else f"{name}{i}", form(F.lit(term.lower()))).alias(f"t{i}_{j}_{name}") for name, form in ANALYSES.items()]
        for j, phrase in enumerate(phrases):
            cols.append(_phrase_count(f"bag{i}", phrase).alias(f"p{i}_{j}"))
            cols += [n(f"bag{i}", F.lit(w)).alias(f"w{i}_{j}_{m}") for m, w in enumerate(phrase)]
    return forms.select(key, *keep, *cols)


def _phrase_count(bag: str, phrase: list[str]) -> Column:
    """How often the words of a phrase follow each other."""
    places = F.sequence(F.lit(1), F.size(bag) - len(phrase) + 1)
    found = F.filter(places, lambda at: F.slice(bag, at, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.when(F.size(bag) >= len(phrase), F.size(found)).otherwise(0)


def _idf(n: str, df: str) -> Column:
    return F.log(1 + (F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def _norm(tf: str, i: int) -> Column:
    mean = F.when(F.col(f"mean{i}") > 0, F.col(f"mean{i}")).otherwise(F.lit(1.0))
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(f"len{i}") / mean))


def scored(docs: DataFrame, fields: dict[str, float], terms: list[str], phrases: list[str] | None = None, where: Column | None = None, key: str = "article_id", keep: list[str] | None = None) -> DataFrame:
    """(key, keep …, score) of the documents under `where` that have every term in some field and form and every phrase in some field.

    A term scores in all fields and forms where it is found, each by that field's own lengths and frequencies over all documents, times the field's boost; a phrase
    scores in its best field, with the rarity of all its words. Without terms and phrases all documents score 0.
    """
    names, words = list(fields), [tokens_of(p) for p in phrases or []]
    phrases_ = [w for w in words if w]
    keep = keep or []
    extra = docs.select("*", (where if where is not None else F.lit(True)).alias("__fits"))
    rows = _kept(_counts(extra, key, names, terms, phrases_, [*keep, "__fits"]))  # narrow, read for the statistics and the scores
    counted = [c for c in rows.columns if c[0] in "tw" and "_" in c and c not in keep]
    stats = rows.agg(
        *[F.count_if(F.col(f"len{i}") > 0).alias(f"n{i}") for i in range(len(names))], *[F.avg(F.when(F.col(f"len{i}") > 0, F.col(f"len{i}"))).alias(f"mean{i}") for i in range(len(names))],
        *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in counted],
    )
    both = rows.filter("__fits").join(F.broadcast(stats))  # one row
    total, needed = F.lit(0.0), F.lit(True)
    for j in range(len(terms)):
        cells = [(i, boost, f"t{i}_{j}_{a}") for i, boost in enumerate(fields.values()) for a in ANALYSES]
        needed = needed & reduce(lambda x, y: x | y, [F.col(c) > 0 for _, _, c in cells])
        for i, boost, c in cells:
            total = total + F.when(F.col(c) > 0, boost * _idf(f"n{i}", f"df_{c}") * _norm(c, i)).otherwise(0.0)
    for j, phrase in enumerate(phrases_):
        needed = needed & reduce(lambda x, y: x | y, [F.col(f"p{i}_{j}") > 0 for i in range(len(names))])
        each = [F.when(F.col(f"p{i}_{j}") > 0, boost * reduce(lambda x, y: x + y, [_idf(f"n{i}", f"df_w{i}_{j}_{m}") for m in range(len(phrase))]) * _norm(f"p{i}_{j}", i)).otherwise(0.0) for i, boost in enumerate(fields.values())]
        total = total + (F.greatest(*each) if len(each) > 1 else each[0])
    return both.filter(needed).select(key, *keep, F.round(total, 6).alias("score"))


def tokens_of(text: str) -> list[str]:
    """The words of a query's phrase, as `search.tokens` finds them."""
    return re.findall(r"[^\W_]+", text.lower())


def page(docs: DataFrame, fields: dict[str, float], terms: list[str], phrases: list[str] | None = None, where: Column | None = None, order: str = "relevance", limit: int = 30, after: list | None = None, key: str = "article_id") -> DataFrame:
    """A page of `scored` in one of ORDERS, and one row more where there is another page; `after`: the last row's keys and id.

    `docs` holds effective_at and sources beside the fields. Only the first limit + 1 rows of each task are ever sorted together.
    """
    found = scored(docs, fields, terms, phrases, where, key, ["effective_at", "sources"])
    return keyset_page(found, [*ORDERS[order], (key, False)], after, limit)
