"""Queries of search over fields and forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext
from ..sources import archive as A
from .registry import _stem_sql, query

_BOOSTS = {"title": 3.0, "text": 1.0}
_TERMS, _PHRASE = ["hands", "Ther"], "of the"
#: The terms as they are compared in each form.
_FORMS = {"raw": ["hands", "ther"], "en": ["hand", "ther"], "el": ["hands", "ther"]}


def _docs(spark, d):
    key = F.col("article_id")
    return A.texts(spark, d).withColumns({"effective_at": F.timestamp_seconds(F.lit(1704067200) + key % 97 * 3600), "sources": (key % 5).cast("int")})


def _sql(terms: bool, phrase: bool, where: str = "true") -> str:
    """Scores as `fulltext.scored` defines them: word counts by field and form, then the statistics of each."""
    forms = [(f, a, j, w[j]) for f in _BOOSTS for a, w in _FORMS.items() for j in range(2)] if terms else []
    column = {"raw": "w", "en": "en", "el": "w"}
    tf = [f"count(*) FILTER (field = '{f}' AND {column[a]} = '{w}') AS {f}_{a}_{j}" for f, a, j, w in forms]
    lens = [f"count(*) FILTER (field = '{f}') AS len_{f}" for f in _BOOSTS]
    words = [f"count(*) FILTER (field = '{f}' AND w = '{w}') AS w_{f}_{w}" for f in _BOOSTS for w in ("of", "the")] if phrase else []
    ph = [f"count(*) FILTER (field = '{f}' AND w = 'of' AND next = 'the') AS p_{f}" for f in _BOOSTS] if phrase else []
    cells = [f"{f}_{a}_{j}" for f, a, j, _ in forms]
    idf = lambda f, c: f"ln(1 + (n_{f} - df_{c} + 0.5) / (df_{c} + 0.5))"
    norm = lambda f, c: f"{c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * len_{f} / mean_{f}))"
    total = [f"CASE WHEN {c} > 0 THEN {_BOOSTS[f]} * {idf(f, c)} * {norm(f, c)} ELSE 0 END" for (f, _, _, _), c in zip(forms, cells, strict=True)]
    need = [" OR ".join(f"{f}_{a}_{j} > 0" for f in _BOOSTS for a in _FORMS) for j in range(2)] if terms else []
    if phrase:
        each = ", ".join(f"CASE WHEN p_{f} > 0 THEN {_BOOSTS[f]} * ({idf(f, f'w_{f}_of')} + {idf(f, f'w_{f}_the')}) * {norm(f, f'p_{f}')} ELSE 0 END" for f in _BOOSTS)
        total.append(f"greatest({each})")
        need.append(" OR ".join(f"p_{f} > 0" for f in _BOOSTS))
    stats = [*[f"count(*) FILTER (len_{f} > 0) AS n_{f}, avg(len_{f}) FILTER (len_{f} > 0) AS mean_{f}" for f in _BOOSTS], *[f"count(*) FILTER ({c} > 0) AS df_{c}" for c in [*cells, *(x.split(" AS ")[1] for x in words)]]]
    staged = _stem_sql("w").replace("SELECT article_id", "SELECT article_id, field, pos, w")
    return rf""", fw AS (SELECT article_id, 'title' AS field, title AS x FROM texts UNION ALL SELECT article_id, 'text', text FROM texts), lw AS (SELECT article_id, field, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT article_id, field, regexp_extract_all(lower(x), '([\p{{L}}\p{{N}}]+)') AS ws FROM fw)),
    sw AS (SELECT article_id, field, pos, w, term AS en, lead(w) OVER (PARTITION BY article_id, field ORDER BY pos) AS next FROM ({staged})), cn AS (SELECT article_id, {', '.join([*lens, *tf, *words, *ph])} FROM texts LEFT JOIN sw USING (article_id) GROUP BY 1),
    ss AS (SELECT {', '.join(stats)} FROM cn),
    sc AS (SELECT article_id, TIMESTAMP '2024-01-01' + to_hours(article_id % 97) AS effective_at, (article_id % 5)::INT AS sources, round({' + '.join(total) if total else '0.0'}, 6)::DOUBLE AS score FROM cn, ss WHERE {' AND '.join(f'({x})' for x in [*need, where])})"""


@query("search_fields", _sql(True, False) + " SELECT * FROM sc")
def _(spark, d):
    return fulltext.scored(_docs(spark, d), _BOOSTS, _TERMS, keep=["effective_at", "sources"])


@query("search_relevance", _sql(True, True) + " SELECT * FROM sc ORDER BY score DESC, effective_at DESC, article_id LIMIT 31")
def _(spark, d):
    return fulltext.page(_docs(spark, d), _BOOSTS, _TERMS, [_PHRASE])


@query("search_newest", _sql(False, True, "article_id % 3 = 0") + " SELECT * FROM sc WHERE effective_at < TIMESTAMP '2024-01-04' OR (effective_at = TIMESTAMP '2024-01-04' AND article_id > 70) ORDER BY effective_at DESC, article_id LIMIT 21")
def _(spark, d):
    return fulltext.page(_docs(spark, d), _BOOSTS, [], [_PHRASE], F.col("article_id") % 3 == 0, "newest", 20, ["2024-01-04 00:00:00", 70])


@query("search_by_sources", _sql(True, False) + " SELECT * FROM sc ORDER BY sources DESC, effective_at DESC, article_id LIMIT 26")
def _(spark, d):
    return fulltext.page(_docs(spark, d), _BOOSTS, _TERMS, order="most_sources", limit=25)


@query("search_eldest", _sql(True, False) + " SELECT * FROM sc ORDER BY effective_at, article_id LIMIT 26")
def _(spark, d):
    return fulltext.page(_docs(spark, d), _BOOSTS, _TERMS, order="oldest", limit=25)
