"""Queries of web pages, with their SQL."""

from __future__ import annotations

from ..functions.columns import ENTITIES
from ..operators import boilerplate
from ..sources import archive as A
from .registry import query


def _plain(text: str) -> str:
    out = f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"
    for name, char in ENTITIES.items():
        out = "replace({}, '{}', '{}')".format(out, name, char.replace("'", "''"))
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_GONE = "|".join(["<!--.*?-->", *(rf"<{t}\b.*?</{t}>" for t in ("script", "style", "nav", "footer", "head", "aside"))])
_LINES = rf""", raw AS (SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)', 1), '') AS host,
        string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is){_GONE}', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|h[1-6]|article|section|tr)>', chr(10), 'g'), chr(10)) AS parts FROM pages),
    ln AS MATERIALIZED (SELECT page_id, host, line, pos FROM (SELECT page_id, host, {_plain('part')} AS line, pos FROM (SELECT page_id, host, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM raw)) WHERE line <> ''),
    hn AS (SELECT host, count(*) AS n FROM raw GROUP BY 1 HAVING count(*) >= 3),
    bp AS MATERIALIZED (SELECT host, line, count(DISTINCT page_id) AS pages, any_value(n) AS n FROM ln JOIN hn USING (host) WHERE host <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_id) > 0.5 * any_value(n))"""


@query("host_boilerplate", _LINES + ' SELECT host, line, pages, n AS "of" FROM bp')
def _(spark, d):
    return boilerplate.repeated_lines(boilerplate.page_lines(A.table(spark, d, "pages")).filter("host <> ''"))


@query("page_text", _LINES + """, k AS (SELECT ln.page_id, string_agg(ln.line, chr(10) ORDER BY pos) AS text, count(*) AS kept FROM ln LEFT JOIN bp ON bp.host = ln.host AND bp.line = ln.line WHERE bp.line IS NULL GROUP BY 1), t AS (SELECT page_id, count(*) AS n FROM ln GROUP BY 1)
    SELECT page_id, coalesce(text, '') AS text, (coalesce(n, 0) - coalesce(kept, 0))::INT AS dropped FROM raw LEFT JOIN k USING (page_id) LEFT JOIN t USING (page_id)""")
def _(spark, d):
    return boilerplate.without_boilerplate(A.table(spark, d, "pages"))
