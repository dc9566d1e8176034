"""Column expressions: addresses, titles, words, similarities and time. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a reader, besides all that start with utm_.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref_src")
#: Units of HTML character entities that plain text keeps.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, sorted query; null where not absolute http(s)."""
    u = F.trim(url)
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    port = F.nullif(F.regexp_extract(F.try_parse_url(u, F.lit("AUTHORITY")), r":(\d+)$", 1), F.lit(""))
    port = F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), None).otherwise(port)
    pairs = F.split(F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit("")), "&")

    def wanted(pair: Column) -> Column:
        key = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
        return (pair != "") & ~key.startswith("utm_") & ~key.isin(*TRACKING)

    query = F.array_join(F.array_sort(F.filter(pairs, wanted)), "&")
    path = F.coalesce(F.nullif(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lit("/"))
    whole = F.concat(scheme, F.lit("://"), host, F.coalesce(F.concat(F.lit(":"), port), F.lit("")), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & host.isNotNull(), whole)


def title_hash(title: Column) -> Column:
    """SHA-256 of the title with runs of white space as one space and in lower case."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(title, r"\s+", " "))), 256)


def plain_text(html: Column) -> Column:
    """Without tags, character entities decoded, white space collapsed."""
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def main_text(html: Column) -> Column:
    """Lines of a page's body: scripts, styles, comments, navigation and footers go; block ends become line ends."""
    kept = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|head|aside)\b.*?</\1>", " ")
    kept = F.regexp_replace(kept, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|article|section|tr)>", "\n")
    lines = F.transform(F.split(kept, "\n"), plain_text)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def title_tokens(title: Column, stop_words: list[str]) -> Column:
    """Sorted different runs of a-z and 0-9 of the lower-case title, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"([0-9a-z]+)"), 1))
    return F.array_sort(F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words)


def stem(word: Column) -> Column:
    """Plurals, -ing and -ed with a doubled consonant undone, and a final e, taken off an English word."""

    def bare(w: Column) -> Column:
        twin = w.rlike(r"([^aeioulsz])\1$")
        return F.when(twin, F.left(w, F.length(w) - 1)).otherwise(w)

    def cut(w: Column, n: int) -> Column:
        return F.left(w, F.length(w) - n)

    w = word
    plural = F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(cut(w, 3), F.lit("y"))).when(w.endswith("sses"), cut(w, 2)).when(w.endswith("s") & ~w.rlike("(ss|us|is)$") & (F.length(w) > 3), cut(w, 1)).otherwise(w)
    suffix = F.when(plural.endswith("ing") & (F.length(plural) > 5), bare(cut(plural, 3))).when(plural.endswith("ed") & (F.length(plural) > 4), bare(cut(plural, 2))).otherwise(plural)
    return F.when(suffix.endswith("e") & (F.length(suffix) > 3), cut(suffix, 1)).otherwise(suffix)


def lede_terms(text: Column, stop_words: list[str], words: int = 80) -> Column:
    """Stems of the different words of letters, three or more long, among the first `words` words."""
    found = F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), 1), 1, words)
    kept = F.filter(found, lambda w: (F.length(w) >= 3) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.left(stem(w), F.lit(64)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def link_strength(both: Column, a: Column, b: Column) -> Column:
    """Shared articles over articles of either, to four places."""
    return F.round(both / (a + b - both), 4)


def time_proximity(a: Column, b: Column, hours: float = 48.0) -> Column:
    """1 at the same time, falling in a line to 0 at `hours` apart."""
    apart = F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(hours * 3_600_000_000)
    return F.greatest(F.lit(0.0), 1.0 - apart)


def time_gap_seconds(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Seconds between two spans; 0 where they overlap, null where one has no times."""
    gap = F.greatest(F.unix_micros(start_b) - F.unix_micros(end_a), F.unix_micros(start_a) - F.unix_micros(end_b), F.lit(0))
    return F.when(start_a.isNotNull() & start_b.isNotNull() & end_a.isNotNull() & end_b.isNotNull(), gap / 1_000_000)


def term_weight(df: Column, window: Column) -> Column:
    """Rarity of a term found in `df` of a window's articles, 0 to 1; windows count as 100 articles at least."""
    n = F.greatest(window, F.lit(100))
    return F.greatest(F.lit(0.0), F.log(n / F.greatest(df, F.lit(1))) / F.log(n))


def entity_weight(articles: Column) -> Column:
    return 1.0 / F.log(F.lit(2.718281828459045) + articles)


def partial_date_valid(text: Column) -> Column:
    """Whether `2009`, `2021-10` or `2021-10-28` names a real year, month or day."""
    padded = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.coalesce(F.try_to_date(padded, "yyyy-MM-dd").isNotNull(), F.lit(False))


def period_ordered(start: Column, end: Column) -> Column:
    """Whether the end is not before the start at the precision that both have; open ends are in order."""
    n = F.least(F.length(start), F.length(end))
    return start.isNull() | end.isNull() | (F.left(end, n) >= F.left(start, n))


def in_quiet_hours(moment: Column, zone: str, start_s: int, end_s: int) -> Column:
    """Whether the clock in `zone` is within [start, end), which may pass midnight; equal ends: never."""
    local = F.from_utc_timestamp(moment, zone)
    clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    if start_s == end_s:
        return F.lit(False)
    return (clock >= start_s) & (clock < end_s) if start_s < end_s else (clock >= start_s) | (clock < end_s)


def trigrams(text: Column) -> Column:
    """Different character trigrams of lower-case words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != ""), lambda w: F.left(w, F.lit(1))), "")


def highlight(text: Column, words: list[str], mark: str = "**") -> Column:
    """The text with whole words of `words` marked, case aside."""
    import re

    pattern = r"(?iU)\b(" + "|".join(re.escape(w) for w in words) + r")\b"
    return F.regexp_replace(text, pattern, f"{mark}$1{mark}") if words else text


def term_overlap(a: Column, b: Column, weight: Column) -> Column:
    """Sum of the shared terms' weights over the smaller set's size held between 12 and 25, at most 1; 0 with fewer than four shared. `weight`: a map of term weights."""
    shared = F.array_intersect(a, b)
    total = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(weight, t), F.lit(0.0)))
    size = F.greatest(F.lit(12), F.least(F.lit(25), F.size(a), F.size(b)))
    return F.when(F.size(shared) < 4, 0.0).otherwise(F.least(F.lit(1.0), total / size))
