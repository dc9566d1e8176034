"""Annotation of article text: language, keywords, named entities and countries, as joins of words with small or sized tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import without_overlaps

#: Commonest function words, a profile a language.
PROFILES = {
    "en": "the of and to in is that for it with was on are as be this have from",
    "fr": "le la les de des et un une que qui dans pour est sur pas ne avec au",
    "de": "der die das und ist von zu mit den auf im nicht ein eine dem als auch",
    "es": "el la los las de y que en un una por con para es del se al lo",
}
#: Kinds of names that are not entities.
JUNK_KINDS = ("DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL")
#: What a recogniser's kinds are called here; others are OTHER.
KINDS = {"PERSON": "PERSON", "PER": "PERSON", "ORG": "ORG", "GPE": "GPE", "LOC": "LOCATION", "FAC": "LOCATION", "EVENT": "EVENT"}
LETTERS, CONFIDENCE, MARGIN = 50, 0.80, 0.20
WORD = r"(\p{L}[\p{L}\p{N}'’-]*)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 1)


def detect_language(docs: DataFrame, key: str = "article_id", profiles: dict[str, str] | None = None) -> DataFrame:
    """language, confidence and margin by the share of function words; `und` under 50 letters, .80 confidence or .20 margin.

    The counts are made inside the row, so nothing is shuffled however long the text.
    """
    profiles = profiles or PROFILES
    bag = F.transform(words(F.col("text")), lambda w: F.lower(w))
    rows = docs.select(key, F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]", "")).alias("letters"), bag.alias("bag"))

    def hits(listed: str) -> Column:
        return F.size(F.filter("bag", lambda w: w.isin(*listed.split())))

    counted = rows.select(key, "letters", *[hits(v).alias(k) for k, v in profiles.items()])
    total = sum((F.col(k) for k in list(profiles)[1:]), F.col(next(iter(profiles))))
    ranked = F.sort_array(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("lang")) for k in profiles]), False)
    scored = counted.select(key, "letters", total.alias("total"), ranked[0].alias("a"), ranked[1].alias("b"))
    confidence, margin = F.col("a.n") / F.greatest("total", F.lit(1)), (F.col("a.n") - F.col("b.n")) / F.greatest("total", F.lit(1))
    sure = (F.col("letters") >= LETTERS) & (confidence >= CONFIDENCE) & (margin >= MARGIN)
    return scored.select(key, F.when(sure, F.col("a.lang")).otherwise("und").alias("language"), confidence.alias("confidence"), margin.alias("margin"))


def keywords(docs: DataFrame, stop_words: list[str], key: str = "article_id", most: int = 3, k: int = 50) -> DataFrame:
    """Up to `k` phrases of one to three words a text by rarity times frequency; no phrase begins or ends with a stop word.

    relevance = 1 / (1 + score) where score falls as a phrase is rarer in the corpus and more frequent in the text (our own statistic).
    """
    bag = F.filter(F.transform(words(F.col("text")), lambda w: F.lower(w)), lambda w: F.length(w) > 0)
    rows = docs.select(key, bag.alias("bag"))
    grams = []
    for n in range(1, most + 1):
        whole = F.when(F.size("bag") >= n, F.sequence(F.lit(1), F.size("bag") - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams.append(_phrases(whole, n, stop_words))
    found = rows.select(key, F.explode(F.concat(*grams)).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("occurrences"))
    spread = found.groupBy("phrase").agg(F.count("*").alias("df"))
    score = F.col("df") / (F.col("occurrences") * F.col("occurrences"))
    scored = found.join(spread, "phrase").withColumn("relevance", 1.0 / (1.0 + score))
    w = Window.partitionBy(key).orderBy(F.desc("relevance"), "phrase")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "phrase", F.when(F.col("phrase").contains(" "), "keyphrase").otherwise("keyword").alias("kind"), "occurrences", F.round("relevance", 6).alias("relevance"), "rank")


def _phrases(starts: Column, n: int, stop_words: list[str]) -> Column:
    cut = F.transform(starts, lambda i: F.slice("bag", i, F.lit(n)))
    good = F.filter(cut, lambda p: ~F.element_at(p, 1).isin(*stop_words) & ~F.element_at(p, n).isin(*stop_words) & (F.length(F.element_at(p, 1)) >= 3))
    return F.transform(good, lambda p: F.array_join(p, " "))


def is_junk(name: Column, kind: Column) -> Column:
    """Kinds that are not entities, and names without a letter or with fewer than two letters or digits."""
    plain = F.regexp_replace(name, r"[^\p{L}\p{N}]", "")
    return kind.isin(*JUNK_KINDS) | ~name.rlike(r"\p{L}") | (F.length(plain) < 2)


def canonical(name: Column) -> Column:
    """Key of a name: no possessive, no leading "the", dotted acronyms closed, lower case."""
    x = F.regexp_replace(F.trim(name), r"['’]s$", "")
    x = F.regexp_replace(x, r"(?i)^the\s+", "")
    x = F.when(x.rlike(r"^(\p{L}\.){2,}$"), F.replace(x, F.lit("."), F.lit(""))).otherwise(x)
    return F.lower(F.regexp_replace(x, r"\s+", " "))


def canonical_kind(kind: Column) -> Column:
    out = F.lit("OTHER")
    for k, v in KINDS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def greek_fold(text: Column) -> Column:
    """Lower case without Greek accents, the final sigma as any other."""
    return F.translate(F.lower(text), "άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ")


def mentions(docs: DataFrame, names: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, name id, place, n_words): whole-word runs that are a known name, of names of any length; of overlapping ones the longest stays, then the first, then the smaller id.

    `names`: entity_id, folded (lower-case words joined by a space). The join is on the words; Spark broadcasts `names` where it is small.
    """
    sizes = [r[0] for r in names.select(F.size(F.split("folded", " "))).distinct().collect()]  # the different lengths of names, in words
    bag = F.transform(words(F.col("text")), lambda w: F.lower(w))
    rows = docs.select(key, bag.alias("bag")).select(key, "bag", F.posexplode("bag").alias("place", "_w")).drop("_w")
    runs = [F.struct(F.lit(n).alias("n_words"), F.when(F.col("place") + n <= F.size("bag"), F.array_join(F.slice("bag", F.col("place") + 1, n), " ")).alias("folded")) for n in sorted(sizes) or [1]]
    each = rows.select(key, "place", F.explode(F.array(*runs)).alias("g"))
    hit = each.select(key, "place", "g.*").filter(F.col("folded").isNotNull()).join(names.select("entity_id", "folded"), "folded")
    spans = hit.select(key, F.col("place").alias("start"), (F.col("place") + F.col("n_words")).alias("stop"), "entity_id")
    kept = without_overlaps(spans, [key], lambda s: F.struct((s["start"] - s["stop"]).alias("a"), s["start"].alias("b"), s["entity_id"].alias("c")))
    return kept.select(key, "entity_id", F.col("start").alias("place"), (F.col("stop") - F.col("start")).alias("n_words"))


def entity_rows(found: DataFrame, key: str = "article_id") -> DataFrame:
    """One row an article and entity: count, relevance min(1, n/5), places in order."""
    return found.groupBy(key, "entity_id").agg(F.count("*").alias("occurrence_count"), F.array_sort(F.collect_list("place")).alias("places")).withColumn("relevance", F.least(F.lit(1.0), F.col("occurrence_count") / 5.0))


def primary_country(rows: DataFrame, key: str = "article_id") -> DataFrame:
    """The one country of the title, where it also occurs outside of it. `rows`: key, country, in_title."""
    n = rows.groupBy(key, "country").agg(F.bool_or("in_title").alias("titled"), F.bool_or(~F.col("in_title")).alias("beyond"))
    one = n.groupBy(key).agg(F.count_if("titled").alias("n"), F.max(F.when(F.col("titled") & F.col("beyond"), F.col("country"))).alias("country"))
    return one.filter((F.col("n") == 1) & F.col("country").isNotNull()).select(key, "country")


def merge_short_names(people: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, name, target): names that are the end of one longer name's words in the same article, where all longer ones share a first word.

    `people`: key, name (folded), n. A name is matched by its suffixes, so names of different articles never meet; the target is the
    most mentioned longer name, the later in the alphabet on ties.
    """
    split = people.withColumn("words", F.split("name", " "))
    ends = split.filter(F.size("words") > 1).select(key, F.col("name").alias("long"), F.col("n").alias("long_n"), F.element_at("words", 1).alias("first"), F.explode(F.transform(F.sequence(F.lit(2), F.size("words")), lambda i: F.array_join(F.slice("words", i, F.size("words")), " "))).alias("name"))
    met = people.select(key, "name").join(ends, [key, "name"])
    best = met.groupBy(key, "name").agg(F.count_distinct("first").alias("firsts"), F.max_by("long", F.struct("long_n", "long")).alias("target"))
    return best.filter("firsts = 1").select(key, "name", "target")


def locate(docs: DataFrame, value: str, key: str = "article_id") -> DataFrame:
    """(key, section, start, end, text_start, text_end): whole-word places of a value, case aside, counted in characters from 0.

    `docs`: key, sections (kind, text), which are read joined by a newline. A place within a section has its offsets there; one that
    crosses sections has section `input` and the offsets of the joined text. Null texts are empty; an empty value is found nowhere.
    """
    import re

    parts = F.transform("sections", lambda s: F.coalesce(s["text"], F.lit("")))
    rows = docs.select(key, "sections", parts.alias("parts"), F.array_join(parts, "\n").alias("whole"))
    pattern = r"(?iUs)(?<![\p{L}\p{N}_])" + re.escape(value) + r"(?![\p{L}\p{N}_])"
    pieces = F.split("whole", pattern)
    found = F.regexp_extract_all("whole", F.lit(f"({pattern})"), 1)
    # A place begins where the pieces and matches before it end.
    step = lambda acc, i: F.struct(
        F.concat(acc["at"], F.array(acc["end"] + F.length(F.get("pieces", i)))).alias("at"), (acc["end"] + F.length(F.get("pieces", i)) + F.length(F.get("found", i))).alias("end")
    )
    places = F.aggregate(F.sequence(F.lit(0), F.size("found") - 1), F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end")), step)["at"]
    rows = rows.select(key, "sections", "parts", pieces.alias("pieces"), found.alias("found")).filter((F.size("found") > 0) & F.lit(value != ""))
    each = rows.select(key, "sections", "parts", F.explode(F.arrays_zip(places.alias("at"), F.col("found").alias("hit"))).alias("p")).select(key, "sections", "parts", F.col("p.at").alias("text_start"), (F.col("p.at") + F.length("p.hit")).alias("text_end"))
    begin = F.aggregate("parts", F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t) + 1)))
    inside = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: (F.get("begin", i) <= F.col("text_start")) & (F.col("text_end") <= F.get("begin", i) + F.length(F.get("parts", i))))
    placed = each.withColumn("begin", begin).withColumn("i", F.get(inside, F.lit(0))).withColumn("from", F.coalesce(F.get("begin", F.col("i")), F.lit(0)))
    section = F.coalesce(F.get("sections", F.col("i"))["kind"], F.lit("input"))
    return placed.select(key, section.alias("section"), (F.col("text_start") - F.col("from")).alias("start"), (F.col("text_end") - F.col("from")).alias("end"), "text_start", "text_end")


def annotations(articles: DataFrame, values: DataFrame, homes: DataFrame, kinds: list[str], key: str = "article_id", most: int = 50) -> DataFrame:
    """One row an article: its columns, an array of values for each of `kinds`, best first (the length of the report is `most`), and its sources' countries.

    `values`: key, kind, value, relevance; ties go by value. `homes`: key, country (nulls are left out). Articles without any have empty arrays.
    """
    ranked = values.withColumn("place", F.row_number().over(Window.partitionBy(key, "kind").orderBy(F.desc("relevance"), "value"))).filter(F.col("place") <= most)
    each = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "value")))), lambda x: x["value"]).alias(k) for k in kinds]
    lists = ranked.groupBy(key).agg(*each)
    where = homes.groupBy(key).agg(F.array_sort(F.collect_set("country")).alias("source_countries"))
    out = articles.join(lists, key, "left").join(where, key, "left")
    kind = dict(values.dtypes)["value"]
    empty = {k: F.coalesce(k, F.array().cast(f"array<{kind}>")) for k in kinds}
    return out.withColumns(empty | {"source_countries": F.coalesce("source_countries", F.array().cast(f"array<{dict(homes.dtypes)['country']}>"))})


def latest_runs(runs: DataFrame, states: DataFrame, key: str = "article_id") -> DataFrame:
    """The newest run of each processor of an article, and whether the article's annotations are of its present text.

    `runs`: key, processor, run_id, started_at, status; `states`: key, processor, fresh. Ties go to the larger run.
    """
    newest = runs.groupBy(key, "processor").agg(F.max_by(F.struct("run_id", "started_at", "status"), F.struct("started_at", "run_id")).alias("r"))
    return states.join(newest, [key, "processor"], "left").select(key, "processor", "fresh", "r.*")


def country_spellings(lexicon: DataFrame, shown: DataFrame, ambiguous: list[str], short: dict[str, str]) -> DataFrame:
    """(code, display, normalized, written): other spellings of each country, without ambiguous names and the display name itself.

    `lexicon`: code, names (array, the first is the usual one); `shown`: code, display, where that reads oddly. `short`: aliases in lower case and
    their codes, written in capitals up to three letters and with a capital first letter beyond. Of a name written in two ways the first is taken.
    """
    usual = F.trim(F.split_part(F.get("names", F.lit(0)), F.lit(","), F.lit(1)))
    base = lexicon.join(shown.select("code", F.col("display").alias("odd")), "code", "left").withColumn("display", F.coalesce("odd", usual))
    each = base.select("code", "display", F.posexplode("names").alias("place", "written")).withColumn("normalized", canonical(F.col("written")))
    listed = each.filter(~F.lower("written").isin(*ambiguous)) if ambiguous else each
    if short:
        pairs = [F.struct(F.lit(k).alias("normalized"), F.lit(v).alias("code")) for k, v in short.items()]
        extra = base.select("code", "display", F.explode(F.filter(F.array(*pairs), lambda p: p["code"] == F.col("code"))).alias("p"))
        n = F.col("p.normalized")
        listed = listed.unionByName(extra.select("code", "display", F.lit(2**31 - 1).alias("place"), F.when(F.length(n) <= 3, F.upper(n)).otherwise(F.initcap(n)).alias("written"), n.alias("normalized")))
    first = listed.groupBy("code", "display", "normalized").agg(F.min_by("written", "place").alias("written"))
    return first.filter(F.col("normalized") != F.lower("display")).select("code", "display", "normalized", "written")
