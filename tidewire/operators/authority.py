"""Entity authority: roots and variants, merges, combined rows, relations and suggestions of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import initials, trigrams

#: Fixed values of the duplicate rules: what each reason is worth, kinds that are places, and kinds that are mistaken for others.
RULES = {"item name": 0.9, "same name, other type": 0.85, "acronym": 0.8, "initials": 0.8, "surname": 0.6, "similar spelling": 0.6}
PLACES = ["GPE", "LOCATION"]
LOOSE = ["ORG", "PRODUCT", "EVENT", "TOPIC", "OTHER"]


def roots(entities: DataFrame) -> DataFrame:
    """entity_id -> root_id; a variant points at its root and never further."""
    return entities.select("entity_id", F.coalesce("authority_id", "entity_id").alias("root_id"))


def combine_rows(links: DataFrame, root_map: DataFrame) -> DataFrame:
    """One row an article and root: summed counts, relevance min(1, n/5), and the name with most mentions (the root's own on ties)."""
    rows = links.join(root_map, "entity_id").groupBy("article_id", "root_id", "entity_id").agg(F.sum("occurrence_count").alias("n"))
    best = F.struct(-F.col("n"), (F.col("entity_id") != F.col("root_id")), F.col("entity_id"))
    out = rows.groupBy("article_id", "root_id").agg(F.sum("n").alias("occurrence_count"), F.min_by("entity_id", best).alias("observed_entity_id"))
    return out.withColumn("relevance", F.least(F.lit(1.0), F.col("occurrence_count") / 5.0))


def merge_problems(requests: DataFrame, entities: DataFrame, distinct: DataFrame, relations: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """The first reason against each requested merge (source into target), or null: self, already a variant (of it, or of another), a target that is one,
    a pair marked as different, a see-also relation between them (`relations`: subject, object), different items (`items`: entity_id, item)."""
    e = entities.select("entity_id", "authority_id")
    rows = requests.join(e.withColumnsRenamed({"entity_id": "source", "authority_id": "source_root"}), "source", "left").join(e.withColumnsRenamed({"entity_id": "target", "authority_id": "target_root"}), "target", "left")

    def pairs(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.lit(True).alias(name)).distinct()

    rows = rows.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target")).join(pairs(distinct, "a", "b", "apart"), ["lo", "hi"], "left")
    why = F.when(F.col("source") == F.col("target"), "self").when(F.col("source_root").isNotNull(), "already_variant").when(F.col("target_root").isNotNull(), "target_is_variant").when(F.col("apart"), "distinct")
    if relations is not None:
        rows = rows.join(pairs(relations, "subject", "object", "linked"), ["lo", "hi"], "left")
        why = why.when(F.col("linked"), "linked")
    if items is not None:
        one = items.groupBy("entity_id").agg(F.min("item").alias("item"))
        for side in ("source", "target"):
            rows = rows.join(one.select(F.col("entity_id").alias(side), F.col("item").alias(f"{side}_item")), side, "left")
        why = why.when(F.col("source_item") != F.col("target_item"), "different items")
    return rows.select("source", "target", why.alias("problem"))


def merge_changes(entities: DataFrame, merges: DataFrame, items: DataFrame) -> DataFrame:
    """(entity_id, other_id, action, before, after): the history of merges: a root's own kind and "not a name" mark that it gives up as a variant, its item that
    goes to the new root, and the merge. `entities`: entity_id, kind, preferred_kind, hidden; `merges`: source, target; `items`: entity_id, item."""
    rows = merges.select(F.col("source").alias("entity_id"), F.col("target").alias("other_id")).join(entities.select("entity_id", "kind", "preferred_kind", "hidden"), "entity_id").join(items.select("entity_id", "item"), "entity_id", "left")
    entry = lambda when, action, before, after, own="entity_id", other="other_id": F.when(when, F.struct(F.col(own).alias("entity_id"), (F.col(other) if other else F.lit(None).cast("long")).cast("long").alias("other_id"), F.lit(action).alias("action"), before.cast("string").alias("before"), after.cast("string").alias("after")))
    none = F.lit(None)
    each = F.array(
        entry(F.col("item").isNotNull(), "item_linked", none, F.col("item"), "other_id", "entity_id"),
        entry(F.col("preferred_kind").isNotNull(), "kind_changed", F.col("preferred_kind"), F.col("kind"), other=None),
        entry(F.col("hidden"), "hidden_changed", F.lit("true"), F.lit("false"), other=None),
        entry(F.lit(True), "merged", none, F.col("other_id")),
    )
    return rows.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("e")).select("e.*")


def apply_merges(entities: DataFrame, merges: DataFrame, steps: int = 10) -> DataFrame:
    """Variants re-rooted so that none points at another variant; chains of merges close in at most `steps` joins of doubling reach."""
    m = merges.select(F.col("source").alias("entity_id"), F.col("target").alias("to"))
    now = entities.join(m, "entity_id", "left").select("entity_id", F.coalesce("to", "authority_id", "entity_id").alias("root_id"))
    for _ in range(max(1, steps.bit_length())):
        now = now.join(now.select(F.col("entity_id").alias("root_id"), F.col("root_id").alias("next")), "root_id").select("entity_id", F.col("next").alias("root_id"))
    return now


def similar_names(names: DataFrame, least: float = 0.6, group: str = "kind") -> DataFrame:
    """Pairs of names of one group whose trigram similarity is `least` or more.

    Pairs meet on shared trigrams, rarest first: a pair at the threshold shares one of the rarest (1 - least) share of either's, so only
    these prefixes are joined (prefix filter), and sets are compared whole afterwards.
    """
    sets = names.select("entity_id", group, "name", trigrams(F.col("name")).alias("grams")).filter(F.size("grams") > 0)
    long = sets.select("entity_id", group, F.explode("grams").alias("gram"), F.size("grams").alias("n"))
    df = long.groupBy("gram").agg(F.count("*").alias("df"))
    w = Window.partitionBy("entity_id").orderBy("df", "gram")
    keep = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    prefix = long.join(df, "gram").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select("entity_id", group, "gram")
    a, b = prefix.withColumnRenamed("entity_id", "a"), prefix.withColumnRenamed("entity_id", "b")
    met = a.join(b, [group, "gram"]).filter("a < b").select("a", "b").distinct()
    g = sets.select("entity_id", "grams")
    rows = met.join(g.withColumnsRenamed({"entity_id": "a", "grams": "ga"}), "a").join(g.withColumnsRenamed({"entity_id": "b", "grams": "gb"}), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return rows.withColumn("similarity", both / (F.size("ga") + F.size("gb") - both)).filter(F.col("similarity") >= least).select("a", "b", F.round("similarity", 6).alias("similarity"))


def same_initials(names: DataFrame, group: str = "kind") -> DataFrame:
    """Pairs (long name, short name) of one group where the short one is the long one's initials."""
    long = names.filter(F.size(F.split("name", " ")) >= 2).select(F.col("entity_id").alias("a"), group, initials(F.col("name")).alias("key"))
    short = names.filter(~F.col("name").contains(" ")).select(F.col("entity_id").alias("b"), group, F.lower("name").alias("key"))
    return long.join(short, [group, "key"]).select("a", "b")


def rule_pairs(names: DataFrame, connectors: list[str]) -> DataFrame:
    """(a, b, reason), a < b: names of one language that may be one entity: acronym, surname, initials, and the same name of another kind.

    `names`: entity_id, language, kind, name (lower case). Every rule is a join on its key. Acronyms are the first letters of all words or of those that
    are no `connectors`, and join kinds alike, or not places of which one is loose; surnames are of people, three letters or more;
    initials are names of the same number of words of which one has words cut to their first letter and all others alike.
    """
    group = F.when(F.col("kind").isin(*PLACES), "PLACE").otherwise(F.col("kind"))
    n = names.select("entity_id", "language", "name", group.alias("kind"), F.col("kind").alias("type"), F.filter(F.split(F.trim("name"), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("words"))
    first = lambda w: F.array_join(F.transform(w, lambda x: F.left(x, F.lit(1))), "")
    long, single = n.filter(F.size("words") >= 2), n.filter(F.size("words") == 1).withColumn("key", F.element_at("words", 1))
    short = single.select("language", "key", F.col("entity_id").alias("b"), F.col("kind").alias("b_kind"))
    kept = F.filter("words", lambda w: ~w.isin(*connectors)) if connectors else F.col("words")
    keys = long.withColumn("key", F.explode(F.array_distinct(F.array(first(F.col("words")), first(kept))))).filter(F.length("key") >= 2)
    loose = ~F.array_contains(F.array("kind", "b_kind"), "PLACE") & (F.col("kind").isin(*LOOSE) | F.col("b_kind").isin(*LOOSE))
    acronym = keys.join(short, ["language", "key"]).filter((F.col("kind") == F.col("b_kind")) | loose).select(F.col("entity_id").alias("a"), "b", F.lit("acronym").alias("reason"))
    last = F.element_at("words", -1)
    people = long.filter((F.col("kind") == "PERSON") & (F.length(last) >= 3)).withColumn("key", last)
    surname = people.join(short.filter("b_kind = 'PERSON'"), ["language", "key"]).select(F.col("entity_id").alias("a"), "b", F.lit("surname").alias("reason"))
    shape = long.select("entity_id", "language", "kind", "words", first(F.col("words")).alias("shape"), last.alias("last"))
    cut = shape.filter(F.exists("words", lambda w: F.length(w) == 1)).withColumnsRenamed({"entity_id": "b", "words": "b_words"})
    met = shape.join(cut, ["language", "kind", "shape", "last"]).filter((F.col("entity_id") != F.col("b")) & (F.size("words") == F.size("b_words")))
    fits = F.zip_with("words", "b_words", lambda w, x: (w == x) | ((F.length(x) == 1) & (F.length(w) > 1)))
    initial = met.filter(F.forall(fits, lambda x: x) & (F.col("words") != F.col("b_words"))).select(F.col("entity_id").alias("a"), "b", F.lit("initials").alias("reason"))
    twin = n.select("language", "name", F.col("entity_id").alias("b"), F.col("type").alias("b_type"))
    same = n.join(twin, ["language", "name"]).filter("entity_id < b AND type <> b_type").select(F.col("entity_id").alias("a"), "b", F.lit("same name, other type").alias("reason"))
    rows = acronym.unionByName(surname).unionByName(initial).unionByName(same)
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "reason").distinct()


def item_pairs(names: DataFrame, links: DataFrame, item_names: DataFrame) -> DataFrame:
    """(a, b, reason): roots named like a label or alias of the item that another root of the same kind is linked to.

    `links`: entity_id, item; `item_names`: item, language, name (as names are held).
    """
    linked = links.join(names.select("entity_id", "kind"), "entity_id").join(item_names.select("item", "language", "name").distinct(), "item")
    found = linked.select(F.col("entity_id").alias("root"), "kind", "language", "name").join(names, ["language", "kind", "name"]).filter("root <> entity_id")
    return found.select(F.least("root", "entity_id").alias("a"), F.greatest("root", "entity_id").alias("b"), F.lit("item name").alias("reason")).distinct()


def suggestions(pairs: DataFrame, rejected: DataFrame, links: DataFrame, names: DataFrame, linked: DataFrame | None = None, k: int | None = 100) -> DataFrame:
    """Pairs (a, b, reason) as merges, best first: keep, drop, reasons, shared, score.

    The score is the best reason's plus .05 a shared article up to .2, 1 at most. Left out: rejected pairs (a < b), and pairs linked to two different items
    (`linked`: entity_id, item). The name with more articles is kept, then the longer, then the earlier in the alphabet, then the smaller id. Ties
    of scores: more shared articles, then the kept name, then ids. `k` is the length of the report, None all.
    """
    open_ = pairs.join(rejected.select("a", "b").distinct(), ["a", "b"], "left_anti")
    if linked is not None:
        i, j = (linked.select(F.col("entity_id").alias(x), F.col("item").alias(f"{x}_item")) for x in ("a", "b"))
        open_ = open_.join(i, "a", "left").join(j, "b", "left").filter("a_item IS NULL OR b_item IS NULL OR a_item = b_item").drop("a_item", "b_item")
    rule = F.lit(0.0)
    for reason, value in RULES.items():
        rule = F.when(F.col("reason") == reason, value).otherwise(rule)
    open_ = open_.groupBy("a", "b").agg(F.max(rule).alias("rule"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    mine = links.select("article_id", "entity_id").distinct()
    shared = open_.select("a", "b").join(mine.withColumnRenamed("entity_id", "a"), "a").join(mine.withColumnRenamed("entity_id", "b"), ["b", "article_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    known = names.select("entity_id", "name").join(mine.groupBy("entity_id").agg(F.count("*").alias("articles")), "entity_id", "left").fillna(0, ["articles"])
    side = lambda x: known.select(F.col("entity_id").alias(x), F.struct((-F.col("articles")).alias("n"), (-F.length("name")).alias("length"), F.col("name").alias("name"), F.col("entity_id").alias("id")).alias(f"{x}_rank"))
    out = open_.join(shared, ["a", "b"], "left").fillna(0, ["shared"]).join(side("a"), "a").join(side("b"), "b")
    score = F.round(F.least(F.lit(1.0), F.col("rule") + F.least(F.lit(0.2), 0.05 * F.col("shared"))), 4)
    rows = out.select(F.least("a_rank", "b_rank").alias("x"), F.greatest("a_rank", "b_rank").alias("y"), "reasons", "shared", score.alias("score"))
    rows = rows.select(F.col("x.id").alias("keep"), F.col("y.id").alias("drop"), "reasons", "shared", "score", F.col("x.name").alias("name"))
    if k is not None:
        rows = rows.orderBy(F.desc("score"), F.desc("shared"), "name", "keep", "drop").limit(k)
    return rows.drop("name")


def claim_name(names: DataFrame, claims: DataFrame, claimed: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """What a root's claim of a name in all its kinds does: (root_id, entity_id, outcome, holder) for every other entity of that name.

    `names`: entity_id, language, name, authority_id, ambiguous; `claims` (wanted): root_id, name, which must be the root's own or a variant's;
    `claimed` (held): language, name, root_id. `problems`: entity_id, root_id, problem, merges that may not be (`merge_problems`). Outcomes: `merge`, `other_root`
    (a variant elsewhere; `holder` is its root), the problem's name; and one row with a null entity for a refused claim: `not_a_root`, `ambiguous`, `not_own_name`, `taken`.
    """
    root = names.select(F.col("entity_id").alias("root_id"), "language", F.col("ambiguous").alias("r_ambiguous"), F.col("authority_id").alias("r_authority"))
    own = names.select(F.coalesce("authority_id", "entity_id").alias("root_id"), "language", "name", F.lit(True).alias("own")).distinct()
    held = claimed.select("language", "name", F.col("root_id").alias("holder"))
    rows = claims.select("root_id", "name").distinct().join(root, "root_id", "left").join(own, ["root_id", "language", "name"], "left").join(held, ["language", "name"], "left")
    why = F.when(F.col("language").isNull() | F.col("r_authority").isNotNull(), "not_a_root").when(F.col("r_ambiguous"), "ambiguous").when(F.col("own").isNull(), "not_own_name").when(F.col("holder") != F.col("root_id"), "taken")
    judged = rows.withColumn("outcome", why)
    refused = judged.filter("outcome IS NOT NULL").select("root_id", F.lit(None).cast(dict(names.dtypes)["entity_id"]).alias("entity_id"), "outcome", "holder")
    found = judged.filter("outcome IS NULL").select("root_id", "language", "name").join(names.select("entity_id", "language", "name", "authority_id"), ["language", "name"])
    found = found.filter((F.col("entity_id") != F.col("root_id")) & (F.col("authority_id").isNull() | (F.col("authority_id") != F.col("root_id"))))
    if problems is None:
        found = found.withColumn("problem", F.lit(None).cast("string"))
    else:
        found = found.join(problems.select("entity_id", "root_id", "problem"), ["entity_id", "root_id"], "left")
    outcome = F.when(F.col("authority_id").isNotNull(), "other_root").otherwise(F.coalesce("problem", F.lit("merge")))
    return refused.unionByName(found.select("root_id", "entity_id", outcome.alias("outcome"), F.col("authority_id").alias("holder")))


def other_types(names: DataFrame) -> DataFrame:
    """(root_id, entity_id): other shown roots spelled like one of a root's names, under another kind: what a claim would bring in."""
    group = names.select(F.coalesce("authority_id", "entity_id").alias("root_id"), "language", "name").distinct()
    open_ = names.filter("authority_id IS NULL AND NOT coalesce(hidden, false)").select("entity_id", "language", "name")
    return group.join(open_, ["language", "name"]).filter("root_id <> entity_id").select("root_id", "entity_id").distinct()


def reach(edges: DataFrame, starts: DataFrame, steps: int = 10) -> DataFrame:
    """Nodes reached from the starts along edges (a -> b) in at most `steps` steps, with the fewest steps. Stops when nothing is new."""
    from .graph import _kept

    found = _kept(starts.select(F.col("node"), F.lit(0).alias("steps")).distinct())
    front = found
    for i in range(1, steps + 1):
        front = _kept(front.select(F.col("node").alias("a")).join(edges.select("a", "b"), "a").select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti").withColumn("steps", F.lit(i)))
        if front.isEmpty():
            break
        found = _kept(found.unionByName(front))
    return found
