"""Linking of entity roots to items of a knowledge base, given as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .annotate import canonical
from .skew import split_join

#: What each reason adds to a candidate's score.
LABEL, ALIAS, VARIANT, TYPE_FITS, TYPE_DIFFERS, KNOWN, KNOWN_AT = 0.6, 0.4, 0.2, 0.2, -0.4, 0.1, 400


def score_candidates(names: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """(entity_id, qid, score, label_match, type_match) of items whose label or alias is one of a root's names.

    `names`: entity_id, kind, home (the root's language), language, folded. `labels`: qid, language, folded, is_label. `items`: qid, kind, sitelinks.
    The join is on language and name together. Each side brings all its names along, so a pair is scored where it first meets, by the least name
    in common, and the pairs themselves are not shuffled. A name that many roots and items have is split (`split_join`).
    """
    key = F.struct("language", "folded")
    own = F.col("language") == F.col("home")
    roots = names.dropna(subset=["language", "folded"]).groupBy("entity_id", "kind").agg(F.collect_set(F.struct(key.alias("key"), own.alias("own"))).alias("root_names"))
    held = labels.dropna(subset=["language", "folded"]).groupBy("qid").agg(F.collect_set(F.struct(key.alias("key"), "is_label")).alias("item_names"))
    held = held.join(items.select("qid", F.col("kind").alias("item_kind"), "sitelinks"), "qid")
    of = lambda rows, bag: rows.withColumn("k", F.explode(F.array_distinct(F.transform(bag, lambda n: n["key"])))).select(*rows.columns, "k.*")
    met = split_join(of(roots, "root_names"), of(held, "item_names"), ["language", "folded"])
    one = (F.size("root_names") == 1) & (F.size("item_names") == 1)
    least = F.array_min(F.array_intersect(F.transform("root_names", lambda n: n["key"]), F.transform("item_names", lambda n: n["key"])))
    met = met.filter(one | (least == key))

    def has(test) -> Column:
        """Whether a name of the root and one of the item are the same and fit `test` (own language, label)."""
        each = F.exists("root_names", lambda r: F.exists("item_names", lambda i: (r["key"] == i["key"]) & test(r["own"], i["is_label"])))
        return F.coalesce(F.when(one, test(F.get("root_names", F.lit(0))["own"], F.get("item_names", F.lit(0))["is_label"])).otherwise(each), F.lit(False))

    g = met.withColumns({"label_match": has(lambda o, x: o & x), "alias": has(lambda o, x: o & ~x), "variant": has(lambda o, x: ~o & x)})
    rows = g.filter(F.col("label_match") | F.col("alias") | F.col("variant"))
    fits = F.col("kind") == F.col("item_kind")
    score = F.when(F.col("label_match"), LABEL).when(F.col("alias"), ALIAS).otherwise(0.0) + F.when(F.col("variant"), VARIANT).otherwise(0.0) + F.when(fits, TYPE_FITS).when(~fits, TYPE_DIFFERS).otherwise(0.0)
    score = score + F.when(F.col("sitelinks") > 0, KNOWN * F.least(F.lit(1.0), F.log1p("sitelinks") / F.log1p(F.lit(KNOWN_AT)))).otherwise(0.0)
    return rows.select("entity_id", "qid", F.round(score, 3).alias("score"), "label_match", fits.alias("type_match"))


def exact_choices(scored: DataFrame) -> DataFrame:
    """(entity_id, qid) where exactly one item has the root's label and its type fits."""
    n = scored.filter("label_match").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("qid").alias("qid"), F.bool_and(F.coalesce("type_match", F.lit(False))).alias("fits"))
    return n.filter((F.col("n") == 1) & F.col("fits")).select("entity_id", "qid")


def review_queue(scored: DataFrame, linked: DataFrame, least: float = 0.5) -> DataFrame:
    return scored.filter(F.col("score") >= least).join(linked.select("entity_id"), "entity_id", "left_anti")


def refresh(held: DataFrame, snapshot: DataFrame) -> DataFrame:
    """qid and what happened: missing, redirected, changed or same; new items are not taken."""
    rows = held.select("qid", F.col("revision").alias("old")).join(snapshot.select("qid", "revision", "redirect_to"), "qid", "left")
    state = F.when(F.col("revision").isNull(), "missing").when(F.col("redirect_to").isNotNull(), "redirected").when(F.col("revision") != F.col("old"), "changed").otherwise("same")
    return rows.select("qid", state.alias("state"), "redirect_to")


def item_names(labels: DataFrame, languages: list[str]) -> DataFrame:
    """(item, language, name, kind, place): an item's labels, then its aliases, in the order of the languages, each name of a language once.

    `labels`: item, language, name, kind (label or alias), place among the aliases of a language.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    rows = labels.filter(F.col("language").isin(*languages) & (F.col("name") != "")).withColumn("rank", F.struct((F.col("kind") != "label").alias("alias"), order.alias("language"), F.col("place").alias("place")))
    first = rows.groupBy("item", "language", "name").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("item").orderBy("rank", "name")
    return first.select("item", "language", "name", F.when(F.col("rank.alias"), "alias").otherwise("label").alias("kind"), F.row_number().over(w).alias("place"))


def name_states(linked: DataFrame, names: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, language, name, kind, place, state, holder) for each name of the item that a root is linked to: absent, this_entity or other_entity.

    `linked`: entity_id, item; `entities`: entity_id, language, type, name (as held), authority_id. A name is looked for under the root's type, by its key.
    """
    root = linked.join(entities.select("entity_id", "type"), "entity_id").join(names, "item").withColumn("key", canonical(F.col("name")))
    held = entities.select("language", "type", F.col("name").alias("key"), F.coalesce("authority_id", "entity_id").alias("holder"))
    rows = root.join(held, ["language", "type", "key"], "left")
    state = F.when(F.col("holder").isNull(), "absent").when(F.col("holder") == F.col("entity_id"), "this_entity").otherwise("other_entity")
    return rows.select("entity_id", "language", "name", "kind", "place", state.alias("state"), "holder")


def names_to_add(states: DataFrame, chosen: DataFrame) -> DataFrame:
    """(entity_id, language, name): the absent labels, and those absent aliases that were chosen (entity_id, language, name)."""
    wanted = chosen.select("entity_id", "language", "name").distinct().withColumn("chosen", F.lit(True))
    rows = states.filter("state = 'absent'").join(wanted, ["entity_id", "language", "name"], "left")
    return rows.filter((F.col("kind") == "label") | F.col("chosen")).select("entity_id", "language", "name").distinct()
