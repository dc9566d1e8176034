"""Stated relations between entities: their stored form, what speaks against each, cycles of any length, and merges that move them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import partial_date_valid, period_ordered
from .authority import PLACES
from .graph import _kept

#: What a label asks for (relation, whether the entity asking is its subject), the kinds allowed for subject and object
#: (None: any; "same": as the subject), and the relations that may not lead back to their start.
LABELS = {
    "later_name": ("succeeded_by", True), "earlier_name": ("succeeded_by", False), "part_of": ("part_of", True), "has_part": ("part_of", False), "member_of": ("member_of", True),
    "has_member": ("member_of", False), "leader_of": ("leader_of", True), "led_by": ("leader_of", False), "related": ("related", True),
}
SIDES: dict[str, tuple[list[str] | None, list[str] | str | None]] = {
    "succeeded_by": (["ORG", "PLACE"], "same"), "part_of": (["ORG", "PLACE"], "same"), "member_of": (["PERSON", "ORG", "PLACE"], ["ORG"]), "leader_of": (["PERSON"], ["ORG", "PLACE"]), "related": (None, None),
}
ACYCLIC = ["succeeded_by", "part_of"]


def _kind(kind: str) -> Column:
    return F.when(F.col(kind).isin(*PLACES), "PLACE").otherwise(F.col(kind))


def stored(asked: DataFrame, roots: DataFrame) -> DataFrame:
    """`asked` (relation_id, label, asking, target, …) with relation, subject and object: roots stand for their variants, the label says who is
    subject, and a "related" pair is kept with its smaller id first. Unknown labels have no relation, unknown entities no id. `roots`: entity_id, root_id."""
    of = lambda name, to: roots.select(F.col("entity_id").alias(name), F.col("root_id").alias(to))
    rows = asked.join(of("asking", "one"), "asking", "left").join(of("target", "two"), "target", "left")
    names = F.create_map(*(x for label, (relation, _) in LABELS.items() for x in (F.lit(label), F.lit(relation))))
    back = F.col("label").isin(*[label for label, (_, subject) in LABELS.items() if not subject]) | ((F.col("label") == "related") & (F.col("two") < F.col("one")))
    return rows.select(*asked.columns, F.element_at(names, F.col("label")).alias("relation"), F.when(back, F.col("two")).otherwise(F.col("one")).alias("subject"), F.when(back, F.col("one")).otherwise(F.col("two")).alias("object"))


def wrong_sides(relation: Column, subject: Column, object_: Column) -> Column:
    """Whether a relation may not hold between entities of these kinds (places are one kind)."""
    out = F.lit(False)
    for name, (subjects, objects) in SIDES.items():
        bad = ~subject.isin(*subjects) if subjects else F.lit(False)
        if objects == "same":
            bad = bad | (subject != object_)
        elif objects:
            bad = bad | ~object_.isin(*objects)
        out = F.when(relation == name, bad).otherwise(out)
    return out


def peeled(edges: DataFrame) -> DataFrame:
    """`edges` (g, a, b) without those that no path can return along: their start has no way in, or their end no way out. A long thread takes a round a link."""
    held, n = edges, edges.count()
    while n:
        into, out = held.select("g", F.col("b").alias("a")).distinct(), held.select("g", F.col("a").alias("b")).distinct()
        held = _kept(held.join(into, ["g", "a"], "left_semi").join(out, ["g", "b"], "left_semi").select("g", "a", "b"))
        left = held.count()
        if left == n:
            break
        n = left
    return held


def _spread(start: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(g, node, value): the largest value of `start` that can be reached from each node of `edges` against their direction from `a` to `b`, until nothing moves."""
    now = _kept(start)
    while True:
        near = edges.join(now.select("g", F.col("node").alias(a), F.col("value").alias("near")), ["g", a]).groupBy("g", F.col(b).alias("node")).agg(F.max("near").alias("near"))
        next_ = F.greatest("value", "near")
        after = _kept(now.join(near, ["g", "node"], "left").select("g", "node", next_.alias("value"), (next_ > F.coalesce("value", next_ - 1)).alias("moved")))
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            return now


def cycle_members(relations: DataFrame) -> DataFrame:
    """(g, node, cycle): the entities that lie on a cycle of one group of links (g, a, b), with the smallest entity that leads to them and back.

    Links on no cycle are peeled from their ends first. Then every node takes the largest node that leads to it as its colour; the nodes that
    lead back to their colour's own node form a strongly connected part, which is taken out, and the rest goes through again.
    A link of a node to itself is a cycle of one. Rounds follow the longest path of what peeling leaves; ids are numbers.
    """
    links = _kept(relations.select("g", "a", "b").dropna().distinct())
    found = links.filter("a = b").select("g", F.col("a").alias("node"), F.col("a").alias("cycle"))
    edges = peeled(links.filter("a <> b"))
    while not edges.isEmpty():
        nodes = edges.select("g", F.col("a").alias("node")).unionByName(edges.select("g", F.col("b").alias("node"))).distinct()
        colour = _spread(nodes.withColumn("value", F.col("node")), edges, "a", "b")
        of = lambda side: colour.select("g", F.col("node").alias(side), F.col("value").alias(f"c{side}"))
        inside = _kept(edges.join(of("a"), ["g", "a"]).join(of("b"), ["g", "b"]).filter("ca = cb").select("g", "a", "b"))
        root = colour.select("g", "node", F.when(F.col("node") == F.col("value"), F.col("value")).alias("value"))
        back = _spread(root, inside, "b", "a").filter("value IS NOT NULL")  # these lead to their colour's node
        sizes = back.groupBy("g", "value").agg(F.min("node").alias("cycle"), F.count("*").alias("size"))
        parts = _kept(back.join(sizes, ["g", "value"]))
        found = found.unionByName(parts.filter("size > 1").select("g", "node", "cycle"))
        gone = parts.select("g", "node")
        edges = peeled(_kept(_rest(edges, gone)))
    return found.groupBy("g", "node").agg(F.min("cycle").alias("cycle"))


def _rest(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Links between nodes that are not `gone`."""
    for side in ("a", "b"):
        edges = edges.join(gone.withColumnRenamed("node", side), ["g", side], "left_anti")
    return edges.select("g", "a", "b")


def problems(asked: DataFrame, entities: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """(relation_id, problem): the first reason against each asked relation, or null.

    In order: unknown label, unknown entity, self, wrong kinds, missing note, unknown source, bad date, period out of order, cycle, and duplicate of a
    relation of smaller id. `asked`: relation_id, label, asking, target, start, stop, note, and source (an article) where `articles` is given;
    `entities`: entity_id, authority_id, kind. A link lies on a cycle where those that pass the other tests lead from its object back to its subject.
    """
    roots = entities.select("entity_id", F.coalesce("authority_id", "entity_id").alias("root_id"))
    kinds = entities.select("entity_id", _kind("kind").alias("kind"))
    rows = stored(asked, roots)
    for side in ("subject", "object"):
        rows = rows.join(kinds.select(F.col("entity_id").alias(side), F.col("kind").alias(f"{side}_kind")), side, "left")
    source = F.lit(False)
    if articles is not None:
        rows = rows.join(articles.select(F.col("article_id").alias("source"), F.lit(True).alias("has_source")).distinct(), "source", "left")
        source = F.col("source").isNotNull() & F.col("has_source").isNull()
    bad = lambda c: F.col(c).isNotNull() & ~partial_date_valid(F.col(c))
    early = (
        F.when(F.col("relation").isNull(), "unknown label").when(F.col("subject").isNull() | F.col("object").isNull(), "unknown entity").when(F.col("subject") == F.col("object"), "self")
        .when(wrong_sides(F.col("relation"), F.col("subject_kind"), F.col("object_kind")), "wrong kinds").when((F.col("relation") == "related") & (F.trim(F.coalesce("note", F.lit(""))) == ""), "missing note")
        .when(source, "unknown source").when(bad("start") | bad("stop"), "bad date").when(~period_ordered(F.col("start"), F.col("stop")), "out of order")
    )
    rows = _kept(rows.withColumn("early", early).select("relation_id", "relation", "subject", "object", "start", "early"))
    chains = rows.filter(F.col("early").isNull() & F.col("relation").isin(*ACYCLIC)).select(F.col("relation").alias("g"), F.col("subject").alias("a"), F.col("object").alias("b"))
    on = cycle_members(chains)
    for side in ("subject", "object"):
        rows = rows.join(on.select(F.col("g").alias("relation"), F.col("node").alias(side), F.col("cycle").alias(f"{side}_cycle")), ["relation", side], "left")
    round_ = F.col("early").isNull() & (F.col("subject_cycle") == F.col("object_cycle"))
    alike = rows.groupBy("relation", "subject", "object", F.coalesce("start", F.lit("")).alias("since")).agg(F.min(F.when(F.col("early").isNull(), F.col("relation_id"))).alias("first"))
    rows = rows.withColumn("since", F.coalesce("start", F.lit(""))).join(alike, ["relation", "subject", "object", "since"], "left")
    again = F.col("early").isNull() & (F.col("relation_id") > F.col("first"))
    return rows.select("relation_id", F.coalesce("early", F.when(round_, "cycle"), F.when(again, "duplicate")).alias("problem"))


# ---------------------------------------------------------------- merges


def moved(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """`relations` (relation_id, relation, subject, object, start, …) after merges: ends become their roots; of those that become alike the smallest id
    stays, and a relation of a root with itself goes. `roots`: entity_id, root_id of the merged entities."""
    of = lambda name: roots.select(F.col("entity_id").alias(name), F.col("root_id").alias(f"{name}_root"))
    rows = relations.join(of("subject"), "subject", "left").join(of("object"), "object", "left")
    rows = rows.withColumns({"s": F.coalesce("subject_root", "subject"), "o": F.coalesce("object_root", "object")})
    flip = (F.col("relation") == "related") & (F.col("o") < F.col("s"))
    rows = rows.withColumns({"subject": F.when(flip, F.col("o")).otherwise(F.col("s")), "object": F.when(flip, F.col("s")).otherwise(F.col("o"))}).filter("s <> o").select(*relations.columns)
    same = rows.groupBy("relation", "subject", "object", F.coalesce("start", F.lit("")).alias("since")).agg(F.min("relation_id").alias("relation_id")).select("relation_id")
    return rows.join(same, "relation_id", "left_semi").select(*relations.columns)


def moved_keys(rows: DataFrame, roots: DataFrame, key: str, alike: list[str]) -> DataFrame:
    """External ids or name claims after merges: `key` becomes its root, and rows that become alike in `alike` are one (the root's own first)."""
    to = roots.select(F.col("entity_id").alias(key), "root_id")
    held = rows.join(to, key, "left").withColumn("came", F.col("root_id").isNotNull()).withColumn(key, F.coalesce("root_id", key)).drop("root_id")
    rest = [c for c in rows.columns if c not in {key, *alike}]
    first = held.groupBy(key, *alike).agg(F.min(F.struct("came", *rest)).alias("r"))
    return first.select(*[F.col(c) if c in {key, *alike} else F.col(f"r.{c}") for c in rows.columns])
