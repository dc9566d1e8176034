"""Queries of stated relations and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import authority, relations
from ..sources import archive as A
from .registry import query

_LABELS = ["later_name", "earlier_name", "part_of", "has_part", "member_of", "has_member", "leader_of", "led_by", "related", "knows"]

#: Orders as statements about customers: the label and the dates go by the order's number, every 50th customer is a variant of the one before.
_ASKED = f""", en AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END AS root, CASE c_custkey % 11 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PLACE' ELSE 'ORG' END AS kind FROM customer),
    ak AS (SELECT o_orderkey AS relation_id, [{', '.join(f"'{x}'" for x in _LABELS)}][o_orderkey % 10 + 1] AS label, o_custkey AS asking, (o_custkey * 3) % 200 AS target, CASE WHEN o_orderkey % 3 = 0 THEN ' ' WHEN o_orderkey % 3 = 1 THEN 'n' END AS note,
        CASE WHEN o_orderkey % 50 = 3 THEN '2010-13' WHEN o_orderkey % 4 = 1 THEN '2010' END AS start, CASE WHEN o_orderkey % 70 = 1 THEN '2009-05' ELSE '2011' END AS stop FROM orders),
    st0 AS (SELECT ak.*, CASE label WHEN 'later_name' THEN 'succeeded_by' WHEN 'earlier_name' THEN 'succeeded_by' WHEN 'has_part' THEN 'part_of' WHEN 'has_member' THEN 'member_of' WHEN 'led_by' THEN 'leader_of' WHEN 'knows' THEN NULL ELSE label END AS relation,
        label IN ('earlier_name', 'has_part', 'has_member', 'led_by') OR (label = 'related' AND t.root < a.root) AS back, a.root AS one, t.root AS two FROM ak LEFT JOIN en a ON a.id = asking LEFT JOIN en t ON t.id = target),
    st AS (SELECT *, CASE WHEN back THEN two ELSE one END AS subject, CASE WHEN back THEN one ELSE two END AS object FROM st0),
    ea AS (SELECT st.*, CASE WHEN relation IS NULL THEN 'unknown label' WHEN one IS NULL OR two IS NULL THEN 'unknown entity' WHEN one = two THEN 'self'
        WHEN (relation IN ('succeeded_by', 'part_of') AND (s.kind NOT IN ('ORG', 'PLACE') OR s.kind <> o.kind)) OR (relation = 'member_of' AND o.kind <> 'ORG') OR (relation = 'leader_of' AND (s.kind <> 'PERSON' OR o.kind NOT IN ('ORG', 'PLACE'))) THEN 'wrong kinds'
        WHEN relation = 'related' AND trim(coalesce(note, '')) = '' THEN 'missing note' WHEN start = '2010-13' THEN 'bad date' WHEN start IS NOT NULL AND left(stop, 4) < left(start, 4) THEN 'out of order' END AS early FROM st LEFT JOIN en s ON s.id = subject LEFT JOIN en o ON o.id = object),
    lk AS (SELECT DISTINCT relation AS g, subject AS a, object AS b FROM ea WHERE early IS NULL AND relation IN ('succeeded_by', 'part_of')),
    rc(g, a, b) AS (SELECT g, a, b FROM lk UNION SELECT rc.g, rc.a, lk.b FROM rc JOIN lk ON lk.g = rc.g AND lk.a = rc.b),
    cy AS (SELECT x.g, x.a AS node, min(y.b) AS cycle FROM rc x JOIN rc y ON y.g = x.g AND y.a = x.a JOIN rc z ON z.g = x.g AND z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY 1, 2)"""


def _asked(spark, d):
    o = A.table(spark, d, "orders")
    key = F.col("o_orderkey")
    c = F.col("c_custkey")
    entities = A.table(spark, d, "customer").select(c.alias("entity_id"), F.when(c % 50 == 49, c - 1).alias("authority_id"), F.when(c % 11 == 0, "PERSON").when(c % 11 == 1, "GPE").otherwise("ORG").alias("kind"))
    asked = o.select(
        key.alias("relation_id"), F.element_at(F.array(*map(F.lit, _LABELS)), (key % 10 + 1).cast("int")).alias("label"), F.col("o_custkey").alias("asking"), (F.col("o_custkey") * 3 % 200).alias("target"),
        F.when(key % 3 == 0, " ").when(key % 3 == 1, "n").alias("note"), F.when(key % 50 == 3, "2010-13").when(key % 4 == 1, "2010").alias("start"), F.when(key % 70 == 1, "2009-05").otherwise("2011").alias("stop"),
    )
    return asked, entities


@query("relation_checks", _ASKED + """ SELECT relation_id, CASE WHEN early IS NOT NULL THEN early WHEN p.cycle = q.cycle THEN 'cycle' WHEN relation_id > min(CASE WHEN early IS NULL THEN relation_id END) OVER (PARTITION BY relation, subject, object, coalesce(start, '')) THEN 'duplicate' END AS problem
    FROM ea LEFT JOIN cy p ON p.g = relation AND p.node = subject LEFT JOIN cy q ON q.g = relation AND q.node = object""")
def _(spark, d):
    return relations.problems(*_asked(spark, d))


@query("relation_cycles", _ASKED + " SELECT g AS relation, node AS entity_id, cycle FROM cy")
def _(spark, d):
    asked, entities = _asked(spark, d)
    good = relations.problems(asked, entities).filter("problem IS NULL OR problem IN ('cycle', 'duplicate')")
    rows = relations.stored(asked, authority.roots(entities)).join(good, "relation_id").filter(F.col("relation").isin(*relations.ACYCLIC))
    return relations.cycle_members(rows.select(F.col("relation").alias("g"), F.col("subject").alias("a"), F.col("object").alias("b"))).withColumnsRenamed({"g": "relation", "node": "entity_id"})


@query("moved_relations", _ASKED + """, mv AS (SELECT relation_id, relation, start, CASE WHEN relation = 'related' THEN least(s, o) ELSE s END AS subject, CASE WHEN relation = 'related' THEN greatest(s, o) ELSE o END AS object
        FROM (SELECT *, CASE WHEN subject % 6 = 5 THEN subject - 5 ELSE subject END AS s, CASE WHEN object % 6 = 5 THEN object - 5 ELSE object END AS o FROM ea WHERE early IS NULL) WHERE s <> o)
    SELECT relation_id, relation, subject, object FROM mv QUALIFY relation_id = min(relation_id) OVER (PARTITION BY relation, subject, object, coalesce(start, ''))""")
def _(spark, d):
    asked, entities = _asked(spark, d)
    good = relations.problems(asked, entities).filter("problem IS NULL OR problem IN ('cycle', 'duplicate')").select("relation_id")
    rows = relations.stored(asked, authority.roots(entities)).join(good, "relation_id").select("relation_id", "relation", "subject", "object", "start")
    merged = entities.filter("entity_id % 6 = 5").select("entity_id", (F.col("entity_id") - 5).alias("root_id"))
    return relations.moved(rows, merged).drop("start")


_MERGES = """, q AS (SELECT p_partkey AS source, (p_partkey * 7) % 200 AS target FROM part), it AS (SELECT p_partkey AS id, p_size AS item FROM part WHERE p_partkey % 2 = 0),
    e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 END AS root, p_type AS kind, CASE WHEN p_size % 3 = 0 THEN 'ORG' END AS preferred, p_size % 4 = 0 AS hidden FROM part),
    sa AS (SELECT DISTINCT least(l_partkey, (l_suppkey * 7) % 200) AS lo, greatest(l_partkey, (l_suppkey * 7) % 200) AS hi FROM lineitem),
    mp AS (SELECT source, target, CASE WHEN source = target THEN 'self' WHEN s.root IS NOT NULL THEN 'already_variant' WHEN t.root IS NOT NULL THEN 'target_is_variant' WHEN least(source, target) % 10 = 0 AND greatest(source, target) = least(source, target) + 30 THEN 'distinct'
        WHEN sa.lo IS NOT NULL THEN 'linked' WHEN x.item <> y.item THEN 'different items' END AS problem FROM q LEFT JOIN e s ON s.id = source LEFT JOIN e t ON t.id = target LEFT JOIN sa ON lo = least(source, target) AND hi = greatest(source, target) LEFT JOIN it x ON x.id = source LEFT JOIN it y ON y.id = target)"""


def _merges(spark, d):
    p = A.entities(spark, d)
    key = F.col("entity_id")
    e = p.select(key, F.when(key % 5 == 4, key - 4).alias("authority_id"), "kind", F.when(F.col("size") % 3 == 0, "ORG").alias("preferred_kind"), (F.col("size") % 4 == 0).alias("hidden"))
    items = p.filter("entity_id % 2 = 0").select("entity_id", F.col("size").alias("item"))
    linked = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), (F.col("l_suppkey") * 7 % 200).alias("object"))
    apart = e.filter("entity_id % 10 = 0").select(key.alias("a"), (key + 30).alias("b"))
    return e, items, authority.merge_problems(e.select(key.alias("source"), (key * 7 % 200).alias("target")), e, apart, linked, items)


@query("merge_refusals", _MERGES + " SELECT * FROM mp")
def _(spark, d):
    return _merges(spark, d)[2]


@query("merge_history", _MERGES + """, ok AS (SELECT source, target, e.*, item FROM mp JOIN e ON e.id = source LEFT JOIN it ON it.id = source WHERE problem IS NULL)
    SELECT target AS entity_id, source::VARCHAR AS other_id, 'item_linked' AS action, NULL::VARCHAR AS before, item::VARCHAR AS after FROM ok WHERE item IS NOT NULL UNION ALL SELECT source, NULL, 'kind_changed', preferred, kind FROM ok WHERE preferred IS NOT NULL
    UNION ALL SELECT source, NULL, 'hidden_changed', 'true', 'false' FROM ok WHERE hidden UNION ALL SELECT source, target::VARCHAR, 'merged', NULL, target::VARCHAR FROM ok""")
def _(spark, d):
    e, items, checked = _merges(spark, d)
    return authority.merge_changes(e, checked.filter("problem IS NULL"), items).withColumn("other_id", F.col("other_id").cast("string"))
