"""Cycles, reasons against relations and merges against plain loops."""

import random

import pytest

from tidewire.operators import authority, relations

EDGE = "g string, a long, b long"


def parts(edges):
    """{(g, node): smallest node that leads to it and back} by reachability."""
    out = {}
    for g in {e[0] for e in edges}:
        to = {}
        for _, a, b in (e for e in edges if e[0] == g):
            to.setdefault(a, set()).add(b)
        reach = {}
        for s in to:
            seen, todo = set(), list(to[s])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += to.get(x, ())
            reach[s] = seen
        for s in to:
            if s in reach[s]:
                out[g, s] = min(x for x in reach[s] if s in reach.get(x, ()))
    return out


def found(spark, edges):
    return {(r["g"], r["node"]): r["cycle"] for r in relations.cycle_members(spark.createDataFrame(edges, EDGE)).collect()}


@pytest.mark.parametrize(("seed", "nodes", "n"), [(0, 14, 16), (1, 10, 25), (2, 30, 30)])
def test_cycles_of_random_links(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = [(rng.choice("xy"), rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
    assert found(spark, edges) == parts(edges)


def test_a_long_cycle_two_joined_by_a_thread_and_none(spark):
    ring = [("x", i, (i + 1) % 13) for i in range(13)]  # longer than ten steps
    both = [("x", 13, 20), ("x", 20, 21), ("x", 21, 22), ("x", 22, 20), ("x", 5, 20), ("x", 40, 3), ("y", 1, 2), ("y", 2, 3), ("y", 50, 50)]
    assert found(spark, [*ring, *both]) == {("x", i): 0 for i in range(13)} | {("x", i): 20 for i in (20, 21, 22)} | {("y", 50): 50}
    assert found(spark, [("y", 1, 2), ("y", 2, 3), ("y", 1, 3)]) == {} and found(spark, [("x", None, 1)]) == {}


def test_reasons_against_relations(spark):
    kinds = {1: "ORG", 2: "ORG", 3: "PERSON", 4: "GPE", 5: "LOCATION", 6: "ORG", 7: "ORG", 8: "TOPIC"}
    entities = spark.createDataFrame([(i, 2 if i == 7 else None, k) for i, k in kinds.items()], "entity_id long, authority_id long, kind string")
    asked = [
        ("later_name", 1, 2, None, None, None, None), ("earlier_name", 2, 6, None, None, None, None),  # 1 -> 2, 6 -> 2
        ("part_of", 1, 2, None, None, None, None), ("has_part", 1, 7, None, None, None, None),  # 1 -> 2, 7 (that is 2) -> 1
        ("part_of", 4, 5, None, None, None, None), ("part_of", 4, 1, None, None, None, None), ("part_of", 3, 1, None, None, None, None), ("member_of", 3, 1, None, None, None, None), ("member_of", 8, 1, None, None, None, None),
        ("leader_of", 3, 4, None, None, None, None), ("led_by", 1, 3, None, None, None, None), ("leader_of", 1, 3, None, None, None, None), ("related", 8, 3, None, None, "  ", None), ("related", 8, 3, None, None, "x", None), ("related", 3, 8, None, None, "y", None),
        ("related", 3, 8, "2001", None, "y", None), ("knows", 1, 2, None, None, None, None), ("part_of", 1, 99, None, None, None, None), ("part_of", 2, 7, None, None, None, None), ("member_of", 3, 2, "2021-10", "2021", None, 5), ("member_of", 3, 6, "2021-10", "2021-09", None, None),
        ("member_of", 3, 6, "2021-02-30", None, None, None), ("member_of", 3, 6, None, None, None, 6),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "relation_id long, label string, asking long, target long, start string, stop string, note string, source long")
    got = [r["problem"] for r in relations.problems(df, entities, spark.createDataFrame([(5,)], "article_id long")).orderBy("relation_id").collect()]
    assert got == [
        None, None, "cycle", "cycle", None, "wrong kinds", "wrong kinds", None, "wrong kinds", None, None, "wrong kinds", "missing note", None, "duplicate", None, "unknown label", "unknown entity", "self", None, "out of order", "bad date", "unknown source",
    ]


def test_merges_move_relations_ids_and_claims(spark):
    rel = spark.createDataFrame([(1, "part_of", 10, 2, None), (2, "part_of", 11, 2, None), (3, "related", 2, 11, None), (4, "related", 1, 10, None), (5, "part_of", 11, 2, "2001"), (6, "part_of", 11, 10, None)], "relation_id long, relation string, subject long, object long, start string")
    roots = spark.createDataFrame([(11, 10), (2, 1)], "entity_id long, root_id long")
    got = sorted(map(tuple, relations.moved(rel, roots).collect()), key=str)
    assert got == [(1, "part_of", 10, 1, None), (3, "related", 1, 10, None), (5, "part_of", 10, 1, "2001")]
    ids = spark.createDataFrame([(11, "wikidata", "Q1"), (11, "isni", "7"), (10, "isni", "7"), (3, "wikidata", "Q3")], "entity_id long, scheme string, value string")
    assert sorted(map(tuple, relations.moved_keys(ids, roots, "entity_id", ["scheme", "value"]).collect())) == [(3, "wikidata", "Q3"), (10, "isni", "7"), (10, "wikidata", "Q1")]
    claims = spark.createDataFrame([("en", "Name", 11, "a"), ("en", "Name", 10, "b"), ("el", "Name", 2, "c")], "language string, name string, root_id long, source string")
    to = roots.withColumnRenamed("root_id", "root")
    out = relations.moved_keys(claims.withColumnRenamed("root_id", "entity_id"), to.withColumnRenamed("root", "root_id"), "entity_id", ["language", "name"])
    assert sorted(map(tuple, out.collect())) == [("el", "Name", 1, "c"), ("en", "Name", 10, "b")]


def test_history_of_a_merge(spark):
    e = spark.createDataFrame([(1, "ORG", "PERSON", True), (2, "ORG", None, False)], "entity_id long, kind string, preferred_kind string, hidden boolean")
    merges = spark.createDataFrame([(1, 9), (2, 9)], "source long, target long")
    got = authority.merge_changes(e, merges, spark.createDataFrame([(1, "Q1")], "entity_id long, item string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(9, 1, "item_linked", None, "Q1"), (1, None, "kind_changed", "PERSON", "ORG"), (1, None, "hidden_changed", "true", "false"), (1, 9, "merged", None, "9"), (2, 9, "merged", None, "9")], key=str)
