"""Searches through hubs, and merges of edges: no source walks out of a hub on its own, no rows are sorted that need not be."""

import os
from collections import defaultdict

from pyspark.sql import functions as F

from weftgraph.operators import graph, paths, results
from weftgraph.plans.materialize import shared_dir


def _edges(spark, pairs):
    return spark.createDataFrame([(a, "T", b, "c", 0) for a, b in pairs], "src string, edge_type string, dst string, community_id string, chunk_id long")


def _distances(pairs, seeds, depth):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for s in seeds:
        ball, front = {s: 0}, {s}
        for length in range(1, depth + 1):
            front = {y for x in front for y in near[x]} - ball.keys()
            ball |= dict.fromkeys(front, length)
        found |= {(s, t): n for t, n in ball.items() if t in seeds and t != s}
    return found


#: Two hubs that are linked, their leaves, some of which are linked further.
PAIRS = [("h", f"x{i}") for i in range(40)] + [(f"y{i}", "k") for i in range(40)] + [("h", "k"), ("x1", "z1"), ("z1", "y2"), ("z1", "z2"), ("z3", "x3"), ("z4", "z3"), ("z4", "y9"), ("z2", "z2")]
SEEDS = ["x1", "x2", "y2", "y3", "z2", "z4", "h", "x30"]


def test_shortest_lengths_and_paths_through_hubs(spark, monkeypatch):
    monkeypatch.setattr(paths, "HUB", 7)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "id string")
    for depth in (2, 3, 5):
        want = _distances(PAIRS, SEEDS, depth)
        lengths = paths.shortest_lengths(_edges(spark, PAIRS), seeds, depth).collect()
        assert {(r["start"], r["end"]): r["length"] for r in lengths} == want and len(lengths) == len(want)
        whole = paths.shortest_paths(_edges(spark, PAIRS), seeds, depth).collect()
        assert {(r["start"], r["end"]): r["length"] for r in whole} == want and len(whole) == len(want)
        steps = {frozenset(p) for p in PAIRS}
        for r in whole:
            assert r["nodes"][0] == r["start"] and len(r["nodes"]) == r["length"] + 1
            assert all(frozenset(p) in steps for p in zip(r["nodes"], r["nodes"][1:]))


def test_three_edges_need_no_ball_of_two_levels(spark):
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "id string")
    balls = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("ball-")}
    shared_dir(spark)
    before = balls()
    paths.shortest_paths(_edges(spark, PAIRS), seeds, 3).count()
    assert len(balls() - before) == 1


def test_an_edge_is_crossed_from_its_light_end(spark, monkeypatch):
    monkeypatch.setattr(paths, "HUB", 7)
    steps = paths.Steps(_edges(spark, PAIRS))
    light = [(r["a"], r["b"]) for r in steps.rows.where("light").select("a", "b").collect()]
    assert sorted(map(sorted, light)) == sorted(map(sorted, PAIRS))
    assert not [p for p in light if p[0] in "hk" and p[1] not in "hk"]


def test_trails_take_the_first_steps_of_a_hub_once(spark, monkeypatch):
    monkeypatch.setattr(paths, "HUB", 7)
    steps = paths.Steps(_edges(spark, PAIRS))
    none = F.array().cast("array<string>")
    for limit in (3, 1000):
        rows = spark.createDataFrame([(s, limit) for s in SEEDS], "seed string, limit int")
        got = paths.trails(steps, rows.select(F.col("seed").alias("spec_id"), "seed", none.alias("communities"), none.alias("types"), F.lit(3).alias("depth"), "limit")).collect()
        for s in SEEDS:
            near = defaultdict(list)
            for a, b in PAIRS:
                near[a].append((b, (a, "T", b)))
                if a != b:
                    near[b].append((a, (a, "T", b)))
            want, front = [], [([s], [])]
            for _ in range(3):
                front = sorted(((n + [b], e + [x]) for n, e in front for b, x in near[n[-1]] if x not in e), key=lambda p: p[1])
                want += front
            mine = sorted((r for r in got if r["spec_id"] == s), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, min(limit, len(want)) + 1))
            assert [[(x["subject"], x["predicate"], x["object"]) for x in r["steps"]] for r in mine] == [e for _, e in want[:limit]]
    first = [f for f in os.listdir(shared_dir(spark)) if f.startswith("first-steps-")]
    assert first  # the steps of a node stand once for all specs


def test_merged_edges_hold_no_aggregate_that_sorts(spark):
    rows = spark.createDataFrame([("a", "T", "b", 2, "x"), ("a", "T", "b", 1, "y"), ("a", "T", "b", 1, "w"), (None, "T", "b", 3, None), (None, "T", "b", 4, "q"), ("a", "U", "b", 9, "v")], "src string, edge_type string, dst string, pos long, c string")
    out = graph.merge_edges(rows, ["pos"])
    assert {tuple(r) for r in out.collect()} == {("a", "T", "b", 1, "w"), (None, "T", "b", 3, None), ("a", "U", "b", 9, "v")}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_hidden_properties_are_not_shuffled(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c"), ("b", "gone")]).withColumn("properties", F.create_map(F.lit("weight"), F.lit("w"), F.lit("status"), F.lit("Current"), F.lit("label"), F.lit(None).cast("string")))
    nodes = spark.createDataFrame([(x, x.upper(), "t") for x in "abc"], "canonical_id string, name string, type string")
    out = results.slim_triples(edges, nodes)
    assert {(r["subject"]["name"], r["object"]["name"], tuple(r["properties"].items())) for r in out.collect()} == {("A", "B", (("weight", "w"),)), ("B", "C", (("weight", "w"),))}
    plan = out._jdf.queryExecution().optimizedPlan().toString().replace("_", "").lower()
    assert plan.index("join") < plan.rindex("mapfilter")  # below the joins, not above
    assert {(r["src"], r["dst"]) for r in results.known_ends(edges, nodes).collect()} == {("a", "b"), ("b", "c")}
