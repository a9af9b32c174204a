"""Operators on small inputs against plain Python."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import model_output, text
from weftgraph.operators import components, graph, resolution
from weftgraph.plans import planner


def components_by_search(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        todo = [] if x in out else [x]
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo.extend(near[y])
    return out


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, (7, 7), (900, 900)], "src long, dst long")
    assert {r.id: r.component for r in components.connected_components(df).collect()} == components_by_search(edges)


def test_leader_clusters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    names = [f"n{i}" if i % 3 == 0 else "word" for i in range(40)]
    reps, want = [], {}
    for i in range(40):
        best = max(((float(x[i] @ x[r]), -r) for r in reps), default=(-1, 0))
        if best[0] < 0.65:
            reps.append(i)
            want[i] = (i, "rep")
        else:
            digit = i % 3 == 0 or -best[1] % 3 == 0
            want[i] = (-best[1], "alias" if best[0] >= (0.999 if digit else 0.95) else "uncertain")
    df = spark.createDataFrame([(i, names[i], x[i].tolist()) for i in range(40)], "id long, name string, vec array<double>")
    assert {r.id: (r.leader, r.status) for r in resolution.leader_clusters(df).collect()} == want


def test_uuid_and_tokens(spark):
    words = ["hello", "ชุมชน", "Zürich", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.uuid5_zero(F.col("w"))).collect()] == [str(uuid.uuid5(uuid.UUID(int=0), w)) for w in words]
    row = spark.range(1).select(text.token_id(F.lit("hello")), text.sparse_tokens(F.lit("Héllo, ชุมชน a_b!")), text.names_community(F.lit("บ้าน หมู่ 2"))).first()
    assert row[0] == 754077114 and row[1] == ["héllo", "ชุมชน", "a_b"] and row[2]


def test_model_output(spark):
    out = spark.range(1).select(
        model_output.parsed(F.lit("Sure: {'k': 5,} done"), "k bigint")["k"].alias("k"),
        model_output.merged_small(F.from_json(F.lit('[{"start":1,"end":2},{"start":3,"end":5},{"start":6,"end":9}]'), "array<struct<start: bigint, end: bigint>>")).alias("m"),
        model_output.split_ranges(F.array(F.lit(5).cast("long"), F.lit(3).cast("long")), F.lit(9).cast("long")).alias("s"),
        model_output.resolution(F.lit(True), F.lit("b")).alias("r"),
    ).first()
    assert out.k == 5 and [tuple(x) for x in out.m] == [(1, 5), (6, 9)] and [tuple(x) for x in out.s] == [(1, 1, 2), (2, 3, 4), (3, 5, 9)] and out.r == "replace"


def test_planner():
    assert planner.pages("1,3-5, 4") == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        planner.pages("5-3")
    assert planner.branches(0, 0) == ["community_explore"] and planner.branches(2, 0) == ["graph_hop", "find_paths"]
    assert [s["tool"] for s in planner.completed([{"community": "a", "tool": "graph_hop", "depth": 9}, {"tool": "x"}], [("a", "graph_hop"), ("b", "find_paths")])] == ["graph_hop", "find_paths"]


def test_relationship_line(spark):
    line = graph.relationship_line(F.lit("a"), F.lit("p"), F.lit("b"), F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1")))
    assert spark.range(1).select(line).first()[0] == "a -> (p) -> b | x: 1 | y: 2"
