"""Trails whose levels are sent to the steps, shuffled, or sliced at their ends, against loops."""

import pytest

from weftgraph.operators import graph

EDGES = [("n:1", "IN", "r:1"), ("r:1", "IN", "n:1"), ("n:1", "AT", "r:1"), ("x", "OWN", "x")] + [(f"c:{i}", "IN", "n:1") for i in range(7)] + [(f"c:{i}", "BUYS", f"p:{i % 3}") for i in range(7)]


@pytest.mark.parametrize("few, busy", [(200_000, 1_000), (0, 1_000), (0, 2)])
def test_trails_are_those_of_loops(spark, monkeypatch, few, busy):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "BUSY", busy)
    seeds = ["c:0", "c:1", "c:2", "n:1", "p:0", "x"]
    want, now = [], [((s,), ()) for s in seeds]
    for _ in range(3):
        now = [((*ns, b), (*es, e)) for ns, es in now for e in EDGES for a, b in dict.fromkeys(((e[0], e[2]), (e[2], e[0]))) if a == ns[-1] and e not in es]
        want += now
    found = graph.trails(spark.createDataFrame(EDGES, "src string, edge_type string, dst string"), spark.createDataFrame([(s,) for s in seeds], "id string"), 3)
    got = [(tuple(r.nodes), tuple(tuple(e.split("|")) for e in r.edges)) for r in found.collect()]
    assert sorted(got) == sorted(want)
