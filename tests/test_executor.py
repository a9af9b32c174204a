"""Tables of specs against loops over single searches."""

import random
from itertools import pairwise

import pytest

from weftgraph.operators import paths
from weftgraph.plans import executor

SCHEMA = "spec_id string, tool string, entities array<string>, communities array<string>, types array<string>, depth int, limit int"


def graph(seed, n=14, m=30):
    rng = random.Random(seed)
    rows = {(f"v{rng.randrange(n)}", rng.choice("AB"), f"v{rng.randrange(n)}"): (rng.choice(["x", "y", None]), rng.randrange(9)) for _ in range(m)}
    rows |= {("v0", "A", f"v{k}"): ("x", 1) for k in range(n)}  # a hub, and a link with itself
    return [(*k, *v) for k, v in sorted(rows.items())]


def ends(edge, at):
    return [edge[2]] * (edge[0] == at) + [edge[0]] * (edge[2] == at and edge[0] != at)


def key(edge):
    return tuple((x is not None, x if x is not None else "") for x in edge)


def hops(edges, seeds, communities, types, depth):
    front, out = [(s, (s,), ()) for s in seeds], []
    for _ in range(depth):
        front = [(s, (*nodes, b), (*used, e)) for s, nodes, used in front for e in edges if e not in used and (not communities or e[3] in communities) and (not types or e[1] in types) for b in ends(e, nodes[-1])]
        out += front
    return sorted(out, key=lambda r: (len(r[2]), r[0], [key(e) for e in r[2]]))


def balls(edges, seed, communities):
    """Distance, and the least (parent, edge), of every node."""
    found, front, n = {seed: (0, None, None)}, {seed}, 0
    while front:
        n += 1
        new = {}
        for at in sorted(front):
            for e in edges:
                if not communities or e[3] in communities:
                    for b in ends(e, at):
                        if b not in found:
                            new[b] = min(new.get(b, (at, key(e), e)), (at, key(e), e), key=lambda x: x[:2])
        found |= {b: (n, at, e) for b, (at, _, e) in new.items()}
        front = set(new)
    return found


def shortest(edges, seeds, communities, depth):
    own = {s: balls(edges, s, communities) for s in seeds}
    out = []
    for a in seeds:
        for b in seeds:
            d = own[a].get(b, (99,))[0]
            if a == b or d > depth:
                continue
            middle = min(v for v in own[a] if own[a][v][0] == (d + 1) // 2 and own[b].get(v, (99,))[0] == d // 2)
            nodes, steps = [middle], []
            while nodes[0] != a:
                _, parent, e = own[a][nodes[0]]
                nodes, steps = [parent, *nodes], [e, *steps]
            while nodes[-1] != b:
                _, parent, e = own[b][nodes[-1]]
                nodes, steps = [*nodes, parent], [*steps, e]
            out.append((a, tuple(nodes), tuple(steps)))
    return sorted(out, key=lambda r: (len(r[2]), r[0], r[1][-1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_specs_against_loops(spark, monkeypatch, seed):
    monkeypatch.setattr(paths, "HUB", 4)
    edges = graph(seed)
    df = spark.createDataFrame(edges, "src string, edge_type string, dst string, community_id string, chunk_id long")
    specs, rng = [], random.Random(seed)
    for k in range(40):
        tool = rng.choice(["graph_hop", "find_paths", "community_explore", "expansion", "path", "community_exploration", "guess"])
        specs.append((f"s{k}", tool, [f"v{rng.randrange(16)}" for _ in range(rng.randrange(5))], rng.choice([[], None, ["x"], ["x", "y"], ["none"]]), rng.choice([[], None, ["A"], ["A", "B"]]), rng.choice([None, 1, 2, 3, 0]), rng.choice([None, 0, 1, 3, 7, 1000, -1])))
    rows, status = executor.execute(spark.createDataFrame(specs, SCHEMA), df)
    got = {}
    for r in rows.collect():
        got.setdefault(r.spec_id, []).append((r.rank, r.seed, tuple(r.nodes), tuple(tuple(s) for s in r.steps)))
    for spec_id, tool, entities, communities, types, depth, limit in specs:
        tool = executor.TOOLS.get(tool, "community_explore")
        own = executor.DEFAULTS[tool]
        depth, limit = depth if depth is not None else own.get("depth", 1), limit if limit is not None else own["limit"]
        seeds, communities = sorted(set(entities)), communities or []
        if depth < 1 or limit < 0:
            want = []
        elif tool == "graph_hop":
            want = hops(edges, seeds, communities, types, depth)
        elif tool == "find_paths":
            want = shortest(edges, seeds, communities, depth)
        else:
            want = [(None, (e[0], e[2]), (e,)) for e in sorted((e for e in edges if e[3] in communities), key=key)]
        want = [(k, s, n, tuple((e[0], e[1], e[2], e[3], e[4]) for e in u)) for k, (s, n, u) in enumerate(want[: max(limit, 0)], 1)]
        assert sorted(got.get(spec_id, [])) == want, (spec_id, tool, entities, communities, types, depth, limit)
    told = {r.spec_id: r for r in status.collect()}
    assert len(told) == 40
    for s in specs:
        bad = s[5] == 0 or (s[6] or 0) < 0
        assert (told[s[0]].status == "error") == bad == (told[s[0]].error is not None) and told[s[0]].results == len(got.get(s[0], []))


def test_older_specs_saved(spark, tmp_path):
    df = spark.createDataFrame(graph(3), "src string, edge_type string, dst string, community_id string, chunk_id long")
    old = spark.createDataFrame([("a", "expansion", ["v0"]), ("b", None, ["v0"]), ("a", "expansion", ["v0"])], "spec_id string, approach string, entities array<string>")
    rows, status = executor.execute(old, df)
    saved = executor.save(rows, status, f"{tmp_path}/out")
    assert {(r.spec_id, r.tool, r.status, r.results > 0) for r in saved.collect()} == {("a", "graph_hop", "success", True), ("b", "community_explore", "success", False)}
    again = spark.read.parquet(f"{tmp_path}/out/results")
    assert again.count() == rows.count() == saved.where("spec_id = 'a'").first().results
    none, state = executor.execute(old.limit(0), df)
    assert none.count() == state.count() == 0
    assert executor.execute(old, df.limit(0))[0].count() == 0


def test_validated_specs(spark):
    required = spark.createDataFrame([(1, 0, "x", "graph_hop"), (1, 1, "x", "find_paths"), (2, 0, None, "community_explore")], "question long, pos int, community string, tool string")
    proposed = spark.createDataFrame([(1, 2, "x", "graph_hop", 9, 9), (1, 1, "x", "graph_hop", 2, None), (1, 0, "x", "guess", 5, 5), (1, 3, "y", "graph_hop", 5, 5)], "question long, at int, community string, tool string, depth int, limit int")
    got = [tuple(r) for r in executor.validated(proposed, required).orderBy("question", "pos").collect()]
    assert got == [(1, 0, "x", "graph_hop", 2, 50, False), (1, 1, "x", "find_paths", 3, 20, True), (2, 0, None, "community_explore", None, 100, True)]


def test_paths_join_neighbours(spark):
    df = spark.createDataFrame(graph(4), "src string, edge_type string, dst string, community_id string, chunk_id long")
    seeds = spark.createDataFrame([(f"v{k}",) for k in range(14)] + [(None,)], "id string")
    found = paths.shortest_paths(df, seeds, 4).collect()
    near = {(a, b) for e in graph(4) for a, b in ((e[0], e[2]), (e[2], e[0]))}
    assert found and all(set(pairwise(r.nodes)) <= near and len(r.nodes) == r.length + 1 and r.nodes[0] == r.start and r.nodes[-1] == r.end for r in found)
