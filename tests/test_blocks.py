"""Searches by blocks against loops over all vectors, with groups of unlike size."""

import numpy as np

from weftgraph.operators import blocks
from weftgraph.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_groups_of_unlike_size(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(7)
    group = ["hot"] * 200 + ["small"] * 3 + ["alone"] + [None] * 5
    rows = [(k, g, rng.normal(size=4).tolist()) for k, g in enumerate(group)]
    rows += [(900, "hot", None), (901, "hot", []), (902, "hot", [0.0] * 4), (903, "hot", [1.0, 2.0]), (904, "hot", rows[0][2]), (905, "hot", rows[0][2])]
    points = spark.createDataFrame(rows, "id long, g string, vec array<double>")
    got = blocks.top_k(points.where("id % 10 = 0"), points, 4, 0.1, ["g"], digits=6).collect()
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    known = [(i, g, v) for i, g, v in rows if v and any(v)]
    want = set()
    for i, g, v in known:
        if i % 10 == 0 and g is not None:
            scored = sorted((-round(cosine(v, w), 6), j) for j, h, w in known if h == g and len(w) == len(v) and cosine(v, w) >= 0.1)
            want |= {(i, j, -s, n) for n, (s, j) in enumerate(scored[:4], 1)}
    assert {(r.query_id, r.id, round(r.score, 6), r.rank) for r in got} == want and len(got) == len(want) > 60
    hot = points.where("g = 'hot'").drop("g")
    pairs = {(r.i, r.j) for r in blocks.similar_pairs(hot, 0.9).collect()}
    assert pairs == {(i, j) for i, g, v in known for j, h, w in known if g == h == "hot" and j < i and len(v) == len(w) and cosine(v, w) >= 0.9}
    assert blocks.top_k(points.limit(0), points, 4, 0.1, ["g"]).count() == 0


def test_cosine_search_has_no_nested_loop(spark, capsys):
    QUERIES["v07_cosine_knn"](spark, SF).explain()
    assert "NestedLoop" not in capsys.readouterr().out
