"""Blocked search, linking, translation and chunking against brute force, with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import model_output
from weftgraph.operators import blocks, chunking, communities, linking, ranking, registry, results, triples
from weftgraph.plans import planner


def test_numbered(spark):
    df = spark.range(5000).select(F.expr("struct(-(id * 7919 % 5000) AS s, id % 3 AS t)").alias("first"), "id")
    got = ranking.numbered(df.repartition(7), "first", "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 5001))
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == sorted(range(5000), key=lambda i: (-(i * 7919 % 5000), i % 3))
    assert not ranking.numbered(df.where("false"), "first", "n").collect()


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[10] = x[3]
    x[20] = 0
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(90, None, "a"), (91, [], "a"), (92, [1.0, 2.0], "a"), (93, [1.0] * 4 + [float("nan")], "b")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, community_id string")
    u = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), np.nan)[:, None]
    s = u @ u.T
    for by in (None, ["community_id"]):
        got = {}
        for r in blocks.top_k(df.where("id % 10 = 3 OR id > 89"), df, 3, 0.2, by).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 9)))
        for q in range(3, 60, 10):
            own = [(-round(s[q, j], 12), j) for j in range(60) if s[q, j] >= 0.2 and (by is None or q % 2 == j % 2)]
            assert sorted(got.get(q, [])) == [(k + 1, j, round(-v, 9)) for k, (v, j) in enumerate(sorted(own)[:3])], (q, by)
        assert 90 not in got and 91 not in got and 93 not in got and got[92][0][1] == 92
    got = {}
    for r in blocks.top_k(df.where("id % 10 = 3"), df, 4, -1.5, digits=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    for q in range(3, 60, 10):
        own = sorted((-round(s[q, j], 1), j) for j in range(60) if j != 20)[:4]
        assert sorted(got[q]) == [(k + 1, j, -v) for k, (v, j) in enumerate(own)], q
    pairs = {(r.i, r.j) for r in blocks.similar_pairs(df, 0.6).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i) if s[i, j] >= 0.6}
    empty = df.where("false")
    assert not blocks.top_k(empty, df, 3, 0.2).collect() and not blocks.top_k(df, empty, 3, 0.2).collect() and not blocks.similar_pairs(empty, 0.5).collect()


def test_insert_new_communities(spark):
    one = spark.createDataFrame([(1, "a", [1.0, 0.0])], "id long, name string, vec array<double>")
    new = spark.createDataFrame([(2, "b", [1.0, 0.01]), (3, "c", [0.0, 1.0]), (4, "d", [0.01, 1.0])], one.schema)
    assert {r.id for r in communities.insert_new(one, new).collect()} == {1, 3}


def test_linking_of_nothing(spark):
    items = spark.createDataFrame([(1, "i1", "x", None, None, None, "new")], "pos long, id string, name string, name_en string, match_id string, score double, status string")
    told = spark.createDataFrame([], "name string, same boolean, new_is_canonical boolean, canonical_form string")
    reg = spark.createDataFrame([], "id string, name string, name_en string, is_canonical boolean, canonical_id string")
    (r,) = linking.resolved(items, told, reg).collect()
    assert (r.outcome, r.canonical, r.canonical_id) == ("new", "x", "i1")
    assert not linking.resolved(items.where("false"), told, reg).collect()
    assert [x.id for x in linking.applied(reg, linking.resolved(items, told, reg)).collect()] == ["i1"]


def test_decisions_belong_to_a_community(spark):
    items = [(1, "a", "uses", None, "x", "m", 0.9, "candidate"), (2, "b", "uses", None, "y", "m", 0.9, "candidate"), (3, "c", "uses", None, None, "m", 0.9, "candidate"), (4, "d", "owns", None, "x", "m", 0.9, "candidate")]
    classes = spark.createDataFrame(items, "pos long, id string, name string, name_en string, community_id string, match_id string, score double, status string")
    told = spark.createDataFrame([("uses", "x", True, False, ""), ("uses", "x", True, False, ""), ("uses", "y", False, False, ""), ("uses", None, True, True, "use")], "name string, community_id string, same boolean, new_is_canonical boolean, canonical_form string")
    reg = spark.createDataFrame([("m", "employs", None, True, "m")], "id string, name string, name_en string, is_canonical boolean, canonical_id string")
    found = linking.resolved(classes, told, reg)
    assert {(r.id, r.outcome, r.canonical, r.canonical_id) for r in found.collect()} == {("a", "alias", "employs", "m"), ("b", "new", "uses", "b"), ("c", "replace", "use", "c"), ("d", "new", "owns", "d")} and found.count() == 4
    aliases = spark.createDataFrame([(f"{c}{k}", n, None, "uses", c) for k, n in enumerate(("use of", "used")) for c in ("x", "y", "z")], "id string, name string, name_en string, rep_name string, community_id string")
    assert {(r.id, r.canonical_id) for r in linking.follow(aliases, found).collect()} == {("x0", "m"), ("x1", "m"), ("y0", "b"), ("y1", "b"), ("z0", "z0"), ("z1", "z1")}
    same = spark.createDataFrame([("used", "x", True), ("used", "y", False), ("use of", "y", True)], "name string, community_id string, same boolean")
    assert {(r.id, r.canonical_id) for r in linking.follow_decided(aliases, same, found).collect()} == {("x0", "x0"), ("x1", "m"), ("y0", "b"), ("y1", "y1"), ("z0", "z0"), ("z1", "z1")}


def test_evidence_around_an_anchor_without_place(spark):
    e = spark.createDataFrame([("a", None, None, None), ("b", 1, 1, "c"), ("c", 1, 9, "c")], "id string, doc_id long, chunk_index int, community_id string")
    got = {(r.anchor, r.id, r.ordering) for r in registry.surrounding_evidence(e, e).collect()}
    assert got == {("a", "a", "anchor"), ("b", "b", "chunk_index"), ("c", "c", "chunk_index")}


def test_translation_rounds(spark):
    words = spark.createDataFrame([("subject", f"w{k}") for k in range(20)] + [("object", "bad")], "role string, value string")

    def translate(values):
        if "bad" in values:
            raise RuntimeError
        return [f"EN {v}" for v in values]

    got = {r.value: r.value_en for r in triples.translated(words.repartition(1), translate).collect()}
    assert set(got) == {f"w{k}" for k in range(20)} | {"bad"} and got["bad"] is None
    good = triples.translated(words.where("value <> 'bad'"), translate).collect()
    assert all(r.value_en == f"EN {r.value}" for r in good) and len(good) == 20


def test_chunked_asks_and_falls_back(spark):
    docs = spark.createDataFrame([(1, "a\nb\n# c\nd"), (2, "# x\ny\n# z")], "doc_id long, text string")
    got = [tuple(r)[:3] for r in chunking.chunked(docs, lambda t: [(1, 2)] if "[0004]" in t else 1 / 0).orderBy("doc_id", "chunk_id").collect()]
    assert got == [(1, 1, "a\nb"), (2, 1, "# x\ny"), (2, 2, "# z")]
    with pytest.raises(Exception, match="without text"):
        chunking.chunked(docs.withColumn("text", F.lit(" ")), lambda t: []).collect()


def test_repair_keeps_apostrophes(spark):
    texts = ['{"a": "it\'s",}', "{'a': 'x'}", "{a: 1,}", '{{"a": "b"}}', None, "", "none"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.a for r in df.select("id", model_output.parsed(F.col("t"), "a string")["a"].alias("a")).collect()}
    assert got == {0: "it's", 1: "x", 2: "1", 3: "b", 4: None, 5: None, 6: None}


def test_free_queries(spark):
    t = spark.range(500)
    assert planner.run_sql(spark, "SELECT id FROM some_rows WHERE id > :least", {"some_rows": t}, limit=7, least=3).count() == 7
    assert planner.run_sql(spark, "SELEC", {}).columns == ["error", "query"]


def test_path_line_of_one_node(spark):
    (r,) = spark.range(1).select(results.path_line(F.array(F.struct(F.lit("a").alias("name"))), F.array().cast("array<string>"), F.create_map().cast("map<string,string>")).alias("x")).collect()
    assert r.x == "a"
