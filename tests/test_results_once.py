"""Results whose shuffles carry what is needed: best edges before their ends are known, relevance without texts, quotes beside their text."""

from pyspark.sql import functions as F

from weftgraph.operators import context, ranking, results
from weftgraph.plans import views


def _relevance(spark):
    rows = spark.createDataFrame([("triple", "t1", ["7"], "Ann Bob LIKES big MOO 7", "Ann Bob LIKES"), ("triple", "t2", [], "xann bob", "ann"), ("path", "p1", ["7", "8", "9"], "bob", "Ann"), ("chunk", "c1", ["7"], "ann Kate ann", "ann Kate"), ("triple", "t3", ["9"], None, None)], "kind string, result_id string, chunk_ids array<string>, text string, names string")
    scores = spark.createDataFrame([(7, 0.5), (7, 0.25), (8, 0.75)], "chunk_id long, score double")
    return results.relevance(rows, scores, F.lit("Ann and kate moo"))


def test_relevance_of_each_kind(spark):
    out = _relevance(spark)
    assert {r["result_id"]: round(r["score"], 6) for r in out.collect()} == {"t1": round(0.5 + 1 / 3, 6), "t2": round(1 / 3, 6), "p1": round(0.75 + 1 / 3, 6), "c1": round(2 / 3, 6), "t3": 0.0}
    # triples meet the score of their chunk and are not joined back by their own id
    plan = out.select("result_id", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in "".join(line for line in plan.splitlines() if "Join" in line) and "LeftOuter, (_c#" in plan


def test_best_known_edges_equal_known_ones_ranked(spark):
    rows = [(f"g{i % 3}", f"a{i}" if i % 7 else "gone", "T", f"b{i}", float(i % 5), f"k{i:03}") for i in range(90)] + [("h", "gone", "T", "b1", 9.0, f"z{i:02}") for i in range(30)] + [("h", "a1", "T", "b1", 0.0, "z99")]
    edges = spark.createDataFrame(rows, "community_id string, src string, edge_type string, dst string, score double, pos string")
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "ab" for i in range(90)], "canonical_id string")
    want = ranking.best_of(results.known_ends(edges, nodes), "community_id", cap=4)
    got = results.best_known(edges, nodes, "community_id", "pos", 4)
    key = ["community_id", "rank", "pos"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert ("h", 1, "z99") in {tuple(r) for r in got.select(*key).collect()}


def test_ends_of_the_graph_equal_joined_nodes(spark):
    d = "/root/testdata/sf0.001"
    flat = lambda s, p, o, rest: [F.col(f"{s}.canonical_id"), F.col(f"{s}.name"), F.col(f"{s}.type"), p, F.col(f"{o}.canonical_id"), F.col(f"{o}.name"), F.col(f"{o}.type"), *rest]
    edges = views.kg_edges(spark, d).withColumn("properties", F.create_map(F.lit("line"), F.col("line").cast("string")))
    want = results.slim_triples(edges, views.kg_nodes(spark, d)).select(*flat("subject", "predicate", "object", ["community_id", "chunk_id", F.col("properties.line").cast("int")]))
    got = views.kg_ends(spark, d).select(*flat("src_node", "edge_type", "dst_node", ["community_id", "chunk_id", "line"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quotes_beside_their_text(spark):
    long = "one two three " + "x" * 587  # 601 characters
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three\nfour five six"), (3, long), (4, long + "\nb"), (5, "a b c" + " z" * 400 + "\nd e f"), (6, "same id here"), (6, "same id here\nand more lines"), (None, "no id here"), (8, None)], "doc_id long, text string")
    sentence = lambda q: q.select("doc_id", "triple_no", context.evidence_sentence(F.col("evidence_quote"), F.lit(None).cast("string"), F.col("text"), F.array("subject", "object"), F.array("predicate"), F.lit(None).cast("string"), F.col("chunk_id")).alias("s"))
    want = sorted(map(tuple, sentence(views.triples_of(docs).join(docs, "doc_id")).collect()))
    assert sorted(map(tuple, sentence(context.quotes_in_texts(docs, views.triples_of)).collect())) == want
    plan = context.quotes_in_texts(docs.where("doc_id < 6"), views.triples_of)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
