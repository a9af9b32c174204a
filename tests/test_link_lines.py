"""Link lines of edges against those of their uses."""

from pyspark.sql import functions as F

from weftgraph.operators import results


def test_lines_of_edges_are_those_of_their_uses(spark):
    details = spark.createDataFrame(
        [("entity", "c:1", "Ann", "", ["ann", "Ann", "Customer"]), ("entity", "c:1", "Ann", "the ann", ["ann", ""]), ("entity", "c:2", "Ann", "an ann", ["ann", "Customer"]), ("entity", "n:1", "IN", "in", ["lies in"]), ("predicate", "x1", "IN", "inside", ["is in"]), ("predicate", "x0", "IN", "", ["lies in"])],
        "kind string, canonical_id string, name string, name_en string, raw_names array<string>",
    )
    edges = spark.createDataFrame([("c:1", "KNOWS", "c:2"), ("c:1", "KNOWS", "c:1"), ("c:2", "IN", "n:1"), ("c:9", "OWNS", "c:8")], "src string, edge_type string, dst string")
    uses = edges.select(F.concat("src", "edge_type", "dst").alias("result_id"), F.explode(F.array(*(F.struct(F.col(c).alias("canonical_id"), p.alias("predicate")) for c, p in (("src", F.lit(None).cast("string")), ("dst", F.lit(None).cast("string"))))).cast("array<struct<canonical_id:string,predicate:string>>")).alias("u")).select("result_id", "u.*")
    uses = uses.unionAll(edges.select(F.concat("src", "edge_type", "dst"), F.lit(None).cast("string"), "edge_type"))
    got = results.edge_link_lines(edges, details)
    rows = [(r.src + r.edge_type + r.dst, r.line) for r in got.collect()]
    assert sorted(rows) == sorted(map(tuple, results.link_lines(uses, details).collect())) and len(rows) > 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
