"""Steps that no path can take are not shuffled."""

from tests.test_crowds import _shuffled
from weftgraph.operators import graph


def test_steps_from_elsewhere_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = spark.createDataFrame([(f"x{i}", "T", f"y{i % 5000}") for i in range(10000)], "src string, edge_type string, dst string")
        seeds = spark.createDataFrame([("x1",), ("y7",)], "id string")
        begun = _shuffled(spark)[1]
        found = {r["nodes"][-1] + str(r["length"]) for r in graph.trails(edges, seeds, 2).collect()}
        assert found == {"y11", "x50012", "x71", "x50071"}
        assert _shuffled(spark, begun)[0] < 8000  # of 40000 steps of both levels
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
