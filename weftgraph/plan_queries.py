"""Registered queries that run tables of specs, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import executor, views
from weftgraph.queries import HUNDREDS, hundreds, query
from weftgraph.plans.views import table


def specs(spark, d) -> DataFrame:
    """Hops from every node whose key is divisible by 100 (one level; two; two in two communities), shortest paths between such nodes of a
    thousand keys, every nation explored by an older name, and a spec that cannot run."""
    seeds = hundreds(views.kg_nodes(spark, d))
    none, text = F.array().cast("array<string>"), F.col("id")
    shape = lambda df, name, tool, entities, communities, depth, limit: df.select(name.alias("spec_id"), F.lit(tool).alias("tool"), entities.alias("entities"), communities.alias("communities"), F.lit(depth).cast("int").alias("depth"), F.lit(limit).cast("int").alias("limit"))
    two = F.array(F.lit("NATION_0"), F.lit("NATION_1"))
    groups = seeds.groupBy(F.floor(F.split("id", ":")[1].cast("long") / 1000).alias("g")).agg(F.collect_set("id").alias("ids"))  # ten keys of each kind at most
    nations = table(spark, d, "nation").select("n_name")
    return (
        shape(seeds, F.concat(F.lit("one "), text), "graph_hop", F.array("id"), none, None, None)
        .unionAll(shape(seeds, F.concat(F.lit("two "), text), "graph_hop", F.array("id"), none, 2, 70))
        .unionAll(shape(seeds, F.concat(F.lit("own "), text), "expansion", F.array("id"), two, 2, 90))
        .unionAll(shape(groups, F.concat(F.lit("paths "), F.col("g").cast("string")), "path", F.col("ids"), none, None, None))
        .unionAll(shape(nations, F.concat(F.lit("all "), "n_name"), "community_exploration", none, F.array("n_name"), None, None))
        .unionAll(shape(nations, F.concat(F.lit("bad "), "n_name"), "graph_hop", F.array("n_name"), none, 0, None))
    )


SPECS = HUNDREDS + """
, hop AS (SELECT 'one ' || id AS spec_id, id, 1 AS depth, 50 AS lim, false AS own FROM hundreds UNION ALL SELECT 'two ' || id, id, 2, 70, false FROM hundreds UNION ALL SELECT 'own ' || id, id, 2, 90, true FROM hundreds),
st AS (SELECT a, b, community_id, [src, edge_type, dst] AS e FROM kg2),
t1 AS (SELECT spec_id, depth, lim, own, id AS seed, b, [a, b] AS ns, [e] AS es FROM hop JOIN st ON a = id WHERE NOT own OR community_id IN ('NATION_0', 'NATION_1')),
t2 AS (SELECT spec_id, depth, lim, own, seed, st.b, list_append(ns, st.b) AS ns, list_append(es, e) AS es FROM t1 JOIN st ON st.a = t1.b WHERE depth = 2 AND e <> es[1] AND (NOT own OR community_id IN ('NATION_0', 'NATION_1'))),
hops AS (SELECT spec_id, 'graph_hop' AS tool, row_number() OVER (PARTITION BY spec_id ORDER BY len(es), seed, es) AS rank, lim, seed, len(es) AS length, b AS "end", array_to_string(ns, '>') AS path FROM (FROM t1 UNION ALL FROM t2)),
grp AS (SELECT 'paths ' || split_part(id, ':', 2)::BIGINT // 1000 AS spec_id, id FROM hundreds),
s0 AS (SELECT DISTINCT a, b FROM kg2),
w1 AS (SELECT id AS s, b FROM hundreds JOIN s0 ON a = id), w2 AS (SELECT DISTINCT s, s0.b FROM w1 JOIN s0 ON s0.a = w1.b), w3 AS (SELECT DISTINCT s, s0.b FROM w2 JOIN s0 ON s0.a = w2.b),
far AS (SELECT s, b, min(n) AS n FROM (SELECT *, 1 AS n FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3) GROUP BY ALL),
pairs AS (SELECT x.spec_id, 'find_paths' AS tool, row_number() OVER (PARTITION BY x.spec_id ORDER BY n, s, b) AS rank, 20 AS lim, s AS seed, n AS length, b AS "end", '' AS path FROM grp x JOIN far ON s = x.id JOIN grp y ON y.spec_id = x.spec_id AND b = y.id WHERE s <> b),
seen AS (SELECT 'all ' || community_id AS spec_id, 'community_explore' AS tool, row_number() OVER (PARTITION BY community_id ORDER BY src, edge_type, dst) AS rank, 100 AS lim, '' AS seed, 1 AS length, dst AS "end", src || '>' || dst AS path FROM kg WHERE community_id IS NOT NULL),
done AS (FROM (FROM hops UNION ALL FROM pairs UNION ALL FROM seen) WHERE rank <= lim)
"""


@query("n11_executed_specs", SPECS + """SELECT spec_id, tool, rank::INTEGER AS rank, seed, length::INTEGER AS length, "end", path FROM done""")
def n11(spark, d):
    rows, _ = executor.execute(specs(spark, d), views.kg_edges(spark, d))
    path = F.when(F.col("tool") == "find_paths", "").otherwise(F.array_join("nodes", ">"))
    return rows.select("spec_id", "tool", "rank", F.coalesce("seed", F.lit("")).alias("seed"), "length", F.element_at("nodes", -1).alias("end"), path.alias("path"))


@query("n11_spec_status", SPECS + """
, want AS (SELECT spec_id, 'graph_hop' AS tool, '' AS error FROM hop UNION ALL SELECT DISTINCT spec_id, 'find_paths', '' FROM grp UNION ALL SELECT 'all ' || n_name, 'community_explore', '' FROM nation UNION ALL SELECT 'bad ' || n_name, 'graph_hop', 'depth 0 is below 1' FROM nation),
had AS (SELECT spec_id, count(*) AS n FROM done GROUP BY spec_id)
SELECT want.spec_id, tool, CASE WHEN error = '' THEN 'success' ELSE 'error' END AS status, coalesce(n, 0)::BIGINT AS results, error FROM want LEFT JOIN had USING (spec_id)
""")
def n11_status(spark, d):
    _, status = executor.execute(specs(spark, d), views.kg_edges(spark, d))
    return status.withColumn("error", F.coalesce("error", F.lit("")))


@query("l04_validated_specs", """
, req AS (SELECT o_custkey AS question, o_orderkey AS pos, o_orderpriority AS community, CASE WHEN o_orderkey % 2 = 0 THEN 'graph_hop' ELSE 'find_paths' END AS tool FROM orders),
prop AS (SELECT o_custkey AS question, o_orderkey AS k, o_orderpriority AS community, CASE o_orderkey % 3 WHEN 0 THEN 'graph_hop' WHEN 1 THEN 'find_paths' ELSE 'guess' END AS tool, CASE WHEN o_totalprice > 1000 THEN floor(o_totalprice / 1000)::INTEGER END AS depth FROM orders),
fst AS (SELECT question, community, tool, arg_min(coalesce(depth, -1), k) AS d FROM prop WHERE tool <> 'guess' GROUP BY ALL)
SELECT req.question, req.pos, req.community, req.tool, CASE WHEN coalesce(d, -1) >= 0 THEN d WHEN req.tool = 'graph_hop' THEN 1 ELSE 3 END AS depth, CASE WHEN req.tool = 'graph_hop' THEN 50 ELSE 20 END AS "limit", d IS NULL AS backfilled FROM req LEFT JOIN fst ON fst.question = req.question AND fst.community = req.community AND fst.tool = req.tool
""")
def l04(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    required = o.select(F.col("o_custkey").alias("question"), k.alias("pos"), F.col("o_orderpriority").alias("community"), F.when(k % 2 == 0, "graph_hop").otherwise("find_paths").alias("tool"))
    depth = F.when(F.col("o_totalprice") > 1000, F.floor(F.col("o_totalprice") / 1000).cast("int"))
    proposed = o.select(F.col("o_custkey").alias("question"), k.alias("at"), F.col("o_orderpriority").alias("community"), F.when(k % 3 == 0, "graph_hop").when(k % 3 == 1, "find_paths").otherwise("guess").alias("tool"), depth.alias("depth"), F.lit(None).cast("int").alias("limit"))
    return executor.validated(proposed, required)
