"""Runs a table of specs as one job: every search of every question at once, with a row of status for each.

A spec is ``spec_id, tool, entities, communities, types, depth, limit`` (arrays of strings, numbers). ``normalised`` brings older
tables to this shape, ``validated`` completes them; ``execute`` runs them against the edges, and ``save`` keeps what came out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.paths import STEP, Steps, shortest, trails
from weftgraph.plans.materialize import materialize
from weftgraph.plans.planner import DEFAULTS

#: The tools, and the names of older approaches that stand for them.
TOOLS = {"graph_hop": "graph_hop", "find_paths": "find_paths", "community_explore": "community_explore", "expansion": "graph_hop", "path": "find_paths", "community_exploration": "community_explore"}


def _default(name: str):
    return F.coalesce(*(F.when(F.col("tool") == tool, F.lit(values.get(name)).cast("int")) for tool, values in DEFAULTS.items()))


def normalised(specs: DataFrame) -> DataFrame:
    """``spec_id, tool, entities, communities, types, depth, limit, error``: one row for each id (of repeated ones the least).

    ``tool`` may be missing where ``approach`` names it; other names explore communities. Missing arrays are empty, missing
    numbers the tool's own. ``error`` tells why a spec cannot run.
    """
    have = set(specs.columns)
    names = [F.col(c) for c in ("tool", "approach") if c in have]
    told = F.coalesce(*names, F.lit("")) if names else F.lit("")
    tool = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in TOOLS.items() for x in pair)), told), F.lit("community_explore"))
    own = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))) if c in have else F.array().cast("array<string>")
    number = lambda c: F.col(c).cast("int") if c in have else F.lit(None).cast("int")
    rows = specs.select("spec_id", tool.alias("tool"), own("entities").alias("entities"), own("communities").alias("communities"), own("types").alias("types"), number("depth").alias("depth"), number("limit").alias("limit"))
    rows = rows.groupBy("spec_id").agg(F.min(F.struct("tool", "entities", "communities", "types", "depth", "limit")).alias("s")).select("spec_id", "s.*")
    rows = rows.withColumns({"depth": F.coalesce("depth", _default("depth")), "limit": F.coalesce("limit", _default("limit"))})
    return rows.withColumn("error", F.when(F.col("depth") < 1, F.concat(F.lit("depth "), F.col("depth").cast("string"), F.lit(" is below 1"))).when(F.col("limit") < 0, F.concat(F.lit("limit "), F.col("limit").cast("string"), F.lit(" is negative"))))


def validated(proposed: DataFrame, required: DataFrame) -> DataFrame:
    """``question, pos, community, tool, depth, limit, backfilled``: the required pairs (``question, pos, community, tool``) in their order.

    Of proposals (``question, at, community, tool, depth, limit``) of a pair the first counts, unknown tools and
    pairs that nobody required are ignored, and pairs that nobody proposed get the tool's own numbers.
    """
    keys = ["question", "community", "tool"]
    first = proposed.where(F.col("tool").isin(list(DEFAULTS))).groupBy(*keys).agg(F.min(F.struct("at", F.col("depth").alias("d"), F.col("limit").alias("l"))).alias("b"))
    out = required.join(first, keys, "left")
    return out.select("question", "pos", "community", "tool", F.coalesce("b.d", _default("depth")).cast("int").alias("depth"), F.coalesce("b.l", _default("limit")).cast("int").alias("limit"), F.col("b").isNull().alias("backfilled"))


def _explored(specs: DataFrame, edges: DataFrame) -> DataFrame:
    """The first edges of the specs' communities; each community's first edges are found once for all specs."""
    wanted = specs.select("spec_id", "limit", F.explode("communities").alias("community_id"))
    most = wanted.agg(F.max("limit").alias("m")).first()["m"] or 0
    order = ["src", "edge_type", "dst"]
    known = edges.join(wanted.select("community_id").distinct(), "community_id", "left_semi")
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy("community_id").orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    rows = wanted.join(first, "community_id").withColumn("rank", F.row_number().over(Window.partitionBy("spec_id").orderBy(*order))).where((F.col("rank") <= most) & (F.col("rank") <= F.col("limit")))
    step = F.struct(F.col("src").alias("subject"), F.col("edge_type").alias("predicate"), F.col("dst").alias("object"), "community_id", "chunk_id").cast(STEP)
    return rows.select("spec_id", "rank", F.lit(None).cast("string").alias("seed"), F.lit(1).alias("length"), F.array("src", "dst").alias("nodes"), F.array(step).alias("steps"))


def execute(specs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results of all specs, and a status for each.

    Results: ``spec_id, tool, rank, seed, length, nodes, steps``; steps are edges in their stored direction, in the order of the path.
    Hops are paths of up to ``depth`` edges from an entity, ordered by length, entity and edges; paths are the shortest ones between
    entities, ordered by length and ends; exploring gives edges in order. ``limit`` cuts that order. Hops and paths without
    communities use all edges, exploring without any finds nothing, and so do hops and paths without entities.
    Status: ``spec_id, tool, status, results, error``; a spec that cannot run is an error there, and the others run.
    """
    specs = materialize(normalised(specs), "specs")
    good = specs.where("error IS NULL")
    steps = Steps(edges)
    seeds = good.select("spec_id", "tool", F.explode("entities").alias("seed"), "communities", "types", "depth", "limit")
    parts = {
        "graph_hop": trails(steps, seeds.where("tool = 'graph_hop'")),
        "find_paths": shortest(steps, seeds.where("tool = 'find_paths'")),
        "community_explore": _explored(good.where("tool = 'community_explore'"), steps.edges),
    }
    rows = None
    for tool, part in parts.items():
        part = part.select("spec_id", F.lit(tool).alias("tool"), "rank", "seed", "length", "nodes", "steps")
        rows = part if rows is None else rows.unionAll(part)
    rows = materialize(rows, "spec-results")
    steps.discard()
    count = rows.groupBy("spec_id").agg(F.count("*").alias("n"))
    status = specs.join(count, "spec_id", "left").select("spec_id", "tool", F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("results"), "error")
    return rows, status


def save(rows: DataFrame, status: DataFrame, folder: str) -> DataFrame:
    """Writes results (``folder/results``, by tool) and status (``folder/status``) as Parquet; the status with where each spec's results are."""
    rows.write.partitionBy("tool").parquet(f"{folder}/results")
    saved = status.withColumn("path", F.when(F.col("results") > 0, F.concat(F.lit(f"{folder}/results/tool="), F.col("tool"))))
    saved.write.parquet(f"{folder}/status")
    return status.sparkSession.read.parquet(f"{folder}/status")
