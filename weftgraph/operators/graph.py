"""Property-graph merges and queries over node and edge tables.

Edges: ``src, edge_type, dst, community_id, chunk_id``. Communities filter inside of every search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.materialize import materialize

#: Paths that are sent to all steps; paths that end at a node beyond which its steps are sliced, and slices.
FEW, BUSY, SLICES = 200_000, 1_000, 16
#: Words of 64 bits, at most, that tell tasks which nodes may be ends of paths (8 MB).
WORDS = 1 << 20


def merge_edges(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("src", "edge_type", "dst")) -> DataFrame:
    """One edge for each source, type and target (``keys``): the first writer's properties stay.

    The first row of each edge is taken before the shuffle too, so a hot edge is no large group; rows leave in the order of
    their keys, which packs well, and no group is held.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return rows.withColumn("_n", first).where("_n = 1").select(*keys, *order, *rest)


def in_communities(edges: DataFrame, communities: list[str] | None) -> DataFrame:
    return edges if communities is None else edges.where(F.col("community_id").isin(communities))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends; a self-link once. ``a, edge_type, b`` and the edge's own columns."""
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type", "src", "dst", "community_id", "chunk_id")
    back = edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_type", "src", "dst", "community_id", "chunk_id")
    return there.unionAll(back)


def neighbourhood(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, communities: list[str] | None = None) -> DataFrame:
    """``seed, subject, predicate, object, community_id, chunk_id``: edges at the seeds (``id``), in their stored direction; one between two seeds comes for both."""
    own = in_communities(edges, communities)
    own = own if types is None else own.where(F.col("edge_type").isin(types))
    near = both_ways(own).join(seeds.select(F.col("id").alias("a")).distinct(), "a")
    return near.select(F.col("a").alias("seed"), F.col("src").alias("subject"), F.col("edge_type").alias("predicate"), F.col("dst").alias("object"), "community_id", "chunk_id")


def _near(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """The steps from ``ends`` (``end``, distinct) and a few others: a bit for each hash of an end is sent to the steps, so that most of the others are not shuffled."""
    words = 1 << min(WORDS.bit_length() - 1, max(4, (ends.count() // 6).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    word = lambda c: F.floor(place(c) / 64).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(c), F.lit(64)).cast("int"))
    own = ends.groupBy(word("end").alias("w")).agg(F.bit_or(bit("end")).alias("v"))
    every = ends.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("v"))
    whole = own.unionAll(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    bits = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("_bits"))
    return steps.join(F.broadcast(bits), F.get("_bits", word("a")).bitwiseAND(bit("a")) != 0, "left_semi")


def trails(edges: DataFrame, seeds: DataFrame, depth: int, communities: list[str] | None = None) -> DataFrame:
    """All paths of 1 to ``depth`` edges from the seeds that repeat no edge: ``start, end, length, nodes, edges``.

    ``edges`` need only ``src, edge_type, dst`` (and ``community_id`` for communities). A level shuffles ends and type of each step alone and names
    the edge behind the join; counted ends of few paths are sent to the steps instead, of many a bit each, which leaves most steps from elsewhere unshuffled. Steps from an end of more than ``BUSY`` paths go to ``SLICES`` tasks.
    """
    own = in_communities(edges, communities)
    there = own.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type", F.lit(True).alias("_there"))
    steps = there.unionAll(own.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_type", F.lit(False).alias("_there")))
    now = seeds.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    out = None
    for length in range(1, depth + 1):
        if now.count() <= FEW:
            walked = steps.join(F.broadcast(now), F.col("a") == F.col("end"))
        else:
            busy = F.broadcast(materialize(now.groupBy("end").count().where(F.col("count") > BUSY).select(F.col("end").alias("a")), "busy"))
            to = busy.select(F.col("a").alias("end"), F.sequence(F.lit(0), F.lit(SLICES - 1)).alias("_all"))
            paths = now.join(to, "end", "left").withColumn("_slice", F.explode(F.coalesce("_all", F.array(F.lit(0))))).drop("_all")
            dealt = _near(steps, now.select("end").distinct()).join(busy.select("a", F.lit(True).alias("_busy")), "a", "left")
            dealt = dealt.withColumn("_slice", F.when(F.col("_busy"), F.pmod(F.xxhash64("b", "edge_type"), F.lit(SLICES)).cast("int")).otherwise(0)).drop("_busy")
            walked = dealt.join(paths.hint("shuffle_hash").withColumnRenamed("_slice", "_s"), (F.col("a") == F.col("end")) & (F.col("_slice") == F.col("_s")))
        edge = F.when(F.col("_there"), F.concat_ws("|", "a", "edge_type", "b")).otherwise(F.concat_ws("|", "b", "edge_type", "a"))
        walked = walked.withColumn("e", edge).where(~F.array_contains("edges", F.col("e")))
        now = walked.select("start", F.col("b").alias("end"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("e")).alias("edges"))
        if length < depth:
            now = materialize(now, "trails")  # for its own rows and for the next level
        found = now.withColumn("length", F.lit(length))
        out = found if out is None else out.unionAll(found)
    return out.select("start", "end", "length", "nodes", "edges")


def match(edges: DataFrame, subjects: list[str] | DataFrame | None = None, types: list[str] | None = None, objects: list[str] | None = None, communities: list[str] | None = None) -> DataFrame:
    """Directed edges for which all given conditions hold; ``subjects`` may be a table of ``id``."""
    out = in_communities(edges, communities)
    if isinstance(subjects, DataFrame):
        out, subjects = out.join(subjects.select(F.col("id").alias("src")).distinct(), "src", "left_semi"), None
    for c, values in (("src", subjects), ("edge_type", types), ("dst", objects)):
        out = out if values is None else out.where(F.col(c).isin(values))
    return out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``canonical_id, name, degree`` of every node, those without edges too."""
    ends = edges.select(F.col("src").alias("canonical_id")).unionAll(edges.where("src <> dst").select("dst"))
    count = ends.groupBy("canonical_id").agg(F.count("*").alias("degree"))
    return nodes.join(count, "canonical_id", "left").select("canonical_id", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


def top_degree(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "canonical_id").limit(limit)


def self_links(edges: DataFrame) -> DataFrame:
    """Edges of a node with itself by node, and their share of all edges in per cent."""
    total = edges.agg(F.count("*").alias("total"))
    own = edges.where("src = dst").groupBy("src").agg(F.count("*").alias("n"))
    return own.join(F.broadcast(total)).select(F.col("src").alias("canonical_id"), "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def relationship_line(subject: Column, predicate: Column, obj: Column, properties: Column) -> Column:
    """``s -> (p) -> o`` and, where there are any, ``| k: v`` parts."""
    parts = F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")
    head = F.concat(subject, F.lit(" -> ("), predicate, F.lit(") -> "), obj)
    return F.when(parts == "", head).otherwise(F.concat_ws(" | ", head, parts))
