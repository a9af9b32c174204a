"""Shaping search results: slim triples and paths, relevance, keys, memberships, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import overlap_tokens
from weftgraph.operators.ranking import best_of
from weftgraph.plans.materialize import materialize

#: Tokens that say nothing about relevance.
NOISE = ["village", "หมู่", "หมู่บ้าน", "moo", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "community", "ชุมชน"]
#: Properties of an edge that are shown elsewhere or not at all.
HIDDEN = ["community_id", "chunk_id", "updated_at", "label", "status"]

#: Predicates whose lines are sent to all edges.
FEW = 200_000


def tokens(text: Column) -> Column:
    """Distinct tokens without noise."""
    return F.array_except(overlap_tokens(F.coalesce(text, F.lit(""))), F.array(*map(F.lit, NOISE)))


def _words(text: Column) -> Column:
    """Tokens, repeated ones and noise too. Tokens are ASCII and Thai, so they may be lower-cased as one text."""
    return F.split(F.lower(F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-zA-Z0-9ก-๙]+)"), 1), " ")), " ")


def share(question: Column, others: Column) -> Column:
    """Share of the question's tokens among the others; 0 without any."""
    return F.size(F.array_intersect(question, others)) / F.greatest(F.size(question), F.lit(1))


def shown_properties(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, v: ~k.isin(HIDDEN) & v.isNotNull())


def slim_triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``subject, predicate, object, community_id, chunk_id, properties`` of edges (``properties`` a map): the ends with name, id and type."""
    end = lambda c: nodes.select(F.col("canonical_id").alias(c), F.struct("name", "canonical_id", "type").alias(f"{c}_node"))
    own = edges.select("src", "edge_type", "dst", "community_id", "chunk_id", shown_properties(F.col("properties")).alias("properties"))  # hidden ones are not shuffled
    found = own.join(end("src"), "src").join(end("dst"), "dst")
    return found.select(F.col("src_node").alias("subject"), F.col("edge_type").alias("predicate"), F.col("dst_node").alias("object"), "community_id", "chunk_id", "properties")


def slim_named(edges: DataFrame) -> DataFrame:
    """``slim_triples`` of edges that have their ends (``src_node, dst_node``: name, id, type)."""
    return edges.select(F.col("src_node").alias("subject"), F.col("edge_type").alias("predicate"), F.col("dst_node").alias("object"), "community_id", "chunk_id", shown_properties(F.col("properties")).alias("properties"))


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that ``slim_triples`` shows: both ends are among the nodes. Names are left for the few that are shown."""
    for c in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("canonical_id").alias(c)), c, "left_semi")
    return edges


def best_known(edges: DataFrame, nodes: DataFrame, by: str, tie: str, cap: int) -> DataFrame:
    """``ranking.best_of`` of the edges that ``known_ends`` keeps; ends are looked up for the best edges alone, and for more of them while a group lacks some."""
    wide = 2 * cap
    while True:
        first = materialize(best_of(edges, by, tie=tie, cap=wide), "first")
        known = materialize(known_ends(first.drop("rank"), nodes), "known")
        full = first.groupBy(by).agg(F.max("rank").alias("_most")).where(F.col("_most") >= wide)
        if full.join(known.groupBy(by).agg(F.count("*").alias("_n")), by, "left").where(F.coalesce("_n", F.lit(0)) < cap).isEmpty():
            return best_of(known, by, tie=tie, cap=cap)
        wide *= 8


def slim_paths(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path_id, chain, predicates, community_ids, chunk_ids, properties`` of paths (``path_id, nodes, edges``, edges as ``src|type|dst``).

    ``chain`` has the nodes (name, id, type) in order, ``predicates`` what stands between them; communities, chunks and the
    merged properties (of equal keys the last) come from the edges.
    """
    places = paths.select("path_id", F.posexplode("nodes").alias("k", "canonical_id")).join(nodes, "canonical_id", "left")
    chain = places.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("k", "name", "canonical_id", "type"))).alias("chain"))
    known = edges.select(F.concat_ws("|", "src", "edge_type", "dst").alias("e"), "edge_type", "community_id", "chunk_id", shown_properties(F.col("properties")).alias("p"))
    hops = paths.select("path_id", F.posexplode("edges").alias("k", "e")).join(known, "e", "left")
    hop = F.struct("k", "edge_type", "community_id", "chunk_id", F.map_entries("p").alias("p"))
    hops = hops.groupBy("path_id").agg(F.sort_array(F.collect_list(hop)).alias("h"))
    value = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform("h", lambda x: x[c]), lambda v: v.isNotNull())))
    entries = F.flatten(F.transform("h", lambda x: F.coalesce(x["p"], F.array().cast("array<struct<key:string,value:string>>"))))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda f: f["key"] == e["key"]))
    out = chain.join(hops, "path_id", "left")
    return out.select("path_id", F.transform("chain", lambda x: F.struct(x["name"].alias("name"), x["canonical_id"].alias("canonical_id"), x["type"].alias("type"))).alias("chain"), F.transform("h", lambda x: x["edge_type"]).alias("predicates"), value("community_id").alias("community_ids"), value("chunk_id").alias("chunk_ids"), F.map_from_entries(last).alias("properties"))


def as_results(triples: DataFrame | None = None, paths: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Results of all kinds in one schema: ``kind`` (triple, path, chunk), ``key, community_ids, chunk_ids, text, names``.

    ``key`` is what makes two results equal: kind and subject, predicate, object; the path's node ids in order; the chunk's id.
    ``text`` holds all strings, ``names`` those of ends, nodes and predicate (a chunk's quotes).
    """
    none = F.array().cast("array<string>")
    ids = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), none).otherwise(F.array(F.col(c).cast("string")))
    parts = []
    if triples is not None:
        names = F.concat_ws(" ", "subject.name", "object.name", "predicate")
        values = F.array_join(F.map_values("properties"), " ")
        parts.append(triples.select(F.lit("triple").alias("kind"), F.to_json(F.array(F.col("subject.canonical_id"), F.col("predicate"), F.col("object.canonical_id"))).alias("key"), ids("community_id").alias("community_ids"), ids("chunk_id").alias("chunk_ids"), F.concat_ws(" ", names, "subject.canonical_id", "subject.type", "object.canonical_id", "object.type", "community_id", values).alias("text"), names.alias("names")))
    if paths is not None:
        names = F.array_join(F.transform("chain", lambda x: x["name"]), " ")
        strings = F.concat_ws(" ", names, F.array_join(F.transform("chain", lambda x: F.concat_ws(" ", x["canonical_id"], x["type"])), " "), F.array_join("predicates", " "), F.array_join("community_ids", " "), F.array_join(F.map_values("properties"), " "))
        parts.append(paths.select(F.lit("path").alias("kind"), F.to_json(F.transform("chain", lambda x: x["canonical_id"])).alias("key"), F.col("community_ids").cast("array<string>").alias("community_ids"), F.col("chunk_ids").cast("array<string>").alias("chunk_ids"), strings.alias("text"), names.alias("names")))
    if evidence is not None:
        quotes = F.concat_ws(" ", "evidence_quote_en", "evidence_quote")
        parts.append(evidence.select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("key"), ids("community_id").alias("community_ids"), ids("chunk_id").alias("chunk_ids"), F.concat_ws(" ", quotes, "community_id").alias("text"), quotes.alias("names")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def relevance(results: DataFrame, chunk_scores: DataFrame, question: Column) -> DataFrame:
    """Results with ``score``: the best score of their chunks plus the better of two token overlaps with the question (all
    strings, names); a chunk's own is the sum of both, without chunk scores. ``chunk_scores`` has ``chunk_id, score``.

    Results are known by ``result_id``; chunk scores join to the exploded ids, so no result carries the whole table. Overlaps are taken before any shuffle. A triple,
    which has one chunk at most, meets its score by that chunk and is shuffled once; chunks of documents are not shuffled.
    """
    q = tokens(question)  # has no noise, so what it shares has none
    whole, own = share(q, _words(F.col("text"))), share(q, _words(F.col("names")))
    better = F.when(F.col("text").startswith(F.concat("names", F.lit(" "))), whole).otherwise(F.greatest(whole, own))  # a text that begins with the names has all their tokens
    rows = results.withColumn("score", F.when(F.col("kind") == "chunk", whole + own).otherwise(better))
    scores = chunk_scores.groupBy(F.col("chunk_id").cast("string").alias("_c")).agg(F.max("score").alias("_s"))
    one = rows.where("kind = 'triple'").withColumn("_c", F.get("chunk_ids", F.lit(0))).join(scores.hint("shuffle_hash"), "_c", "left").drop("_c")
    rest = rows.where("kind IS NULL OR kind NOT IN ('triple', 'chunk')")
    best = rest.where("kind IS NOT NULL").select("result_id", F.explode("chunk_ids").alias("_c")).join(scores, "_c").groupBy("result_id").agg(F.max("_s").alias("_s"))
    found = one.unionByName(rest.join(best, "result_id", "left")).withColumn("score", F.coalesce("_s", F.lit(0.0)) + F.col("score")).drop("_s")
    return found.unionByName(rows.where("kind = 'chunk'")).select(*results.columns, "score")


def memberships(results: DataFrame) -> DataFrame:
    """One row for each community of a result; ``unknown`` where it has none."""
    own = F.filter("community_ids", lambda c: c != "")
    return results.withColumn("community_id", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("unknown")))))


def link_lines(uses: DataFrame, details: DataFrame) -> DataFrame:
    """``result_id, line``: ``raw -> (linked) -> canonical [english]`` for each raw name of what a result uses.

    ``uses`` has ``result_id`` and ``canonical_id``, or for predicates ``predicate`` (a name; of equal names the least id
    counts); ``details`` has ``kind`` (entity or predicate), ``canonical_id, name, name_en, raw_names``. Names that equal the
    canonical one have no line; a pair has one line a result.
    """
    entity = uses.where("canonical_id IS NOT NULL").select("result_id", "canonical_id").distinct().join(details.where("kind = 'entity'"), "canonical_id")
    first = details.where("kind = 'predicate'").groupBy("name").agg(F.min(F.struct("canonical_id", "name_en", "raw_names")).alias("b"))
    first = first.select(F.col("name").alias("predicate"), "name", "b.canonical_id", "b.name_en", "b.raw_names")
    predicate = uses.where("predicate IS NOT NULL").select("result_id", "predicate").distinct().join(first, "predicate")
    both = entity.select("result_id", "name", "name_en", "raw_names").unionByName(predicate.select("result_id", "name", "name_en", "raw_names"))
    raw = both.select("result_id", "name", "name_en", F.explode("raw_names").alias("raw")).where("raw <> '' AND raw <> name")
    one = raw.groupBy("result_id", "raw", "name").agg(F.max("name_en").alias("name_en"))
    shown = F.when(F.col("name_en") != "", F.concat("name", F.lit(" ["), "name_en", F.lit("]"))).otherwise(F.col("name"))
    return one.select("result_id", F.concat("raw", F.lit(" -> (linked) -> "), shown).alias("line"))


def edge_link_lines(edges: DataFrame, details: DataFrame) -> DataFrame:
    """``src, edge_type, dst, line``: the ``link_lines`` of distinct edges, each edge one result that uses its ends and its type.

    Edges meet the lines of their source, then those of their target, with the lines as the hashed side, and equal ones are found in the row: no edge is
    sorted, and neither uses nor lines are grouped.
    """
    line = F.struct("raw", "name", "name_en")
    of = lambda d, key: d.select(key, "name", "name_en", F.explode("raw_names").alias("raw")).where("raw <> '' AND raw <> name").groupBy(key).agg(F.collect_set(line).alias("_l"))
    entity = of(details.where("kind = 'entity'"), "canonical_id")
    first = details.where("kind = 'predicate'").groupBy("name").agg(F.min(F.struct("canonical_id", "name_en", "raw_names")).alias("b"))
    predicate = of(first.select("name", F.col("name").alias("edge_type"), "b.name_en", "b.raw_names"), "edge_type")
    predicate = predicate.withColumnRenamed("_l", "_p")
    # edges by their few types would be few groups; many predicates are counted first
    out = edges.select("src", "edge_type", "dst").join(F.broadcast(predicate) if predicate.count() <= FEW else predicate, "edge_type", "left")
    for end in ("src", "dst"):
        out = out.join(entity.select(F.col("canonical_id").alias(end), F.col("_l").alias(f"_{end}")).hint("shuffle_hash"), end, "left")
    none = F.array().cast("array<struct<raw:string,name:string,name_en:string>>")
    found = F.array_sort(F.concat(*(F.coalesce(c, none) for c in ("_src", "_dst", "_p"))))
    rows = out.select("src", "edge_type", "dst", found.alias("_l"))
    # of equal raw names and names the greatest English one stands last
    last = F.filter("_l", lambda x, i: ~F.coalesce((F.get("_l", i + 1)["raw"] == x["raw"]) & (F.get("_l", i + 1)["name"] == x["name"]), F.lit(False)))
    shown = lambda x: F.when(x["name_en"] != "", F.concat(x["name"], F.lit(" ["), x["name_en"], F.lit("]"))).otherwise(x["name"])
    lines = F.array_distinct(F.transform(last, lambda x: F.concat(x["raw"], F.lit(" -> (linked) -> "), shown(x))))
    return rows.select("src", "edge_type", "dst", F.explode(lines).alias("line"))


def path_line(chain: Column, predicates: Column, properties: Column) -> Column:
    """``a -> (p) -> b -> (q) -> c`` and, where there are any, ``| k: v`` parts."""
    steps = F.transform(chain, lambda x, i: F.concat(F.coalesce(x["name"], F.lit("?")), F.coalesce(F.concat(F.lit(" -> ("), F.get(predicates, i), F.lit(") -> ")), F.lit(""))))
    parts = F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(F.lit(" | "), e["key"], F.lit(": "), e["value"])), "")
    return F.concat(F.array_join(steps, ""), parts)
