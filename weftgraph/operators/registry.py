"""Lookups in the registries of entities, predicates, labels, communities and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import top_k


def by_similar_name(names: DataFrame, registry: DataFrame, vectors: list[str], limit: int = 5, threshold: float = 0.7) -> DataFrame:
    """``query_id, canonical_id, id, score``: for each name and vector column the nearest ``limit`` rows, of those the ones
    >= threshold, and of those the best for each canonical id (the row's own where it has none)."""
    found = [top_k(names, registry.select("id", F.col(v).alias("vec")), limit, threshold).drop("rank") for v in vectors]
    hits = reduce(DataFrame.unionByName, found).join(registry.select("id", F.coalesce("canonical_id", "id").alias("canonical_id")), "id")
    best = hits.groupBy("query_id", "canonical_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("query_id", "canonical_id", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def canonical_rows(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each asked ``canonical_id`` that is there: the canonical one, else the least alias."""
    rows = registry.join(ids.select("canonical_id").distinct(), "canonical_id", "left_semi")
    rest = [c for c in registry.columns if c not in ("canonical_id", "id", "is_canonical")]
    best = rows.groupBy("canonical_id").agg(F.min(F.struct((~F.col("is_canonical")).alias("alias"), "id", *rest)).alias("b"))
    return best.select("canonical_id", "b.id", (~F.col("b.alias")).alias("is_canonical"), *(F.col(f"b.{c}").alias(c) for c in rest))


def community_metadata(communities: DataFrame, ids: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """The communities asked for by ``unique_id``, or the first ``limit`` of all."""
    if ids is None:
        return communities.orderBy("unique_id").limit(limit)
    return communities.join(ids.select("unique_id").distinct(), "unique_id", "left_semi")


def community_ids(communities: DataFrame) -> DataFrame:
    return communities.select(F.col("unique_id")).where("unique_id IS NOT NULL").distinct()


def first_per(registry: DataFrame, by: str, values: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows (by id) for each of the values of ``by`` that are asked for: labels of a group, entities of a label."""
    rows = registry.join(values.select(by).distinct(), by, "left_semi")
    w = Window.partitionBy(by).orderBy("id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def evidence_by_ids(evidence: DataFrame, ids: DataFrame, per_chunk: int = 2) -> DataFrame:
    """Evidence whose ``id`` is asked for; for ids that no row has, at most ``per_chunk`` rows whose ``chunk_id`` they are. ``asked`` is the id."""
    asked = ids.select(F.col("id").alias("asked")).distinct()
    own = evidence.join(asked, evidence["id"] == asked["asked"])
    missing = asked.join(evidence.select(F.col("id").alias("asked")), "asked", "left_anti")
    w = Window.partitionBy("asked").orderBy("id")
    chunks = evidence.join(missing, evidence["chunk_id"] == missing["asked"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_chunk).drop("_n")
    return own.unionByName(chunks)


def surrounding_evidence(evidence: DataFrame, anchors: DataFrame, window: int = 2, limit: int = 20) -> DataFrame:
    """``anchor, id, ordering``: evidence of the anchor's document with an index within ``window``, in order; where the anchor
    has no document or index, of its community; where that is missing too, the anchor itself. At most ``limit`` each."""
    a = evidence.join(anchors.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("anchor"), F.col("doc_id").alias("_d"), F.col("chunk_index").alias("_i"), F.col("community_id").alias("_c"))
    placed = F.col("_d").isNotNull() & F.col("_i").isNotNull()
    near = a.where(placed).withColumn("chunk_index", F.explode(F.sequence(F.col("_i") - window, F.col("_i") + window)))
    near = near.join(evidence.withColumnRenamed("doc_id", "_d"), ["_d", "chunk_index"]).select("anchor", "id", F.col("chunk_index").cast("long").alias("_o"), F.lit("chunk_index").alias("ordering"))
    same = a.where(~placed & F.col("_c").isNotNull()).join(evidence.withColumnRenamed("community_id", "_c"), "_c").select("anchor", "id", F.lit(0).cast("long").alias("_o"), F.lit("approximate_same_community").alias("ordering"))
    alone = a.where(~placed & F.col("_c").isNull()).select("anchor", F.col("anchor").alias("id"), F.lit(0).cast("long").alias("_o"), F.lit("anchor").alias("ordering"))
    w = Window.partitionBy("anchor").orderBy("_o", "id")
    return near.unionAll(same).unionAll(alone).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("_o")


def best_over_languages(hits: DataFrame, threshold: float | None = None) -> DataFrame:
    """``query_id, id, score, language``: the best score of a row over the languages it was found in; the threshold is for dense scores alone."""
    own = hits if threshold is None else hits.where(F.col("is_rrf") | (F.col("score") >= threshold))
    best = own.groupBy("query_id", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "language", "is_rrf")).alias("b"))
    return best.select("query_id", "id", (-F.col("b.s")).alias("score"), "b.language", "b.is_rrf")


def normalised(hits: DataFrame) -> DataFrame:
    """Rank-fusion scores brought to 0..1 for each query (1 where all are equal); dense scores stay."""
    w = Window.partitionBy("query_id", "is_rrf")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(~F.col("is_rrf"), F.col("score")).when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo))
    return hits.withColumn("raw_score", F.col("score")).withColumn("score", scaled)


def raw_links(matches: DataFrame, registry: DataFrame) -> DataFrame:
    """``canonical_id, name, name_en, raw_names, score``: which raw names stand for a canonical row, with the best score.

    ``matches`` has ``raw_name, canonical_id, score, pos``; names are in the order they are first seen.
    """
    first = matches.groupBy("canonical_id", "raw_name").agg(F.min("pos").alias("pos"), F.max("score").alias("score"))
    grouped = first.groupBy("canonical_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw_name"))), lambda x: x["raw_name"]).alias("raw_names"), F.max("score").alias("score"))
    return grouped.join(canonical_rows(registry, grouped).select("canonical_id", "name", "name_en"), "canonical_id", "left")
