"""Entity resolution by vector similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import has_digit
from weftgraph.plans.materialize import materialize

from .blocks import similar_pairs


def leader_clusters(items: DataFrame, candidate: float = 0.65, alias: float = 0.95, digit_alias: float = 0.999) -> DataFrame:
    """``id, leader, score, status`` (``rep``, ``alias`` or ``uncertain``) of greedy leader clustering by id.

    An item is a representative if no earlier representative is similar enough: the lexicographically first
    maximal independent set. Each round decides every item whose earlier neighbours are all decided
    or include a representative. ``items`` has ``id, name, vec``.
    """
    pairs = materialize(similar_pairs(items, candidate), "similar")
    state = materialize(items.join(pairs.select(F.col("i").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("rep")), "leaders")
    open_ids = materialize(pairs.select(F.col("i").alias("id")).distinct(), "open")
    while not open_ids.isEmpty():
        near = pairs.join(open_ids.select(F.col("id").alias("i")), "i").join(state.select(F.col("id").alias("j"), "rep"), "j", "left")
        found = near.groupBy("i").agg(F.max(F.coalesce("rep", F.lit(False))).alias("led"), F.max(F.col("rep").isNull()).alias("waits"))
        decided = found.where("led OR NOT waits").select(F.col("i").alias("id"), (~F.col("led")).alias("rep"))
        decided = materialize(decided, "decided")
        state = materialize(state.unionAll(decided), "leaders")
        open_ids = materialize(open_ids.join(decided, "id", "left_anti"), "open")
    reps = state.where("rep").select(F.col("id").alias("j"))
    best = pairs.join(reps, "j").groupBy("i").agg(F.max(F.struct("score", (-F.col("j")).alias("m"))).alias("b"))
    best = best.select(F.col("i").alias("id"), (-F.col("b.m")).alias("leader"), F.col("b.score").alias("score"))
    names = items.select("id", "name")
    leaders = items.select(F.col("id").alias("leader"), F.col("name").alias("leader_name"))
    out = state.join(names, "id").join(best.join(leaders, "leader"), "id", "left")
    need = F.when(has_digit(F.coalesce("name", F.lit(""))) | has_digit(F.coalesce("leader_name", F.lit(""))), digit_alias).otherwise(alias)
    status = F.when(F.col("rep"), "rep").when(F.col("score") >= need, "alias").otherwise("uncertain")
    return out.select("id", F.when(F.col("rep"), F.col("id")).otherwise(F.col("leader")).alias("leader"), F.when(~F.col("rep"), F.col("score")).alias("score"), status.alias("status"))
