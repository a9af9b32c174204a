"""The table of communities: ids, insertion without near duplicates, search, deletion, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.blocks import top_k
from weftgraph.operators.resolution import leader_clusters

#: Fixed value: the mandatory fields, in the order in which they make up an id.
MANDATORY = ("moo", "village")


def with_unique_id(metadata: DataFrame, fields: tuple[str, ...] = MANDATORY) -> DataFrame:
    """``unique_id`` from the mandatory fields; an error where one is null or blank."""
    whole = F.least(*(F.coalesce(F.trim(f) != "", F.lit(False)).cast("int") for f in fields), F.lit(1)) == 1
    return metadata.withColumn("unique_id", F.when(whole, F.concat_ws("_", *(F.trim(f) for f in fields))).otherwise(F.raise_error(F.lit("mandatory fields: " + ", ".join(fields)))))


def insert_new(existing: DataFrame, new: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``existing`` and those rows of ``new`` (``id, name, vec``) that are like none of them and like no new one kept
    before (by id)."""
    like = top_k(new, existing, 1, threshold).select(F.col("query_id").alias("id"))
    fresh = new.join(like, "id", "left_anti")
    kept = leader_clusters(fresh, threshold, threshold, threshold).where("status = 'rep'").select("id")
    return existing.unionByName(fresh.join(kept, "id", "left_semi").select(existing.columns))


def by_location(metadata: DataFrame, moo: str | None = None, village: str | None = None) -> DataFrame:
    """Rows whose fields hold the texts given; all without any."""
    for name, value in (("moo", moo), ("village", village)):
        if value:
            metadata = metadata.where(F.col(name).contains(value))
    return metadata


def without_ids(metadata: DataFrame, ids: list[str]) -> DataFrame:
    return metadata.where(~F.coalesce(F.col("unique_id").isin(ids), F.lit(False)))


def label(fields: list[Column], unique_id: Column, most: int = 2) -> Column:
    """The first distinct values that are not blank, else the id."""
    shown = F.slice(F.array_distinct(F.array_compact(F.array(*(F.when(F.trim(c) != "", F.trim(c)) for c in fields)))), 1, most)
    return F.when(F.size(shown) > 0, F.array_join(shown, " / ")).otherwise(unique_id)
