"""Linking items to a registry of canonical ones: search, decisions, aliases, registry rows.

``registry`` has ``id, name, name_en, is_canonical, canonical_id, vec``; ``items`` has ``id, name, name_en`` and a
position ``pos``. A decision is ``name, same, new_is_canonical, canonical_form``, made by the caller's model; where it and the items
have ``kind`` or ``community_id``, these belong to its key as the name does (null equals null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import top_k


def shown(name_en: str = "name_en", name: str = "name") -> Column:
    """The English name, or the name where that is missing or blank."""
    return F.coalesce(F.when(F.trim(F.col(name_en)) != "", F.col(name_en)), F.col(name))


def _keys(*tables: DataFrame) -> list[str]:
    return [c for c in ("kind", "name", "community_id") if all(c in t.columns for t in tables)]


def _by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str, names: list[str] | None = None) -> DataFrame:
    """A join of the columns ``names`` of the left side with the keys of the right one, where nulls are equal."""
    right = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = F.lit(True)
    for k, name in zip(keys, names or keys, strict=True):
        on = on & left[name].eqNullSafe(right[f"_key_{k}"])
    return left.join(right, on, how).drop(*(f"_key_{k}" for k in keys))


def canonical_matches(items: DataFrame, registry: DataFrame, threshold: float = 0.65, same_community: bool = False) -> DataFrame:
    """``query_id, id, score``: the nearest canonical row of each item, within its community where asked."""
    return top_k(items, registry.where("is_canonical"), 1, threshold, ["community_id"] if same_community else None).drop("rank")


def general_matches(items: DataFrame, registry: DataFrame, limit: int = 5) -> DataFrame:
    """``query_id, id, score, rank``: the nearest rows of any kind, without a threshold."""
    return top_k(items, registry, limit, -1.0)


def classified(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Items with ``match_id, score`` and ``status``: ``candidate`` for a decision if anything matches, however well, else ``new``."""
    found = matches.select(F.col("query_id").alias("id"), F.col("id").alias("match_id"), "score")
    return items.join(found, "id", "left").withColumn("status", F.when(F.col("match_id").isNull(), "new").otherwise("candidate"))


def resolved(classes: DataFrame, decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """One row an item: ``outcome`` (new, alias or replace) and what it resolves to.

    A candidate without a decision is new, like one that was decided not to be the same; of repeated decisions of a key the least counts.
    ``canonical, canonical_id`` name the resolution, ``point_id`` is the canonical id of the item's own registry row.
    """
    keys = _keys(classes, decisions)
    told = decisions.groupBy(*keys).agg(F.min(F.struct("same", "new_is_canonical", "canonical_form")).alias("_told"))
    told = told.select(*keys, F.col("_told.same").alias("_same"), F.col("_told.new_is_canonical").alias("_new"), F.col("_told.canonical_form").alias("_form"))
    old = registry.select(F.col("id").alias("match_id"), shown().alias("_old"), F.coalesce("canonical_id", "id").alias("_old_id"))
    x = _by_key(classes, told, keys, "left").join(old, "match_id", "left")
    outcome = F.when((F.col("status") == "new") | ~F.coalesce("_same", F.lit(False)), "new").when(F.coalesce("_new", F.lit(False)), "replace").otherwise("alias")
    x = x.withColumn("outcome", outcome).withColumn("is_canonical", F.col("outcome") != "alias")
    own = F.when(F.col("outcome") == "replace", F.coalesce(F.when(F.col("_form") != "", F.col("_form")), shown())).otherwise(shown())
    return x.select(
        *(c for c in classes.columns if c not in ("status", "score", "match_id")),
        "match_id",
        "outcome",
        F.when(F.col("outcome") == "alias", F.col("_old")).otherwise(own).alias("canonical"),
        F.when(F.col("outcome") == "alias", F.col("_old_id")).otherwise(F.col("id")).alias("canonical_id"),
        F.when(F.col("outcome") == "alias", F.col("match_id")).otherwise(F.col("id")).alias("point_id"),
        (F.col("outcome") != "alias").alias("is_new"),
        "is_canonical",
    )


def changes(resolution: DataFrame, registry: DataFrame) -> DataFrame:
    """The log of replacements: ``old_canonical_id, old_canonical_name, new_canonical_id, new_canonical_name``; the last one by position counts."""
    last = resolution.where("outcome = 'replace'").groupBy("match_id").agg(F.max(F.struct("pos", F.col("id").alias("new"), F.col("name").alias("new_name"))).alias("r"))
    old = registry.select(F.col("id").alias("match_id"), F.col("name").alias("old_name"))
    return last.join(old, "match_id").select(F.col("match_id").alias("old_canonical_id"), F.col("old_name").alias("old_canonical_name"), F.col("r.new").alias("new_canonical_id"), F.col("r.new_name").alias("new_canonical_name"))


def applied(registry: DataFrame, resolution: DataFrame) -> DataFrame:
    """``id, name, name_en, is_canonical, canonical_id`` of the registry after the resolution: replaced rows are demoted, the items' rows come in or take the place of rows with their id."""
    gone = changes(resolution, registry).select(F.col("old_canonical_id").alias("id"), F.col("new_canonical_id").alias("_to"))
    new = resolution.select("id", "name", "name_en", "is_canonical", F.col("point_id").alias("canonical_id"))
    kept = registry.join(gone, "id", "left").join(new.select("id"), "id", "left_anti")
    demoted = F.col("_to").isNotNull()
    return kept.select("id", "name", "name_en", (F.col("is_canonical") & ~demoted).alias("is_canonical"), F.coalesce("_to", "canonical_id").alias("canonical_id")).unionByName(new)


def new_canonicals(items: DataFrame) -> DataFrame:
    """Items that become canonical as they are: ``canonical, canonical_id, is_new, is_canonical``."""
    return items.select("id", "name", "name_en", shown().alias("canonical"), F.col("id").alias("canonical_id"), F.lit(True).alias("is_new"), F.lit(True).alias("is_canonical"))


def follow(aliases: DataFrame, resolution: DataFrame) -> DataFrame:
    """Aliases of representatives (``rep_name``) get what these resolve to; without a resolution they become canonical.

    Where both sides have ``kind`` or ``community_id``, a representative is one of the alias's own kind and community.
    Of representatives of one key the first by ``pos`` counts.
    """
    keys = _keys(aliases, resolution)
    to = resolution.groupBy(*keys).agg(F.min_by(F.struct(F.col("canonical").alias("c"), F.col("canonical_id").alias("i")), "pos").alias("_to"))
    to = to.select(*keys, F.col("_to.c").alias("_c"), F.col("_to.i").alias("_i"))
    x = _by_key(aliases, to, keys, "left", ["rep_name" if k == "name" else k for k in keys])
    alone = F.col("_i").isNull()
    return x.select("id", "name", "name_en", F.coalesce("_c", shown()).alias("canonical"), F.coalesce("_i", "id").alias("canonical_id"), alone.alias("is_new"), alone.alias("is_canonical"))


def follow_decided(uncertain: DataFrame, decisions: DataFrame, resolution: DataFrame) -> DataFrame:
    """Uncertain pairs: those decided to be the same follow their representative, all others (undecided too) become canonical."""
    keys = _keys(uncertain, decisions)
    told = decisions.where("same").select(*keys).distinct()
    follows = follow(_by_key(uncertain, told, keys, "left_semi"), resolution)
    return follows.unionByName(new_canonicals(_by_key(uncertain, told, keys, "left_anti")))


def points(items: DataFrame) -> DataFrame:
    """Registry rows: ``has_thai`` where an English name differs from the name, ``name_th`` then, ``canonical_id`` (its own if canonical)."""
    thai = F.coalesce((F.trim("name_en") != "") & (F.trim("name_en") != F.trim("name")), F.lit(False))
    kind = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("type"), F.lit(""))
    return items.select(
        "id", "name", F.when(F.col("name_en") != "", F.col("name_en")).alias("name_en"), F.when(thai, F.col("name")).alias("name_th"), thai.alias("has_thai"),
        kind.alias("label"), kind.alias("type"), F.when(F.col("community_id") != "", F.col("community_id")).alias("community_id"), "is_canonical",
        F.when(F.col("is_canonical"), F.col("id")).otherwise(F.col("canonical_id")).alias("canonical_id"), shown().alias("dense_text"),
    )


def cache_keys(resolution: DataFrame, kind: str) -> DataFrame:
    """The resolution under its key: kind and name, for predicates the community too; the first by position of a key."""
    community = F.col("community_id") if kind == "predicate" else F.lit(None).cast("string")
    rest = F.struct("pos", "canonical", "canonical_id", "is_new", "is_canonical")
    best = resolution.groupBy(F.lit(kind).alias("kind"), "name", community.alias("community_id")).agg(F.min(rest).alias("b"))
    return best.select("kind", "name", "community_id", "b.canonical", "b.canonical_id", "b.is_new", "b.is_canonical")
