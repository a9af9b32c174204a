"""The refinement of triples as stages: evidence first, then the registries of entities, predicates and labels, then the triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import triples
from weftgraph.plans.stages import Stage

Resolve = Callable[[str, DataFrame], DataFrame]


def items(kind: str, rows: DataFrame) -> DataFrame:
    """Distinct items of a registry: names of subjects and objects, predicates by community, labels that are not blank."""
    if kind == "predicate":
        return rows.select(F.col("predicate").alias("name"), "community_id").where("name IS NOT NULL").distinct()
    ends = ("subject", "object") if kind == "entity" else ("subject_label", "object_label")
    names = rows.select(F.explode(F.array(*ends)).alias("name")).where("name IS NOT NULL").distinct()
    return names if kind == "entity" else names.where("name <> ''")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Canonical labels of both ends beside their own; without a resolution the label stays."""
    out = rows
    for end in ("subject_label", "object_label"):
        own = labels.select(F.col("name").alias(end), F.col("canonical").alias(f"{end}_name"))
        out = out.join(own, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return out


def stages(resolve: Resolve, params: dict | None = None) -> list[Stage]:
    """Over the input ``triples`` (``subject, predicate, object, evidence_quote, community_id, chunk_id, subject_label, object_label``).

    ``resolve(kind, items)`` gives ``name, canonical, canonical_id`` (predicates: ``community_id`` too) of the items that it resolves;
    ``params`` is what it depends on, so that a change of it runs the registries again.
    """
    registry = lambda kind: Stage(kind, lambda t: resolve(kind, items(kind, t["triples"])), ("triples",), {"resolve": params or {}})
    return [
        Stage("evidence", lambda t: triples.evidence_groups(t["triples"]), ("triples",)),
        registry("entity"),
        registry("predicate"),
        registry("label"),
        Stage("refined", lambda t: with_labels(triples.refined(t["triples"], t["entity"], t["predicate"]), t["label"]), ("triples", "entity", "predicate", "label")),
    ]
