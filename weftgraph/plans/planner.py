"""From resolved ids to graph queries: branch rules, defaults and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default parameters of each tool (depth and limit).
DEFAULTS = {"graph_hop": {"depth": 1, "limit": 50}, "find_paths": {"depth": 3, "limit": 20}, "community_explore": {"limit": 100}}


def branches(entities: int, predicates: int) -> list[str]:
    if not entities and not predicates:
        return ["community_explore"]
    return ["graph_hop", "find_paths"] if entities >= 2 else ["graph_hop"]


def branches_column(entities: Column, predicates: Column) -> Column:
    return F.when((entities == 0) & (predicates == 0), F.array(F.lit("community_explore"))).when(entities >= 2, F.array(F.lit("graph_hop"), F.lit("find_paths"))).otherwise(F.array(F.lit("graph_hop")))


def question_kind(has_community: Column, communities: Column, entities: Column) -> Column:
    return F.when(has_community & (communities >= 1), "community").when(entities >= 2, "pathing").when(entities == 1, "exploration").otherwise("general")


def completed(specs: list[dict], required: list[tuple[str, str]]) -> list[dict]:
    """Specs with known tools; the first of each required (community, tool) stays, missing ones get the defaults."""
    known: dict[tuple[str, str], dict] = {}
    for spec in specs:
        key = (spec.get("community"), spec.get("tool"))
        if spec.get("tool") in DEFAULTS and key in required:
            known.setdefault(key, spec)
    return [known.get(k) or {"community": k[0], "tool": k[1], **DEFAULTS[k[1]]} for k in required]


def pages(argument: str) -> list[int]:
    """``1,3-5,7`` as sorted distinct page numbers; an error for numbers below 1 and reversed ranges."""
    found: set[int] = set()
    for part in argument.split(","):
        a, _, b = part.strip().partition("-")
        first, last = int(a), int(b or a)
        if first < 1 or last < first:
            raise ValueError(f"no page range: {part}")
        found.update(range(first, last + 1))
    return sorted(found)


def community_specs(ids: DataFrame) -> DataFrame:
    """``community, tool, entities, predicates, depth, limit``: default specs for each community's own ids (``community, entities,
    predicates`` arrays), by the branch rules."""
    specs = ids.select("community", "entities", "predicates", F.explode(branches_column(F.size("entities"), F.size("predicates"))).alias("tool"))
    value = lambda name: F.coalesce(*(F.when(F.col("tool") == t, F.lit(v.get(name)).cast("int")) for t, v in DEFAULTS.items()))
    return specs.select("community", "tool", "entities", "predicates", value("depth").alias("depth"), value("limit").alias("limit"))


def tuned_specs(specs: DataFrame, tuned: DataFrame) -> DataFrame:
    """Specs with the parameters that a model proposed (``community, tool, depth, limit, pos``): the first proposal of a pair counts,
    unknown tools and pairs are ignored, what is missing stays."""
    first = tuned.where(F.col("tool").isin(list(DEFAULTS))).groupBy("community", "tool").agg(F.min(F.struct("pos", F.col("depth").alias("d"), F.col("limit").alias("l"))).alias("b"))
    out = specs.join(first, ["community", "tool"], "left")
    return out.withColumns({"depth": F.coalesce("b.d", "depth"), "limit": F.coalesce("b.l", "limit")}).drop("b")


def label_group_seeds(labels: DataFrame, entities: DataFrame, groups: list[str], chosen: list[str] | None = None, most_groups: int = 3, most_labels: int = 5, per_label: int = 50) -> DataFrame:
    """``id, label`` of entities of the labels of some groups: at most three groups, the chosen (else first) five labels, fifty entities each."""
    from pyspark.sql import Window

    own = labels.where(F.col("grp").isin(groups[:most_groups])).select("label").distinct()
    own = (own if chosen is None else own.where(F.col("label").isin(chosen))).orderBy("label").limit(most_labels)
    w = Window.partitionBy("label").orderBy("id")
    return entities.join(own, "label", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).select("id", "label")


def seeds_from_results(rows: DataFrame) -> DataFrame:
    """Distinct ids in the columns of tool results that hold ids, for a plan from tool outputs."""
    names = [c for c in rows.columns if c in ("canonical_id", "src", "dst", "start", "end", "connected")]
    return rows.select(F.explode(F.array(*names)).alias("id")).where("id IS NOT NULL").distinct()


def chunk_refs(rows: DataFrame) -> DataFrame:
    """Distinct ``community_id, chunk_id`` that graph rows refer to."""
    return rows.select("community_id", "chunk_id").where("community_id IS NOT NULL AND chunk_id IS NOT NULL").distinct()


def run_sql(spark, query: str, tables: dict[str, DataFrame], limit: int = 100, **params) -> DataFrame:
    """A free query over named tables with parameters; ``LIMIT`` is added where the text has none. An error becomes one row ``error, query``."""
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query if "limit" in query.lower() else f"{query} LIMIT {limit}", args=params or None)
    except Exception as e:  # noqa: BLE001 - the caller's text may fail in any way, and the error is the result
        return spark.createDataFrame([(str(e), query)], "error string, query string")
