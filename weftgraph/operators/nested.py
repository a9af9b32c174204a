"""Values of unknown shape: canonical text, leaves with their paths, all text in them. JSON in, VARIANT inside, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.materialize import materialize


def canonical(json: Column) -> Column:
    """JSON with its keys sorted and no spaces, so that equal values have equal texts; null where it is no JSON.

    Numbers lose trailing zeros (``1.50`` is ``1.5``, ``1.0`` is ``1``).
    """
    return F.to_json(F.try_parse_json(json))


def _told(v: Column) -> list[Column]:
    """``kind`` (``more`` for lists and objects, null for null), ``value`` of a scalar, ``_json`` of the others."""
    name = F.substring_index(F.schema_of_variant(v), "<", 1)
    kind = F.when(name.isin("OBJECT", "ARRAY"), "more").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name != "VOID", "number")
    return [kind.alias("kind"), F.try_variant_get(v, "$", "string").alias("value"), F.when(name.isin("OBJECT", "ARRAY"), F.to_json(v)).alias("_json")]


def leaves(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """``keys, path, place, kind, value`` of each scalar in the column ``json``, however deep: one row a leaf of each row.

    ``path`` is ``$.device.os`` or ``$.items[0].sku``, ``place`` its steps (indices filled to ten digits, so that they sort as they stand),
    ``kind`` one of string, number, boolean. Nulls, empty lists and objects, and texts that are no JSON have no leaves.
    Each level is exploded once, set-based, and written; there are as many levels as the deepest value has.
    """
    spark = df.sparkSession
    node = df.select(*keys, F.lit("$").alias("path"), F.array().cast("array<string>").alias("place"), F.try_parse_json(json).alias("_v")).where("_v IS NOT NULL")
    node = node.select(*keys, "path", "place", *_told(F.col("_v")))
    done = None
    while True:
        scalars = node.where("kind <> 'more'").drop("_json")
        done = scalars if done is None else done.unionAll(scalars)
        more = node.where("kind = 'more'")
        if more.isEmpty():
            return done
        inside = more.select(*keys, "path", "place", F.parse_json("_json").alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).withColumnsRenamed({"pos": "_pos", "key": "_key", "value": "_value"}))
        step = F.coalesce(F.col("_key"), F.lpad(F.col("_pos").cast("string"), 10, "0"))
        path = F.concat("path", F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "_key")))
        # what is inside travels as JSON, so a level is written without types that differ from row to row
        node = materialize(inside.select(*keys, path.alias("path"), F.concat("place", F.array(step)).alias("place"), *_told(F.col("_value"))), "level")


def all_text(leaf_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text``: the strings of each value in order of their places (keys sorted), joined by spaces; rows without a string are absent.

    The strings of one value are gathered, as long as the value they come from.
    """
    rows = leaf_rows.where("kind = 'string'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_s"))
    return rows.select(*keys, F.array_join(F.transform("_s", lambda s: s["value"]), " ").alias("text"))


def distinct_values(df: DataFrame, json: str, order: str) -> DataFrame:
    """One row for each value of the column ``json``: ``canonical, n, first`` (least ``order``); what is no JSON is one value each text."""
    text = F.coalesce(canonical(F.col(json)), F.concat(F.lit("text:"), F.col(json)))
    return df.select(text.alias("canonical"), F.col(order).alias("_o")).where("canonical IS NOT NULL").groupBy("canonical").agg(F.count("*").alias("n"), F.min("_o").alias("first"))
