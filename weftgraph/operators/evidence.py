"""Evidence points that are one by the direction of their vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components
from weftgraph.plans.materialize import materialize

#: Projections whose cells block the comparison, and the least width of a cell.
PROJECTIONS, WIDTH = 4, 0.005


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def _projection(unit: Column, number: int) -> Column:
    """Onto a fixed vector of signs, divided by its length: two units differ in it by no more than their distance."""
    signed = F.transform(unit, lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(number)), F.lit(2)) == 0, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / F.sqrt(F.size(unit).cast("double"))


def _cells(places: list[Column], reach: float, width: float) -> Column:
    """The cells that a neighbour within ``reach`` may have as its own: two for each projection at most, mostly the same one."""
    cell = lambda p: F.floor(p / width).cast("string")
    either = [F.array_distinct(F.array(cell(p - reach), cell(p + reach))) for p in places]
    both = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(" "), y))))
    return reduce(both, either)


def same_direction(points: DataFrame, by: list[str], least: float = 1 - 1e-12) -> DataFrame:
    """``points`` (``vec`` and the columns ``by``) with ``direction``: a number shared by rows of one ``by`` whose cosine is ``least`` or more, along chains.

    Nulls in ``by`` are equal. Null, zero and non-finite vectors, or those with null components, have a null direction. Units equal to
    twelve digits are one before anything is compared, so repeated rows and multiples of one vector cost one row; the rest meets in cells
    of ``PROJECTIONS`` projections, widened by the greatest distance that ``least`` allows, and is checked by its cosine.
    """
    vec = F.col("vec").cast("array<double>")
    norm = _norm(vec)
    good = norm.isNotNull() & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    unit = F.when(good, F.transform(vec, lambda x: x / norm))
    rows = points.withColumn("_unit", unit).withColumn("_near", F.transform("_unit", lambda x: F.round(x, 12) + 0.0))
    keyed = rows.withColumn("_d", F.when(F.col("_near").isNotNull(), F.sha2(F.concat_ws(",", *(F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in by), F.to_json(F.struct("_near"))), 256)))
    reps = keyed.where("_d IS NOT NULL").groupBy("_d").agg(F.min(F.struct(*by, "_unit")).alias("r"))
    reps = materialize(reps.select("_d", F.monotonically_increasing_id().alias("n"), "r.*"), "directions")
    reach = (2 * (1 - least)) ** 0.5 + 1e-12
    width = max(WIDTH, 4 * reach)
    places = [_projection(F.col("_unit"), k) for k in range(PROJECTIONS)]
    same, whole = F.xxhash64(F.lit(0), *by).alias("same"), F.struct(F.lit(0), *by)  # the hash joins, the whole key decides
    home = reps.select(same, "n", "_unit", whole.alias("_by"), F.concat_ws(" ", *(F.floor(p / width).cast("string") for p in places)).alias("cell"))
    near = reps.select(same, F.col("n").alias("n2"), F.col("_unit").alias("_unit2"), whole.alias("_by2"), F.explode(_cells(places, reach, width)).alias("cell"))
    pairs = home.join(near, ["same", "cell"]).where((F.col("n") != F.col("n2")) & F.col("_by").eqNullSafe(F.col("_by2")) & (F.size("_unit") == F.size("_unit2")))
    dot = F.aggregate(F.zip_with("_unit", "_unit2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    found = connected_components(pairs.where(dot >= least).select("n", "n2"), "n", "n2")
    numbers = reps.select("_d", "n").join(found.withColumnRenamed("id", "n"), "n", "left").select("_d", F.coalesce("component", "n").alias("direction"))
    return keyed.join(numbers, "_d", "left").drop("_d", "_unit", "_near")


def merge_by_direction(existing: DataFrame, new: DataFrame, least: float = 1 - 1e-12) -> DataFrame:
    """``id, community_id, chunk_id, entities, predicates, is_new, n_points``: points of one community, chunk and direction are one.

    Both sides have ``id, vec, community_id, chunk_id, entities, predicates``. The id that was there first stays (of several the least), lists
    become sorted unions. A point whose vector has no direction is merged with nothing.
    """
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    placed = same_direction(rows, ["community_id", "chunk_id"], least)
    lists = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    group = [F.col("direction"), F.when(F.col("direction").isNull(), F.col("id")).alias("_alone")]
    found = placed.groupBy(*group).agg(F.min(F.struct("_new", "id", "community_id", "chunk_id")).alias("b"), lists("entities"), lists("predicates"), F.count("*").alias("n_points"))
    return found.select("b.id", "b.community_id", "b.chunk_id", "entities", "predicates", (F.col("b._new") == 1).alias("is_new"), "n_points")
