"""Exact similarity search in blocks: matrix products instead of pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about.
BLOCK = 2048


def _blocks(items: DataFrame, by: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``by, dim, block, name`` (id and vector of about ``BLOCK`` items each), and ``by, dim, n``: the blocks of each group."""
    own = items.where("vec IS NOT NULL AND size(vec) > 0").select(*by, F.size("vec").alias("_dim"), "id", F.col("vec").cast("array<double>").alias("vec"))
    sizes = own.groupBy(*by, "_dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    blocks = own.join(sizes, [*by, "_dim"]).groupBy(*by, "_dim", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("_block"))
    return blocks.agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias(name)), sizes


def _matrix(column: pa.Array, row: int) -> tuple[pa.Array, np.ndarray]:
    items = column[row].values
    flat = items.field("vec").flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(items), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return items.field("id"), x / np.linalg.norm(x, axis=1, keepdims=True)


def _met(left: DataFrame, right: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Every block of the left side beside every block of the right one in its group, of which ``sizes`` has the number."""
    spread = left.join(sizes, [*by, "_dim"]).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return spread.withColumnRenamed("_block", "_mine").join(right.withColumnRenamed("_block", "_other"), [*by, "_dim", "_other"])


def top_k(queries: DataFrame, points: DataFrame, k: int, threshold: float, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``query_id, id, score, rank``: for each query its best ``k`` points of cosine >= threshold (equals by id).

    Both sides have ``id, vec``, and a query meets the points that equal it in the columns ``by``. A block of queries
    and a block of points give one matrix product and at most k rows (and equals) a query; only those are
    shuffled. Null, empty and zero vectors and other lengths match nothing. With ``digits``, scores are rounded
    before they are ranked; points that may equal the k-th one after rounding stay until then.
    """
    by, slack = by or [], 0.0 if digits is None else 10.0**-digits
    left, _ = _blocks(queries, by, "q")
    right, sizes = _blocks(points, by, "p")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                (qs, x), (ps, y) = _matrix(b.column(0), row), _matrix(b.column(1), row)
                s = np.nan_to_num(x @ y.T, nan=-2.0)
                least = np.full(len(s), threshold)
                if s.shape[1] > k:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack)
                i, j = np.nonzero(s >= least[:, None])
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(i)), ps.take(pa.array(j)), pa.array(s[i, j])], ["query_id", "id", "score"])

    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    found = _met(left, right, sizes, by).select("q", "p").mapInArrow(search, kinds)
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """``i, j, score`` of the pairs with id j < i and cosine >= threshold."""
    blocks, sizes = _blocks(items, [], "q")
    pairs = _met(blocks, blocks.withColumnRenamed("q", "p"), sizes, []).where("_other <= _mine")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                (ids, x), (other, y) = _matrix(b.column(0), row), _matrix(b.column(1), row)
                i, j = np.nonzero(x @ y.T >= threshold)
                one, two = np.array(ids)[i], np.array(other)[j]
                score = np.einsum("ij,ij->i", x[i], y[j])
                keep = one > two if b.column(2)[row].as_py() else one != two
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)[keep]), pa.array(np.minimum(one, two)[keep]), pa.array(score[keep])], ["i", "j", "score"])

    kind = items.schema["id"].dataType.simpleString()
    return pairs.select("q", "p", (F.col("_mine") == F.col("_other")).alias("same")).mapInArrow(search, f"i {kind}, j {kind}, score double")
