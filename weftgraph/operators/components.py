"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.materialize import discard, materialize


#: Edges that one task may join by itself (16 bytes each, and a table of their nodes).
LOCAL_EDGES = 250_000


def _by_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges that arrive: each node with its component's least node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(up.setdefault(x, x) if x not in up else x), root(up.setdefault(y, y) if y not in up else y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["id", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component``: for each node with an edge to another node, the least node reachable from it.

    Each round hooks every node to its least neighbour if that is less, follows these pointers to
    their roots, and contracts the edges. Every node that is no root disappears, so the number of nodes
    falls by half at least; pointers are followed by doubling. Least neighbours are found with partial
    aggregation, so a node with very many edges costs each task one row. Each round ends in a written
    table, which survives lost executors. Once at most ``LOCAL_EDGES`` edges are left, one task joins them.
    """
    left = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    left = materialize(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while (count := left.count()) > 0:
        if count <= LOCAL_EDGES:
            last = left.coalesce(1).mapInArrow(_by_one_task, "id long, component long")
            if labels is None:
                return materialize(last, "labels")
            last = last.withColumnsRenamed({"id": "component", "component": "further"})
            out = materialize(labels.join(last, "component", "left").select("id", F.coalesce("further", "component").alias("component")), "labels")
            discard(labels, left)
            return out
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        to = written = materialize(to, "pointers")
        while True:
            up = to.select(F.col("a").alias("to"), F.col("to").alias("up"))
            further = materialize(to.join(up, "to").select("a", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")), "pointers")
            discard(written)
            to, written = further.select("a", "to"), further
            if further.where("moved").isEmpty():
                break
        ends = to.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = left
        left = left.join(to, "a").join(ends, "b").select(F.least("to", "tb").alias("a"), F.greatest("to", "tb").alias("b")).where("a <> b").distinct()
        left, spent = materialize(left, "edges"), labels
        if labels is None:
            labels = to.select(F.col("a").alias("id"), F.col("to").alias("component"))
        else:
            new = to.select(F.col("a").alias("component"), F.col("to").alias("further"))
            labels = labels.join(new, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
        labels = materialize(labels, "labels")
        discard(edges, written, spent)
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
