"""Exact near-duplicate links between vectors by dual traversal of cover trees.

Vectors are scaled to unit length; cosine >= t is a distance of at most sqrt(2 - 2t). Equal vectors
are one node with a weight. Nodes are dealt into cells around at most ``cells`` sampled centres and, where a
cell is large, by hash into blocks of about ``BLOCK`` nodes; every block builds a cover tree: nested levels whose radii
halve, each node within its parent's radius, with the true covering radius kept. Blocks are dealt into groups of
about ``GROUP`` bytes; a task gets two groups, so a vector is sent once for each group and not for each
block. Pairs of blocks whose balls are further apart than the threshold are pruned; for the others both
trees are descended together, level by level, and pairs of nodes are pruned by the same bound. What reaches
the leaves is compared in double precision. A task returns counts and a spanning forest of its links, never
all links, so a group of n copies costs n rows.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of another length. Every row is a vector of its own, whether its id is null or repeated, and has its own result;
a component is named by the least id in it (null if there is none), and ``kept`` compares ids, null being equal
to null. Scaling is free of overflow, so very large and very small components count as they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components
from weftgraph.plans.materialize import materialize

from ._frame import by_rows

BLOCK = 3072
LEVELS = 12
#: Bytes of vectors in a group of blocks, a task getting two groups.
GROUP = 8_000_000
#: Rows of a matrix product, and pairs of nodes, handled at once.
ROWS, PAIRS = 512, 50_000
#: Bounds are widened by this much distance, more than rounding can make.
SLACK = 1e-6


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


class CoverTree:
    """Nested levels of one block: ``levels[l]`` has the nodes' points, covering radii and child ranges."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        gram = x @ x.T
        order: list[int] = [0]
        starts = [1]  # points of level l: order[:starts[l]]
        parents: list[np.ndarray] = []
        for level in range(1, LEVELS):
            radius = 2.0 ** (1 - level)
            near = 1.0 - radius * radius / 2.0
            before = np.array(order)
            covered = (gram[before] >= near).any(axis=0)
            covered[before] = True
            for p in range(n):
                if not covered[p]:
                    order.append(p)
                    covered |= gram[p] >= near
                    covered[p] = True
            starts.append(len(order))
            parents.append(before[np.argmax(gram[np.ix_(order, before)], axis=1)] if len(before) > 1 else np.zeros(len(order), np.int64))
            if len(order) == n:
                break
        if len(order) < n:
            before = np.array(order)
            rest = np.setdiff1d(np.arange(n), before)
            order.extend(rest.tolist())
            starts.append(n)
            parents.append(before[np.argmax(gram[np.ix_(order, before)], axis=1)])
        self.order = np.array(order)
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        #: By level: number of nodes, covering radius of each, children as a sorted list with offsets.
        self.sizes = starts
        self.radii = [np.zeros(s) for s in starts]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        top = np.arange(n)  # the ancestor of each point at the level at hand
        for level in range(len(starts) - 1, -1, -1):
            d = _distance(gram[self.order[top], self.order])
            np.maximum.at(self.radii[level], top, d)
            if level:
                up = place[parents[level - 1]]
                up[: starts[level - 1]] = np.arange(starts[level - 1])  # nested: a node is its own parent
                by = np.argsort(up, kind="stable")
                self.children.insert(0, (by, np.searchsorted(up[by], np.arange(starts[level - 1] + 1))))
                top = up[top]
        self.x = np.ascontiguousarray(x[self.order])

    def packed(self) -> bytes:
        """The tree without its vectors."""
        radii = [(r + SLACK).astype(np.float32) * (r > 0) for r in self.radii]
        return pickle.dumps((self.sizes, radii, [(a.astype(np.int32), b.astype(np.int32)) for a, b in self.children]))

    @classmethod
    def unpacked(cls, raw: bytes, x: np.ndarray) -> CoverTree:
        """The tree over the vectors in its own order."""
        tree = cls.__new__(cls)
        tree.sizes, radii, tree.children = pickle.loads(raw)
        tree.radii, tree.x, tree.order = [r.astype(np.float64) for r in radii], x, np.arange(len(x))
        return tree


def _children(tree: CoverTree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each given node its children at the next level: which of the given, and the child."""
    by, offsets = tree.children[level]
    counts = offsets[nodes + 1] - offsets[nodes]
    which = np.repeat(np.arange(len(nodes)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, by[offsets[nodes][which] + inner]


def dual_links(a: CoverTree, b: CoverTree, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of points of two trees, or of one (each pair once), in bounded portions."""
    reach = _distance(np.array(cosine)) + SLACK
    level_of = lambda t, level: min(level, len(t.sizes) - 1)
    depth = max(len(a.sizes), len(b.sizes)) - 1
    ra, rb = a.radii[level_of(a, 1)], b.radii[level_of(b, 1)] + reach
    first = b.x[: len(rb)].T
    for s in range(0, len(ra), ROWS):
        e = min(s + ROWS, len(ra))
        bound = ra[s:e, None] + rb[None, :]
        p, q = np.nonzero(a.x[s:e] @ first >= 1.0 - bound * bound / 2.0)
        p += s
        if same:
            p, q = p[p <= q], q[p <= q]
        work = [(min(1, depth), p, q)]
        while work:
            level, p, q = work.pop()
            if len(p) > PAIRS:
                work += [(level, p[k : k + PAIRS], q[k : k + PAIRS]) for k in range(0, len(p), PAIRS)]
                continue
            if level >= depth:
                keep = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= cosine
                if same:
                    keep &= p != q
                yield p[keep], q[keep]
                continue
            la, lb = level_of(a, level), level_of(b, level)
            one = p == q if same else None
            if la + 1 < len(a.sizes):
                which, p = _children(a, la, p)
                q, one = q[which], one[which] if same else None
            if lb + 1 < len(b.sizes):
                which, q = _children(b, lb, q)
                p, one = p[which], one[which] if same else None
            if same:  # children of one node meet in both orders, of two nodes in one
                p, q = np.where(one, p, np.minimum(p, q)), np.where(one, q, np.maximum(p, q))
                p, q = p[p <= q], q[p <= q]
            for k in range(0, len(p), PAIRS):
                ps, qs = p[k : k + PAIRS], q[k : k + PAIRS]
                bound = a.radii[level_of(a, level + 1)][ps] + b.radii[level_of(b, level + 1)][qs] + reach
                keep = np.einsum("ij,ij->i", a.x[ps], b.x[qs]) >= 1.0 - bound * bound / 2.0
                if keep.any():
                    work.append((level + 1, ps[keep], qs[keep]))


def unite(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (the least point of each component so far) after joining the pairs."""
    while len(p):
        x, y = label[p], label[q]
        p, q, x, y = p[x != y], q[x != y], x[x != y], y[x != y]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label = further
    return label


def _unit(raw: bytes, kind: str, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, np.dtype(kind)).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_pairs(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = 256) -> DataFrame:
    """``id_col, n_links long, component_id long, kept boolean`` of every row."""
    spark = df.sparkSession
    element = df.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    v = F.col(vector_col) if element in ("float", "double") else F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    plain = F.transform(v, lambda x: x + F.lit(0).cast(element if element in ("float", "double") else "double"))  # -0 becomes 0
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(good, plain).alias("v"))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    nodes = materialize(rows.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("w"), F.first("v").alias("v")).withColumn("uid", F.monotonically_increasing_id()), "nodes")

    count = nodes.count()
    k = max(1, min(cells, count // BLOCK))
    picked = nodes.orderBy(F.xxhash64(F.lit(3), "h1"), "h2").limit(k).select("v").collect()  # at most `cells` vectors
    centres: dict[int, np.ndarray] = {}
    for row in picked:
        x = np.array([row.v], dtype=kind)
        centres[x.shape[1]] = np.concatenate((centres.get(x.shape[1], np.empty((0, x.shape[1]))), _unit(x.tobytes(), kind, x.shape[1])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column(2)
            lengths = vs.value_lengths().to_numpy(zero_copy_only=False)
            flat, at = vs.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(np.concatenate(([0], lengths)))
            cell, raw = np.zeros(len(lengths), np.int32), [None] * len(lengths)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                block = np.concatenate([flat[at[i] : at[i + 1]] for i in own])
                for i in own:
                    raw[i] = flat[at[i] : at[i + 1]].tobytes()
                if dim in centres:
                    cell[own] = (_unit(block.tobytes(), kind, dim) @ centres[dim].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(lengths.astype(np.int32)), pa.array(cell)], ["uid", "w", "raw", "dim", "cell"])

    dealt = materialize(nodes.select("uid", "w", "v").mapInArrow(deal, "uid long, w long, raw binary, dim int, cell int"), "dealt")
    sized = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = dealt.join(sized, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        first = {c: table.column(c)[:1] for c in ("dim", "cell", "part")}
        raw = table.column("raw").to_pylist()
        tree = CoverTree(_unit(b"".join(raw), kind, table.column("dim")[0].as_py()))
        join = lambda c: pa.array([table.column(c).to_numpy()[tree.order].tobytes()], pa.binary())
        return pa.table(first | {"uids": join("uid"), "ws": join("w"), "raw": pa.array([b"".join(raw[i] for i in tree.order)], pa.binary()), "tree": pa.array([tree.packed()], pa.binary())})

    packed = blocks.select("dim", "cell", "part", "uid", "w", "raw").groupBy("dim", "cell", "part").applyInArrow(pack, "dim int, cell int, part int, uids binary, ws binary, raw binary, tree binary")
    packed = materialize(packed.withColumn("block", F.concat_ws(":", "dim", "cell", "part")), "blocks")

    wide = int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism)))  # groups that keep all cores at work, if there are so many blocks
    n, size = F.count("*"), F.lit(BLOCK * (4 if kind == "<f4" else 8)) * F.first("dim")
    groups = materialize(packed.groupBy("dim").agg(F.greatest(F.ceil(n * size / F.lit(GROUP)), F.least(n, F.lit(wide))).cast("int").alias("groups")), "groups")
    tasks = groups.agg(F.coalesce(F.sum(F.col("groups") * (F.col("groups") + 1.0) / 2), F.lit(0.0)).alias("x")).first().x
    dealt_out = packed.join(groups, "dim").withColumn("own", F.pmod(F.xxhash64("block"), F.col("groups")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt_out = dealt_out.select("dim", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), (F.col("own") > F.col("other")).alias("second"), "block", "uids", "ws", "raw", "tree")
    dealt_out = dealt_out.repartition(max(1, min(int(2 * tasks), 20_000)), "dim", "g", "h").sortWithinPartitions("dim", "g", "h", "block")
    reach = float(_distance(np.array(cosine))) + SLACK

    def linked(one: tuple, two: tuple, same: bool) -> pa.RecordBatch | None:
        (ua, wa, ta), (ub, wb, tb) = one, two
        if float(_distance(ta.x[0] @ tb.x[0])) > ta.radii[0][0] + tb.radii[0][0] + reach:
            return None
        shift = 0 if same else len(ua)
        uid = ua if same else np.concatenate((ua, ub))
        links, label = np.zeros(len(uid), np.int64), np.arange(len(uid))
        for p, q in dual_links(ta, tb, cosine, same):
            links += np.bincount(p, wb[q], len(uid)).astype(np.int64) + np.bincount(q + shift, wa[p], len(uid)).astype(np.int64)
            label = unite(label, p, q + shift)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(uid[label[some]])], ["uid", "n", "root"]) if len(some) else None

    def task(held: list[dict]) -> Iterator[pa.RecordBatch]:
        """All pairs of blocks of two groups, or of one."""
        open_ = lambda r: (np.frombuffer(r["uids"], np.int64), np.frombuffer(r["ws"], np.int64), CoverTree.unpacked(r["tree"], _unit(r["raw"], kind, r["dim"])))
        first, second = [open_(r) for r in held if not r["second"]], [open_(r) for r in held if r["second"]]
        alone = held[0]["g"] == held[0]["h"]
        for i, one in enumerate(first):
            for j, two in enumerate(first[i:] if alone else second):
                if (out := linked(one, two, alone and j == 0)) is not None:
                    yield out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in by_rows(batches, 1):
            row = b.to_pylist()[0]
            if held and [row[c] for c in ("dim", "g", "h")] != [held[0][c] for c in ("dim", "g", "h")]:
                yield from task(held)
                held = []
            held.append(row)
        if held:
            yield from task(held)

    links = materialize(dealt_out.mapInArrow(search, "uid long, n long, root long"), "links")
    totals = links.groupBy("uid").agg(F.sum("n").alias("n"))
    parts = connected_components(links, "uid", "root").select(F.col("id").alias("uid"), F.col("component").alias("c"))
    known = nodes.select("h1", "h2", "uid", "w", "least").join(totals, "uid", "left").join(parts, "uid", "left").withColumn("c", F.coalesce("c", "uid"))
    named = known.groupBy("c").agg(F.min("least").alias("component_id"))
    known = known.join(named, "c").select("h1", "h2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("found"))
    out = rows.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
