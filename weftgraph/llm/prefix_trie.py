"""A trie of conversations by their turns, built level by level, and what it would save to share prefixes.

A node of depth ``d`` is a distinct sequence of ``d`` turns (role and text) with which some conversation starts; it is
known by its depth and the smallest conversation id below it. Going down, each level groups the conversations that are
still live by (parent node, next turn) and gives each group its smallest id; a conversation that is alone in its node
leaves, since all below it is a chain. Going up, each level joins the sums of its children: leaves and saved bytes.

Turns are compared by the SHA-256 of role and text, and travel in rows of at most ``SLOTS`` turns, so a conversation of
any length is never gathered in one row. A hot first turn or many equal conversations cost partial aggregates
and joins whose other side has one row a node. Ids that end in one node are hashed in two steps: ranges of (node, id)
give digests of nodes within a range and pieces of text for those across ranges, and one task
streams a node's pieces, since SHA-256 has an order.

Turns order by ``turn`` (nulls first), equals by role and text; null roles and texts are empty. Rows without
a conversation id belong to no conversation. Repeated rows are turns of their own. An empty table gives no node at all.
Extra columns are not read. Turns are numbered over ranges of (conversation, turn), so a conversation may hold most of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.plans.materialize import discard, materialize

#: Turns in one row, nodes of a chain in one piece, and characters of a piece of joined ids.
SLOTS, CHAIN, PIECE = 16, 4096, 1 << 16


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, key, bytes``: the turns of each conversation from 0, the digest of role and text, the text's UTF-8 bytes."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    dealt = materialize(dealt.select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    per = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = per.select("conv_id", "range", before.alias("before")).where("before > 0")  # no more rows than ranges
    pos = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("at")) - 1
    return dealt.withColumn("pos", pos).join(before, ["conv_id", "range"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "key", "bytes")


def rebranched(rows: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversation ``c`` rebuilt: the first ``h`` turns of conversation ``c - c % group``, then its own behind its first ``h``; ``h`` is crc32 of
    the decimal id modulo ``most``.

    Takes and returns ``conv_id, pos, key, bytes``, and gives a row with null ``pos`` for a conversation without turns.
    """
    rows = materialize(rows, "trie-turns")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % group
    of = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.select("conv_id", base.alias("base"), (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).alias("h")).join(of, "base", "left")
    plan = plan.withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = rows.join(plan.select("conv_id", "h", "lead"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "key", "bytes")
    heads = rows.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    lent = heads.join(plan.where("lead > 0").select("conv_id", "base", "lead"), "base").where("pos < lead").select("conv_id", "pos", "key", "bytes")
    none = F.lit(None)
    empty = plan.join(own.select("conv_id").distinct(), "conv_id", "left_anti").where("lead = 0")
    return own.unionByName(lent).unionByName(empty.select("conv_id", none.cast("long").alias("pos"), none.cast("binary").alias("key"), none.cast("long").alias("bytes")))


def _rows_of_slots(rows: DataFrame) -> DataFrame:
    """``conv_id, part, length, slots``: the turns in rows of ``SLOTS``; ``length`` counts all turns of the conversation."""
    part = F.coalesce(F.floor(F.col("pos") / SLOTS), F.lit(0)).cast("long")
    slot = F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "bytes"))
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    length = parts.groupBy("conv_id").agg(F.sum(F.size("slots")).cast("long").alias("length"))
    return parts.join(length, "conv_id")


def _digest(column: Column) -> Column:
    return F.sha2(column.cast("string"), 256)


def _ends(ends: DataFrame) -> DataFrame:
    """``depth, node, ends_sha256`` of ``depth, node, conv_id``: the hash of a node's ids, joined in ascending order."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, size = None, 0, [], 0
        split = True  # the first and the last node of a range may go on in another, a long one goes out in pieces
        for b in batches:
            out = []
            for depth, node, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, node) != now:
                    if now is not None:
                        text = ",".join(ids)
                        out.append((*now, first, text, None) if split else (*now, first, None, hashlib.sha256(text.encode()).hexdigest()))
                        split = False
                    now, first, ids, size = (depth, node), conv, [], 0
                elif size > PIECE:
                    out.append((*now, first, ",".join(ids), None))
                    split, first, ids, size = True, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _pieces(out)
        if now is not None:
            yield _pieces([(*now, first, ",".join(ids), None)])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, out = None, None, []
        for b in batches:
            for depth, node, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, node) != now:
                    if now is not None:
                        out.append((*now, hashed.hexdigest()))
                    now, hashed = (depth, node), hashlib.sha256(text.encode())
                else:
                    hashed.update(b"," + text.encode())
        if now is not None:
            out.append((*now, hashed.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "node", "ends_sha256"), x, strict=True)) for x in out], schema=pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())]))

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(n, "depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    first = materialize(dealt.select("depth", "node", "conv_id").mapInArrow(within, "depth long, node long, at long, text string, ends_sha256 string"), "trie-ends")
    across = first.where("text IS NOT NULL").repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "at")
    rest = across.select("depth", "node", "text").mapInArrow(streamed, "depth long, node long, ends_sha256 string")
    return first.where("text IS NULL").select("depth", "node", "ends_sha256").unionByName(rest)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ("depth", "node", "at", "text", "ends_sha256")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of all conversations' prefixes, from ``conv_id, pos, key, bytes`` (null ``pos``: a conversation without turns).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` (over the subtree:
    members beyond the first, times the bytes of the node's last text) and ``ends_sha256`` (the conversations that end in the node).
    """
    slots = materialize(_rows_of_slots(rows), "trie-slots")
    tops = slots.where("part = 0")
    root = tops.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    long = lambda x: F.lit(x).cast("long")
    live = tops.select("conv_id", long(None).alias("parent"), long(root["node"]).alias("node"), long(root["n"]).alias("n"), long(0).alias("bytes"), "length", "slots")
    levels = [materialize(live, "trie-level")]
    depth = 0
    while True:
        going = levels[depth].where(F.col("length") > depth)
        going = going if depth == 0 else going.where("n > 1")
        if depth and depth % SLOTS == 0:
            going = going.drop("slots").join(slots.where(F.col("part") == depth // SLOTS).select("conv_id", "slots"), "conv_id")
        turn = F.get("slots", F.lit(depth % SLOTS))
        going = going.select("conv_id", F.col("node").alias("parent"), "length", "slots", turn["key"].alias("key"), turn["bytes"].alias("bytes"))
        groups = going.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
        level, seen = going.join(groups, ["parent", "key"]).select("conv_id", "parent", "node", "n", "bytes", "length", "slots"), Observation()
        level = materialize(level.observe(seen, F.count("*").alias("n")), "trie-level")
        if not seen.get["n"]:
            discard(level)
            break
        levels.append(level)
        depth += 1
    discard(slots)

    alone = None  # conversations from the level on at which nobody shares their node
    shared_ends = None
    for d, level in enumerate(levels):
        one = level.where("n = 1 AND conv_id = node") if d else level.limit(0)
        one = one.select("conv_id", "parent", long(d).alias("depth"), "length")
        end = (level.where("n > 1") if d else level).where(F.col("length") == d).select(long(d).alias("depth"), "node", "conv_id")
        alone, shared_ends = (one, end) if alone is None else (alone.unionAll(one), shared_ends.unionAll(end))

    up, done = None, []
    for d in range(len(levels) - 1, -1, -1):
        own = levels[d].where("conv_id = node AND n > 1" if d else "conv_id = node").select("node", "parent", "n", "bytes")
        below = None
        if d + 1 < len(levels):
            single = levels[d + 1].where("n = 1 AND conv_id = node").select(F.col("parent").alias("node"), long(1).alias("n_leaves"), long(0).alias("saved"))
            below = single if up is None else single.unionAll(up.select(F.col("parent").alias("node"), "n_leaves", "saved"))
            below = below.groupBy("node").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
        zero = long(0)
        own = own.withColumns({"children": zero, "leaves": zero, "saved": zero}) if below is None else own.join(below, "node", "left")
        up = materialize(own.select(
            "node", long(d).alias("depth"), "parent", "n", F.coalesce("children", zero).alias("n_children"),
            F.when(F.coalesce("children", zero) == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            (F.coalesce("saved", zero) + (F.col("n") - 1) * F.col("bytes")).alias("saved"),
        ), "trie-up")
        done.append(up)

    inner = done[0]
    for more in done[1:]:
        inner = inner.unionAll(more)
    inner = inner.join(_ends(shared_ends), ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", _digest(F.lit(""))).alias("ends_sha256"),
    )
    pieces = alone.withColumn("from", F.explode(F.sequence("depth", "length", long(CHAIN))))
    chain = pieces.withColumn("at", F.explode(F.sequence("from", F.least(F.col("length"), F.col("from") + CHAIN - 1))))
    last = F.col("at") == F.col("length")
    tails = chain.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), long(1).alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"),
        F.when(last, _digest(F.col("conv_id"))).otherwise(_digest(F.lit(""))).alias("ends_sha256"),
    )
    return inner.unionByName(tails)
