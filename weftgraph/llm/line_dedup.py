"""Line dedup by a suffix array over line-ID sequences, with DataFrame functions alone.

Every line is known by its ID; blank lines are skipped, so a run may reach across them. Distributed
prefix doubling ranks the suffixes of all documents: rank 0 orders them by their first line, and rank
k+1, by the first 2**(k+1) lines, comes from the pair of ranks k at a place and 2**k lines on. Ranks are
places in a range-partitioned sort of the distinct pairs; pairs that occur once end no common prefix
and leave the work. Suffixes that share a prefix of t lines are neighbours in the suffix array, an
interval with a longest common prefix of at least t: they have one pair of ranks k at their start and
2**k lines before the prefix's end, for the greatest 2**k <= t.

A repeated run of at least ``min_words`` words is the union of its least windows: from each of its lines
the fewest lines on, and back from each of its lines the fewest lines, that have so many words. Such a
window has at most ``min_words`` lines, so the doubling ends there. In each interval of a window's length the
occurrence that comes first by (id, hash of the text, line) stays, and the lines of all later ones
are deleted; their union is every later copy of every maximal repeated run.

A line's words are the fields between single spaces of the trimmed line. Null texts stay null, without
lines. Rows that repeat id and text count as one document and get one result each; a null id is an id,
the first of all. Extra columns stay as they are. A document's lines are the largest group a task sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.materialize import materialize


#: Bytes of line flags that may be broadcast.
SMALL = 32_000_000


def _ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """Order-preserving names of distinct keys, from a range-partitioned sort; written, so they stay."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(keys.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("r", F.monotonically_increasing_id()), "ranks")


def _joined(left: DataFrame, right: DataFrame, value: str, name: str) -> DataFrame:
    """``left`` with the ``value`` of ``right`` at the document's place ``at``, as ``name``; null ids are equal."""
    found = right.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("j").alias("_j"), F.col(value).alias(name))
    return left.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("at") == F.col("_j"))).drop("_id", "_h", "_j")


def deleted_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``id, h, i``: the lines (from 0) to delete of the document with this id and hash of its text."""
    line = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"] != "")
    lines = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.posexplode(line).alias("j", "s"))
    lines = lines.select("id", "h", "j", F.col("s.i").alias("i"), F.xxhash64("s.x").alias("l1"), F.xxhash64(F.lit(1), "s.x").alias("l2"), (F.length("s.x") - F.length(F.replace("s.x", F.lit(" "), F.lit(""))) + 1).cast("long").alias("w")).distinct()
    lines = materialize(lines, "lines")
    names = _ranked(lines.groupBy("l1", "l2").agg(F.count("*").alias("n")).where("n > 1").select("l1", "l2"), "l1", "l2")

    by_doc = Window.partitionBy("id", "h")
    placed = lines.join(names, ["l1", "l2"], "left").withColumn("upto", F.sum("w").over(by_doc.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("before", F.col("upto") - F.col("w"))
    on = by_doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = by_doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    sizes = {f"{name}_{what}": F.sum(x).over(w) for name, w in (("on", on), ("back", back)) for what, x in (("w", F.col("w")), ("n", F.lit(1)), ("r", F.when(F.col("r").isNotNull(), 1).otherwise(0)))}
    placed = placed.withColumns(sizes).where("r IS NOT NULL")
    whole = lambda k: F.when((F.col(f"{k}_w") >= min_words) & (F.col(f"{k}_n") == F.col(f"{k}_r")), F.col(f"{k}_n"))
    placed = materialize(placed.select("id", "h", F.col("j").cast("long").alias("j"), "i", "r", whole("on").alias("on"), whole("back").alias("back")), "places")

    forward = placed.where("on IS NOT NULL").select("id", "h", "j", F.col("on").alias("t"))
    backward = placed.where("back IS NOT NULL").select("id", "h", (F.col("j") - F.col("back") + 1).alias("j"), F.col("back").alias("t"))
    windows = materialize(forward.unionAll(backward).distinct(), "windows")
    longest = windows.agg(F.coalesce(F.max("t"), F.lit(0)).alias("t")).first().t

    ranks, k, found = placed.select("id", "h", "j", "r"), 0, None
    while 1 << k <= longest:
        size = 1 << k
        own = windows.where((F.col("t") >= size) & (F.col("t") < 2 * size))
        a = _joined(own.withColumn("at", F.col("j")), ranks, "r", "a")
        b = _joined(a.withColumn("at", F.col("j") + F.col("t") - size), ranks, "r", "b")
        keyed = materialize(b.select("id", "h", "j", "t", "a", "b"), "intervals")
        first = keyed.groupBy("t", "a", "b").agg(F.min(F.struct("id", "h", "j")).alias("first"), F.count("*").alias("n")).where("n > 1").select("t", "a", "b", "first")
        later = keyed.join(first, ["t", "a", "b"]).where(~F.struct("id", "h", "j").eqNullSafe(F.col("first"))).select("id", "h", "j", "t")
        found = later if found is None else found.unionAll(later)
        k += 1
        if 1 << k <= longest:
            pairs = materialize(_joined(ranks.withColumn("at", F.col("j") + size), ranks, "r", "r2").select("id", "h", "j", "r", "r2"), "pairs")
            names = _ranked(pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("r").alias("r1"), "r2"), "r1", "r2")
            ranks = materialize(pairs.withColumnRenamed("r", "r1").join(names, ["r1", "r2"]).select("id", "h", "j", "r"), "suffix-ranks")
    if found is None:
        found = windows
    gone = found.select("id", "h", F.explode(F.sequence(F.col("j"), F.col("j") + F.col("t") - 1)).alias("at")).distinct()
    return _joined(gone, placed, "i", "i").select("id", "h", "i")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, counts: bool = True) -> DataFrame:
    """All rows and columns of ``df``, the text without its deleted lines; with ``counts`` also
    ``n_lines long`` and ``n_deleted long``, in place of columns with these names."""
    h, mark = "_weft_h", "_weft_gone"
    gone = deleted_lines(df, id_col, text_col, min_words).groupBy("id", "h").agg(F.sort_array(F.collect_list("i")).alias("gone"))
    # For each of the document's lines up to the last deleted one, whether it goes.
    flags = F.array_join(F.transform("gone", lambda x, k: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("gone", k - 1), F.lit(-1)) - 1), F.lit("1"))), "")
    gone = materialize(gone.select(F.col("id").alias("_weft_id"), F.col("h").alias("_weft_h2"), F.transform(F.split(flags, ""), lambda c: c == "1").alias(mark), F.size("gone").cast("long").alias("_weft_n")), "deleted")
    if gone.agg(F.coalesce(F.sum(F.size(mark) + 64), F.lit(0)).alias("x")).first().x <= SMALL:
        gone = F.broadcast(gone)  # else the texts are dealt out by document
    rows = df.withColumn(h, F.xxhash64(text_col))
    out = rows.join(gone, rows[id_col].eqNullSafe(gone["_weft_id"]) & (rows[h] == gone["_weft_h2"]), "left")
    lines = F.split(text_col, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(mark, i), F.lit(False))), "\n")
    new = {text_col: F.when(F.col(mark).isNull(), F.col(text_col)).otherwise(kept)}
    if counts:
        new |= {"n_lines": F.coalesce(F.size(lines).cast("long"), F.lit(0)) * F.col(text_col).isNotNull().cast("long"), "n_deleted": F.coalesce("_weft_n", F.lit(0)).cast("long")}
    return out.withColumns(new).drop(h, mark, "_weft_id", "_weft_h2", "_weft_n")
