"""Cascading erasure: victims along foreign keys, and copy-on-write of the files that hold them.

``cascade`` takes tables, relations between them and the keys to begin with, and expands a frontier: for each relation the
rows of the child whose foreign key is among the parent's new keys give new keys of the child, until no
table gets any. Relations may form any graph, cycles too. Only the new keys of a round are joined, and known ones are
left out, so each key expands once. Keys are distinct before they meet rows: a parent with very many rows costs each
task one row, and a semi-join with one row a key on the other side can be split at a hot key.

``write_sorted`` lays a table down in files of a stated number of consecutive rows, in a total order; ``rewrite`` reads
the foreign keys of all files, then whole rows of files with victims alone, and writes the survivors to new files, which
take the old ones' places. Spark's Parquet writer makes the files, one task a file (their size is stated by the
caller), so their statistics come from the rows in them. New files move in before old ones go; a run that stops between
leaves a number twice, of which the rewritten one counts.

Null foreign keys reference nothing, and null keys are never victims. Repeated rows live and go together. Orphans stay.
An empty table has no files. Extra columns are written like all others; names beginning with ``_weft`` are reserved.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.materialize import discard, materialize


@dataclass(frozen=True)
class Relation:
    """Rows of ``child`` whose ``column`` is a victim key of ``parent`` are victims; their ``key`` (None: not referenced) goes on."""

    parent: str
    child: str
    column: str
    key: str | None = None


def cascade(tables: dict[str, DataFrame], relations: list[Relation], seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``key``: the distinct victim keys of each table that relations name as a parent, written tables.

    ``seeds`` holds first keys by table, in a column ``key``; a parent may be a name without rows of its own.
    """
    known: dict[str, list[DataFrame]] = {}
    delta = {}
    for name, keys in seeds.items():
        delta[name] = materialize(keys.select("key").where("key IS NOT NULL").distinct(), f"victims-{name}")
        known[name] = [delta[name]]
    while delta:
        found: dict[str, list[DataFrame]] = {}
        for r in relations:
            if r.parent in delta and r.key is not None:
                rows = tables[r.child].select(F.col(r.column).alias("_weft_from"), F.col(r.key).alias("key")).where("key IS NOT NULL")
                keys = delta[r.parent].select(F.col("key").alias("_weft_from"))
                found.setdefault(r.child, []).append(rows.join(keys, "_weft_from", "left_semi").select("key"))
        delta = {}
        for name, parts in found.items():
            new = parts[0]
            for more in parts[1:]:
                new = new.unionAll(more)
            new = new.distinct()
            for old in known.get(name, []):
                new = new.join(old, "key", "left_anti")
            new = materialize(new, f"victims-{name}")
            if new.isEmpty():
                discard(new)
                continue
            delta[name] = new
            known.setdefault(name, []).append(new)
    out = {}
    for name, parts in known.items():
        all_of = parts[0]
        for more in parts[1:]:
            all_of = all_of.unionAll(more)
        out[name] = materialize(all_of, f"victims-{name}") if len(parts) > 1 else all_of
        if len(parts) > 1:
            discard(*parts)
    return out


def is_victim(rows: DataFrame, relations: list[Relation], name: str, victims: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with ``_weft_victim``: whether a relation makes the row of table ``name`` a victim."""
    marks = []
    for k, r in enumerate(r for r in relations if r.child == name and r.parent in victims):
        mark = f"_weft_mark{k}"
        keys = victims[r.parent].select(F.col("key").alias(f"_weft_key{k}"), F.lit(True).alias(mark))
        rows = rows.join(keys, rows[r.column] == keys[f"_weft_key{k}"], "left").drop(f"_weft_key{k}")
        marks.append(mark)
    found = F.coalesce(*marks, F.lit(False)) if marks else F.lit(False)
    return rows.withColumn("_weft_victim", found).drop(*marks)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _move_in(spark: SparkSession, staged: str, folder: str, suffix: str, wanted: set[int] | None = None) -> dict[int, str]:
    """Moves the files that Spark wrote, one a partition, to ``folder`` under their numbers, and removes the rest; the paths by number.

    A folder holds the number of files that the caller states for a table, so the driver may list it.
    """
    files, source = _files(spark, staged)
    _, target = _files(spark, folder)
    files.mkdirs(target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = {}
    for status in files.listStatus(source):
        name = status.getPath().getName()
        if m := re.match(r"part-(\d+)-.*\.parquet$", name):
            number = int(m[1])
            if wanted is None or number in wanted:
                out[number] = f"{folder}/file-{number:05d}{suffix}.parquet"
                if not files.rename(status.getPath(), path(out[number])):
                    raise OSError(f"cannot move {name} to {out[number]}")
    files.delete(source, True)
    return out


def write_sorted(df: DataFrame, folder: str, rows_per_file: int, first_by: list[Column] | None = None, columns: list[str] | None = None) -> dict[int, str]:
    """Writes ``columns`` of all rows to ``folder`` in files of ``rows_per_file`` consecutive rows; the paths by file number.

    Rows order by ``first_by``, then by all columns from left to right, ascending, nulls first. Ranges of
    that order are numbered from the rows in the ranges before them (one row a range), so nothing is sorted in one task.
    """
    spark, columns = df.sparkSession, columns or df.columns
    firsts = {f"_weft_first{k}": c for k, c in enumerate(first_by or [])}
    order = [F.asc_nulls_first(c) for c in (*firsts, *columns)]
    keyed = df.withColumns(firsts).select(*firsts, *columns)
    ranges = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranges = materialize(ranges.select(*columns, F.monotonically_increasing_id().alias("_weft_at")), "sorted")
    part = F.shiftright("_weft_at", 33)
    sizes = ranges.groupBy(part.alias("_weft_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_weft_part", (F.sum("n").over(Window.orderBy("_weft_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_weft_before"))
    total = ranges.count()
    if not total:
        discard(ranges)
        return {}
    pos = F.col("_weft_before") + F.col("_weft_at").bitwiseAND((1 << 33) - 1)
    placed = ranges.withColumn("_weft_part", part).join(F.broadcast(before), "_weft_part")  # a row for each range
    placed = placed.withColumn("_weft_file", F.floor(pos / F.lit(rows_per_file)).cast("int"))
    staged = f"{folder}-staged"
    dealt = placed.repartitionById(-(-total // rows_per_file), F.col("_weft_file")).sortWithinPartitions("_weft_at")
    dealt.select(*columns).write.parquet(staged)
    discard(ranges)
    return _move_in(spark, staged, folder, "")


def _number() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"file-(\d+)", 1).cast("int")


def rewrite(spark: SparkSession, folder: str, paths: dict[int, str], relations: list[Relation], name: str, victims: dict[str, DataFrame]) -> dict[int, tuple[str, int]]:
    """Copy-on-write of one table's files: by number of each final file its path and how many rows it lost."""
    if not paths:
        return {}
    schema = spark.read.parquet(next(iter(paths.values()))).schema
    table = spark.read.schema(schema).parquet(folder)
    own = sorted({r.column for r in relations if r.child == name})
    marked = is_victim(table.select(*own, _number().alias("_weft_file")), relations, name, victims)
    counts = marked.groupBy("_weft_file").agg(F.count("*").alias("n"), F.count(F.when(F.col("_weft_victim"), 1)).alias("gone"))
    lost = {r["_weft_file"]: (r["gone"], r["n"]) for r in counts.where("gone > 0").collect()}  # no more than the table's files
    survivors = {k for k, (gone, n) in lost.items() if gone < n}
    moved: dict[int, str] = {}
    if survivors:
        rows = spark.read.schema(schema).parquet(*(paths[k] for k in sorted(survivors)))
        rows = rows.select(*rows.columns, _number().alias("_weft_file"), F.col("_metadata.row_index").alias("_weft_row"))
        kept = is_victim(rows, relations, name, victims).where("NOT _weft_victim")
        kept = kept.repartitionById(max(survivors) + 1, F.col("_weft_file")).sortWithinPartitions("_weft_row")
        kept.select(*schema.names).write.parquet(f"{folder}-rewritten")
        moved = _move_in(spark, f"{folder}-rewritten", folder, "-rewritten", survivors)
    for k in lost:
        files, old = _files(spark, paths[k])
        files.delete(old, False)
    return {k: (moved.get(k, p), lost.get(k, (0, 0))[0]) for k, p in sorted(paths.items()) if k not in lost or k in survivors}


def file_digests(spark: SparkSession, paths: dict[int, str], id_col: str, money_col: str) -> DataFrame:
    """``file_no, n_rows, cents, ids_sha256`` of files, from their rows: ids in file order are streamed by one task a file, as a hash needs."""
    rows = spark.read.parquet(*(paths[k] for k in sorted(paths)))
    amount = F.col(money_col).cast("double")
    cents = F.when(amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")), 0).otherwise(F.floor(100 * amount + 0.5)).cast("long")
    rows = rows.select(_number().alias("file_no"), F.col("_metadata.row_index").alias("at"), F.col(id_col).cast("string").alias("id"), cents.alias("cents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total, hashed, out = None, 0, 0, None, []
        for b in batches:
            files = b.column(0).to_numpy()
            at = 0
            while at < len(files):
                end = at + int((files[at:] == files[at]).argmin() or len(files) - at)
                text = ",".join(x or "" for x in b.column(1).slice(at, end - at).to_pylist())
                if int(files[at]) != now:
                    if now is not None:
                        out.append((now, n, total, hashed.hexdigest()))
                    now, n, total, hashed = int(files[at]), 0, 0, hashlib.sha256()
                    hashed.update(text.encode())
                else:
                    hashed.update(b"," + text.encode())
                n += end - at
                total += sum(b.column(2).slice(at, end - at).to_pylist())
                at = end
        if now is not None:
            out.append((now, n, total, hashed.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file_no", "n_rows", "cents", "ids_sha256"])

    dealt = rows.repartitionById(max(paths) + 1, F.col("file_no")).sortWithinPartitions("file_no", "at")
    return dealt.select("file_no", "id", "cents").mapInArrow(run, "file_no long, n_rows long, cents long, ids_sha256 string")


def busiest(masters: DataFrame, rows: DataFrame, master_col: str, key_col: str) -> DataFrame:
    """``key``: the master whose members together have most rows (of equals the smallest), also if that is none; no row without masters."""
    members = masters.select(key_col, master_col).where(F.col(master_col).isNotNull()).distinct()
    counts = rows.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.count("*").alias("_weft_n"))
    each = members.join(counts, key_col, "left").groupBy(master_col).agg(F.sum(F.coalesce("_weft_n", F.lit(0))).alias("n"))
    return each.orderBy(F.desc("n"), F.asc(master_col)).limit(1).select(F.col(master_col).alias("key"))
