"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.materialize import materialize

#: Rows in a batch that Python sends back; texts and id lists stay small in the JVM's buffers.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand memory that the task no longer uses back to the system: a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_rows(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


def over_texts(df: DataFrame, text_col: str, names: list[str], task: Callable[[], Callable[[list], list[pa.Array]]], result: str) -> DataFrame:
    """The columns ``names`` and those of ``result``, which a function makes of the texts of a few rows; ``task`` gives the function of one task.

    Each column is sent once, null texts arrive as empty ones, and nothing of a task stays in the worker.
    """
    sent = list(dict.fromkeys([text_col, *names]))
    at, made = [sent.index(c) for c in names], [f"m{k}" for k in range(result.count(",") + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = task()
        for b in by_rows(batches):
            texts = [x or "" for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), *step(texts)], [*(f"c{k}" for k in range(len(at))), *made])
        del step

    rows = df.select(*(F.col(c).alias(f"s{k}") for k, c in enumerate(sent)))
    kinds = [f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(names)]
    new = [x.split() for x in result.split(",")]
    out = rows.mapInArrow(run, ", ".join(kinds + [f"m{k} {kind}" for k, (_, kind) in enumerate(new)]))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), *(F.col(f"m{k}").alias(name) for k, (name, _) in enumerate(new)))


def train_part(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is not 1; a null id counts as one of them."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def sampled(id_col: str, rows: int, total: int, seed: int = 11) -> Column:
    """Holds for about ``rows`` of ``total`` rows, chosen by a 64-bit hash of the id; for all if there are no more."""
    if total <= rows:
        return F.lit(True)
    return F.xxhash64(F.lit(seed), F.col(id_col)) < F.lit(((rows << 64) // total) - (1 << 63))


def bounded_sample(df: DataFrame, id_col: str, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the id; all of them where there are fewer."""
    return df.where(sampled(id_col, rows, df.count(), seed))


#: Ids that may be broadcast (8 bytes each); beyond, rows are picked by a shuffle join.
FEW_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """The ids, marked for broadcast if their number, which is counted, allows it."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is not among ``ids``; a null id is an id."""
    gone = few(materialize(ids.select(F.col(id_col).alias("_gone")).distinct(), "ids"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
