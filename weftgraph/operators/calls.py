"""Calls of a model or a service from tasks: bounded concurrency, a share of the rate, back-off, error rows, kept answers.

The caller injects ``ask(request) -> answer`` (strings; it must pickle). What this module adds is what a job of many tasks
needs around it: each distinct request is asked once, however many rows hold it; an answer is kept in a file under the
request's hash as soon as its batch is done, so a task that runs again after a lost executor, and a job that starts again
after a lost driver, ask only what has no answer yet.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Answers as they are kept. ``error`` is null where ``answer`` counts.
KEPT = "key string, answer string, error string, tries int"


@dataclass(frozen=True)
class Policy:
    """How one task calls: threads, requests kept at a time, tries, seconds of the first and of the longest pause, calls a second of the whole job."""

    concurrency: int = 8
    batch: int = 50
    tries: int = 5
    first_wait: float = 5.0
    longest_wait: float = 60.0
    rate: float | None = None


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _kept_keys(files: pafs.FileSystem, folder: str) -> set[str]:
    """Keys that an earlier attempt of this job answered in one bucket."""
    found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    names = [i.path for i in found if i.base_name.endswith(".parquet") and not i.base_name.startswith(".")]
    return {k for name in names for k in pq.read_table(name, columns=["key"], filesystem=files)["key"].to_pylist()}


def _keep(files: pafs.FileSystem, folder: str, rows: pd.DataFrame) -> None:
    """Write one batch under a hidden name first, so a reader sees it whole or not at all."""
    name = uuid.uuid4().hex
    files.create_dir(folder, recursive=True)
    table = pa.table({"key": pa.array(rows["key"], pa.string()), "answer": pa.array(rows["answer"], pa.string()), "error": pa.array(rows["error"], pa.string()), "tries": pa.array(rows["tries"], pa.int32())})
    pq.write_table(table, f"{folder}/.{name}", filesystem=files)
    files.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")


class _Pace:
    """At most one call each ``gap`` seconds among the threads of a task."""

    def __init__(self, gap: float):
        self.gap, self.next, self.lock = gap, 0.0, Lock()

    def wait(self) -> None:
        if self.gap <= 0:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - now))


def _called(ask: Callable[[str], str], request: str, policy: Policy, pace: _Pace) -> tuple[str | None, str | None, int]:
    """``answer, error, tries`` of one request; pauses double from the first to the longest."""
    error = None
    for turn in range(1, policy.tries + 1):
        pace.wait()
        try:
            return ask(request), None, turn
        except Exception as e:  # noqa: BLE001 - whatever the injected function raises counts as a failed try
            error = f"{type(e).__name__}: {e}"
        if turn < policy.tries:
            time.sleep(min(policy.first_wait * 2 ** (turn - 1), policy.longest_wait))
    return None, error, policy.tries


def kept_answers(spark: SparkSession, store: str) -> DataFrame:
    """One row a key of the store: an answer where any run got one, else the last error by text."""
    rows = spark.read.schema(KEPT).option("recursiveFileLookup", "true").parquet(store)
    best = rows.groupBy("key").agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "tries", "answer", "error")).alias("b"))
    return best.select("key", "b.answer", "b.error", "b.tries")


def answered(requests: DataFrame, ask: Callable[[str], str], store: str, request: str = "request", policy: Policy = Policy(), buckets: int | None = None) -> DataFrame:
    """``requests`` with ``answer, error, tries``; an error row where every try failed, ``no request`` where the request is null.

    ``store`` is a folder that all executors share. Requests that have an answer there are not asked; those that have an error are
    asked again. The others are spread over ``buckets`` (one for each 10 000 requests, four for each core at least), which bounds
    what a task holds of its earlier attempt. Existing columns ``answer``, ``error`` and ``tries`` are replaced.
    """
    spark = requests.sparkSession
    rows = requests.drop("answer", "error", "tries").withColumn("_key", F.sha2(F.col(request).cast("string"), 256))
    wanted = rows.where("_key IS NOT NULL").select(F.col("_key").alias("key"), F.col(request).cast("string").alias("request")).dropDuplicates(["key"])
    files, root = _files(store)
    files.create_dir(root, recursive=True)
    left = wanted.join(kept_answers(spark, store).where("error IS NULL").select("key"), "key", "left_anti")
    at_once = spark.sparkContext.defaultParallelism
    n = buckets or max(4 * at_once, -(-left.count() // 10_000))
    gap = min(n, at_once) / policy.rate if policy.rate else 0.0
    run = f"{root}/run-{uuid.uuid4().hex}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, at, seen = _Pace(gap), None, set()
        with ThreadPoolExecutor(policy.concurrency) as pool:
            for b in batches:
                for bucket, own in b.groupby("bucket"):
                    if bucket != at:
                        at, seen = bucket, _kept_keys(files, f"{run}/{bucket}")
                    own = own[~own["key"].isin(seen)]
                    for i in range(0, len(own), policy.batch):
                        some = own.iloc[i : i + policy.batch]
                        got = list(pool.map(lambda r: _called(ask, r, policy, pace), some["request"]))
                        _keep(files, f"{run}/{bucket}", pd.DataFrame({"key": some["key"].tolist(), "answer": [g[0] for g in got], "error": [g[1] for g in got], "tries": [g[2] for g in got]}))
                yield pd.DataFrame({"asked": [len(b)]})

    spread = left.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).repartition(n, "bucket").sortWithinPartitions("bucket", "key")
    spread.mapInPandas(work, "asked long").agg(F.sum("asked")).collect()  # one number; the answers are in the files
    told = kept_answers(spark, store).withColumnRenamed("key", "_key")
    out = rows.join(told, "_key", "left").drop("_key")
    return out.withColumn("error", F.when(F.col(request).isNull(), "no request").otherwise(F.col("error")))
