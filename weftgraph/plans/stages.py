"""Runs of named stages that resume: each stage's table is kept under a fingerprint of its inputs and parameters.

A run that was killed starts again with the same call; stages whose whole table is there are read, the others run. A row
for each stage tells what became of it. Tables and rows live in a folder that the driver and all executors share.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.materialize import _folder

STATE = "stage string, fingerprint string, status string, n_rows long, seconds double, error string, finished_at string"


@dataclass(frozen=True)
class Stage:
    """``run(tables)`` gets the tables named in ``needs`` (inputs or earlier stages) and returns a DataFrame. A change of
    ``params`` or ``version`` makes it, and all that need it, run again."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    version: int = 1


class StageFailed(RuntimeError):
    """A stage raised; its state row is written, earlier stages keep their tables."""


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def content_fingerprint(table: DataFrame) -> str:
    """Of the schema and of all rows in any order: their number, and the sum and exclusive or of their hashes."""
    h = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in table.schema.fields))
    row = table.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return _digest(table.schema.json(), *map(str, row))


def _present(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def _note(spark: SparkSession, folder: str, *row: object) -> None:
    now = datetime.now(timezone.utc).isoformat()
    spark.createDataFrame([(*row, now)], STATE).coalesce(1).write.mode("append").parquet(f"{folder}/state")


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each stage: ``stage, fingerprint, status`` (done, reused, failed), ``n_rows, seconds, error, finished_at``."""
    rows = spark.read.schema(STATE).parquet(f"{folder}/state")
    rest = [c for c in rows.columns if c not in ("stage", "finished_at")]
    return rows.groupBy("stage").agg(F.max(F.struct("finished_at", *rest)).alias("b")).select("stage", *(f"b.{c}" for c in rest), "b.finished_at")


def resumed(spark: SparkSession, stages: list[Stage], inputs: dict[str, DataFrame], folder: str, fingerprints: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Run the stages in order and return their tables and the inputs by name.

    ``fingerprints`` of inputs (a table's version, say) save the pass over their rows that finds them otherwise. Names must be
    distinct and needs must come first (``ValueError``). A stage that raises ends the run (``StageFailed``).
    """
    names = [*inputs, *(s.name for s in stages)]
    if len(set(names)) < len(names):
        raise ValueError("names of inputs and stages must be distinct")
    tables = dict(inputs)
    marks = dict(fingerprints or {})
    for s in stages:
        if missing := [n for n in s.needs if n not in tables]:
            raise ValueError(f"{s.name} needs {', '.join(missing)}")
        for n in s.needs:
            if n not in marks:
                marks[n] = content_fingerprint(tables[n])
        mark = marks[s.name] = _digest(s.name, s.params, s.version, [(n, marks[n]) for n in s.needs])
        path, began = f"{folder}/{s.name}-{mark}", time.monotonic()
        status = "reused" if _present(spark, path) else "done"
        try:
            if status == "done":
                # without its success mark the folder is what a killed run left; it is written anew
                s.run({n: tables[n] for n in s.needs}).write.mode("overwrite").parquet(path)
            tables[s.name] = spark.read.parquet(path)
            _note(spark, folder, s.name, mark, status, tables[s.name].count(), time.monotonic() - began, None)
        except Exception as e:
            _note(spark, folder, s.name, mark, "failed", None, time.monotonic() - began, f"{type(e).__name__}: {e}"[:2000])
            raise StageFailed(s.name) from e
    return tables
