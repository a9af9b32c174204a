"""Documents and edges that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftgraph.operators.chunking import lines_of


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def lines(docs: DataFrame) -> DataFrame:
    return lines_of(docs)


def counts_by_window(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum for each window and type; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def append_first_edges(edges: DataFrame, path: str, state: str) -> StreamingQuery:
    """Appends each ``src, edge_type, dst`` once, with the properties of its first batch.

    A batch that is run again after a failure writes its own folder over, so every edge stays once.
    """
    keys = ["src", "edge_type", "dst"]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.min(F.struct(*(c for c in batch.columns if c not in keys))).alias("_b")).select(*keys, "_b.*")
        if number > 0:
            done = spark.read.schema(StructType([*batch.schema.fields]).add("batch", "long")).parquet(path).where(F.col("batch") < number)
            new = new.join(done.select(*keys), keys, "left_anti")
        new.select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
