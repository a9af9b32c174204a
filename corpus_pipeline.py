"""A training corpus from ``documents``: toxicity, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes what a stage returns as Parquet and reads it again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from weftgraph.llm._frame import table, train_part, without
from weftgraph.llm.queries import VOCABULARY
from weftgraph.plans.materialize import materialize

#: Documents with at least this toxicity go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the labels of the training part of the ids teach the score."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled_rows(docs.where(train_part()), labels))
    others = tuple(c for c in docs.columns if c != "doc_id")
    return toxicity.score(docs, model, keep=others).where(F.col("score") < TOXIC).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of 50 words go; so do documents of which nothing is left."""
    blank = F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) == ""
    kept = line_dedup.dedup_lines(docs.withColumn("_weft_had", ~blank), counts=False)
    kept = kept.where(~F.coalesce(F.col("_weft_had") & blank, F.lit(False)))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a Jaccard similarity of 0.8 or more of five-word shingles, the least id stays."""
    classes = ngram_join.join_classes(docs, k=5, percent=80)
    return without(docs, classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, word for word or with other values, go."""
    return without(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    coded = bpe.round_trip(docs, VOCABULARY, keep=("text", "lang", "source", "n_chars"))
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", tokenize),
]

#: The classifier, the join and the BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
