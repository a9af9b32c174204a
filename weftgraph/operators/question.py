"""What a question's evidence becomes before planning: filters, indexed sources, selections, chunks.

Evidence has ``question_id, pos, community_id, chunk_id, score, quote, quote_en, entities, predicates``. Selections are made
by the caller's model and come as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import overlap_tokens

from .results import share

OUTPUT = "question_id long, entities array<string>, predicates array<string>, community_ids array<string>, chunk_ids array<string>, canonical_ids array<string>, kind string"


def in_resolved_communities(evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """Evidence in the communities that its question was resolved to (``question_id, community_id``); all of it where there are none."""
    pairs = resolved.select("question_id", "community_id").where("community_id IS NOT NULL").distinct()
    free = evidence.join(pairs.select("question_id").distinct(), "question_id", "left_anti")
    return evidence.join(pairs, ["question_id", "community_id"], "left_semi").select(evidence.columns).unionByName(free)


def structured(evidence: DataFrame) -> DataFrame:
    """One row a question: ``sources`` in order, with numbered entities and predicates and the English quote where there is one, and ``community_ids`` as first seen."""
    numbered = lambda c: F.transform(c, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x))
    quote = F.coalesce(F.when(F.col("quote_en") != "", F.col("quote_en")), "quote", F.lit(""))
    row = F.struct("pos", "community_id", "chunk_id", "score", quote.alias("quote"), numbered("entities").alias("entities"), numbered("predicates").alias("predicates"), F.col("entities").alias("raw_entities"), F.col("predicates").alias("raw_predicates"))
    grouped = evidence.groupBy("question_id").agg(F.sort_array(F.collect_list(row)).alias("sources"))
    return grouped.withColumn("community_ids", F.array_distinct(F.filter(F.transform("sources", lambda s: s["community_id"]), lambda c: c.isNotNull() & (c != ""))))


def sources(structures: DataFrame) -> DataFrame:
    """One row a source, numbered from 0 (``source_no``)."""
    return structures.select("question_id", F.posexplode("sources").alias("source_no", "s")).select("question_id", "source_no", "s.*")


def selected(rows: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """The sources that were chosen (``question_id, source_no``); numbers that name none are ignored, a question without a valid choice keeps all."""
    if chosen is None:
        return rows
    valid = chosen.select("question_id", "source_no").distinct().join(rows.select("question_id", "source_no"), ["question_id", "source_no"], "left_semi")
    free = rows.join(valid.select("question_id").distinct(), "question_id", "left_anti")
    return rows.join(valid, ["question_id", "source_no"], "left_semi").select(rows.columns).unionByName(free)


def everything(rows: DataFrame) -> DataFrame:
    """Choices that keep all: what follows a selection that failed."""
    whole = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select("question_id", "source_no", F.lit(True).alias("relevant"), whole("raw_entities").alias("entity_indices"), whole("raw_predicates").alias("predicate_indices"))


def _named(rows: DataFrame, choices: DataFrame) -> DataFrame:
    own = rows.join(choices.where("relevant"), ["question_id", "source_no"])
    pick = lambda names, at: F.array_compact(F.transform(F.filter(F.coalesce(at, F.array().cast("array<int>")), lambda i: i >= 0), lambda i: F.get(names, i)))
    return own.withColumns({"_e": pick("raw_entities", "entity_indices"), "_p": pick("raw_predicates", "predicate_indices")})


def applied(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """One row a question with relevant sources: sorted distinct ``entities`` and ``predicates``, surviving ``community_ids`` (all where none has one)."""
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = _named(rows, choices).groupBy("question_id").agg(names("_e").alias("entities"), names("_p").alias("predicates"), F.array_sort(F.collect_set(F.when(F.col("community_id") != "", F.col("community_id")))).alias("own"))
    whole = rows.groupBy("question_id").agg(F.array_sort(F.collect_set(F.when(F.col("community_id") != "", F.col("community_id")))).alias("whole"))
    return found.join(whole, "question_id").select("question_id", "entities", "predicates", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("whole")).alias("community_ids"))


def names_by_community(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """``question_id, community_id, raw_entities, raw_predicates``: the chosen names by the community of their source."""
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return _named(rows, choices).where("community_id <> ''").groupBy("question_id", "community_id").agg(names("_e").alias("raw_entities"), names("_p").alias("raw_predicates"))


def chunk_details(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """``question_id, community_id, chunk_id, source_no, score, quote``: the first relevant source of each chunk of each community."""
    own = rows.join(choices.where("relevant").select("question_id", "source_no"), ["question_id", "source_no"], "left_semi").where("chunk_id IS NOT NULL")
    best = own.groupBy("question_id", "community_id", "chunk_id").agg(F.min(F.struct("source_no", "score", "quote")).alias("b"))
    return best.select("question_id", "community_id", "chunk_id", "b.*")


def capped_chunks(details: DataFrame, question: DataFrame, most: int = 5) -> DataFrame:
    """At most ``most`` chunks for each question and community, by their score plus the share of the question's tokens in their quote (noise is kept here); equals in order."""
    q = question.select("question_id", overlap_tokens(F.col("question")).alias("_q"))
    ranked = details.join(q, "question_id").withColumn("rank_score", F.coalesce("score", F.lit(0.0)) + share(F.col("_q"), overlap_tokens(F.coalesce("quote", F.lit("")))))
    w = Window.partitionBy("question_id", "community_id").orderBy(F.desc("rank_score"), "source_no")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_q")


def assembled(names: DataFrame, linked: DataFrame) -> DataFrame:
    """``question_id, raw_names``: the sorted union of all chosen names and of the raw names that were resolved (``question_id, raw_names``)."""
    both = names.select("question_id", F.concat("entities", "predicates").alias("n")).unionAll(linked.select("question_id", "raw_names"))
    return both.select("question_id", F.explode("n").alias("n")).where("n <> ''").groupBy("question_id").agg(F.array_sort(F.collect_set("n")).alias("raw_names"))


def empty_result(spark: SparkSession, question_ids: list[int], kind: str = "general") -> DataFrame:
    """The record of questions that found nothing: empty lists."""
    return spark.createDataFrame([(q, [], [], [], [], [], kind) for q in question_ids], OUTPUT)


def is_empty(community_ids: Column, entities: Column, chunk_ids: Column) -> Column:
    return (F.size(community_ids) == 0) & (F.size(entities) == 0) & (F.size(chunk_ids) == 0)
