"""Answer synthesis around an injected writer: map-reduce over communities, quality bands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summaries(texts: DataFrame, write: Callable[[str, str], str], by: str = "community_id") -> DataFrame:
    """``by, summary``: ``write(community, text)`` for each row of ``by, text``; a failure leaves null and its ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b[by], b["text"], strict=True):
                try:
                    rows.append((key, write(key, text), None))
                except Exception as e:  # noqa: BLE001 - whatever the injected writer raises is this row's error
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=[by, "summary", "error"])

    return texts.select(F.col(by).cast("string").alias(by), "text").mapInPandas(run, f"{by} string, summary string, error string")


def quality(answer: Column, results: Column, signals: list[Column]) -> Column:
    """``no_data`` without results, ``poor`` below 50 characters, then by the number of signals that hold."""
    n = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    return F.when(F.coalesce(results, F.lit(0)) == 0, "no_data").when(F.length(F.trim(F.coalesce(answer, F.lit("")))) < 50, "poor").when(n >= 3, "high").when(n == 2, "medium").otherwise("basic")


#: Said where a question found nothing.
NOTHING = "No results were found for this question."


def no_results(questions: DataFrame, results: DataFrame, by: str = "question_id") -> DataFrame:
    """Questions without any result, with the message to give."""
    return questions.join(results.select(by).distinct(), by, "left_anti").withColumn("answer", F.lit(NOTHING))


def line_counts(texts: DataFrame, by: str) -> DataFrame:
    """``by, n_results``: relationship lines of a text, without blank lines and lines that link names."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & x.contains("->") & ~x.contains("-> (linked) ->"))
    return texts.select(by, F.size(lines).alias("n_results"))


def combined(summaries: DataFrame, combine: Callable[[str], str], by: str = "question_id", order: str = "pos", threshold: int = 3) -> DataFrame:
    """``by, answer``: the summaries of a question's communities in order; ``combine`` makes one answer of ``threshold`` or more of them."""
    rows = summaries.where("summary IS NOT NULL").groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "summary"))), lambda x: x["summary"]).alias("s"))
    one = F.udf(combine, "string", useArrow=True)
    text = F.array_join("s", "\n\n")
    return rows.select(by, F.when(F.size("s") >= threshold, one(text)).otherwise(text).alias("answer"))
