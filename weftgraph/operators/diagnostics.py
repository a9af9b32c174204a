"""Quality of extracted triples against their chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.materialize import materialize


def chunk_coverage(chunks: DataFrame, triples: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """For each chunk: characters, triples, quotes, distinct quotes and their characters as a percentage of the chunk's."""
    quoted = F.trim(F.coalesce("evidence_quote", F.lit(""))) != ""
    counts = triples.groupBy(*keys).agg(F.count("*").alias("n_triples"), F.sum(quoted.cast("int")).alias("n_quotes"))
    distinct = triples.where(quoted).select(*keys, "evidence_quote").distinct().groupBy(*keys).agg(F.count("*").alias("n_unique"), F.sum(F.length("evidence_quote")).alias("unique_chars"))
    out = chunks.join(counts, list(keys), "left").join(distinct, list(keys), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select(*keys, F.length("content").cast("long").alias("chunk_chars"), *(zero(c) for c in ("n_triples", "n_quotes", "n_unique", "unique_chars")))
    share = F.when(F.col("chunk_chars") > 0, F.col("unique_chars") * 100.0 / F.col("chunk_chars")).otherwise(0.0)
    return out.withColumn("n_duplicates", F.col("n_quotes") - F.col("n_unique")).withColumn("coverage", share)


def summary(coverage: DataFrame) -> DataFrame:
    c = F.col("coverage")
    return coverage.agg(
        F.count("*").alias("n_chunks"), F.sum("n_triples").alias("n_triples"), F.avg("n_triples").alias("avg_triples"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_duplicates").alias("n_duplicates"),
        F.avg(c).alias("avg_coverage"), F.sum((F.col("n_quotes") == 0).cast("int")).alias("without_evidence"), F.sum(((c > 0) & (c < 30)).cast("int")).alias("below_30"), F.max(c).alias("best"), F.min(c).alias("worst"),
    )


def triples_histogram(coverage: DataFrame) -> DataFrame:
    """How many chunks have so many triples, and their share in per cent."""
    total = coverage.agg(F.count("*").alias("total"))
    return coverage.groupBy("n_triples").agg(F.count("*").alias("n_chunks")).join(F.broadcast(total)).select("n_triples", "n_chunks", (F.col("n_chunks") * 100.0 / F.col("total")).alias("percent"))


def triples_extremes(coverage: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """The chunks with the least and with the greatest number of triples (``extreme``), and the average over all chunks."""
    ends = coverage.agg(F.avg("n_triples").alias("avg_triples"), F.min("n_triples").alias("_least"), F.max("n_triples").alias("_greatest"))
    kinds = F.array_compact(F.array(F.when(F.col("n_triples") == F.col("_least"), "least"), F.when(F.col("n_triples") == F.col("_greatest"), "greatest")))
    return coverage.join(F.broadcast(ends)).select(F.explode(kinds).alias("extreme"), *keys, "n_triples", "avg_triples")


def word_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct words (column ``word``) of both sides, and the share of the first side's in per cent."""
    x, y = a.select("word").distinct(), b.select("word").distinct().withColumn("hit", F.lit(1))
    return x.join(y, "word", "left").agg(F.count("*").alias("n_words"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_shared"), (F.sum(F.coalesce("hit", F.lit(0))) * 100.0 / F.count("*")).alias("percent"))


#: Three-word runs of quotes that one key's sentences are held against in their rows; keys with more are joined run by run.
RUNS = 4096


def _words(c: str) -> Column:
    return F.split(F.trim(c), r"\s+")


def _of_words(c: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of the words of a text, which are split once: an expression used inside of a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(_words(c)), f), F.lit(0))


def _runs(words: Column) -> Column:
    """Each three words that follow one another; all words where there are fewer."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))


def _exploded_coverage(s: DataFrame, q: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, n_sentences, n_covered`` by a join of single runs, for keys of any size."""
    s = s.select("*", _words("s").alias("w")).withColumn("_k", F.monotonically_increasing_id())
    s = materialize(s, "sentences")  # so the numbers stay, and words are split once
    q = q.distinct().select("*", _words("q").alias("w"))
    own = q.select(*keys, F.explode(_runs(F.col("w"))).alias("g")).distinct()
    runs = s.where(F.size("w") > 3).select(*keys, "_k", F.explode(_runs(F.col("w"))).alias("g"))
    hit = runs.join(own, [*keys, "g"], "left_semi").select("_k")
    short = s.where(F.size("w") <= 3).drop("w").join(q, list(keys)).where(F.expr("contains(q, s)")).select("_k")
    marked = s.join(hit.unionAll(short).distinct().withColumn("_hit", F.lit(1)), "_k", "left")
    return marked.groupBy(*keys).agg(F.count("*").alias("n_sentences"), F.count("_hit").alias("n_covered"))


def sentence_coverage(sentences: DataFrame, quotes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, n_sentences, n_covered, percent``: sentences that a quote of the same keys holds, or of which it holds a run of three words.

    ``sentences`` has ``text``, ``quotes`` ``evidence_quote``; compared in lower case within one key, three-word runs by equal keys. The runs
    of a key's quotes go to its sentences as one array; keys with more than ``RUNS`` are joined run by run, with the same rows.
    """
    s = sentences.select(*keys, F.lower(F.trim("text")).alias("s")).where("s <> ''")
    q = materialize(quotes.select(*keys, F.lower("evidence_quote").alias("q")).where("trim(q) <> ''"), "quotes")
    size = F.sum(F.greatest(F.size(_words("q")) - 2, F.lit(1)))
    large = materialize(q.groupBy(*keys).agg(size.alias("_n")).where(F.col("_n") > RUNS).select(*keys), "large")
    some = not large.isEmpty()
    split = lambda df, how: df.join(large, list(keys), how) if some else df
    lists = split(q, "left_anti").groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(_of_words("q", _runs)))).alias("_runs"), F.collect_list("q").alias("_q"))
    own = split(s, "left_anti").join(lists, list(keys), "left")
    held = F.exists("_q", lambda x: F.contains(x, F.col("s")))
    hit = _of_words("s", lambda w: F.when(F.size(w) > 3, F.arrays_overlap(_runs(w), F.col("_runs"))).otherwise(held))
    out = own.select(*keys, hit.alias("_hit")).groupBy(*keys).agg(F.count("*").alias("n_sentences"), F.count(F.when(F.col("_hit"), 1)).alias("n_covered"))
    if some:
        out = out.unionByName(_exploded_coverage(split(s, "left_semi"), split(q, "left_semi"), keys))
    return out.withColumn("percent", F.col("n_covered") * 100.0 / F.col("n_sentences"))


def compared(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, column, left_value, right_value, status`` (``same``, ``differs``, ``left only``, ``right only``) of the fields of two stores."""
    flat = lambda df, name: df.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot([key], columns, "column", name)
    both = flat(left, "left_value").join(flat(right, "right_value"), [key, "column"], "full")
    a, b = F.col("left_value"), F.col("right_value")
    return both.withColumn("status", F.when(a.eqNullSafe(b), "same").when(b.isNull(), "left only").when(a.isNull(), "right only").otherwise("differs"))


def quote_details(triples: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """``keys, quote_words, quote_lengths`` of the distinct quotes that are not blank: their words, and their lengths, longest first."""
    quotes = triples.where(F.trim("evidence_quote") != "").select(*keys, "evidence_quote").distinct()
    words = F.size(F.split(F.trim("evidence_quote"), r"\s+")).cast("long")
    return quotes.groupBy(*keys).agg(F.sum(words).alias("quote_words"), F.sort_array(F.collect_list(F.length("evidence_quote")), asc=False).alias("quote_lengths"))


def coverage_extremes(coverage: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """``extreme`` (best, worst), the keys of that chunk and its ``coverage``; of equal ones the first by its keys."""
    key = F.struct(*keys)
    best = coverage.agg(F.min(F.struct((-F.col("coverage")).alias("c"), key.alias("k"))).alias("b"), F.min(F.struct(F.col("coverage").alias("c"), key.alias("k"))).alias("w"))
    row = lambda name, c, sign: F.struct(F.lit(name).alias("extreme"), *(F.col(f"{c}.k.{k}").alias(k) for k in keys), (sign * F.col(f"{c}.c")).alias("coverage"))
    return best.where("b IS NOT NULL").select(F.inline(F.array(row("best", "b", F.lit(-1.0)), row("worst", "w", F.lit(1.0)))))
