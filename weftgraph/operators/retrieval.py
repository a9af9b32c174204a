"""Sparse, dense and hybrid retrieval."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import sparse_tokens, token_id
from weftgraph.plans.materialize import materialize


#: Rows that a task counts at once, tokens whose ids it remembers, and tokens that are broadcast to pick postings.
ROWS, KNOWN, FEW = 2048, 200_000, 1_000_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows ``id, tokens`` (joined by blanks) the ids, and row, token id and count in the order of the rows; token ids as ``token_id`` makes them, each once."""
    known = {"": -1}
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            lists = pc.split_pattern(b.column(1), " ")
            coded = lists.flatten().dictionary_encode()
            if len(known) > KNOWN:
                known = {"": -1}
            words = coded.dictionary.to_pylist()
            known |= {w: int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") & 2147483647 for w in words if w not in known}
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy())
            both, n = np.unique((row << 31 | ids)[ids >= 0], return_counts=True)
            yield b.column(0), both >> 31, both & 2147483647, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, row, token, n in _counts(batches):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(token), pa.array(n)], ["id", "token_id", "tf"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, row, token, n in _counts(batches):
        ends = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
        lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (token, n))  # 8 bytes a token while they are sorted
        yield pa.RecordBatch.from_arrays([ids, *lists], ["id", "token_id", "tf"])


def among(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """The postings of the given tokens, which are broadcast if their number, which is counted, allows it."""
    tokens = tokens.select("token_id").distinct()
    return postings.join(F.broadcast(tokens) if tokens.count() <= FEW else tokens, "token_id", "left_semi")


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """``id_col, token_id, tf``: counts of each token; the postings of a sparse index, or of the ``tokens`` (``token_id``) alone.

    A row's tokens are counted in the row, and rows with one id are one document. All counts of a row are shuffled as one list, and only
    those of ids that come again are added up; of ``tokens``, their postings alone are shuffled.
    """
    words = docs.select(id_col, F.array_join(sparse_tokens(F.col(text_col)), " ").alias("words"))
    kind = docs.schema[id_col].dataType.simpleString()
    added = lambda rows: rows.groupBy("id", "token_id").agg(F.sum("tf").alias("tf"))
    if tokens is not None:
        rows = added(among(words.mapInArrow(_counted, f"id {kind}, token_id long, tf long"), tokens).repartition("id"))
    else:
        lists = words.mapInArrow(_listed, f"id {kind}, token_id array<int>, tf array<int>").withColumn("rows", F.count("*").over(Window.partitionBy("id")))
        long = lambda c: F.col(c).cast("long").alias(c)
        flat = lambda which: lists.where(which).select("id", F.inline(F.arrays_zip("token_id", "tf"))).select("id", long("token_id"), long("tf"))
        rows = flat("rows = 1").unionAll(added(flat("rows > 1")))
    return rows.withColumnRenamed("id", id_col)


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    token = docs.select(F.explode(sparse_tokens(F.col(text_col))).alias("token")).distinct()
    return token.withColumn("token_id", token_id(F.col("token")))


def sparse_scores(queries: DataFrame, postings: DataFrame, n_docs: int) -> DataFrame:
    """``item_id, doc_id, score``: dot products of query and document counts, weighted by inverse document frequency."""
    df = postings.groupBy("token_id").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = queries.withColumnRenamed("tf", "qtf").join(df, "token_id").select("item_id", "token_id", (F.col("qtf") * idf).alias("w"))
    return weights.join(postings, "token_id").groupBy("item_id", "doc_id").agg(F.sum(F.col("w") * F.col("tf")).alias("score"))


#: Postings of a query that are looked up for a first bound, for each wanted result.
PROBED = 200


def sparse_top_k(queries: DataFrame, postings: DataFrame, n_docs: int, k: int, digits: int = 6) -> DataFrame:
    """``item_id, doc_id, score, rank``: the best ``k`` documents of each query by ``sparse_scores`` (rounded; equals by id), without scoring all that share a token.

    Documents lie in blocks by the logarithm of how many of the queries' tokens they hold, and each token's postings have a greatest count for each block;
    times the token's weight it bounds what the token adds there. Tokens of the most promising blocks are looked up first; their
    partial scores bound the k-th best score from below. A block whose bounds together stay below that is not read, and elsewhere
    the tokens at the end of the falling order whose bounds stay below it cannot make a result by themselves: only documents of the
    other tokens are candidates, of which those go whose partial score cannot reach the bound. What is left gets the other
    tokens' parts by (document, token). Nothing that could be a result is left out.
    """
    slack = 10.0**-digits
    queries = materialize(queries.select("item_id", "token_id", F.col("tf").alias("qtf")), "query-tokens")
    shared = among(postings.select("doc_id", "token_id", "tf"), queries)
    block = F.floor(2 * F.log2(F.sum("tf").over(Window.partitionBy("doc_id")))).cast("int")
    postings = materialize(shared.withColumn("block", block), "postings")
    known = postings.groupBy("token_id", "block").agg(F.count("*").alias("n"), F.max("tf").alias("top"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = queries.join(known.groupBy("token_id").agg(F.sum("n").alias("df")), "token_id").select("item_id", "token_id", (F.col("qtf") * idf).alias("w"))
    weights = own.join(known, "token_id").select("item_id", "token_id", "block", "n", "w", (F.col("w") * F.col("top")).alias("most"))
    falling = Window.partitionBy("item_id", "block").orderBy(F.desc("most"), "token_id")
    weights = weights.withColumn("rest", F.sum("most").over(falling.rowsBetween(0, Window.unboundedFollowing))).withColumn("all", F.sum("most").over(Window.partitionBy("item_id", "block")))
    promising = Window.partitionBy("item_id").orderBy(F.desc("all"), "block", F.desc("most"), "token_id").rowsBetween(Window.unboundedPreceding, 0)
    weights = materialize(weights.withColumn("seen", F.sum("n").over(promising) - F.col("n")), "query-weights")

    def partial(tokens: DataFrame) -> DataFrame:
        return tokens.join(postings, ["token_id", "block"]).groupBy("item_id", "block", "doc_id").agg(F.sum(F.col("w") * F.col("tf")).alias("score"))

    kth = best(partial(weights.where(F.col("seen") < PROBED * k)), "item_id", k, "doc_id").where(F.col("rank") == k).select("item_id", (F.col("score") - slack).alias("bound"))
    weights = materialize(weights.join(kth, "item_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).where("all >= bound"), "query-bounds")
    light = F.col("rest") < F.col("bound")
    others = weights.groupBy("item_id", "block", "bound").agg(F.sum(F.when(light, F.col("most")).otherwise(0.0)).alias("other"))
    found = partial(weights.where(~light)).join(others, ["item_id", "block"]).where(F.col("score") + F.col("other") >= F.col("bound"))
    found = materialize(found.select("item_id", "block", "doc_id", "score"), "candidates")
    more = found.join(weights.where(light).select("item_id", "block", "token_id", "w"), ["item_id", "block"]).join(postings, ["doc_id", "token_id"])
    more = more.groupBy("item_id", "doc_id").agg(F.sum(F.col("w") * F.col("tf")).alias("more"))
    whole = found.join(more, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), digits).alias("score"))
    return best(whole, "item_id", k, "doc_id")


def best(scored: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(a: DataFrame, b: DataFrame, by: str, item: str, limit: int, k: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``by, item, rank``): the best ``limit`` for each query by the rounded score."""
    both = a.select(by, item, "rank").unionAll(b.select(by, item, "rank"))
    return best(both.groupBy(by, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score")), by, limit, item)


def min_max(scored: DataFrame, by: str) -> DataFrame:
    """Scores brought to 0..1 for each query; 1 where all are equal."""
    w = Window.partitionBy(by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("raw_score", F.col("score")).withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def by_names(evidence: DataFrame, entities: list[str], predicates: list[str], match_all: bool = False, communities: list[str] | None = None) -> DataFrame:
    """Evidence that names any of the entities or (``match_all``: and) any of the predicates."""
    e = F.arrays_overlap("entities", F.array(*map(F.lit, entities))) if entities else None
    p = F.arrays_overlap("predicates", F.array(*map(F.lit, predicates))) if predicates else None
    conditions: list[Column] = [c for c in (e, p) if c is not None]
    out = evidence
    if len(conditions) == 2:
        out = out.where(conditions[0] & conditions[1] if match_all else conditions[0] | conditions[1])
    elif conditions:
        out = out.where(conditions[0])
    return out if communities is None else out.where(F.col("community_id").isin(communities))


def ids_by_community(names: DataFrame, links: DataFrame) -> DataFrame:
    """``community_id, ids``: the sorted ids that a community's raw names stand for.

    ``names`` has ``community_id, raw_name``, ``links`` has ``raw_name, canonical_id``. Pairs are made distinct before the
    join, so a frequent name costs one row a community.
    """
    linked = names.select("community_id", "raw_name").distinct().join(links.select("raw_name", "canonical_id").distinct(), "raw_name")
    return linked.groupBy("community_id").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))
