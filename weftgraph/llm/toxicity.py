"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, word pairs and pairs with one word between, hashed into ``2**BITS``
coordinates, present or not. FTRL-proximal keeps a learning rate for each coordinate, and its L1 term
leaves most weights at exactly zero; the others are broadcast as a sorted table (12 bytes each, and there
are no more than coordinates). Training takes a sample of about ``sample_rows`` labelled ids and
``sample_bytes`` bytes of their texts at most, chosen by a hash of the id, and runs in one executor task (FTRL is
sequential); everything is scored.

A null text counts as empty: its score is that of the intercept. Labels other than 0 and 1 are left
out of training; an id labelled both ways counts as 1. Rows that repeat an id are all learned from, in an
order given by id and content. Without labels of both kinds every score is 0. A score of exactly the
caller's limit counts as reaching it. Rows keep their multiplicity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frame import by_rows, over_texts, sampled
from ._words import WORDS, mix, word_hashes

BITS = 22
#: Coordinates whose weights are worked out at once.
PART = 1 << 17


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct coordinates of each text."""
    shift, out = np.uint64(64 - BITS), []
    for w in word_hashes(texts, WORDS):
        pair = mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) if len(w) > 1 else w[:0]
        skip = mix(w[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] + np.uint64(1)) if len(w) > 2 else w[:0]
        out.append(np.unique(np.concatenate((w, pair, skip)) >> shift).astype(np.int32))
    return out


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 3, alpha: float = 1.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1e-3, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, coordinates and weights after passes in shuffled order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = np.zeros(2)  # z and n of the intercept, without L1
    rng = np.random.default_rng(seed)

    def weights(z, n, l1=l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x, y = rows[k]
            zi, ni = z[x], n[x]
            w, b = weights(zi, ni), weights(bias[:1], bias[1:], 0.0)[0]
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[x] = ni + g * g
            bias += (g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / alpha * b, g * g)
    found = [weights(z[k : k + PART], n[k : k + PART]) for k in range(0, len(z), PART)]
    at = np.concatenate([np.flatnonzero(w) + k * PART for k, w in enumerate(found)])
    return float(weights(bias[:1], bias[1:], 0.0)[0]), at.astype(np.int32), np.concatenate([w[w != 0] for w in found])


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 16_000, sample_bytes: int = 256_000_000) -> DataFrame:
    """Texts with their labels, of about ``sample_rows`` labelled ids and ``sample_bytes`` bytes at most; only their texts move."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_weft_id")).agg(F.max(F.col(label_col).cast("int")).alias("_weft_y"))
    own = docs.select(F.col(id_col).alias("_weft_id"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("size")).join(known, "_weft_id")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    few = own.where(sampled("_weft_id", min(sample_rows, n * sample_bytes // max(size, 1)), n)).select("_weft_id", "_weft_y").distinct()
    return docs.join(F.broadcast(few), F.col(id_col) == F.col("_weft_id")).select(F.col(id_col), F.col(text_col), F.col("_weft_y").alias(label_col))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[float, np.ndarray, np.ndarray]:
    """Weights learned from all given rows with label 0 or 1 (a bounded sample, as of ``labelled_rows``)."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"), F.col(label_col).cast("int").alias("y"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches):
            x = [v.tobytes() for v in features(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], ["id", "x", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for b in by_rows(batches, 1 << 30):
            data += zip(b.column(0).to_pylist(), (np.frombuffer(x.as_buffer(), np.int32) for x in b.column(1)), b.column(2).to_pylist(), strict=True)
        data.sort(key=lambda r: (str(r[0]), r[2], len(r[1]), zlib.crc32(r[1])))  # any order of arrival gives the same model
        rows = [(x, y) for _, x, y in data]
        if len({y for _, y in rows}) == 2:
            bias, at, w = ftrl(rows)
            yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([at.tobytes()]), pa.array([w.tobytes()])], ["bias", "at", "w"])

    kind = labelled.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(hashed, f"id {kind}, x binary, y int").repartition(1).mapInArrow(learn, "bias double, at binary, w binary").collect()
    if not found:
        return -1e9, np.empty(0, np.int32), np.empty(0)
    return found[0].bias, np.frombuffer(found[0].at, np.int32), np.frombuffer(found[0].w, np.float64)


def score(df: DataFrame, model: tuple[float, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, and ``score double`` of every row."""
    bias, at, w = model
    sent = df.sparkSession.sparkContext.broadcast((at.tobytes(), w.tobytes()))

    def task():
        at, w = np.frombuffer(sent.value[0], np.int32), np.frombuffer(sent.value[1], np.float64)
        known = np.zeros(1 << BITS, dtype=bool)
        known[at] = True

        def step(texts: list[str]) -> list[pa.Array]:
            total = np.array([w[np.searchsorted(at, x[known[x]])].sum() for x in features([t.encode() for t in texts])], dtype=np.float64) + bias
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))) * (bias > -1e9))]

        return step

    return over_texts(df, text_col, [id_col, *keep], task, "score double")
