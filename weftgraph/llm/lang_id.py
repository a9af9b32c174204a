"""Language ID with hyperdimensional profiles.

Each letter has a random vector of ``DIM`` signs. A letter n-gram is bound by multiplying the vectors
of its letters, each rotated by its distance from the n-gram's end; a document bundles (sums) the
vectors of all its n-grams, and a language prototype bundles its documents' unit vectors. A document
takes the language whose prototype, less the mean of all prototypes, has the highest cosine with it.
Runs of anything but letters count as one blank.

Prototypes come from at most ``sample_rows`` rows, chosen by a hash of the id; every text is
predicted whole. Null texts and texts without a letter get ``und`` and score 0; so do all texts where
nothing could be learned. Ties go to the lesser language name. Rows keep their multiplicity.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frame import bounded_sample, by_rows
from ._words import mix

DIM, N = 512, 3
#: Code points looked at together, and distinct n-grams bound together.
PIECE, BLOCK = 1 << 19, 4096
#: Unit vectors are summed as whole numbers of this size, so the sum has no order.
UNIT = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], dtype=bool)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of signs for each code point; the blank's is that of 0."""
    at = points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(DIM // 64, dtype=np.uint64)[None, :]
    bits = np.unpackbits(mix(mix(at + np.uint64(0x5851F42D4C957F2D))).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _normal(text: str) -> np.ndarray:
    """Code points of the letters in lower case, with one 0 for what stands between and at the ends."""
    is_letter = _letters()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.concatenate(([0], np.where(is_letter[points], points, 0), [0]))
    return points[(points > 0) | np.concatenate(([True], points[:-1] > 0))]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them; by a table where values are small."""
    most = int(values.max(initial=0))
    if most > 1 << 22:
        return np.unique(values, return_inverse=True)
    there = np.zeros(most + 1, dtype=np.int64)
    there[values] = 1
    distinct = np.flatnonzero(there)
    there[distinct] = np.arange(len(distinct))
    return distinct, there[values]


def profiles(texts: list[str]) -> np.ndarray:
    """The bundled n-gram vector of each text; zeros where it has no letter."""
    out = np.zeros((len(texts), DIM))
    rows, size, first = [], 0, 0

    def flush(last: int) -> None:
        if not rows:
            return
        flat = np.concatenate(rows)
        if len(flat) < N:
            rows.clear()
            return
        owner = np.repeat(np.arange(first, last), [len(r) for r in rows])
        alphabet, code = _numbered(flat)
        gram, at = np.zeros(len(flat) - N + 1, dtype=np.int64), len(flat) - N + 1
        for k in range(N):
            gram = gram * len(alphabet) + code[k : k + at]
        whole = owner[:at] == owner[N - 1 :]
        gram, who = gram[whole], owner[:at][whole] - first
        grams, which = _numbered(gram)
        letters = letter_vectors(alphabet)
        for a in range(0, len(grams), BLOCK):
            part = grams[a : a + BLOCK]
            bound = np.ones((len(part), DIM), dtype=np.float32)
            rest = part
            for k in range(N):  # the last letter first
                bound *= np.roll(letters, k, axis=1)[rest % len(alphabet)]
                rest = rest // len(alphabet)
            w, k = (who, which) if len(part) == len(grams) else (lambda own: (who[own], which[own] - a))((which >= a) & (which < a + len(part)))
            counts = np.bincount(w * len(part) + k, minlength=(last - first) * len(part))
            out[first:last] += counts.reshape(last - first, len(part)).astype(np.float32) @ bound
        rows.clear()

    for k, text in enumerate(texts):
        points = _normal(text)
        if len(points) > 1:
            rows.append(points)
        else:
            rows.append(np.zeros(1, dtype=points.dtype))
        size += len(points)
        if size > PIECE:
            flush(k + 1)
            first, size = k + 1, 0
    flush(len(texts))
    return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 12_000, parts: int = 12) -> tuple[list[str], np.ndarray]:
    """Names and prototypes of the languages found in the rows (those with null language are left out)."""
    rows = bounded_sample(df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), "id", sample_rows)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in by_rows(batches):
            found = profiles(b.column(0).to_pylist())
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            unit = np.rint(found / np.where(norm > 0, norm, 1) * UNIT).astype(np.int64)
            for lang, v, n in zip(b.column(1).to_pylist(), unit, norm[:, 0], strict=True):
                if n > 0:
                    sums[lang] = sums.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for row in rows.select("text", "lang").repartition(parts).mapInArrow(bundle, "lang string, v binary").collect():
        total[row.lang] = total.get(row.lang, 0) + np.frombuffer(row.v, np.int64)
    names = sorted(total)
    made = np.array([total[k] / np.linalg.norm(total[k]) for k in names]).reshape(len(names), DIM)
    return names, made


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``lang_pred string`` and ``score double`` of every row."""
    names, made = model
    centred = made - made.mean(axis=0) if len(names) > 1 else made
    sent = df.sparkSession.sparkContext.broadcast((names, made, centred))
    cols = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, made, centred = sent.value
        for b in by_rows(batches):
            found = profiles(b.column(0).to_pylist())
            norm = np.linalg.norm(found, axis=1)
            some = (norm > 0) & bool(names)
            lang, score = np.full(len(found), "und", dtype=object), np.zeros(len(found))
            if names:
                size = np.linalg.norm(centred, axis=1)
                best = np.argmax(found @ (centred / np.where(size > 0, size, 1)[:, None]).T, axis=1)
                lang = np.where(some, np.array(names, dtype=object)[best], "und")
                score = np.clip(np.einsum("ij,ij->i", found, made[best]) / np.where(some, norm, 1), 0, 1) * some
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang.tolist(), pa.string()), pa.array(score)], [*(f"c{k}" for k in range(len(cols))), "lang_pred", "score"])

    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(cols)))
    kinds = ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(cols))
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(cols)), "lang_pred", "score")
