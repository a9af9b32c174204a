"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles. Documents with one set are one class. A first
pass counts, in a count sketch of fixed size that covers all documents, how often each shingle
occurs; (count, hash) is the global order, rare shingles first. Two sets with Jaccard similarity of at
least p/100 share ``t = ceil(p n / 100)`` shingles, n being the larger set's size, so for every l the first
``n - t + l`` shingles of each share at least l. A second pass writes the longest prefixes; from the lengths of
their posting lists each document chooses its own l: it lengthens the prefix by one shingle for each
further required match, as long as the estimated cost of its candidates falls. Two documents are
candidates if their prefixes share as many shingles as the lesser of their two l; each candidate pair
is held against bitmaps and then against the whole sets.

Groups of near copies would be candidates pair by pair. While the estimate of such pairs is beyond
the number of postings, rounds compare each document with one leader of each of its bands only (sets with
equal least hashes in the same few parts of the hash range), and join what links, until they join few. Then
the documents choose their l again, now from what other components have in their lists, and all
candidates between components are compared, so no link between components is lost.

Shingles are 64-bit hashes and sets are known by a 64-bit digest in the posting lists. Null and empty
texts have no shingles and link with nothing; a text with fewer than k words is one shingle. A null id
takes part, with the least id of its component as component (null if it is alone). Rows keep their
multiplicity, extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components
from weftgraph.plans.materialize import discard, materialize

from ._frame import by_rows, few
from ._words import mix, shingles, word_hashes

#: The sketch: rows, counters of a row, and counters of a segment.
DEPTH, WIDTH, SEGMENT = 2, 1 << 17, 1 << 12
#: Most matches asked for, cost of verifying a candidate in posting reads, pairs for each posting that need no rounds.
MOST, VERIFY, DENSE = 6, 20.0, 1
#: Rounds end with one that joins fewer than one in so many of the documents that share a band with another component.
FEW = 50
#: Bands of a set, and parts of the hash range in each.
BANDS, PARTS = 16, 4


def _slots(tokens: np.ndarray) -> np.ndarray:
    bits = np.uint64(64 - (WIDTH.bit_length() - 1))
    return np.stack([(mix(tokens + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) >> bits).astype(np.int64) for r in range(DEPTH)])


def digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The longest prefix that a document may choose, in the global order."""
    n = len(tokens)
    least = -(-percent * n // 100)
    return tokens[np.lexsort((tokens, counts))[: n - least + min(MOST, least)]]


def bands(tokens: np.ndarray) -> np.ndarray:
    """Keys of a set, one for each band: the least hashes in ``PARTS`` parts of the hash range (an empty part has the next one's)."""
    parts = BANDS * PARTS
    at = np.searchsorted(tokens, np.arange(parts, dtype=np.uint64) * np.uint64(2**64 // parts))
    least = tokens[at % len(tokens)].reshape(BANDS, PARTS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(PARTS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least[:, j])
    return h


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit for each slot that a token falls in, of two to four slots a token."""
    size = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(mix(tokens + np.uint64(77)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the longer bitmap is folded."""
    a, b = (np.frombuffer(v, np.uint8) for v in sorted((x, y), key=len))
    if len(a) < len(b):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _sets(batches: Iterator[pa.RecordBatch], k: int, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in by_rows(batches):
        yield b, [shingles(w, k) for w in word_hashes(b.column(column).to_pylist())]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))


def _documents(texts: DataFrame, k: int) -> DataFrame:
    """Pass one: size and digest of every set, and the segments of each task's sketch (``kind`` 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((DEPTH, WIDTH), dtype=np.int64)
        names = ["kind", "id", "n", "f1", "f2", "blob"]
        for b, sets in _sets(batches, k, 1):
            found = [digest(s) if len(s) else (0, 0) for s in sets]
            some = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            for r, slots in enumerate(_slots(some)):
                counters[r] += np.bincount(slots, minlength=WIDTH)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.nulls(m, pa.binary())], names)
        parts = [(i, p) for i, p in enumerate(counters.reshape(-1, SEGMENT)) if p.any()]
        m = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array([i for i, _ in parts], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([zlib.compress(p.tobytes(), 1) for _, p in parts], pa.binary())], names)

    return texts.mapInArrow(run, "kind int, id long, n long, f1 long, f2 long, blob binary")


def _sketch(first: DataFrame) -> np.ndarray:
    """The sum of all sketches: DEPTH x WIDTH counters, whatever the input's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["i", "blob"])

    total = np.zeros((DEPTH * WIDTH // SEGMENT, SEGMENT), dtype=np.int64)
    for row in first.where("kind = 1").select("id", "blob").repartition("id").mapInArrow(add, "i long, blob binary").collect():
        total[row.i] += np.frombuffer(row.blob, np.int64)
    return total.reshape(DEPTH, WIDTH)


def _postings(texts: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """Pass two: ``token, d, n, pos`` for the longest prefixes, and with a ``pos`` of -1 for the bands; a set that a task has seen is not repeated."""
    sent = texts.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        seen: set[int] = set()
        for _, sets in _sets(batches, k, 1):
            out: list[tuple[np.ndarray, int, int, int]] = []
            for s in sets:
                if not len(s) or (d := digest(s)[0]) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(d)
                slots = _slots(s)
                counts = np.minimum.reduce([table[r][slots[r]] for r in range(DEPTH)])
                out += (prefix(s, counts, percent), d, len(s), 0), (bands(s), d, len(s), -1)
            if out:
                size = [len(o[0]) for o in out]
                column = lambda j, t: pa.array(np.repeat(np.array([o[j] for o in out], t), size))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), column(1, np.int64), column(2, np.int32), pa.array(np.concatenate([np.full(x, -1, np.int32) if o[3] else np.arange(x, dtype=np.int32) for o, x in zip(out, size, strict=True)]))], ["token", "d", "n", "pos"])

    return texts.mapInArrow(run, "token long, d long, n int, pos int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (token, d): each once, if its token has another document. Keeps one row back."""
    held: tuple[int, int, int, int] | None = None
    names = ["token", "d", "n", "pos"]
    kept_before = False  # whether the held row's token came before it
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(4)]
        if held is not None:
            cols = [np.concatenate((np.array([h], c.dtype), c)) for h, c in zip(held, cols, strict=True)]
        new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        cols = [c[new] for c in cols]
        like = cols[0][1:] == cols[0][:-1]
        keep = np.concatenate(([kept_before], like)) | np.concatenate((like, [False]))
        held = tuple(c[-1].item() for c in cols)
        kept_before = bool(like[-1]) if len(like) else kept_before
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)
    if held is not None and kept_before:
        yield pa.RecordBatch.from_arrays([pa.array([h], t) for h, t in zip(held, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)


def _crossing(postings: DataFrame) -> DataFrame:
    """The postings whose list holds other components ``c``, with the number ``x`` of the postings of those."""
    own = postings.groupBy("token", "c").agg(F.count("*").alias("own"))
    whole = own.groupBy("token").agg(F.sum("own").alias("whole"), F.count("*").alias("cs")).where("cs > 1")
    return postings.join(own.join(whole, "token").select("token", "c", (F.col("whole") - F.col("own")).alias("x")), ["token", "c"])


def _need(percent: int) -> Column:
    return F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int")


def _base(percent: int) -> Column:
    """Shingles that a set has more than it must share with one of its size."""
    return F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100.0 + percent)).cast("int")


def _chosen(crossing: DataFrame, percent: int) -> DataFrame:
    """The postings of the prefixes that the documents choose, with the number of matches ``ell`` they ask for.

    With l matches a document reads the lists, whose lengths are known, of its first ``base + l`` shingles (``base``
    for partners of its own size, as most are), and has at most reads / l candidates to verify, each at the cost of
    ``VERIFY`` reads.
    """
    need = _need(percent)
    reads = lambda l: F.sum(F.when(F.col("pos") < _base(percent) + l, F.col("x")).otherwise(0))  # noqa: E741, E731
    cost = F.array(*(F.when(F.lit(l) <= need, F.col(f"r{l}") * (1.0 + VERIFY / l) + l).otherwise(F.lit(float("inf"))) for l in range(1, MOST + 1)))  # noqa: E741
    sums = crossing.groupBy("d", "n").agg(*(reads(l).alias(f"r{l}") for l in range(1, MOST + 1)))  # noqa: E741
    ells = sums.select("d", F.array_position(cost, F.array_min(cost)).cast("int").alias("ell"))
    return crossing.join(ells, "d").where(F.col("pos") < F.col("n") - need + F.col("ell")).select("token", "d", "n", "pos", "ell", "c")


def _verified(pairs: DataFrame, df: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, ...]:
    """The pairs ``a, b`` whose whole sets are similar enough.

    Bitmaps, whose differing bits bound the difference of the sets from below, rule out most pairs that are not;
    only the others move whole sets. Then the tables that they are read from.
    """

    def of_documents(pairs: DataFrame, pack, name: str) -> DataFrame:
        wanted = materialize(pairs.select(F.col("a").alias("f1")).unionAll(pairs.select("b")).distinct(), "wanted")
        ids = docs.join(few(wanted), "f1").groupBy("f1", "f2").agg(F.min("id").alias("id")).select("id").distinct()
        ids = materialize(ids, "wanted-ids")
        texts = _texts(df, id_col, text_col)
        texts = texts.join(few(ids), texts["id"].eqNullSafe(ids["id"]), "left_semi")

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for _, sets in _sets(batches, k, 1):
                new = [(d, s) for d, s in ((digest(s)[0], s) for s in sets if len(s)) if d not in seen and not seen.add(d)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], pa.int64()), pa.array([len(s) for _, s in new], pa.int64()), pa.array([pack(s) for _, s in new], pa.binary())], ["d", "n", "s"])

        found = texts.mapInArrow(emit, "d long, n long, s binary")
        return materialize(found.join(few(wanted.withColumnRenamed("f1", "d")), "d", "left_semi"), name)

    def joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("d").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
        return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def keep(similar):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = [similar(n, m, x.as_py(), y.as_py()) for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        return run

    def may_be(n: int, m: int, x: bytes, y: bytes) -> bool:
        both = (n + m - least_difference(x, y)) // 2  # an upper bound
        return 100 * both >= percent * (n + m - both)

    def are(n: int, m: int, x: bytes, y: bytes) -> bool:
        both = n + m - len(np.union1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
        return 100 * both >= percent * (n + m - both)

    maps = of_documents(pairs, bitmap, "bitmaps")
    left = materialize(joined(pairs, maps).mapInArrow(keep(may_be), "a long, b long").distinct(), "left-pairs")
    sets = of_documents(left, lambda s: s.tobytes(), "sets")
    return joined(left, sets).mapInArrow(keep(are), "a long, b long"), maps, left, sets


def join_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """``id_col, n_shingles long, component_id``: one row for each row, with the least id that links reach."""
    texts = _texts(df, id_col, text_col)
    first = materialize(_documents(texts, k), "sets-and-sketch")
    docs = first.where("kind = 0").select("id", "n", "f1", "f2")
    postings = _postings(texts, _sketch(first), k, percent).repartition("token").sortWithinPartitions("token", "d")
    postings = materialize(postings.mapInArrow(_shared, "token long, d long, n int, pos int"), "postings")
    lists, keys = postings.where("pos >= 0"), postings.where("pos < 0")
    total = lists.count()
    similar = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        found, *spent = _verified(pairs, df, docs, id_col, text_col, k, percent)
        found = materialize(found, "links")
        discard(pairs, *spent)
        return found

    links: DataFrame | None = None
    labels: DataFrame | None = None
    turn, merged = 0, 0

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("c", F.col("d"))
        return rows.join(labels.select(F.col("id").alias("d"), F.col("component").alias("_c")), "d", "left").withColumn("c", F.coalesce("_c", "d")).drop("_c")

    while True:
        crossing = materialize(_crossing(labelled(lists)), "crossing")
        now = crossing.where(F.col("pos") <= _base(percent)).agg(F.coalesce(F.sum("x") / 2.0, F.lit(0.0)).alias("x")).first().x
        if now <= DENSE * total:
            break
        rows = materialize(_crossing(labelled(keys)), "keys")
        # First the most central document of each band leads, the one whose bands are the largest; then any.
        rank = F.xxhash64(F.lit(turn), "d") if turn else -F.col("w")
        central = rows.join(rows.groupBy("d").agg(F.sum("x").alias("w")), "d")
        leader = central.groupBy("token").agg(F.min(F.struct(rank, F.xxhash64("d"), F.col("d").alias("l"), F.col("c").alias("lc"), F.col("n").alias("m"))).alias("top"))
        star = rows.join(leader.select("token", "top.l", "top.lc", "top.m"), "token").where((F.col("c") != F.col("lc")) & similar)
        new = verified(star.select(F.least("d", "l").alias("a"), F.greatest("d", "l").alias("b")).distinct())
        links = new if links is None else links.unionAll(new)
        discard(labels)
        labels = connected_components(links, "a", "b")
        turn, before = turn + 1, merged
        merged = labels.where("id <> component").count()
        members = rows.select("d").distinct().count()
        discard(rows)
        if (merged - before) * FEW < members:
            crossing = materialize(_crossing(labelled(lists)), "crossing")
            break
        discard(crossing)
    chosen = materialize(_chosen(crossing, percent), "chosen")
    other = chosen.select("token", F.col("d").alias("e"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("ell").alias("ell2"), F.col("c").alias("c2"))
    # The first l shared shingles of two similar sets stand before n - t + l in both, t being what sets of these sizes must share.
    reach = F.least("ell", "ell2") - F.ceil(percent * (F.col("n") + F.col("m")) / F.lit(100.0 + percent))
    early = (F.col("pos") < F.col("n") + reach) & (F.col("pos2") < F.col("m") + reach)
    pairs = chosen.join(other, "token").where((F.col("d") < F.col("e")) & (F.col("c") != F.col("c2")) & similar & early)
    pairs = pairs.groupBy(F.col("d").alias("a"), F.col("e").alias("b")).agg(F.count("*").alias("x"), F.first(F.least("ell", "ell2")).alias("need")).where("x >= need").select("a", "b")
    new = verified(pairs)
    links = new if links is None else links.unionAll(new)

    classes = docs.where("n > 0").groupBy("f1").agg(F.min("id").alias("least"))
    labels = connected_components(links, "a", "b").select(F.col("id").alias("f1"), F.col("component").alias("c"))
    classes = classes.join(labels, "f1", "left").withColumn("c", F.coalesce("c", "f1"))
    ids = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    by_set = classes.join(ids, "c").select("f1", "component_id")
    out = docs.join(by_set, "f1", "left")
    kind = df.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).cast(kind).alias("component_id"))
