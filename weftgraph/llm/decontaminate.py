"""Benchmark decontamination by template canonicalisation.

Words (ASCII letters and digits and everything beyond ASCII, ASCII lower-cased) become templates:
numbers become ``<number>``, a unit after a number ``<unit>``, a capitalised word inside a sentence
``<name>``; a run of names is one placeholder. A line feed is a blank, an empty line ends a sentence. Windows of ``width`` template words of the benchmark
items are joined by hash with those of every document. Windows that share an item and a diagonal form
an alignment; the words of its whole diagonal are compared exactly, and its slots must be consistent:
one value of the item always meets the same value of the document and the other way round.
Re-parameterised items are thus found, chance agreements of placeholders are not. An item that begins
with a capitalised word is also looked for as a text inside a sentence, and all items are looked for word
for word, so copies are found whatever stands around them.

An item counts as found where an alignment covers ``min(least, item's words)`` template words in a row.
Items of fewer than ``width`` words are matched whole; windows with fewer than ``min(4, width)`` literal
words find copies word for word only, unless they are a whole item. Null or empty texts and items match
nothing, a null item id is an id like others. Texts are taken whole, memory is bounded by one text and one benchmark block:
the benchmark goes to the executors in blocks of at most ``block_words`` words, each a pass over the
documents, so its size has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._frame import by_rows
from ._words import WORDS, hash_spans, windows

#: Units of measure that count as a slot after a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ounce ounces ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros pound pounds usd eur mph kmh hz khz mhz ghz w kw v j kj cal kcal degrees celsius fahrenheit apples coins pages marbles tickets".split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547))
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[0x2C, 0x2E]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x21, 0x2E, 0x3A, 0x3F]] = True


class Words:
    """Words of a text: hashes, kinds (0 literal), spans of their bytes, and the hash of each that is one word as it stands (else 0)."""

    def __init__(self, text: bytes, hashes: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray):
        self.text, self.hash, self.kind, self.starts, self.ends, self.own = text, hashes, kind, starts, ends, own

    def __len__(self) -> int:
        return len(self.hash)

    def value(self, k: int) -> bytes:
        """The word or slot value at a place, lower-cased, with white space made even."""
        return b" ".join(self.text[self.starts[k] : self.ends[k]].lower().split())

    def window_hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows that are used."""
        n = len(self)
        if n < width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = windows(self.hash, width)
        literal = np.concatenate(([0], np.cumsum(self.kind == 0)))
        used = np.flatnonzero(literal[width:] - literal[:-width] >= min(4, width))
        return used, h[used]


class Template(Words):
    """The template words of a text, and in ``raw`` its words as they stand. ``inside``: the text is taken to begin inside a sentence."""

    def __init__(self, text: bytes, inside: bool = False):
        buf = np.frombuffer(text, dtype=np.uint8)
        apart = WORDS[buf]
        digit = _DIGIT[buf]
        if len(buf) > 2:  # a point or comma between digits belongs to the number
            apart[1:-1] &= ~(_POINT[buf[1:-1]] & digit[:-2] & digit[2:])
        starts, ends, h = hash_spans(buf, ~apart)
        self.raw = Words(text, h, np.zeros(len(h), np.int8), starts, ends, h)
        if not len(starts):
            super().__init__(text, h, np.empty(0, np.int8), starts, ends, h)
            return
        other = np.concatenate(([0], np.cumsum(~(digit | apart | _POINT[buf]))))
        stop = _STOP[buf]
        stop[1:] |= (buf[1:] == 0x0A) & (buf[:-1] == 0x0A)  # a wrapped line goes on, an empty one ends
        stops = np.concatenate(([0], np.cumsum(stop)))
        number = digit[starts] & (other[ends] == other[starts])
        after = np.concatenate(([not inside], stops[starts[1:]] > stops[ends[:-1]]))
        name = _UPPER[buf[starts]] & ~after
        kind = name.astype(np.int8) * np.int8(3)
        behind = np.flatnonzero(number[:-1]) + 1
        kind[behind[np.isin(h[behind], UNIT_HASHES)]] = 2
        kind[number] = 1
        first = ~((kind == 3) & np.concatenate(([False], (kind[:-1] == 3) & ~after[1:])))
        last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(first) - 1]))
        own = np.where(last == np.flatnonzero(first), h[first], np.uint64(0))
        kind = kind[first]
        slots = h[first]
        for k, value in ((1, NUMBER), (2, UNIT), (3, NAME)):
            slots[kind == k] = value
        super().__init__(text, slots, kind, starts[first], ends[last], own)


UNIT_HASHES = np.unique(np.concatenate([hash_spans(np.frombuffer(u.encode(), np.uint8), np.ones(len(u), bool))[2] for u in UNITS]))


def consistent_runs(doc: Words, item: Words, shift: int, least: int) -> Iterator[tuple[int, int, bool]]:
    """Longest runs of at least ``least`` item places, on the whole diagonal, that agree with the document: from, to (exclusive), and whether all values are equal.

    A word also agrees with itself where only one side takes it as a slot, as at the beginning of a sentence; and
    with a name of the item, if the document has no capital letter where the item would stand.
    """
    at, upto = max(0, -shift), min(len(item), len(doc) - shift)
    if upto - at < least:
        return
    there, here = slice(at + shift, upto + shift), slice(at, upto)
    agrees = (doc.hash[there] == item.hash[here]) | ((doc.own[there] == item.own[here]) & (item.own[here] != 0))
    lowered = (item.kind[here] == 3) & (doc.kind[there] == 0)
    if lowered.any():
        stands = doc.text[doc.starts[at + shift] : doc.ends[upto + shift - 1]]
        if not _UPPER[np.frombuffer(stands, np.uint8)].any():
            agrees |= lowered
    edge = np.diff(np.concatenate(([0], agrees.view(np.int8), [0])))
    for a, z in zip(np.flatnonzero(edge == 1) + at, np.flatnonzero(edge == -1) + at, strict=True):
        if z - a >= least:
            yield from _consistent(doc, item, shift, int(a), int(z), least)


def _consistent(doc: Words, item: Words, shift: int, at: int, upto: int, least: int) -> Iterator[tuple[int, int, bool]]:
    start = at
    differs = -1
    there: dict[tuple[int, bytes], tuple[bytes, int]] = {}
    back: dict[tuple[int, bytes], tuple[bytes, int]] = {}
    for k in range(at, upto + 1):
        begin = start
        if k < upto:
            kind, a, b = max(int(item.kind[k]), int(doc.kind[k + shift])), item.value(k), doc.value(k + shift)
            if kind == 0:
                begin = start if a == b else k + 1
            else:  # after a clash the run goes on from behind the place it clashes with
                for seen, x, y in ((there, a, b), (back, b, a)):
                    was = seen.get((kind, x))
                    if was and was[0] != y:
                        begin = max(begin, was[1] + 1)
        if (k == upto or begin > start) and k - start >= least:
            yield start, k, differs < start
        if k < upto:
            start = begin
            if kind:
                there[kind, a], back[kind, b] = (b, k), (a, k)
                differs = k if a != b else differs


class Block:
    """Some benchmark items with the sorted hashes of their windows: of their template words, also as inside a sentence, and of their words as they stand."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        items = list(dict.fromkeys(items))  # rows that repeat an item are one
        self.ids = [i for i, _ in items]
        self.items = [Template(t) for _, t in items]
        self.forms: list[tuple[int, Words, bool]] = []
        for k, t in enumerate(self.items):
            inside = Template(t.text, inside=True)
            self.forms.append((k, t, False))
            if not np.array_equal(inside.kind, t.kind):
                self.forms.append((k, inside, False))
            self.forms.append((k, t.raw, True))
        found: dict[tuple[bool, int], list[tuple[int, int, int]]] = {}
        for k, (_, t, raw) in enumerate(self.forms):
            own = min(width, len(t))
            if not own:
                continue
            places, hashes = t.window_hashes(own) if own == width else (np.array([0]), windows(t.hash, own))
            if not len(places):  # all of its windows have too few literal words: the whole item is the window
                own = len(t)
                places, hashes = np.array([0]), windows(t.hash, own)
            for p, h in zip(places.tolist(), hashes.tolist(), strict=True):
                found.setdefault((raw, own), []).append((h, k, p))
        self.tables = {own: (np.array([r[0] for r in sorted(rows)], np.uint64), sorted(rows)) for own, rows in found.items()}

    def find(self, doc: Template, least: int) -> list[tuple[int, int, int, bool]]:
        """Items found in a document: place in the block, longest run, words of the item, whether it is word for word."""
        diagonals: dict[tuple[int, int], None] = {}
        for (raw, own), (hashes, rows) in self.tables.items():
            words = doc.raw if raw else doc
            if len(words) < own:
                continue
            h = windows(words.hash, own)
            left = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == h)
            for p in hit.tolist():
                k = int(left[p])
                while k < len(hashes) and hashes[k] == h[p]:
                    _, form, q = rows[k]
                    diagonals[form, p - q] = None
                    k += 1
        best: dict[int, tuple[int, bool]] = {}
        for f, shift in diagonals:
            k, form, raw = self.forms[f]
            item = self.items[k]
            need = min(least, len(item))
            for a, z, same in consistent_runs(doc.raw if raw else doc, form, shift, max(1, need - max(0, len(item) - len(form)))):
                n = int(np.searchsorted(item.ends, form.ends[z - 1], "right") - np.searchsorted(item.starts, form.starts[a]))
                if n >= need:  # whole template words of the item
                    best[k] = max(best.get(k, (0, False)), (n, same))
        return [(k, run, len(self.items[k]), exact) for k, (run, exact) in sorted(best.items())]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 8, least: int = 13, block_words: int = 2_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document and item found in it: ``id_col``, the columns of ``keep``, ``item_col,
    n_words long, n_item_words long, exact boolean`` (longest run, words of the item, all slots equal)."""
    spark = docs.sparkSession
    names = [id_col, *keep]
    kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names))
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    out_type = f"{kinds}, item {item_kind}, n_words long, n_item_words long, exact boolean"
    rows = docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))

    def one_pass(items: list[tuple[int, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value, width)
            for b in by_rows(batches):
                at, found = [], []
                for k, raw in enumerate(b.column(0).to_pylist()):
                    hits = block.find(Template(raw), least)
                    at.extend([k] * len(hits))
                    found.extend(hits)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in b.columns[1:]), pa.array([block.ids[f[0]] for f in found], item_pa), *(pa.array([f[j] for f in found], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_())))],
                    [*(f"c{k}" for k in range(len(names))), "item", "n_words", "n_item_words", "exact"],
                )

        return rows.mapInArrow(run, out_type)

    item_pa = to_arrow_type(benchmark.schema[item_col].dataType)
    passes: list[DataFrame] = []
    items: list[tuple[int, bytes]] = []
    size = 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.encode(F.coalesce(F.col(item_text), F.lit("")), "UTF-8").alias("t")).toLocalIterator():
        items.append((row.i, bytes(row.t)))
        size += 1 + len(row.t) // 4
        if size > block_words:
            passes.append(one_pass(items))
            items, size = [], 0
    if items or not passes:
        passes.append(one_pass(items))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionAll(more)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), F.col("item").alias(item_col), "n_words", "n_item_words", "exact")
