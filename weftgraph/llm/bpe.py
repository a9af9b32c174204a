"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie (sorted bytes; neighbours share their common prefix). A
depth-first walk carries, for every prefix on the path, the last token of its encoding. The encoding
of a prefix is the encoding of a shorter prefix plus that token: among the tokens that end the
prefix, the one that forms a valid pair with the last token of what stands before it. So encodings of
shared prefixes are computed once, and the walk costs one step for each trie edge.

Nulls count as empty texts (no ids, empty decoding). Rows keep their order and multiplicity; extra
columns are not returned. Memory: one batch, the vocabulary as flat arrays (made of the file by the driver), and a
task's caches: words of about ``CACHE_BYTES`` bytes in all (a word longer than ``LONG`` characters is never kept; of two
halves the older goes, and what is used again moves to the newer), ``CACHE_STEPS`` steps of the automaton,
``CACHE_PAIRS`` pairs and ``CACHE_SPINES`` lists of a token's parts. They end with the task.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frame import give_back, over_texts
from ._pieces import WHITE, encoded

CACHE_BYTES, LONG, CACHE_STEPS, CACHE_PAIRS, CACHE_SPINES = 32_000_000, 200, 100_000, 150_000, 20_000
#: Characters of texts that are cut into words at once, about; a text is never divided.
CHARS = 1 << 19

#: Fixed value: the public byte-level splitting pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files of byte-level tokenizers."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Tables:
    """A vocabulary as flat arrays, which the driver makes of the file once; a worker that reads the file itself keeps several times as much.

    The nodes of the automaton over bytes are numbered by depth, then by parent and byte, so the ``i``-th of the
    sorted keys (parent << 8 | byte) is the edge to node ``i + 1``. The root is 0.
    """

    edges: np.ndarray  # keys of the edges, int64
    fail: np.ndarray  # by node: the node of the longest proper suffix
    depth: np.ndarray
    token: np.ndarray  # by node: the token that it spells, or -1
    pairs: np.ndarray  # by rank of a merge: left token << 32 | right token, int64
    parts: np.ndarray  # by token: left part, right part and rank of its first merge, or -1
    ids: np.ndarray
    raw: bytes  # the bytes of ``ids`` one behind the other
    sizes: np.ndarray
    special: dict[str, int]


def tables(file: bytes) -> Tables:
    spec = json.loads(file)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
    special = spec["added_tokens"]
    if not plain or spec["normalizer"] or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
        raise ValueError("only byte-level BPE files without normaliser and without prefix space are read")
    alphabet = byte_alphabet()
    as_bytes = lambda s: bytes(alphabet[c] for c in s)
    extra = {t["content"]: t["id"] for t in special}
    ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in extra}
    merges = [(ids[as_bytes(a)], ids[as_bytes(b)], ids[as_bytes(a + b)]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    parts = np.full((max([*ids.values(), *extra.values()], default=-1) + 1, 3), -1, dtype=np.int32)
    for r, (a, b, c) in reversed(list(enumerate(merges))):
        parts[c] = a, b, r
    pairs = np.array([a << 32 | b for a, b, _ in merges], dtype=np.int64)
    shown = {i: raw for raw, i in ids.items()} | {i: s.encode() for s, i in extra.items()}
    sizes = np.fromiter(map(len, shown.values()), dtype=np.int32, count=len(shown))
    return Tables(*_automaton(ids), pairs, parts, np.fromiter(shown, dtype=np.int32, count=len(shown)), b"".join(shown.values()), sizes, extra)


def _automaton(ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges, fail links, depths and tokens of the nodes, one depth after the other."""
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    first = np.cumsum(size) - size
    flat, token_of = np.frombuffer(b"".join(ids), dtype=np.uint8), np.fromiter(ids.values(), dtype=np.int32, count=len(ids))
    at = np.zeros(len(ids), dtype=np.int64)  # by token: the node of its first bytes
    edges, fail, depth, token = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int16), np.full(1, -1, dtype=np.int32)
    for d in range(1, int(size.max(initial=0)) + 1):
        here = np.flatnonzero(size >= d)
        keys, number = np.unique(at[here] << 8 | flat[first[here] + d - 1], return_inverse=True)
        at[here] = number + len(fail)
        own = np.full(len(keys), -1, dtype=np.int32)
        ended = size[here] == d
        own[number[ended]] = token_of[here[ended]]
        # the longest suffix of the parent from which the byte goes on; depth 1 falls back to the root
        link, of, b = np.zeros(len(keys), dtype=np.int32), np.arange(len(keys) if d > 1 else 0), keys & 255
        back = fail[keys >> 8]
        while len(of):
            wanted = back[of].astype(np.int64) << 8 | b[of]
            place = np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)
            found = edges[place] == wanted
            link[of[found]] = place[found] + 1
            of = of[~found & (back[of] > 0)]
            back[of] = fail[back[of]]
        edges, fail = np.concatenate((edges, keys)), np.concatenate((fail, link))
        depth, token = np.concatenate((depth, np.full(len(keys), d, dtype=np.int16))), np.concatenate((token, own))
    return edges, fail, depth, token


class TrieBpe:
    """A byte-level BPE vocabulary, given as its file or as the tables made of it, with the traversal."""

    def __init__(self, source: bytes | Tables):
        t = tables(source) if isinstance(source, bytes) else source
        plain = lambda kind, values: array(kind, values.tobytes())  # noqa: E731 (single numbers are read faster than from numpy)
        self.edges, self.fail, self.depth, self.token = plain("q", t.edges), plain("i", t.fail), plain("h", t.depth), plain("i", t.token)
        self.rank = dict(zip(t.pairs.tolist(), range(len(t.pairs)), strict=True))
        self.parts, self.made = (plain("i", t.parts[:, 0].copy()), plain("i", t.parts[:, 1].copy())), plain("i", t.parts[:, 2].copy())
        ends = np.cumsum(t.sizes).tolist()
        self.bytes = {i: t.raw[end - n : end] for i, n, end in zip(t.ids.tolist(), t.sizes.tolist(), ends, strict=True)}
        self.special = t.special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(t.special, key=len, reverse=True)) + ")") if t.special else None
        self.step: dict[int, int] = {}  # node << 8 | byte: the next node
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}  # by node that a step leads to: the tokens that end there, as (size, id), longest first
        self.spines: dict[int, list[tuple[int, float]]] = {}
        self.valid: dict[int, bool] = {}  # left token << 32 | right token
        self.words: dict[str, bytes] = {}  # ids as int32
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the words, about

    def next_node(self, node: int, b: int) -> int:
        key, edges = node << 8 | b, self.edges
        while (at := bisect_left(edges, node << 8 | b)) == len(edges) or edges[at] != node << 8 | b:
            if not node:
                at = -1
                break
            node = self.fail[node]
        if len(self.step) >= CACHE_STEPS:
            self.step.clear()  # the walk holds on to these dictionaries
            self.ends.clear()
        found = self.step[key] = at + 1
        if found not in self.ends:
            here, out = found, []
            while here:
                if self.token[here] >= 0:
                    out.append((self.depth[here], self.token[here]))
                here = self.fail[here]
            self.ends[found] = tuple(out)
        return found

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that stand at its right (1) or left (0) end while it is put together, each with the rank of the merge that takes it up."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if self.made[token] < 0:
                return out
            until = self.made[token]
            token = self.parts[side][token]

    def is_pair(self, a: int, b: int) -> bool:
        """Whether the bytes of the two tokens are encoded as these two tokens.

        They are unless some merge across the border comes before the merges that take up the two
        parts it joins. Of equal merges the leftmost comes first: the one within ``a`` before, the
        one within ``b`` after the one across.
        """
        found = self.valid.get(a << 32 | b)
        if found is None:
            if len(self.valid) > CACHE_PAIRS:
                self.valid.clear()
            if len(self.spines) > CACHE_SPINES:
                self.spines.clear()
            left, right = (self.spines.get(k) or self.spines.setdefault(k, self.spine(k >> 1, k & 1)) for k in (a << 1 | 1, b << 1))
            rank = self.rank.get
            found = self.valid[a << 32 | b] = not any((r := rank(x << 32 | y)) is not None and r < p and r <= q for x, p in left for y, q in right)
        return found

    def traverse(self, words: Iterable[str]) -> Iterator[tuple[str, array]]:
        """Encodings of distinct words, in the order of a depth-first walk over their trie."""
        following, ends, known = self.step.get, self.ends, self.valid.get
        path, last, back, nodes = b"", [-1], [0], [0]  # by length of prefix: the last token, its length, the automaton's node
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for x, y in zip(raw, path):  # noqa: B905
                if x != y:
                    break
                shared += 1
            room = len(raw) + 1 - len(last)
            if room > 0:
                for states in (last, back, nodes):
                    states.extend([0] * room)
            node, end = nodes[shared], shared
            for b in raw[shared:]:
                end += 1
                at = node << 8 | b
                node = following(at)
                if node is None:
                    node = self.next_node(at >> 8, b)
                for size, token in ends[node]:  # noqa: B007
                    if size == end:
                        break
                    before = last[end - size]
                    found = known(before << 32 | token)
                    if found or (found is None and self.is_pair(before, token)):
                        break
                last[end], back[end], nodes[end] = token, size, node
            path, at, out = raw, len(raw), array("i")
            while at:
                out.append(last[at])
                at -= back[at]
            out.reverse()
            yield word, out

    def _words(self, words: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES // 2:
            self.older, self.words, self.held = self.words, {}, 0
        new = [w for w in words if w not in self.words]
        found = {w: array("i", (self.special[w],)).tobytes() if w in self.special else self.older[w] for w in new if w in self.special or w in self.older}
        self.words.update(found)
        self.words.update((w, ids.tobytes()) for w, ids in self.traverse(w for w in new if w not in found))
        out = [self.words[w] for w in words]
        self.held += sum(map(len, new)) * 2 + 250 * len(new)
        for word in new:
            if len(word) > LONG:
                self.held -= 2 * len(word) + 250
                del self.words[word]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        ends = list(accumulate(map(len, texts)))
        at = 0
        while at < len(texts):
            upto = max(at + 1, bisect_right(ends, ends[at] - len(texts[at]) + CHARS))
            flat, sizes = encoded(texts[at:upto], self.special, self.cut, self._words)
            out += np.split(flat.view("<i4"), np.cumsum(sizes)[:-1])
            at = upto
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def _reader(df: DataFrame, path: str):
    """The vocabulary goes to the executors as a broadcast of its tables, about three times the size of the file."""
    with open(path, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(tables(file.read()))
    give_back()
    return lambda: TrieBpe(sent.value)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every row; ``path`` names a vocabulary file on the driver."""
    read = _reader(df, path)

    def task():
        model = read()
        return lambda texts: [_lists(model.encode(texts))]

    return over_texts(df, text_col, [id_col], task, "ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` of every row; bytes that are no UTF-8 become replacement characters, a null list an empty text."""
    read = _reader(df, path)

    def task():
        model = read()
        return lambda lists: [pa.array([model.decode(x) for x in lists], type=pa.string())]

    return over_texts(df.withColumn(ids_col, F.col(ids_col).cast("array<int>")), ids_col, [id_col], task, "text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``ids array<int>`` and ``decoded string``: both directions in one pass, the text decoded from the ids."""
    read = _reader(df, path)

    def task():
        model = read()

        def step(texts: list[str]) -> list[pa.Array]:
            ids = model.encode(texts)
            return [_lists(ids), pa.array([model.decode(x.tolist()) for x in ids], type=pa.string())]

        return step

    return over_texts(df, text_col, [id_col, *keep], task, "ids array<int>, decoded string")
