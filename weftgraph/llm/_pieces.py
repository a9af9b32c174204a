"""The words that a byte-level pattern cuts texts into, found for many texts at once with array operations.

The pattern is the public one that ``bpe.PATTERN`` states. Its words are runs of letters, numbers, white
space or anything else; a space before a run belongs to it, and an apostrophe takes a contraction's letters.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: the white space of the public byte-level splitting pattern (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: what an apostrophe may take with it.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def kinds() -> np.ndarray:
    """By code point: other, letter, number or white space (1.1 MB)."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{WHITE}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point of texts that stand one behind the other; ``firsts`` has the texts' places."""
    kind = kinds()[points]
    first = np.zeros(len(points), dtype=bool)
    first[firsts] = True
    out = first.copy()
    out[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    after = np.flatnonzero(out[1:] & ~first[1:] & space[:-1] & ~space[1:]) + 1
    out[after - 1] = True
    out[after[points[after - 1] == 32]] = False
    quotes = np.flatnonzero(out & (points == 39))
    if len(quotes):
        # what follows an apostrophe, up to the end of its text
        ends = np.append(firsts, len(points))[np.searchsorted(firsts, quotes, side="right")]
        for taken in CONTRACTIONS:
            here = quotes[quotes + len(taken) < ends]
            for k, c in enumerate(taken, 1):
                here = here[points[here + k] == ord(c)]
            out[here + 1] = False
            beyond = here + 1 + len(taken)
            out[beyond[beyond < len(points)]] = True
    return out


def cut(texts: list[str], whole: list[bool] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each place's word, and how many words each text has; texts marked ``whole`` are words themselves."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = "".join(texts)
    if not joined:
        return [], np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    there = sizes > 0
    at = starts(points, begins[there])
    for i in np.flatnonzero(whole) if whole else ():
        at[begins[i] + 1 : ends[i]] = False
    places = np.flatnonzero(at)
    raw = joined.encode()
    if len(raw) == len(points):
        offsets = np.append(places, len(raw))
    else:
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[places], len(raw))
    words = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[there] = np.diff(np.append(np.searchsorted(places, begins[there]), len(places)))
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64), counts


def _gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the words ``codes`` one behind the other; word ``i`` has the next ``sizes[i]`` of ``flat``."""
    own = sizes[codes]
    begins = (np.cumsum(sizes) - sizes)[codes]
    skip = begins - (np.cumsum(own) - own)
    return flat[np.repeat(skip, own) + np.arange(own.sum())]


def encoded(texts: list[str], special: dict[str, int], between: regex.Pattern | None, ids_of: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one behind the other, and how many each has.

    ``between`` splits texts at special tokens, which ``ids_of`` gets as words of their own; it gives the ids of distinct words, 4 bytes each.
    """
    parts, whole, of = [], [], []
    for i, text in enumerate(texts):
        pieces = between.split(text) if between and any(s in text for s in special) else [text]
        parts += pieces
        whole += [k % 2 == 1 for k in range(len(pieces))]
        of += [i] * len(pieces)
    words, codes, counts = cut(parts, whole)
    if not words:
        return np.empty(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
    ids = ids_of(words)
    sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
    ends = np.concatenate(([0], np.cumsum(sizes[codes])))[np.cumsum(counts)]
    each = np.bincount(of, weights=np.diff(ends, prepend=0), minlength=len(texts)).astype(np.int64)
    return _gathered(np.frombuffer(b"".join(ids), dtype="<u4"), sizes, codes), each
