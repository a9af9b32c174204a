"""Vectorised word and shingle hashing on UTF-8 buffers (numpy).

Texts are handled whole; memory is bounded by working through a text in pieces of at most
``PIECE`` bytes that are cut at a separator, so only 8 bytes a word are kept for one text.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_SHINGLE = [int(x) * 2 + 1 for x in _rng.integers(1, 2**62, 64)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators: white space of ASCII, or all of ASCII but letters and digits.
SPACES = _SPACE
WORDS = np.ones(256, dtype=bool)
WORDS[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    WORDS[_a:_b] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n places."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE % (1 << 64), inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size <= PIECE * 2:
            _POWERS[size] = tuple(both)
        return tuple(both)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (ASCII lower-cased) of the runs of bytes marked in ``inside``, piece by piece."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, k = [], 0
    while k < len(starts):
        a = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, a + PIECE, side="right")))
        z = int(ends[m - 1])
        power, inverse = _powers(z - a + 1)
        total = np.zeros(z - a + 1, dtype=np.uint64)
        np.cumsum(_TABLE[_LOWER[buf[a:z]]] * power[: z - a], out=total[1:])
        s, e = starts[k:m] - a, ends[k:m] - a
        out.append(mix((total[e] - total[s]) * inverse[s] ^ (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        k = m
    return starts, ends, np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def word_hashes(texts: list[bytes], apart: np.ndarray = SPACES) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, ASCII lower-cased, in order."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        buf = np.frombuffer(b"\n".join(group), dtype=np.uint8)
        starts, _, h = hash_spans(buf, ~apart[buf])
        bounds = np.cumsum([0] + [len(x) + 1 for x in group])
        cut = np.searchsorted(starts, bounds)
        out.extend(h[cut[i] : cut[i + 1]] for i in range(len(group)))
        group.clear()
        size = 0

    for text in texts:
        if size + len(text) > PIECE:
            flush()
        group.append(text)
        size += len(text) + 1
    flush()
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence as one."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - k + 1)
    width = min(k, len(words))
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h += words[i : i + n] * np.uint64(_SHINGLE[i % 64] + 2 * (i // 64))
    return np.unique(mix(h))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, in order."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h += words[i : i + n] * np.uint64(_SHINGLE[i % 64] + 2 * (i // 64))
    return mix(h)
