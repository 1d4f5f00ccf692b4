"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_WEIGHTS = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    n = 1 << bits
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _hashed(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; the texts lie between the bounds."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    word = ~space[1:-1]
    starts = np.flatnonzero(word & (space[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (space[2:] | edge[1:])) + 1
    power, inverse = _powers(max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, bounds)  # the first word of each text
    grams = max(0, len(words) - width + 1)
    rolled = np.zeros(grams, np.uint64)
    for k in range(width):
        rolled += words[k : k + grams] * np.uint64(_WEIGHTS[k % len(_WEIGHTS)] + 2 * (k // len(_WEIGHTS)))
    rolled = _mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.uint64(b - a)
            for k in range(a, b):
                short = _mix(words[k : k + 1] + short * np.uint64(_WEIGHTS[0]))[0] if width else short
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(texts: pa.Array, width: int = WIDTH, limit: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, about ``limit`` bytes of text at a time; none for null or wordless texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer than
    ``width`` words has its whole sequence as one shingle.
    """
    out: list[np.ndarray] = []
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit)) - 1)
            stop = min(stop, len(texts))
            out += _hashed(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], width)
            at = stop
    return out
