"""Minimizers of byte windows: equal windows fall into equally named runs, wherever they lie."""

from __future__ import annotations

import numpy as np

from tidemark.llm.shingles import _mix, _powers


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit hash of every k bytes in a row."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(max(16, int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        return _mix((sums[k:] - sums[:n]) * inverse[:n])


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of every ``width`` values in a row."""
    out, done = values, 1
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of ``length`` bytes that have the same minimizer.

    Its hash, the first start, the number of starts, and whether the minimizer lies in
    the run's bytes more than once, so that windows of the run can equal each other.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    width = length - k + 1
    hashes = gram_hashes(data, k)
    minima = _slide(hashes, width, np.minimum)
    first = np.concatenate([[0], np.flatnonzero(minima[1:] != minima[:-1]) + 1])
    name = minima[first]
    # A gram is some window's minimum if it equals the greatest minimum of the windows over it.
    padded = np.zeros(len(minima) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(minima)] = minima
    chosen = np.flatnonzero(hashes == _slide(padded, width, np.maximum))
    order = np.lexsort((chosen, hashes[chosen]))
    place, value = chosen[order], hashes[chosen][order]
    close = (value[1:] == value[:-1]) & (np.diff(place) <= width)
    several = np.unique(value[1:][close])
    multi = np.isin(name, several) if len(several) else np.zeros(len(name), bool)
    return name, first, np.diff(np.append(first, len(minima))), multi
