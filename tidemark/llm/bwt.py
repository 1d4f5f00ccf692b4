"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

The alphabet is that of blocks of bytes: a suffix is read ``step`` bytes at a time, so a
common prefix of ``depth`` bytes is ``depth / step`` symbols. Symbols are ordered by
hash; any fixed order gives the same repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.windows import gram_hashes


@dataclass
class ShardTransform:
    """A shard's suffixes in order (elements: string by string, position by position) and the symbol before each."""

    order: np.ndarray
    before: np.ndarray
    ends: int


def shard_transform(strings: list[bytes], step: int) -> ShardTransform:
    """Sort the suffixes of a shard by prefix doubling. Strings have at least ``step`` bytes.

    Symbol 0 stands for the missing one before a suffix at a string's start. Suffixes
    shorter than a symbol come first, in order of string and position.
    """
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    at = np.arange(len(owner)) - base[owner]
    left = sizes[owner] - at
    grams = np.maximum(gram_hashes(data, step), np.uint64(1))
    symbol = np.zeros(len(owner), np.uint64)
    whole = left >= step
    symbol[whole] = grams[(np.arange(len(owner)) - owner)[whole]]
    before = np.zeros(len(owner), np.uint64)
    later = at >= step
    before[later] = symbol[np.flatnonzero(later) - step]
    ends = int((~whole).sum())
    inside = np.flatnonzero(whole)
    order = np.concatenate([np.flatnonzero(~whole), inside[np.argsort(symbol[inside])]])
    key = symbol[order]
    new = np.ones(len(order), bool)
    new[ends + 1 :] = key[ends + 1 :] != key[ends:-1]
    rank = np.empty(len(order), np.int64)
    places, who, reach = np.arange(len(order)), order, step
    while True:
        # A rank is the place of its first suffix; suffixes of one rank are then ranked by what follows.
        first = np.flatnonzero(new)
        rank[who] = np.repeat(places[first], np.diff(np.append(first, len(new))))
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = places[tied]
        if not len(places):
            return ShardTransform(order, before[order], ends)
        who = order[places]
        key = rank[who] * (len(order) + 1) + rank[who + reach]
        resort = np.argsort(key)
        key, who = key[resort], who[resort]
        order[places] = who
        new = np.ones(len(who), bool)
        new[1:] = key[1:] != key[:-1]
        reach *= 2


def _sorted_by(symbols: np.ndarray) -> np.ndarray:
    """Stable order of dense symbols, by their low half, then by their high half."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    high = (symbols >> np.uint32(16)).astype(np.uint16)
    if high.any():
        order = order[np.argsort((high.astype(np.uint8) if high.max() < 256 else high)[order], kind="stable")]
    return order


def merge(shards: list[ShardTransform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all suffixes by their first ``rounds`` symbols, and where a common prefix of that length ends.

    The interleave says which shard each place of the merged order belongs to. A round
    reads the symbols before the suffixes in the present order and sorts the places by
    them, stably: suffixes ordered by k symbols are then ordered by k + 1. A place
    opens a block when its symbol or its suffix's block differs from its neighbour's.
    Within a shard the order is never computed anew.
    """
    sizes = [len(s.order) for s in shards]
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    alphabet, symbols = np.unique(np.concatenate([s.before for s in shards]), return_inverse=True)
    symbols = symbols.astype(np.uint32) + np.uint32(bool(alphabet[0]))
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.ends for s in shards])
    interleave, block = source, np.zeros(len(source), np.int64)
    opens = np.zeros(len(source), bool)
    read = np.empty(len(source), np.uint32)
    for _ in range(rounds):
        if interleave is source:
            read[:] = symbols
        else:
            read[np.argsort(interleave, kind="stable")] = symbols
        order = _sorted_by(read)
        interleave = interleave[order]
        interleave[: len(ends)] = ends
        known, was = read[order], block[order]
        opens = np.ones(len(order), bool)
        opens[1:] = (known[1:] != known[:-1]) | (was[1:] != was[:-1])
        opens[: len(ends) + 1] = True  # suffixes shorter than a symbol are all different
        block = np.cumsum(opens)
    offsets = np.cumsum(sizes) - sizes
    merged = np.empty(len(source), np.int64)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate([s.order + o for s, o in zip(shards, offsets)])
    return merged, opens


def repeats(strings: list[bytes], depth: int = 100, step: int = 25, shards: int = 8) -> list[np.ndarray]:
    """For each string, whether the ``depth`` bytes from each position on also start earlier (in an earlier string, or before in it)."""
    size = -(-len(strings) // shards)
    parts = [strings[i : i + size] for i in range(0, len(strings), size)]
    merged, opens = merge([shard_transform(p, step) for p in parts], depth // step)
    first = np.flatnonzero(opens)
    earliest = np.repeat(np.minimum.reduceat(merged, first), np.diff(np.append(first, len(merged))))
    found = np.zeros(len(merged), bool)
    found[merged] = merged != earliest
    bounds = np.cumsum([len(s) + 1 for s in strings])[:-1]
    return [f[: max(0, len(s) - depth + 1)] for f, s in zip(np.split(found, bounds), strings)]
