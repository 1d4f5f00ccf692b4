"""Byte-level BPE by monoid tree reduction.

Encodings of neighbouring byte strings form a monoid: the encoding of a
concatenation is the two encodings with a window at the seam encoded anew. An
encoding is the one that the merges give if, and only if, every pair of neighbouring
tokens is what the merges give for the pair's own bytes. So a window is wide
enough once its first and last tokens fit their outer neighbours: tokens outside
then cannot change. Decoding concatenates the tokens' bytes up the same tree.

The pieces of many texts climb the tree together: each level is one batch of leaves or
windows, merged in numpy as rows of ids.
"""

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkMemo, chunks, pieces_pattern, segments

LEAF = 16
BATCH_CHARS = 1 << 20  # text whose new chunks are encoded together
NONE = np.int32(np.iinfo(np.int32).max)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """The rank of the token that two neighbouring tokens make, for arrays of pairs: open addressing in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(left << 32 | right, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None]
        key, value = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)
        self.bits = max(8, (4 * len(key)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = key[placed], value[placed]
            rest = np.ones(len(key), bool)
            rest[placed] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(key), NONE, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            known = self.keys[slot]
            hit = known == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (known != -1)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class TreeCodec:
    """Encodes byte strings with a table of ranks, halves first, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair = PairTable(ranks)

    def merge(self, strings: list[bytes]) -> list[list[int]]:
        """The ids that the merges give for each of many short strings; strings of like lengths are merged together."""
        out: list[list[int]] = [[]] * len(strings)
        sizes = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(sizes, kind="stable")
        low = 8
        at = int(np.searchsorted(sizes[order], 1))
        while at < len(order):
            stop = int(np.searchsorted(sizes[order], low, "right"))
            rows = max(1, (1 << 21) // low)
            for a in range(at, stop, rows):
                self._merge_rows(order[a : min(stop, a + rows)], strings, sizes, out)
            at, low = max(at, stop), 2 * low
        return out

    def _merge_rows(self, who: np.ndarray, strings: list[bytes], sizes: np.ndarray, out: list[list[int]]) -> None:
        """A row an string: in each round every row's lowest pair, leftmost first, becomes one token."""
        size = sizes[who]
        width = int(size.max()) + 1  # the last column stays empty
        column = np.arange(width)
        filled = column < size[:, None]
        ids = np.full((len(who), width), -1, np.int32)
        ids[filled] = self.bytes[np.frombuffer(b"".join([strings[i] for i in who.tolist()]), np.uint8)]
        ranks = np.full((len(who), width), NONE, np.int32)
        paired = column < size[:, None] - 1
        ranks[paired] = self.pair(ids[paired], ids[:, 1:][paired[:, :-1]])
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            done = best == NONE
            if done.any():
                flat = ids[done][column < size[done, None]].tolist()
                ends = np.cumsum(size[done]).tolist()
                for i, a, b in zip(who[done].tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
                on = ~done
                who, ids, ranks, size, at, best = who[on], ids[on], ranks[on], size[on], at[on], best[on]
                if not len(who):
                    return
            row = np.arange(len(who))
            later = column[:-1] > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ids[row, at] = best
            size -= 1
            right = at + 1 < size
            ranks[row, at] = NONE
            ranks[row[right], at[right]] = self.pair(best[right], ids[row[right], at[right] + 1])
            left = at > 0
            ranks[row[left], at[left] - 1] = self.pair(ids[row[left], at[left] - 1], best[left])

    def _fit(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether each two neighbouring tokens are what the merges give for their own bytes."""
        distinct = list(dict.fromkeys(pairs))
        fits = dict(zip(distinct, (found == [*pair] for pair, found in zip(distinct, self.merge([self.tokens[a] + self.tokens[b] for a, b in distinct])))))
        return [fits[p] for p in pairs]

    def join(self, seams: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The encodings of concatenations, each from the encodings of its two parts; windows grow until both edges fit."""
        out: list[list[int]] = [[]] * len(seams)
        width, open_ = 1, list(range(len(seams)))
        while open_:
            cuts = [(max(0, len(seams[i][0]) - width), min(len(seams[i][1]), width)) for i in open_]
            windows = self.merge([b"".join([self.tokens[t] for t in seams[i][0][a:] + seams[i][1][:b]]) for i, (a, b) in zip(open_, cuts)])
            edges, wait = [], []
            for i, (a, b), window in zip(open_, cuts, windows):
                left, right = seams[i]
                own = ([(left[a - 1], window[0])] if a else []) + ([(window[-1], right[b])] if b < len(right) else [])
                out[i] = left[:a] + window + right[b:]
                edges += own
                wait += [i] * len(own)
            open_ = list(dict.fromkeys(i for i, fit in zip(wait, self._fit(edges)) if not fit))
            width *= 2
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: tokens as they are, the others by leaves whose encodings are joined up the tree."""
        whole = list(map(self.ranks.get, pieces))
        out = [None if rank is None else [rank] for rank in whole]
        rest = [i for i, rank in enumerate(whole) if rank is None]
        small = [i for i in rest if len(pieces[i]) <= self.leaf]
        for i, ids in zip(small, self.merge([pieces[i] for i in small])):
            out[i] = ids
        tall = [i for i in rest if len(pieces[i]) > self.leaf]
        leaves = [[pieces[i][k : k + self.leaf] for k in range(0, len(pieces[i]), self.leaf)] for i in tall]
        merged = iter(self.merge([leaf for own in leaves for leaf in own]))
        levels = [[next(merged) for _ in own] for own in leaves]
        while any(len(level) > 1 for level in levels):
            joined = iter(self.join([(level[k], level[k + 1]) for level in levels for k in range(0, len(level) - 1, 2)]))
            levels = [[next(joined) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)] for level in levels]
        for i, level in zip(tall, levels):
            out[i] = level[0]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated by halves."""
        if len(ids) <= 8:
            return b"".join([self.tokens[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _pieces(keys: list[str], find: Callable[[str], list[str]]) -> list[list[str]]:
    """The pieces of each chunk. Chunks of a space and more stand side by side as they do in a text, so one search does for them."""
    out: list[list[str] | None] = [None] * len(keys)
    joint = [i for i, k in enumerate(keys) if k[:1] == " " and k[1:2].strip()]
    found = find("".join([keys[i] for i in joint]))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    bounds = np.cumsum(np.fromiter((len(keys[i]) for i in joint), np.int64, len(joint)))
    cuts = np.searchsorted(ends, bounds)
    if len(joint) and np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], bounds):
        stops = (cuts + 1).tolist()
        for i, a, b in zip(joint, [0, *stops], stops):
            out[i] = found[a:b]
    return [find(k) if own is None else own for k, own in zip(keys, out)]


@lru_cache(4)  # a worker keeps what it remembers from task to task
def chunk_encoder(ranks_path: str, pattern: str, compute: Callable[[list[int], TreeCodec], object]) -> ChunkMemo:
    """A function that gives ``compute(ids, codec)`` for each of a list of independent chunks, in order."""
    codec, find = TreeCodec(load_ranks(ranks_path)), pieces_pattern(pattern).findall

    def fresh(keys: list[str]) -> list:
        cut = _pieces(keys, find)
        distinct = list(dict.fromkeys([p for own in cut for p in own]))
        ids = dict(zip(distinct, codec.encode([p.encode() for p in distinct])))
        return [compute(ids[own[0]] if len(own) == 1 else [i for p in own for i in ids[p]], codec) for own in cut]

    return ChunkMemo(fresh, limit=300_000)


def _parts(texts: Iterable[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Segments of texts with the text's number, about ``BATCH_CHARS`` at a time."""
    held, total = [], 0
    for number, text in enumerate(texts):
        for segment in segments(text or "", BATCH_CHARS):
            held.append((number, segment))
            total += len(segment)
            if total >= BATCH_CHARS:
                yield held
                held, total = [], 0
    if held:
        yield held


def encoded(texts: Iterable[str | None], ranks_path: str, pattern: str, compute: Callable[[list[int], TreeCodec], object]) -> Iterator[tuple[int, list]]:
    """(number of the text, results of its chunks): in order, long texts in several parts."""
    encoder = chunk_encoder(ranks_path, pattern, compute)
    find = pieces_pattern(pattern).findall
    for part in _parts(texts):
        cut = [find(segment) if (own := chunks(segment)) is None else own for _, segment in part]
        found = encoder([c for own in cut for c in own])
        at = 0
        for (number, _), own in zip(part, cut):
            yield number, found[at : at + len(own)]
            at += len(own)


def _both_ways(ids: list[int], codec: TreeCodec) -> tuple[int, str, bytes]:
    names = codec.names
    return len(ids), ",".join([names[i] for i in ids]), codec.decode(ids)


def _ids(ids: list[int], codec: TreeCodec) -> list[int]:
    return ids


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; doc_id, n_tokens, ids_sha256 and decoded_sha256 per row.

    A null text counts as empty: no tokens, and the digest of nothing. Repeated
    rows give repeated results; other columns are ignored. Nothing is shuffled, and a
    task holds about ``BATCH_CHARS`` of text in pieces, also of longer texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [0] * batch.num_rows
            ids, decoded = ([hashlib.sha256() for _ in counts] for _ in range(2))
            for row, found in encoded((x.as_py() for x in batch.column(1)), ranks_path, pattern, _both_ways):
                found = [x for x in found if x[0]]
                if found:
                    if counts[row]:
                        ids[row].update(b",")
                    counts[row] += sum([x[0] for x in found])
                    ids[row].update(",".join([x[1] for x in found]).encode())
                    decoded[row].update(b"".join([x[2] for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *[pa.array([h.hexdigest() for h in side], pa.string()) for side in (ids, decoded)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns plus the token ids of the text (null: no ids); a column named as ``ids`` says is replaced."""

    @F.pandas_udf("array<int>")
    def encode(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            rows: list[list[int]] = [[] for _ in s]
            for row, found in encoded(s, ranks_path, pattern, _ids):
                for own in found:
                    rows[row] += own
            yield pd.Series(rows, index=s.index, dtype=object)

    return docs.withColumn(ids, encode(docs[text]))
