"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.chunks import ChunkMemo, chunks

LINEAR, QUADRATIC = 6.0, 1.0 / 256


def attention_cost(length):
    """Estimated cost of a piece: linear (projections) plus quadratic (attention) in its length."""
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: np.ndarray, size: int) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of the given token counts; (document, start, length, sequence, offset) per piece.

    Whole sequences are cut off first. What is left of each document goes, in
    descending order of cost, to the sequence of lowest cost that has room for it.
    The number of sequences is the least possible one; a rest for which no
    sequence has room is cut over the cheapest ones. At most the last sequence's
    worth of tokens is padding.
    """
    full, rest = lengths // size, lengths % size
    out = []
    whole = int(full.sum())
    docs = np.repeat(np.arange(len(lengths)), full)
    starts = (np.arange(whole) - np.repeat(np.cumsum(full) - full, full)) * size
    out += [(int(d), int(s), size, q, 0) for q, (d, s) in enumerate(zip(docs, starts))]
    count = -(-int(rest.sum()) // size)
    room, cost = np.full(count, size, np.int64), np.zeros(count)

    def place(doc: int, start: int, length: int, seq: int) -> None:
        out.append((doc, start, length, whole + seq, size - int(room[seq])))
        room[seq] -= length
        cost[seq] += attention_cost(length)

    late = []
    for doc in np.argsort(-attention_cost(rest), kind="stable"):
        length = int(rest[doc])
        if length:
            fits = np.flatnonzero(room >= length)
            if len(fits):
                place(int(doc), int(full[doc]) * size, length, int(fits[np.argmin(cost[fits])]))
            else:
                late.append(int(doc))
    for doc in late:
        start, left = int(full[doc]) * size, int(rest[doc])
        while left:
            open_ = np.flatnonzero(room)
            seq = int(open_[np.argmin(cost[open_])])
            length = min(left, int(room[seq]))
            place(doc, start, length, seq)
            start, left = start + length, left - length
    return out


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The merge ranks of a plain byte-level BPE file; None for any other kind of tokenizer."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    # Bytes that print stand for themselves, the others for the code points from 256.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):  # ids don't follow the merges' order
        return None
    return {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}


@lru_cache(1)  # a worker keeps what it remembers from task to task
def _encoder(path: str, pattern: str | None) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian bytes.

    Chunks that are not remembered go to the tokenizer, in one call for each text; with
    the pattern of a byte-level BPE file, its ranks give the same ids several times faster.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        ranks = _byte_ranks(json.load(f)) if pattern else None
    if ranks:
        encode_plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        memo = ChunkMemo(lambda keys: [array("I", encode_plain(k)).tobytes() for k in keys])
    else:
        memo = ChunkMemo(ids)

    def encode(text: str) -> bytes:
        cut = None if any(s in text for s in special) else chunks(text)
        return b"".join(memo(cut)) if cut is not None else ids([text])[0]

    return encode


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str | None = None, size: int = 1024, end_id: int = 0, window_tokens: int = 1 << 21, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize documents and pack them into sequences of ``size`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, with ``with_ids``, the ids. Every document ends with ``end_id``;
    a null or empty text is that id alone, so every row of the input has a piece.
    Repeated rows are packed each on its own. Other columns are ignored.

    Each task packs its own rows, in windows of about ``window_tokens`` tokens, so
    no row is shuffled and a task holds one window; a window wastes less than one
    sequence. sequence_id is the task's number times 2**40 plus a running number.
    Rows are read in the order of their files, so a repeated task gives the same
    pieces.
    """

    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, pattern)
        end = np.asarray([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        keys: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, tokens
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            rows = assign(lengths, size)
            cut = [held[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in rows]
            columns = [[keys[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x) for x in cut], [int(lengths[r[0]]) for r in rows], [base + r[3] for r in rows], [r[4] for r in rows]]
            if with_ids:
                columns.append([np.frombuffer(x, "<i4") for x in cut])
            base += max((r[3] for r in rows), default=-1) + 1
            keys.clear()
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(encode(value.as_py() or "") + end)
                keys.append(key)
                tokens += len(held[-1]) // 4
                if tokens >= window_tokens:
                    yield flush()
        if held:
            yield flush()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(pack, kinds)
