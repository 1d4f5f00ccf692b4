import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.TreeCodec(bpe.load_ranks(MULTI), leaf=4)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcde éñ漢\n\t .'!1", max_size=300))
def test_encoding_is_the_librarys(library, text):
    assert [i for _, found in bpe.encoded([text], MULTI, P.PATTERN, bpe._ids) for ids in found for i in ids] == library.encode_ordinary(text)


def test_long_texts_come_in_parts(library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["wordy", " some", " things\n", " 12,5", " ñandú", " \nnext", "  two", " "]) for _ in range(n)) for n in (0, 1, 40, 300)]
    found: dict[int, list[int]] = {}
    for row, parts in bpe.encoded(texts, MULTI, P.PATTERN, bpe._ids):
        found.setdefault(row, []).extend(i for ids in parts for i in ids)
    assert [found[i] for i in range(4)] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120))
def test_join_is_a_monoid(codec, a, b):
    left, right, whole = codec.encode([a, b, a + b])
    assert [codec.ranks[a + b]] == whole if a + b in codec.ranks else codec.join([(left, right)]) == codec.merge([a + b]) == [whole]
    assert codec.decode(whole) == a + b


def test_digest_of_every_row(docs, rows, library):
    found = {r.doc_id: r for r in bpe.bpe_digest(docs, MULTI, P.PATTERN).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(nothing):
    assert bpe.bpe_digest(nothing, MULTI, P.PATTERN).count() == packing.pack_documents(nothing, PLAIN).count() == 0


def test_encode_column(docs, library):
    r = bpe.bpe_encode(docs.where("doc_id = 3"), MULTI, P.PATTERN).first()
    assert r.ids == library.encode_ordinary(r.text)


def test_packing_covers_every_token_once(docs, rows):
    tokenizer = Tokenizer.from_file(PLAIN)
    pieces = packing.pack_documents(docs, PLAIN, P.PATTERN, window_tokens=4096).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert len(by_doc) == len(rows)
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert all(p.offset == sum(q.length for q in own[:k]) for k, p in enumerate(own))
        assert sum(p.length for p in own) <= 1024


def test_assignment_wastes_less_than_a_sequence_and_balances():
    rnd = random.Random(1)
    lengths = np.array([rnd.randrange(1, 5000) for _ in range(300)])
    rows = packing.assign(lengths, 1024)
    filled = {}
    for _, _, n, q, _ in rows:
        filled[q] = filled.get(q, 0) + n
    assert len(filled) == -(-int(lengths.sum()) // 1024)
    assert sum(1024 - v for v in filled.values()) < 1024


def test_other_tokenizers_and_special_strings_take_the_plain_way():
    tokenizer = Tokenizer.from_file(PLAIN)
    for text in ("a<|endoftext|> b", "plain words"):
        assert np.frombuffer(packing._encoder(PLAIN, P.PATTERN)(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing._encoder(PLAIN, None)("plain words"), "<u4").tolist() == tokenizer.encode("plain words", add_special_tokens=False).ids
