import hashlib
import random
import re

import pytest

from tidemark.llm import bwt, jaccard, suffixes, windows
from tidemark.llm.components import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_removal(rows, length=100):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_components_equal_brute_force(docs, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert found == brute_components(rows)


def test_near_copies_around_the_threshold(spark):
    """A group whose members are partly over and partly under the limit, with frequent tokens throughout."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == brute_components(rows)


def test_links_of_short_documents(spark):
    """Groups of 9 to 50 variants of texts of 8 to 20 words: all shared tokens are frequent, and few."""
    rows, want = [], {}
    for seed in range(60):
        rnd = random.Random(seed)
        base = [f"g{seed}w{k}" for k in range(13 + seed % 3 if seed % 2 else rnd.randrange(8, 21))]
        group = []
        for _ in range(rnd.randrange(9, 51)):
            words = list(base)
            words[-1 if seed % 2 else rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
            group.append((len(rows) + len(group), " ".join(words)))
        rows += group
        want |= brute_components(group)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == want


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()} == {(2, 2), (4, 2)}


@pytest.mark.parametrize("run", [jaccard.jaccard_components, suffixes.remove_repeats, suffixes.cut_repeats])
def test_empty_table(nothing, run):
    assert run(nothing).count() == 0


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[100] == found[95] == found[90] == 90


def test_components_of_shuffled_chains(spark):
    """Ids in no order: a label that moves a link a round needs hundreds of rounds."""
    rnd = random.Random(4)
    links, want = [], {}
    for k, length in enumerate((1000, 1000, 300, 2)):
        ids = [1000 * k + i for i in range(length)]
        rnd.shuffle(ids)
        links += zip(ids, ids[1:])
        want |= dict.fromkeys(ids, 1000 * k)
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == want


def test_removal_equals_brute_force(docs, rows):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()}
    assert found == brute_removal(rows)


def test_cut_text_is_what_remains(docs, rows):
    want = brute_removal(rows)
    found = {r.doc_id: r for r in suffixes.cut_repeats(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()}
    for i, text, *_ in rows:
        n, removed, _, digest = want[i]
        if n and removed == n:
            assert i not in found
        elif not removed:
            assert found[i].text == text
        elif all(ord(c) < 128 for c in text):
            assert hashlib.sha256(found[i].text.encode()).hexdigest() == digest and found[i].n_chars == len(found[i].text)


def test_repeated_rows_in_far_slices(spark):
    """Rows of one id and text more than 2500 rows apart in one partition, one id of two texts, and a passage to cut."""
    rnd = random.Random(6)
    passage = "".join(rnd.choices("abcdefgh ", k=150))
    first = [(i, "".join(rnd.choices("abcdefgh ", k=220)) + passage * (i > 1)) for i in range(4)]
    rows = first + [(i, f"short {i}") for i in range(10, 3010)] + first + [(3, "".join(rnd.choices("abcdefgh ", k=300)))]
    want = [(i, *brute_removal(first)[i]) for i, _ in first] + [(3, 300, 0, 0, hashlib.sha256(rows[-1][1].encode()).hexdigest())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars").coalesce(1).cache()
    found = suffixes.remove_repeats(df).where("doc_id < 10").drop("spans").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    left = suffixes.cut_repeats(df).collect()
    assert len(left) == 3005 and sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in left if r.doc_id < 10) == sorted(w[-1] for w in want)


@pytest.mark.parametrize(("hot", "few"), [(0, 1 << 20), (20, 1 << 20), (0, 0), (20, 0)])
def test_runs_around_a_common_passage_are_spread(spark, docs, rows, monkeypatch, hot, few):
    """Many different runs under one minimizer are judged window by window, with the results of brute force, be hot ones broadcast or joined."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BROADCAST", few)
    rnd = random.Random(8)
    footer = "".join(rnd.choices("abcdefgh ", k=130))
    extra = [(1000 + i, "".join(rnd.choices("abcdefgh ", k=150)) + footer + "".join(rnd.choices("abcdefgh ", k=150))) for i in range(60)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    seen = []
    real = suffixes._marked
    monkeypatch.setattr(suffixes, "_marked", lambda held, hot: seen.append(hot.count()) or real(held, hot))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(both).collect()}
    assert found == brute_removal([r[:2] for r in rows] + extra)
    assert seen[0] > 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_merged_transforms_find_repeats(shards):
    rnd = random.Random(shards)
    for alphabet in (b"a", b"ab", b"abcdef"):
        pool = bytes(rnd.choice(alphabet) for _ in range(300))
        strings = [pool[a : a + 12 + rnd.randrange(50)] for a in (rnd.randrange(200) for _ in range(11))]
        seen = set()
        for s, flags in zip(strings, bwt.repeats(strings, 12, 4, shards)):
            want = []
            for p in range(len(s) - 11):
                want.append(s[p : p + 12] in seen)
                seen.add(s[p : p + 12])
            assert flags.tolist() == want


def test_equal_windows_have_equal_minimizers():
    import numpy as np

    rnd = random.Random(2)
    raw = bytes(rnd.choice(b"ab") for _ in range(900)) * 2
    name, start, count, _ = windows.runs(np.frombuffer(raw, np.uint8), 100, 32)
    of = np.repeat(name, count)
    assert len(of) == len(raw) - 99 and start[0] == 0
    assert (of[:801] == of[900:1701]).all()
