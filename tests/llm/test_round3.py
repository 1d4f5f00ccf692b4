"""Prefix trie, toxicity and whitening: against brute force, held-out labels and dense algebra, with nulls, ties, copies and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, toxicity, trie, whitening

CLASHING = ["'x' AS n", "1 AS key", "'y' AS path", "2 AS depth", "'z' AS smallest", "0 AS x", "'k' AS kept", "1.5 AS score", "3 AS toxic", "'v' AS v", "4 AS id", "'w' AS whitened"]


def clashing(df):
    return df.selectExpr("*", *[c for c in CLASHING if c.split(" AS ")[1] not in df.columns])


# Prefix trie


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: z[:2])] for c, v in conv.items()}
    again = {}
    for c in conv:
        h, base = zlib.crc32(str(c).encode()) % 6, int(c - math.fmod(c, 100))
        again[c] = conv.get(base, [])[:h] + conv[c][h:]
    members, children, below = defaultdict(list), defaultdict(set), {}
    for c, v in again.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below[p] = (sum(below[k][0] for k in children[p]) or 1, sum(below[k][1] for k in children[p]) + own)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(again[c]) == len(p)).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below[p], ends(p)) for p, m in members.items()}


def conversations(seed, long):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-250, 900), 250):
        opening = rnd.randrange(3)
        for k in range(rnd.choice([1, 2, 3, 4, 60 if long else 5])):
            rows.append((c, None if k == 0 and rnd.random() < 0.3 else k, rnd.choice(["u", "a", None]) if k > 2 and rnd.random() < 0.2 else "u", f"{opening if k < 2 else rnd.randrange(2)}é" * rnd.choice([1, 1, 2]) if rnd.random() < 0.9 else rnd.choice([None, "", "𝄞"])))
    same = [(10_000 + i, k, "u", f"copy{k}") for i in range(200) for k in range(3)]  # most rows are copies of one conversation
    return rows + same + [(None, 1, "u", "nobody's"), (5_000, None, None, None), (5_000, None, None, None)]


@pytest.mark.parametrize("seed,long", [(1, False), (2, True)])
def test_the_trie_equals_brute_force(spark, seed, long):
    rows = conversations(seed, long)
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    expected = brute_trie(rows)
    # one stretch; many, peeled some bytes at a time and closed in one round; and in several rounds
    for sizes in ((5000, 100_000, 8 << 20), (30, 100_000, 1500), (7, 30, 300)):
        found = [tuple(r) for r in trie.prefix_trie(df, *sizes).collect()]
        assert len(found) == len(expected) and set(found) == expected


def test_the_shared_conversations_and_none(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.queries()["op11_truncation_peeling"](spark, "/root/testdata/sf0.001").collect()} == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).collect() == []


# Toxicity


def plain_ratios(toxic, ordinary, every):
    """The models over again with dictionaries: the log ratio of each expression."""

    def grams(words):
        out = Counter()
        for w, n in words.items():
            s = toxicity.START * 3 + w + toxicity.END
            for j in range(3, len(s)):
                out[s[j - 3 : j + 1]] += n
        return out

    def shorter(counts):
        return Counter(g[1:] for g in counts)

    def model(counts, lower):
        n = Counter(min(c, 5) for c in counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        off = [0.0] + [0.75 if y is None or not n[k] else min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), 0.95 * k) for k in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += off[min(c, 3)]
        return lambda g: (counts[g] - off[min(counts[g], 3)] + left[g[:-1]] * lower(g[1:])) / total[g[:-1]] if total[g[:-1]] else lower(g[1:])

    def exact(counts):
        n = Counter(counts.values())
        return Counter({k: v for k, v in n.items()})

    all4 = grams(every)
    two = shorter(shorter(all4))
    one = shorter(two)
    size = len(one) + 1
    shared = model(two, model(one, lambda _: 1 / size))
    classes = []
    for words in (toxic, ordinary):
        four = grams(words)
        classes.append(model(four, model(shorter(four), shared)))
    assert exact(all4)
    return {g: math.log(classes[0](g) / classes[1](g)) for g in all4}


def test_ratios_equal_plain_models(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["stone", "river", "été", "ßtraße", "漢字", "idiot", "clown", "a", "notion", "station"]
    texts = [(rnd.choice([None, 0, 1]), " ".join(rnd.choice(words[:8] if k % 3 else words) for _ in range(rnd.randrange(1, 12)))) for k in range(80)]
    by = {k: Counter(w for c, t in texts if k in (c, "all") for w in t.split()) for k in (0, 1, "all")}
    df = spark.createDataFrame([(t, c) for c, t in texts], "text string, toxic int").repartition(3)
    grams = df.mapInArrow(toxicity._count, "g string, toxic long, ordinary long, total long").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "total")])
    found = {r.g: r.r for r in toxicity.expression_ratios(grams).collect()}
    expected = plain_ratios(by[1], by[0], by["all"])
    # counts of counts beyond four don't matter to the discounts
    assert found.keys() == expected.keys() and all(abs(found[g] - expected[g]) < 1e-9 for g in found)


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("truth"))
    scored = queries.queries()["op12_kneser_ney"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    right = (scored.predicted == scored.truth).mean()
    caught, wrong = scored[scored.predicted == 1], scored[scored.truth == 0]
    print("held-out accuracy", right, "precision", caught.truth.mean(), "false alarms", wrong.predicted.mean())
    assert len(scored) > 500 and right > 0.93 and caught.truth.mean() > 0.85 and wrong.predicted.mean() < 0.01
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()


def test_toxicity_cases_and_blocks(spark, docs, nothing):
    kind = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, 1, i % 7 == 0 or None) if i % 5 else (i, None, None) for i in range(0, 60)] and [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(3, 1, None), (None, 1, 1), (4, 1, 1), (4, 1, 0)], kind)
    rows = sorted(toxicity.score_toxicity(docs, labels).collect(), key=repr)
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    by_text = defaultdict(set)
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), [r.text for r in docs.orderBy("doc_id").collect()]):
        by_text[t or ""].add(round(r.score, 9))
    assert all(len(s) == 1 for s in by_text.values())
    again = sorted(toxicity.score_toxicity(docs, labels, block=300).collect(), key=repr)  # the ratios in several blocks
    assert [(r.doc_id, r.held_out, r.predicted) for r in again] == [(r.doc_id, r.held_out, r.predicted) for r in rows]
    assert max(abs(a.score - b.score) for a, b in zip(again, rows)) < 1e-6
    assert toxicity.score_toxicity(nothing, labels).collect() == []
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_isotonic_steps():
    x, y = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 4.0]), np.array([0, 1, 0, 1, 1, 0])
    knots, shares = toxicity.isotonic(x, y)
    assert knots.tolist() == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0] and shares.tolist() == [0.0, 0.0, 0.5, 0.5, 2 / 3, 2 / 3]


# Whitening


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (7, 3), (24, 24)])
def test_components_equal_dense_algebra(d, rank):
    rnd = np.random.default_rng(d)
    a = rnd.normal(size=(200, rank)) @ rnd.normal(size=(rank, d))
    scatter = a.T @ a
    factor, order = whitening.pivoted_cholesky(scatter)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, scatter[order][:, order])
    values, vectors = whitening.principal_components(scatter)
    dense, basis = np.linalg.eigh(scatter)
    assert np.allclose(values, dense[::-1][:rank], rtol=1e-10) and np.allclose(vectors @ vectors.T, np.eye(rank), atol=1e-12)
    assert np.allclose(np.abs((vectors * basis[:, ::-1][:, :rank].T).sum(1)), 1, atol=1e-9)


def brute_whitening(rows):
    ok = [(i, np.floor(64 * np.array(v, float)) + 1e6) for i, v in rows if v is not None and len(v) == 6 and None not in v and np.isfinite(np.array(v, float)).all()]
    u = np.unique(np.stack([x for _, x in ok]), axis=0)
    n, s = len(u), u.sum(0)
    e, w = np.linalg.eigh(np.cov(u.T, bias=True))
    e, w = e[::-1], w[:, ::-1]
    return {(i, k + 1): (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), abs(float((x - s / n) @ w[:, k] / math.sqrt(e[k]))), float(e[k] / e.sum())) for i, x in ok for k in range(6)}


def test_whitened_rows_equal_dense_algebra(spark):
    rnd = np.random.default_rng(8)
    scale = np.array([9, 5, 3, 2, 1, 0.5])
    rows = [(i, (rnd.normal(size=6) * scale).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(80)] + [(i, rows[i][1]) for i in range(3)]  # copies, repeated rows
    rows += [(300, None), (301, [1.0, None, 0, 0, 0, 0]), (302, [float("inf")] + [0.0] * 5), (303, [float("nan")] * 6), (304, [1.0]), (305, []), (306, [3e38] + [0.0] * 5), (307, [600.0] * 6)]
    df = clashing(spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").repartition(3))
    found = whitening.whitened_components(df).collect()
    expected = brute_whitening([r for r in rows if r[0] not in (306,)])
    assert Counter((r.vec_id, r.component) for r in found) == Counter({k: 2 if k[0] < 3 else 1 for k in expected})
    for r in found:
        n, deviation, whitened, explained = expected[r.vec_id, r.component]
        assert r.n == n and abs(abs(r.whitened) - whitened) < 1e-6 * (1 + whitened) and abs(r.explained - explained) < 1e-4 * explained and r.identity_error < 1e-4
        assert r.deviation == (deviation if deviation < 2**63 else None)
    assert len({r.identity_error for r in found}) == 1


def test_an_outlier_leaves_small_components_whole(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, (rnd.normal(size=6) * 3).tolist()) for i in range(200)] + [(500, [4e7] * 6), (501, [9e6] + [0.0] * 5)]
    found = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 202 * 6 and found[0].identity_error < 1e-6
    assert all(r.deviation is None for r in found)  # the outlier moves the sums so far that no deviation is a long


def test_whitening_without_rows_or_spread(spark):
    kind = "vec_id long, embedding array<float>"
    names = "vec_id component n deviation whitened explained identity_error".split()
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whitened_components(spark.createDataFrame(rows, kind))
        assert found.columns == names and found.collect() == []
    few = whitening.whitened_components(spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.5, 2.5])], kind)).collect()
    assert [(r.vec_id, r.component, r.n) for r in few] == [(None, 1, 2), (2, 1, 2)] and {round(abs(r.whitened), 9) for r in few} == {1.0} and few[0].explained == 1.0
