"""Fitted text vectors against plain counts and numpy's decomposition, and the hook for other embeddings."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import text_vectors as tv

WORDS = "stone river garden light winter paper market letter window music silver morning the of and été straße".split()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    return [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(3, 30)))) for i in range(120)] + [(200, None), (201, ""), (202, "the of and"), (203, "Stone stone STONE a x"), (203, "one, two!")]


def plain_terms(text):
    kept = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in tv.STOP_WORDS]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]


def plain_matrix(texts, features):
    counts = Counter(t for _, x in texts for t in plain_terms(x))
    kept = sorted(sorted(counts, key=lambda t: (-counts[t], t))[:features])
    n, df = len(texts), Counter(t for _, x in texts for t in set(plain_terms(x)))
    rows = np.array([[plain_terms(x).count(t) * (math.log((1 + n) / (1 + df[t])) + 1) for t in kept] for _, x in texts])
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return kept, np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def test_weights_equal_plain_counts(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string").selectExpr("*", "'x' AS terms", "1 AS t").repartition(3)
    model = tv.fit_text_model(df, "text", 40)
    kept, matrix = plain_matrix(texts, 40)
    assert list(model.terms) == kept
    found = sorted((r.id, dict(zip(r.terms, r.weights))) for r in model.weights(df, "id", "text").collect() if r.id != 203)
    for (i, w), row in zip(found, [m for (i, _), m in zip(texts, matrix) if i != 203]):
        assert w.keys() == set(np.flatnonzero(row)) and all(abs(w[k] - row[k]) < 1e-9 for k in w)
    fresh = model.weights(spark.createDataFrame([("new", "stone unknown")], "id string, text string"), "id", "text").first()
    assert fresh.id == "new" and [model.terms[k] for k in fresh.terms] == ["stone"] and fresh.weights == [1.0]


@pytest.mark.parametrize("features", [1, 2, 5, 9, 17, 60, 1000])
def test_ties_and_frequent_pairs_keep_the_same_terms(spark, features):
    """Words as common as each other, pairs as common as words, and pairs that are commoner than most words."""
    rnd = random.Random(features)
    texts = [(i, "stone river stone river") for i in range(3)] + [(9, "zebra apple zebra apple, mole")] + [(i, " ".join(rnd.choices("abc bcd cde def".split(), k=rnd.randrange(1, 4)))) for i in range(20, 24)]
    model = tv.fit_text_model(spark.createDataFrame(texts, "id long, text string").repartition(2), "text", features)
    kept, _ = plain_matrix(texts, features)
    assert list(model.terms) == kept


def test_rare_pairs_are_not_shuffled(spark, monkeypatch):
    """Of 60,000 words' pairs, nearly all different, only those of the commonest words leave their task."""
    rnd = random.Random(1)
    names = [f"w{i:03d}" for i in range(300)]
    texts = [(" ".join(rnd.choices(names, weights=range(300, 0, -1), k=600)),) for _ in range(100)]
    df = spark.createDataFrame(texts, "text string").repartition(2)
    seen = []
    real = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: seen.append(self.count()) or real(self, *c))
    tv.fit_text_model(df, "text", 10)
    assert sum(seen) < 2000


@pytest.mark.parametrize("gram", [0, 1024])
def test_both_ways_to_the_directions(spark, texts, monkeypatch, gram):
    monkeypatch.setattr(tv, "GRAM", gram)
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    latent = tv.fit_latent_model(df, "text", tv.fit_text_model(df, "text", 60), 8, 1e-10)
    assert np.allclose(latent.values, np.linalg.svd(plain_matrix(texts, 60)[1])[1][:8] ** 2, rtol=1e-6)


def test_latent_vectors_equal_the_decomposition(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    model = tv.fit_text_model(df, "text", 60)
    latent = tv.fit_latent_model(df, "text", model, 8, 1e-12)
    _, matrix = plain_matrix(texts, 60)
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(latent.values, s[:8] ** 2, rtol=1e-6)
    vectors = {}
    for r in latent.vectors(df, "id", "text").collect():
        vectors.setdefault(r.id, []).append(r.vector)
    ours = np.array([vectors[i].pop() for i, _ in texts if i != 203]) @ latent.directions.T
    best = np.array([row for (i, _), row in zip(texts, (u[:, :8] * s[:8]) @ v[:8]) if i != 203])
    assert np.abs(ours - best).max() < 1e-3  # the best reconstruction with as many directions


def test_search_takes_any_embedding(spark, texts):
    rows = spark.createDataFrame(texts, "id long, text string").select("id", F.col("text").alias("words"))
    latent = tv.fit_latent_model(rows, "words", tv.fit_text_model(rows, "words", 60), 8)
    found = tv.search(rows, "stone", latent.embed(), 3).collect()
    assert len(found) == 3 and found[0].score >= found[1].score >= found[2].score > 0
    lengths = lambda df: df.select("id", F.array(F.coalesce(F.length("words"), F.lit(0)).cast("double"), F.lit(10.0)).alias("vector"))
    nearest = tv.search(rows, "x" * 10, lengths, 1).first()
    assert min(abs(len(t or "") - 10) for _, t in texts) == abs(len({i: t for i, t in texts if i != 203}.get(nearest.id) or "one, two!") - 10)


def test_nothing_to_fit(spark):
    none = spark.createDataFrame([], "id long, text string")
    model = tv.fit_text_model(none, "text")
    latent = tv.fit_latent_model(none, "text", model)
    assert model.terms == () and latent.vectors(spark.createDataFrame([(1, "word")], "id long, text string"), "id", "text").first().vector == []


def test_words_are_counted_in_arrow():
    """Counting 200,000 different words makes next to no Python objects."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"word{i}" for i in range(k, k + 1000)) for k in range(0, 200_000, 1000)])], ["t"])
    tracemalloc.start()
    sent = sum(b.num_rows for b in tv._words(iter([batch]), frozenset(), 10**6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 200_000 and peak < 2_000_000


@pytest.mark.parametrize("features", [3, 8, 30])
def test_counts_of_small_pieces_add_up(spark, texts, monkeypatch, features):
    monkeypatch.setattr(tv, "PIECE", 100, raising=False)  # a few texts at a time, sums sent often
    monkeypatch.setattr(tv, "HELD", 6)
    odd = [(300, "Ünder_score—Straße; 10x\t10X\n\nx  y stone"), (301, " , "), (302, "stone")]
    df = spark.createDataFrame(texts + odd, "id long, text string").repartition(2)
    kept, matrix = plain_matrix(texts + odd, features)
    model = tv.fit_text_model(df, "text", features)
    assert list(model.terms) == kept
    docs = Counter(t for _, x in texts + odd for t in set(plain_terms(x)))
    assert np.allclose(model.idf, [math.log((1 + len(texts + odd)) / (1 + docs[t])) + 1 for t in kept])
    found = {r.id: dict(zip(r.terms, r.weights)) for r in model.weights(df, "id", "text").collect() if r.id >= 300}
    for (i, _), row in zip(texts + odd, matrix):
        if i >= 300:
            assert found[i].keys() == set(np.flatnonzero(row)) and all(abs(w - row[k]) < 1e-9 for k, w in found[i].items())
