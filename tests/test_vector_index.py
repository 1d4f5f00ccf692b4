"""The vector index against brute force: exact search, recall of the probed one, nulls, copies and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vector_index as vi
from tidemark.sources.tables import table

KIND = "vec_id long, embedding array<float>, cell string, gap int"


def _brute(rows, queries, k):
    out = {}
    for q, v in queries:
        gaps = sorted((float(((np.array(w, float) - np.array(v, float)) ** 2).sum()), i) for i, w in rows)
        out[q] = [(i, round(1 / (1 + g), 9)) for g, i in gaps[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 8)) * 4
    points = (centres[rnd.integers(0, 12, 900)] + rnd.normal(size=(900, 8))).astype(np.float32)
    points[600:] = points[5]  # a third are copies
    return [(i, v.tolist()) for i, v in enumerate(points)]


def test_exact_search_equals_brute_force_and_probes_reach_the_recall(spark, vectors, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 40)  # several tasks a cell, and several parts of queries
    monkeypatch.setattr(vi, "QUERIES", 7)
    bad = [(-1, None), (-2, [1.0, None] + [0.0] * 6), (-3, [float("nan")] * 8), (-4, [1.0] * 5), (-5, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors + bad], KIND).repartition(3)
    index = vi.build_index(df, cells=15)
    assert index.sizes.sum() == 900
    asked = [v for v in vectors if v[0] % 50 == 0]
    queries = df.where("vec_id % 50 = 0").union(df.where("vec_id < 0"))
    expected = _brute(vectors, asked, 10)
    found = {}
    for r in vi.nearest(index, queries, 10, 1, exact=True).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    assert found == expected
    probed = vi.nearest(index, queries).collect()
    hits = sum(round(r.score, 9) >= expected[r.query_id][-1][1] for r in probed)
    assert hits / sum(map(len, expected.values())) >= 0.9


def test_recall_on_the_shared_table(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    index, queries = vi.build_index(rows), rows.where("vec_id % 50 = 0")
    exact = vi.nearest(index, queries, 10, None, True).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = vi.nearest(index, queries).join(exact, "query_id").agg(F.avg((F.col("score") >= F.col("least") - 1e-9).cast("int")).alias("precision"), F.count("*").alias("n")).first()
    recall = hits.precision * hits.n / exact.agg(F.sum("n")).first()[0]
    print("recall@10", recall)
    assert recall >= 0.9


def test_few_rows_and_none(spark):
    none = spark.createDataFrame([], KIND)
    index = vi.build_index(none)
    assert vi.nearest(index, none).collect() == [] and index.sizes.sum() == 0
    one = spark.createDataFrame([(7, [1.0, 2.0], None, None), (7, [1.0, 2.0], None, None), (None, [1.0, 3.0], None, None)], KIND)
    index = vi.build_index(one)
    found = vi.nearest(index, one.limit(1), 5, None, True).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in found] == [(7, 7, 1.0), (7, 7, 1.0), (7, None, 0.5)]
    assert vi.nearest(index, none).collect() == []


def test_files_and_batches_do_not_grow_with_the_cells(spark, vectors, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], KIND).repartition(3)
    index = vi.build_index(df, cells=100, folder=str(tmp_path))
    assert len(list((tmp_path / "lists").rglob("*.parquet"))) <= 3  # a file a task, whatever the number of cells
    assert index.lists(spark).count() == 900 and index.sizes.sum() == 900
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["row"])
    parts = list(vi._pieces(iter([batch]), 1000 * 64))
    assert max(p.num_rows for p in parts) * 1000 * 64 <= vi.HELD and pa.Table.from_batches(parts).column(0).to_pylist() == [*range(10_000)]


def test_queries_reach_their_cells_from_several_tasks(spark, vectors, monkeypatch):
    """Queries from one file, small as they are, go out with their cells from as many tasks as these need."""
    monkeypatch.setattr(vi, "HELD", 64)
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], KIND).repartition(1)
    index = vi.build_index(df, cells=15)
    tasks = []
    real = vi._searched
    monkeypatch.setattr(vi, "_searched", lambda index, pairs, k: tasks.append(pairs.rdd.getNumPartitions()) or real(index, pairs, k))
    found = {}
    for r in vi.nearest(index, df.where("vec_id % 50 = 0"), 10, 1, exact=True).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    assert found == _brute(vectors, [v for v in vectors if v[0] % 50 == 0], 10)
    assert len(tasks) == 2 and min(tasks) >= 3  # 18 queries, 15 cells, 8 numbers, 128 a task: 17
