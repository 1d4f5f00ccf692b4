"""Keys, inclusions and dependencies against brute force, over random tables with nulls, repeats and planted structure."""

import random
from itertools import combinations

import pytest

from tidemark.operators import discovery


def _tables(spark, seed):
    rnd = random.Random(seed)
    out, plain = {}, {}
    for t in range(3):
        n = rnd.choice([0, 1, 12, 40])
        columns = [f"c{i}" for i in range(rnd.randrange(2, 5))]
        rows = [tuple(rnd.choice([None, *range(rnd.choice([2, 4, 9]))]) for _ in columns) for _ in range(n)]
        rows = [(*r, None if r[0] is None else r[0] * 2, r[0]) for r in rows]  # the first column and those made of it give each other
        plain[f"t{t}"] = ([*columns, "double", "again"], rows)
        out[f"t{t}"] = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in plain[f"t{t}"][0])).repartition(2)
    return out, plain


def _brute_keys(plain, most):
    found = set()
    for t, (columns, rows) in plain.items():
        own = []
        for k in range(1, most + 1):
            for x in combinations(range(len(columns)), k):
                values = [tuple(r[i] for i in x) for r in rows]
                if rows and not any(set(o) <= set(x) for o in own) and not any(None in v for v in values) and len(set(values)) == len(values):
                    own.append(x)
        found |= {(t, ", ".join(sorted(columns[i] for i in x)), len(rows)) for x in own}
    return found


def _brute_dependencies(plain, most):
    found = set()
    for t, (columns, rows) in plain.items():
        own = []
        for k in range(most + 1):
            for x in combinations(range(len(columns)), k):
                for a in range(len(columns)):
                    if a in x or any(set(o) <= set(x) and b == a for o, b in own):
                        continue
                    if len({tuple(r[i] for i in x) for r in rows}) == len({(*(r[i] for i in x), r[a]) for r in rows}):
                        own.append((x, a))
        found |= {(t, ", ".join(sorted(columns[i] for i in x)), columns[a]) for x, a in own}
    return found


def _brute_inclusions(plain):
    values = {f"{t}.{c}": [r[i] for r in rows] for t, (columns, rows) in plain.items() for i, c in enumerate(columns)}
    out = set()
    for a, own in values.items():
        for b, theirs in values.items():
            x, y = set(own) - {None}, set(theirs) - {None}
            if a != b and x and x <= y:
                out.add((a, b, len(x), len(y), len(y) == len(theirs)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_tables_equal_brute_force(spark, seed):
    tables, plain = _tables(spark, seed)
    for sample in (1, 1000):  # the sample only refutes: its size changes nothing
        assert {tuple(r) for r in discovery.keys(tables, 3, sample).collect()} == _brute_keys(plain, 3)
        assert {tuple(r) for r in discovery.dependencies(tables, 2, sample).collect()} == _brute_dependencies(plain, 2)
    assert {tuple(r) for r in discovery.inclusions(tables).collect()} == _brute_inclusions(plain)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_tables_larger_than_a_slice_equal_brute_force(spark, monkeypatch, broadcast):
    for name, value in (("SLICE", 7), ("ENTRIES", 16), ("SUSPECTS", broadcast)):
        monkeypatch.setattr(discovery, name, value)
    tables, plain = _tables(spark, 4)
    rows = [(i, i % 20, i // 20, i if i != 39 else 38, 5, i % 20 if i != 33 else 1) for i in range(40)]  # one late row breaks a key and a dependency
    plain["late"] = ([f"c{i}" for i in range(6)], rows)
    tables["late"] = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(6))).repartition(3)
    assert {tuple(r) for r in discovery.keys(tables, 2, 5).collect()} == _brute_keys(plain, 2)
    assert {tuple(r) for r in discovery.dependencies(tables, 2, 5).collect()} == _brute_dependencies(plain, 2)


def _sent(spark, use):
    """Shuffled bytes a row, by the plan's own metrics."""
    seen = {s.stageId(): s.shuffleWriteBytes() for s in _stages(spark)}
    use()
    return sum(s.shuffleWriteBytes() - seen.get(s.stageId(), 0) for s in _stages(spark))


def _stages(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [stages.apply(i) for i in range(stages.size())]


def test_a_row_costs_few_bytes_a_combination(spark, monkeypatch):
    """Ten pairs of which five fail often, two are never apart and three are keys or nearly so."""
    monkeypatch.setattr(discovery, "SLICE", 1000, raising=False)
    n = 100_000
    df = spark.range(n, numPartitions=4).selectExpr("id % 1000 AS a", "id div 1000 AS b", "hash(id) % 50000 AS c", "hash(id, 1) % 50000 AS d")
    assert _sent(spark, lambda: discovery.keys({"t": df}, 2, 100).collect()) < 40 * n
    assert _sent(spark, lambda: discovery.dependencies({"t": df}, 2, 100).collect()) < 70 * n


def test_a_planted_composite_key_is_found(spark):
    df = spark.range(3000).selectExpr("id % 30 AS warehouse", "CAST(id / 30 AS INT) % 10 AS shelf", "CAST(id / 300 AS STRING) AS bin", "'same' AS town", "IF(id = 7, NULL, id) AS almost", "CAST(id % 30 AS DOUBLE) / 2 AS half")
    found = {r.key_columns for r in discovery.keys({"stock": df.selectExpr("warehouse", "shelf", "CAST(CAST(bin AS DOUBLE) AS INT) AS bin", "town", "almost", "half")}, 3).collect()}
    assert found == {"bin, shelf, warehouse", "bin, half, shelf"}
    given = {(r.determinant, r.column_name) for r in discovery.dependencies({"stock": df.select("warehouse", "half", "town")}).collect()}
    assert given == {("warehouse", "half"), ("half", "warehouse"), ("", "town")}


def test_types_meet_in_their_class_only(spark):
    a = spark.sql("SELECT * FROM VALUES (1, '1', 1.0D, array(1), true, DATE'2024-01-01', 0.0D), (2, '2', 2.0D, array(2), false, DATE'2024-01-02', -0.0D) AS t(i, s, d, l, b, day, zero)")
    b = spark.sql("SELECT * FROM VALUES (1L, 'x', 5.0F, array(1), TIMESTAMP'2024-01-01', map(1, 2)), (2L, NULL, 2.0F, array(2), NULL, map(2, 1)), (3L, '1', 1.0F, array(3), NULL, NULL) AS t(i, s, d, l, ts, m)")
    found = {(r.child, r.parent, r.n_values, r.parent_key) for r in discovery.inclusions({"a": a, "b": b}).collect()}
    assert {p for p in found if p[0][0] != p[1][0]} == {("a.i", "b.i", 2, True), ("a.d", "b.d", 2, True), ("a.l", "b.l", 2, True)}
    assert ("", "zero") in {(r.determinant, r.column_name) for r in discovery.dependencies({"a": a}, 1).collect()}


def test_sketches_lose_no_inclusion_at_size(spark):
    """Beyond what a sketch keeps whole (4096 values), every pair that holds is still a candidate."""
    tables = {"big": spark.range(60_000).selectExpr("id AS k", "id % 15000 AS part", "id * 3 AS other"), "small": spark.range(9000).selectExpr("id * 2 AS even", "id + 55000 AS beyond")}
    found = {(r.child, r.parent) for r in discovery.inclusions(tables).collect()}
    assert found == {("big.part", "big.k"), ("small.even", "big.k")}
    left = {(r.child, r.parent) for r in discovery.inclusion_candidates(discovery.column_sketches(tables)).collect()}
    assert found <= left and ("big.other", "big.k") not in left


def test_the_engine_discovers_and_searches_by_any_vectors(spark):
    from pyspark.sql import functions as F

    from tidemark.engine import Engine

    engine = Engine(spark, "/root/testdata/sf0.001", names=("region", "nation"))
    assert {(r.table_name, r.key_columns) for r in engine.discover("keys", most=1).collect()} >= {("region", "r_regionkey"), ("nation", "n_nationkey")}
    assert ("nation.n_regionkey", "region.r_regionkey", True) in {(r.child, r.parent, r.parent_key) for r in engine.discover("inclusions").collect()}
    assert ("n_nationkey", "n_name") in {(r.determinant, r.column_name) for r in engine.discover("dependencies", most=1).collect()}
    vowels = lambda df: df.select("id", F.array(*[F.regexp_count("words", F.lit(v)).cast("double") for v in "aeiou"]).alias("vector"))
    assert [set(r) for r in engine.search("region", 2, "table", vowels)] == [{"element", "score", "kind"}] * 2


def test_a_class_travels_twice_a_task_at_most():
    import numpy as np
    import pyarrow as pa

    h = pa.array([7] * 500 + list(range(100)), pa.int64())
    g = pa.array([3] * 500 + [3] * 50 + [4] * 50, pa.int64())
    batches = lambda columns: iter([pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])] * 3)
    sent = [r for b in discovery._packed(batches([h, h, g]), [True, False], 1, 10**6) for r in b.to_pylist()]
    alone, both = (np.frombuffer(r["data"], np.int64) for r in sent)
    assert alone.tolist() == sorted([*range(100)] * 2)  # a key's repetition is told by two rows
    assert both.tolist() == [*range(100), *[3] * 50, *[4] * 50]  # equal values of a class are one
