"""Every registered query of the core that SQL can express against DuckDB on the same files."""

import decimal
import os

import duckdb
import pytest

from tidemark import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5)
    return str(v)[:26].replace(" 00:00:00", "") if hasattr(v, "isoformat") else v


def rows(names, found):
    return sorted(repr(tuple(value(r[i]) for i in names)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = [tuple(r) for r in df.collect()]
    order = sorted(df.columns)
    assert rows([df.columns.index(c) for c in order], got) == rows([want.columns.index(c) for c in order], want.fetchall())


def test_only_iterations_have_no_sql():
    # plain versions, recall and a dense decomposition hold these in their own tests
    assert set(QUERIES) - set(ORACLES) == {"communities_label_propagation", "communities_louvain", "index_nearest_probed", "latent_text_vectors"}


def test_entry_imports_and_names_match():
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = QUERIES["project_alias_filter"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_tax" not in plan.split("ReadSchema")[1]


def test_profile_counts_come_from_footers(spark, tmp_path):
    """Nulls, a nested column, a table in two files, an empty one, and one whose footers have no counts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemark.operators import catalog
    from tidemark.sources.keys import Registry

    spark.sql("SELECT id, IF(id % 3 = 0, NULL, 'x') AS t, IF(id = 4, NULL, array(id)) AS l, IF(id > 6, NULL, named_struct('a', id)) AS s FROM range(10)").repartition(2).write.parquet(f"{tmp_path}/two.parquet")
    spark.range(0).selectExpr("id", "'' AS t").write.parquet(f"{tmp_path}/none.parquet")
    pq.write_table(pa.table({"id": [1, 2, None], "t": ["a", None, None]}), f"{tmp_path}/blind.parquet", write_statistics=False)
    assert catalog._footer_counts(spark, str(tmp_path), "two", ["id", "t"]) == {"": 10, "id": 10, "t": 6}
    assert catalog._footer_counts(spark, str(tmp_path), "blind", ["id", "t"]) is None
    found = {(r.table_name, r.column_name): (r.n, r.n_values) for r in catalog.profile(spark, str(tmp_path), Registry(), ("two", "none", "blind")).collect()}
    assert found == {("two", "id"): (10, 10), ("two", "t"): (10, 6), ("two", "l"): (10, 9), ("two", "s"): (10, 7), ("none", "id"): (0, 0), ("none", "t"): (0, 0), ("blind", "id"): (3, 2), ("blind", "t"): (3, 1)}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
