"""Schema reports, triples and shapes on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import names
from tidemark.operators import schema, shaping
from tidemark.operators import triplestore as ts
from tidemark.sources import views

SF = "/root/testdata/sf0.001"


def test_denormalized_names():
    tables = {"customers": ("id",), "categories": ("id",), "orders": ("id",)}
    assert names.denormalized("orders", "customer_name", "varchar(20)", tables) == "customers"
    assert names.denormalized("orders", "category", "string", tables) == "categories"
    assert names.denormalized("orders", "customer_id", "string", tables) is None
    assert names.denormalized("customers", "customer_name", "string", tables) is None
    assert names.denormalized("orders", "customer_name", "bigint", tables) is None


def test_implied_keys_take_other_endings():
    tables = {"orders": ("o_orderkey",), "lines": ("l_id",)}
    assert names.implied_key("lines", "l_orderkey", tables) is None
    assert names.implied_key("lines", "l_orderkey", tables, ("key",)) == ("orders", "o_orderkey", "embedded_table_name")
    assert names.implied_key("lines", "l_order_key", tables, ("key",)) == ("orders", "o_orderkey", "embedded_table_name")


@pytest.mark.parametrize("have,verdict,pct", [("abcd", "full_match", 100), ("ab", "partial_match", 50), ("a", "low_match", 25), ("x", "no_match", 0), ("", "no_match", 0)])
def test_compatibility(spark, have, verdict, pct):
    frame = lambda ns: spark.createDataFrame([(n,) for n in ns], "table_name string")
    rows = schema.compatibility(frame("abcd"), frame(have.upper() + "")).collect()
    assert {(r.verdict, r.pct) for r in rows} == {(verdict, pct)}
    assert {r.side for r in rows if r.table_name == "x"} <= {"catalogue only"}


def test_names_are_applied(spark):
    kind = "table_name string, column_name string, label string"
    elements = spark.createDataFrame([("t", None, "T"), ("t", "a", "A"), ("u", "a", "Amount"), ("u", "b", "B")], kind)
    wanted = spark.createDataFrame([("t", "a", "amount"), ("t", None, "Orders"), ("t", "zz", "Lost"), ("u", "b", " ")], kind.replace("label", "name"))
    found = {(r.table_name, r.column_name): (r.label, r.applied) for r in schema.apply_names(elements, wanted).collect()}
    assert found == {("t", None): ("Orders", True), ("t", "a"): ("amount (t a)", True), ("u", "a"): ("Amount", False), ("u", "b"): ("B", False)}


def test_upsert_replaces_and_adds(spark):
    frame = lambda rows: spark.createDataFrame(rows, "element string, words string")
    assert sorted(tuple(r) for r in schema.upsert(frame([("a", "1"), ("b", "2")]), frame([("b", "3"), ("c", "4")])).collect()) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_quality_report_counts(spark):
    profile = spark.createDataFrame([("t", "id", "numeric", "attribute", 3, 3), ("t", "x", "numeric", None, 3, 0), ("u", "y", "non_numeric", "attribute", 0, 0)], "table_name string, column_name string, kind string, measure_class string, n bigint, n_values bigint")
    edges = spark.createDataFrame([], "src string, dst string")
    found = {r.measure: r.value for r in schema.quality_report(profile, edges, spark.createDataFrame([("t", "id")], "table_name string, column_name string")).collect()}
    assert found == {"tables": 2, "columns": 3, "keys that hold": 0, "tables without rows": 1, "tables without a primary key": 1, "tables without a link": 2, "numeric columns without a class": 1, "columns without values": 1, "columns with nulls": 1}
    said = spark.createDataFrame([("t", "id")], "table_name string, column_name string")
    assert {r.table_name: (r.n_columns, r.classified, r.filled, r.described) for r in schema.enrichment_coverage(profile, said).collect()} == {"t": (2, 0.5, 0.5, 0.5), "u": (1, 1.0, 0.0, 0.0)}


def test_repeated_descriptions_count_nulls_apart(spark, tmp_path):
    from tidemark.sources.keys import ForeignKey, Registry

    rows = [(1, "a", None), (1, "a", None), (2, "b", None), (2, "b", "x"), (3, "c", "y"), (None, "d", "z"), (None, "e", "z")]
    spark.createDataFrame(rows, "k bigint, same string, some string").write.parquet(f"{tmp_path}/child.parquet")
    found = schema.denormalized_columns(spark, str(tmp_path), Registry(foreign=[ForeignKey("child", "k", "p", "id")])).collect()
    assert {(r.column_name, r.n_keys, r.n_determined) for r in found} == {("same", 2, 2), ("some", 2, 1)}


def test_triples_are_added_once(spark):
    store = spark.createDataFrame([("default", "a", "p", "1")], "g string, s string, p string, o string")
    facts = spark.createDataFrame([("a", "p", "1"), ("a", "p", "2"), ("a", "p", "2"), ("a", "p", None)], "s string, p string, o string")
    assert ts.add(store, facts).count() == 2
    known = ts.add_knowledge(store, facts, {"by": "me"})
    assert sorted(r.o for r in known.collect()) == ["1", "2", "me"]
    assert ts.from_graphs(known.unionByName(known.withColumn("g", F.lit("x"))), ["default", "x"]).count() == 3


def test_select_unions_filters_and_groups(spark):
    store = spark.createDataFrame([("g", "a", "p", "1"), ("g", "b", "q", "2"), ("g", "b", "p", "5")], "g string, s string, p string, o string")
    both = ts.select(store, [[("?s", "p", "?x")], [("?s", "q", "?y")]])
    assert sorted(map(tuple, both.select("s", "x", "y").collect()), key=str) == [("a", "1", None), ("b", "5", None), ("b", None, "2")]
    assert [r.s for r in ts.select(store, [[("?s", "p", "?x")]], where=F.col("x") > 3).collect()] == ["b"]
    assert ts.select(store, [[("?s", "p", "?x")]], measures=[F.count("*").alias("n")]).first().n == 2


def test_path_plus_follows_long_chains_and_cycles(spark):
    rows = [("g", f"n{i}", "next", f"n{i + 1}") for i in range(20)] + [("g", "x", "next", "y"), ("g", "y", "next", "x")]
    assert ts.path_plus(spark.createDataFrame(rows, "g string, s string, p string, o string"), "next").count() == 20 * 21 // 2 + 4


def test_every_shape_finds_its_breach(spark):
    rows = [("c", "rdf:type", "owl:Class"), ("d", "rdf:type", "owl:DatatypeProperty"), ("k", "rdf:type", "owl:ObjectProperty"), ("k2", "referencedTable", "nowhere"), ("k2", "joinsTo", "no.column"), ("d", "measureType", "odd")]
    found = ts.shape_violations(spark.createDataFrame([("g", *r) for r in rows], "g string, s string, p string, o string"))
    assert found.select("shape").distinct().count() == 8


def test_time_axis(spark):
    day = datetime.date(2024, 1, 2)
    df = spark.createDataFrame([(None, None, None, day, 2024), ("no", "x", "01.02.2024", day, 2024), ("2024-05", "y", "z", day, 2024)], "a string, b string, c string, d date, e int")
    assert [shaping.is_time_axis(df, c) for c in "abcde"] == [True, False, True, True, False]
    assert not shaping.is_time_axis(df.limit(0), "a")


def test_one_month_is_enough_for_months_order(spark):
    df = spark.createDataFrame([("other", 1), ("Mar", 2), ("january", 3), ("mar", 1), (None, 9)], "x string, v int")
    assert [r.x for r in shaping.month_ordered(df, "x", F.col("v")).collect()] == ["january", "Mar", "mar", "other"]


def test_engine_context_search_and_views(spark, tmp_path):
    engine = Engine(spark, SF)
    assert engine.search("market segment of a customer", 3, "table")[0]["element"] == "customer"
    found = engine.context("total price of orders", 1)
    assert [t["table_name"] for t in found["tables"] if t["role"] == "search"] == ["orders"]
    assert {(j["src"], j["dst"]) for j in found["joins"]} == {("lineitem", "orders"), ("orders", "customer")}
    assert found["token_estimate"] == 200 * len(found["tables"]) + 50 * len(found["columns"]) + 100 * len(found["joins"])
    spark.sql("WITH o AS (SELECT * FROM orders) SELECT c_name, o_totalprice FROM o JOIN customer ON o_custkey = c_custkey").createOrReplaceTempView("order_names")
    seen = {v["name"]: v for v in engine.views()}
    assert seen["order_names"]["derived_from"] == ["customer", "orders"] and "orders" not in seen
    spark.catalog.dropTempView("order_names")
    assert engine.analyze("region")["row_count"] == 5 and engine.analyze("nope") is None and "default" in engine.databases()
    place = str(tmp_path / "index")
    assert views.load_index(spark, place, "f1") is None
    views.save_index(engine.elements(), place, "f1")
    assert views.load_index(spark, place, "f1").count() == engine.elements().count() and views.load_index(spark, place, "f2") is None
