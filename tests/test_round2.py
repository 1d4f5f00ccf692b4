"""Rules that see through WITH, DISTINCT and windows and run nothing; roles; graphs without hop caps; triples that survive."""

import pytest

from tidemark.engine import Engine
from tidemark.functions import names
from tidemark.operators import graph
from tidemark.operators import triplestore as ts
from tidemark.plans import composite

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF)


@pytest.mark.parametrize(
    "sql, issue",
    [
        ("WITH o AS (SELECT * FROM orders) SELECT sum(o_totalprice) FROM o JOIN lineitem ON l_orderkey = o_orderkey", "measure_across_fan_out"),
        ("SELECT sum(o_totalprice) FROM (SELECT DISTINCT * FROM orders) o JOIN lineitem ON l_orderkey = o_orderkey", "measure_across_fan_out"),
        ("SELECT sum(o_totalprice) OVER (PARTITION BY o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "measure_across_fan_out"),
        ("WITH a AS (SELECT * FROM orders), b AS (SELECT * FROM part) SELECT count(*) FROM a, b", "missing_join_condition"),
        ("SELECT count(*) FROM events JOIN orders ON user_id = o_custkey", "join_of_unknown_cardinality"),
        ("SELECT count(*) FROM orders WHERE nothing = 1", "missing_column"),
        ("SELEC 1", "syntax_error"),
    ],
)
def test_findings(engine, sql, issue):
    assert issue in {f.issue for f in engine.validate(sql).findings}


@pytest.mark.parametrize(
    "sql",
    [
        "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT sum(t) FROM o JOIN customer ON o_custkey = c_custkey",
        "WITH o AS (SELECT * FROM orders) SELECT count(*) FROM o a JOIN o b ON a.o_orderkey = b.o_orderkey",
        "SELECT sum(l_quantity) OVER (PARTITION BY o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT count(*) FROM r",
    ],
)
def test_sound_queries_have_no_error(engine, sql):
    assert engine.validate(sql).is_valid


def test_validation_runs_nothing(engine, spark):
    for sql in ("DROP VIEW orders", "CREATE TEMPORARY VIEW made AS SELECT 1", "SET spark.sql.shuffle.partitions = 3"):
        verdict = engine.validate(sql)
        assert not verdict.is_valid or sql.startswith("SET")
    assert spark.catalog.tableExists("orders") and not spark.catalog.tableExists("made") and spark.conf.get("spark.sql.shuffle.partitions") != "3"


def test_ambiguous_columns_are_an_answer(engine):
    found = engine.query("SELECT doc_id FROM documents JOIN labels ON documents.doc_id = labels.doc_id")
    assert not found["success"] and found["findings"][0]["issue"] == "ambiguous_column" and found["error_type"] == "analysis"


def test_roles_are_named(spark):
    plan = composite.plan_composite(["lineitem", "events"], ["region"])
    assert plan.ambiguous == {("lineitem", "region"): ("l_suppkey>s_nationkey>n_regionkey", "l_orderkey>o_custkey>c_nationkey>n_regionkey")} and plan.conformed == frozenset()
    named = composite.plan_composite(["lineitem", "events"], ["region"], via={("lineitem", "region"): "l_orderkey"})
    assert named.conformed == {"region"} and named.legs[0].ways["region"][-1].parent == "region" and len(named.legs[0].ways["region"]) == 4
    with pytest.raises(LookupError):
        composite.plan_composite(["lineitem"], ["region"], via={("lineitem", "region"): "l_partkey"})
    with pytest.raises(ValueError):
        composite.run_composite(spark, SF, {"lineitem": {"q": composite._cents("l_quantity")}}, {"region": ["r_name"]})
    sums = [{r.r_name: r.q for r in composite.run_composite(spark, SF, {"lineitem": {"q": composite._cents("l_quantity")}}, {"region": ["r_name"]}, via={("lineitem", "region"): v}).collect()} for v in ("l_suppkey", "l_orderkey")]
    assert sums[0] != sums[1] and sum(sums[0].values()) == pytest.approx(sum(sums[1].values()))


def test_components_of_a_long_chain(spark):
    links = [(f"t{k:02}", f"t{k + 1:02}") for k in range(20)] + [("x", "y")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == {f"t{k:02}": "t00" for k in range(21)} | {"x": "x", "y": "x"}


def test_literals_survive_turtle(spark):
    texts = ["two\nlines", "a \\n that is no newline", 'quote " and \\', "tab\t and \r", ""]
    store = spark.createDataFrame([("g", f"s{i}", "comment", t) for i, t in enumerate(texts)], "g string, s string, p string, o string")
    lines = ts.turtle_lines(store)
    assert all("\n" not in r.value for r in lines.collect())
    assert {r.s: r.o for r in ts.read_turtle_lines(lines).collect()} == {f"s{i}": t for i, t in enumerate(texts)}
    with pytest.raises(Exception, match="not a line"):
        ts.read_turtle_lines(spark.createDataFrame([("no triple",)], "value string")).collect()


def test_confidence_counts_kinds_and_matched_names():
    assert names.key_confidence("customer_id", "INT", "customers", "BIGINT") == "high"
    assert names.key_confidence("fk_customer", "VARCHAR(10)", "customer", "STRING") == "high"
    assert names.key_confidence("weight", "DOUBLE", "customer", "BIGINT") == "low"
