import pytest

from tidemark.plans.rules import validate
from tidemark.sources.keys import ForeignKey, Registry
from tidemark.sources.tables import register

SF = "/root/testdata/sf0.001"

CASES = {
    "measure on the one side": ("SELECT sum(o_totalprice) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", {("measure_across_fan_out", "ERROR")}),
    "measure on the many side": ("SELECT sum(l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", set()),
    "through two keys": ("SELECT sum(c_acctbal) FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey", {("measure_across_fan_out", "ERROR")}),
    "siblings": ("SELECT sum(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey JOIN events ON user_id = c_custkey", {("measure_across_fan_out", "ERROR")}),
    "star with two dimensions": ("SELECT sum(l_quantity) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", set()),
    "one to one": ("SELECT sum(n_chars) FROM documents d JOIN labels l ON d.doc_id = l.doc_id", set()),
    "row count over one key": ("SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", set()),
    "row count over two children": ("SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey", {("multiple_fan_out_joins", "ERROR")}),
    "min, max and distinct": ("SELECT min(o_totalprice), max(o_totalprice), count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", set()),
    "conditional count of the one side": ("SELECT sum(CASE WHEN o_totalprice > 100 THEN 1 ELSE 0 END) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", {("conditional_row_count", "WARNING")}),
    "conditional count of the many side": ("SELECT sum(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", set()),
    "pre-aggregated": ("WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT sum(o_totalprice) FROM orders JOIN l ON l_orderkey = o_orderkey", set()),
    "through a derived table": ("SELECT sum(o_totalprice) FROM (SELECT o_orderkey AS k, o_totalprice FROM orders) o JOIN lineitem ON l_orderkey = k", {("measure_across_fan_out", "ERROR")}),
    "no condition": ("SELECT c_name FROM customer, orders", {("missing_join_condition", "ERROR")}),
    "condition in WHERE": ("SELECT c_name FROM customer, orders WHERE o_custkey = c_custkey", set()),
    "subquery is no product": ("SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", set()),
    "off the key": ("SELECT c_name FROM customer JOIN orders ON o_orderkey = c_custkey", {("join_not_on_key", "WARNING")}),
    "text against number": ("SELECT o_orderkey FROM orders WHERE o_orderstatus > 5", {("type_mismatch", "WARNING")}),
    "date literal": ("SELECT o_orderkey FROM orders WHERE o_orderdate > '1996-01-01'", set()),
    "sum of a key": ("SELECT sum(o_custkey) FROM orders", {("sum_of_non_additive", "ERROR")}),
    "sum of a price": ("SELECT sum(unit_price) FROM priced", {("sum_of_non_additive", "WARNING")}),
    "no such table": ("SELECT a FROM nowhere", {("missing_table", "ERROR")}),
    "no such column": ("SELECT nope FROM orders", {("missing_column", "ERROR")}),
    "not grouped": ("SELECT o_orderstatus, sum(o_totalprice) FROM orders GROUP BY o_custkey", {("missing_group_by", "ERROR")}),
    "ambiguous": ("SELECT doc_id FROM documents, labels", {("ambiguous_column", "WARNING")}),
    "syntax": ("SELECT FROM WHERE", None),
    "view in a join": ("SELECT * FROM rich JOIN orders ON o_custkey = c_custkey", {("view_not_joinable", "ERROR")}),
    "rollup": ("SELECT o_orderstatus, count(*) FROM orders GROUP BY ROLLUP (o_orderstatus)", set()),
    "window": ("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) FROM orders", set()),
}


@pytest.fixture(scope="module")
def session(spark):
    register(spark, SF)
    spark.sql("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0").createOrReplaceTempView("rich")
    spark.sql("SELECT o_orderkey AS id, o_totalprice AS unit_price FROM orders").createOrReplaceTempView("priced")
    return spark


@pytest.mark.parametrize("case", CASES)
def test_verdict(session, case):
    sql, want = CASES[case]
    verdict = validate(session, sql)
    if want is None:
        assert not verdict.is_valid
    else:
        assert {(f.issue, f.severity) for f in verdict.findings} == want


def test_override(session):
    verdict = validate(session, CASES["siblings"][0], allow_fan_out=True)
    assert verdict.is_valid and verdict.fan_trap_overridden and not verdict.fan_trap_blocking


def test_flagged_totals_differ_and_clean_ones_agree(session):
    """A flagged sum is really inflated; a clean one is not."""
    alone = session.sql("SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2))) FROM orders").first()[0]
    joined = session.sql("SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2))) FROM orders JOIN lineitem ON l_orderkey = o_orderkey").first()[0]
    to_one = session.sql("SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2))) FROM orders JOIN customer ON o_custkey = c_custkey").first()[0]
    assert joined != alone == to_one


def test_disjoint_siblings():
    registry = Registry({}, [ForeignKey("orders", "customer_id", "customers", "id"), ForeignKey("returns", "customer_id", "customers", "id"), ForeignKey("lines", "order_id", "orders", "id")])
    assert registry.disjoint() == [("orders", "returns")]
