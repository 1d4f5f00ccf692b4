import pytest

from tidemark.engine import Engine
from tidemark.functions import names
from tidemark.operators import shaping
from tidemark.plans import composite, safety
from tidemark.sources.keys import DRIVER, ForeignKey, Registry
from tidemark.sources.tables import table
from tidemark.streaming import events

SF = "/root/testdata/sf0.001"
SALES = Registry(
    {t: ("id",) for t in ("orders", "order_items", "customers", "returns", "products")},
    [ForeignKey("order_items", "order_id", "orders", "id"), ForeignKey("orders", "customer_id", "customers", "id"), ForeignKey("returns", "customer_id", "customers", "id"), ForeignKey("order_items", "product_id", "products", "id")],
)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF)


def test_composite_plans():
    plan = composite.plan_composite(["orders", "returns"], registry=SALES)
    assert plan.required and [leg.fact for leg in plan.legs] == ["orders", "returns"] and plan.conformed == {"customers"}
    plan = composite.plan_composite(["order_items", "returns"], registry=SALES)
    assert {leg.fact: leg.null_pad for leg in plan.legs}["returns"] == {"orders", "products"}
    plan = composite.plan_composite(["orders", "order_items"], registry=SALES)
    assert not plan.required and [leg.fact for leg in plan.legs] == ["order_items"]
    with pytest.raises(ValueError):
        composite.plan_composite([])
    with pytest.raises(LookupError):
        composite.plan_composite(["nope"])


def test_reach_and_measures_are_inverse(engine):
    everything = set(DRIVER.primary) | {"lineitem"}
    for x in everything:
        for y in everything:
            assert (x in engine.reachable_from(y)) == (y in engine.measurable_from(x))
    assert engine.reachable_from("lineitem") == {"orders": 1, "part": 1, "supplier": 1, "customer": 2, "nation": 2, "region": 3}
    assert set(engine.reachable_from("lineitem", 1)) == {"orders", "part", "supplier"}


def test_cycles_end():
    loop = Registry({}, [ForeignKey("a", "b_id", "b", "id"), ForeignKey("b", "a_id", "a", "id"), ForeignKey("a", "a_id", "a", "id")])
    assert set(composite.reachable(loop, "a")) == {"b"}


@pytest.mark.parametrize(
    ("sql", "kind", "allowed"),
    [
        ("SELECT 1", "SELECT", True),
        ("SELECT c_name FROM customer WHERE c_custkey = 1", "SELECT", True),
        ("WITH a AS (SELECT 1 AS x) SELECT x FROM a", "CTE_SELECT", True),
        ("SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders", "SELECT", True),
        ("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders", "SELECT", True),
        ("SHOW TABLES", "METADATA", True),
        ("DESCRIBE customer", "METADATA", True),
        ("DROP TABLE customer", "WRITE", False),
        ("INSERT INTO t SELECT * FROM customer", "WRITE", False),
        ("WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT x FROM a", "WRITE", False),
        ("CREATE TABLE t AS SELECT 1", "WRITE", False),
        ("DELETE FROM t", "WRITE", False),
        ("SELECT 1; DROP TABLE t", "DENIED", False),
        ("SELECT * FROM t WHERE a = 1 OR 1=1", "DENIED", False),
        ("SELECT * FROM t WHERE a = 'x' -- y", "DENIED", False),
        ("SELECT * FROM mysql.user", "DENIED", False),
        ("SELEC", "UNKNOWN", False),
        ("", "UNKNOWN", False),
    ],
)
def test_gate(spark, sql, kind, allowed):
    found = safety.gate(spark, sql)
    assert (found.kind, found.allowed) == (kind, allowed)


def test_strict_gate_identifiers_and_masks(spark):
    assert not safety.gate(spark, "SELECT a FROM t UNION SELECT o_custkey FROM orders", strict=True).allowed
    assert safety.identifier("a.b.c") and not safety.identifier("a.b.c.d") and not safety.identifier("a-b") and not safety.identifier("x" * 129)
    assert safety.masked("SELECT 'it''s' FROM t") == "SELECT '***' FROM t"


def test_measure_classes():
    of = lambda name, kind, **keys: names.measure_class(name, kind, **keys)
    assert of("sale_id", "INTEGER", primary=True) == of("customer_id", "INTEGER", foreign=True) == of("region_name", "TEXT") == of("sale_date", "DATE") == ("attribute", "structural")
    assert of("amount", "DECIMAL") == of("quantity", "INTEGER") == ("additive", "name_pattern")
    assert of("unit_price", "DECIMAL")[0] == "non_additive" and of("account_balance", "DECIMAL")[0] == "semi_additive" and of("mystery_number", "DECIMAL") == (None, None)


def test_types():
    assert [names.type_kind(t) for t in ("UInt64", "POINT", "Array(Float64)", "decimal(10,2)", "interval day", "oddity")] == ["numeric", "non_numeric", "non_numeric", "numeric", "non_numeric", "unknown"]
    assert [names.xsd_type(*x) for x in (("a", "tinyint"), ("a", "bigint"), ("a", "varchar(9)"), ("a", "timestamp"), ("a", "date"), ("a", "double"), ("a", "decimal(9,2)"), ("l_discount", "double"), ("a", "boolean"), ("a", "uuid"))] == ["byte", "integer", "string", "dateTime", "date", "double", "decimal", "integer", "boolean", "string"]


def test_implied_keys():
    tables = {"CUSTOMER": ("c_customer_sk",), "ITEM": ("i_item_sk",), "STORE_SALES": ()}
    assert names.implied_key("STORE_SALES", "ss_customer_sk", tables)[:2] == ("CUSTOMER", "c_customer_sk")
    assert names.implied_key("STORE_SALES", "ss_item_sk", tables)[0] == "ITEM" and names.implied_key("STORE_SALES", "ss_sold_date_sk", tables) is None
    assert names.implied_key("orders", "customer_id", {"customers": ("id",), "orders": ("id",)})[:2] == ("customers", "id")
    assert names.key_confidence("customer_id", "INTEGER", "customers", "INTEGER") == "high" and names.key_confidence("cust", "TEXT", "customers", "INTEGER") == "low"
    assert names.display_name("order_total") == "Order Total" and names.clean_name("1 a.b") == "_1_a_b"


def test_query_contract(engine):
    good = engine.query("SELECT c_mktsegment, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", limit=3)
    assert good["success"] and good["row_count"] == 3 and good["truncated"] and good["fan_trap"] == {"evaluated": True, "blocking": False, "overridden": False}
    bad = engine.query("SELECT sum(o_totalprice) FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    assert not bad["success"] and bad["fan_trap"]["blocking"] and bad["data"] == []
    assert engine.query("SELECT sum(o_totalprice) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey", allow_fan_out=True)["success"]
    assert engine.query("DROP TABLE orders")["error_type"] == "security"
    with pytest.raises(ValueError):
        engine.query("SELECT c_name FROM customer", limit=0)
    with pytest.raises(ValueError):
        engine.frame("SELECT c_name FROM customer, orders")


def test_facade(engine):
    assert len(engine.sample("orders", 4)) == 4 and engine.describe("orders")[1]["references"] == "customer.c_custkey"
    assert len(engine.fingerprint()) == 16 and engine.search("orders totalprice", 3)[0]["element"].startswith("orders")
    assert {r.first_table for r in engine.ask_graph("disjoint_siblings").collect()} == {"customer", "events"}


def test_calendar_order(spark):
    df = spark.createDataFrame([("Q2 2023", 1), ("2023-Q1", 2), ("Q4/2022", 9)], "x string, v int")
    from pyspark.sql import functions as F

    assert [r.x for r in shaping.ordered_sum(df, "x", F.col("v")).orderBy("place").collect()] == ["Q4/2022", "2023-Q1", "Q2 2023"]
    df = spark.createDataFrame([("12AM", 1), ("1 PM", 5), ("11:30 AM", 2)], "x string, v int")
    assert [r.x for r in shaping.ordered_sum(df, "x", F.col("v")).orderBy("place").collect()] == ["12AM", "11:30 AM", "1 PM"]
    assert shaping.axis(["a" * 11])["rotation"] == 45 and shaping.measure_axes(["a_pct", "b"]) == {"a_pct": 2, "b": 1}


def test_stream_equals_batch(spark):
    live = events.tumbling(events.stream(spark, SF))
    query = live.writeStream.format("memory").queryName("live").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM live").collect()}
    assert got == {tuple(r) for r in events.tumbling(table(spark, SF, "events")).collect()}
