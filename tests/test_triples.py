import pytest

from tidemark.operators import triplestore as ts


@pytest.fixture(scope="module")
def store(spark):
    rows = [("a", "rdf:type", "owl:Class"), ("b", "rdf:type", "owl:Class"), ("c", "rdf:type", "owl:Class"), ("a", "next", "b"), ("b", "next", "c"), ("c", "next", "a"), ("a", "label", 'say "hi" \\ there')]
    return spark.createDataFrame([("g", *r) for r in rows], "g string, s string, p string, o string")


def test_patterns(store):
    found = ts.match(store, [("?x", "next", "?y"), ("?y", "next", "?z")], [("?x", "label", "?l")]).collect()
    assert {(r.x, r.y, r.z, r.l is None) for r in found} == {("a", "b", "c", False), ("b", "c", "a", True), ("c", "a", "b", True)}
    assert ts.ask(store, [("a", "next", "?x")]) and not ts.ask(store, [("?x", "next", "?x")])
    with pytest.raises(ValueError):
        ts.match(store, [("?x", "next", "?y"), ("?u", "label", "?v")])
    assert {tuple(r) for r in ts.construct(store, [("?x", "next", "b")], [("b", "before", "?x")]).collect()} == {("b", "before", "a")}


def test_closure_of_a_cycle(store):
    assert ts.path_plus(store, "next").count() == 9


def test_graphs(store, spark):
    other = spark.createDataFrame([("x", "next", "y")], "s string, p string, o string")
    both = store.unionByName(ts.replace_graph(store.limit(0), "h", other))
    assert {(r.g, r.triples) for r in ts.stats(both).collect()} == {("g", 7), ("h", 1)}
    assert ts.replace_graph(both, "g", other).count() == 2 and ts.drop_graph(both, "g").count() == 1
    assert ts.graph_uri("my db.main") == "http://example.com/schema/my_db_main"


def test_turtle_round_trip(store):
    back = ts.read_turtle_lines(ts.turtle_lines(store))
    assert {tuple(r) for r in back.collect()} == {(r.s, r.p, r.o) for r in store.collect()}
    assert ts.escape('a"b\n') == 'a\\"b\\n'


def test_shapes(store):
    assert {(r.node, r.shape) for r in ts.shape_violations(store).collect()} == {(n, "owl:Class without rowCount") for n in "abc"}
