"""Triples (g, s, p, o) as a DataFrame: named graphs, patterns as joins, closures, shape checks, Turtle."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import clean_name
from tidemark.operators import catalog
from tidemark.operators.catalog import triples as catalogue_triples
from tidemark.session import checkpointed, shared_folder
from tidemark.sources.graphs import GraphStore
from tidemark.sources.tables import table
from tidemark.sources.turtle import compacted, read_turtle

Pattern = tuple[str, str, str]


def graph_uri(name: str) -> str:
    return "http://example.com/schema/" + re.sub(r"[ .]", "_", name)


def replace_graph(store: DataFrame, graph: str, fresh: DataFrame) -> DataFrame:
    """The store with one named graph replaced by other triples (s, p, o)."""
    return store.where(F.col("g") != graph).unionByName(fresh.select(F.lit(graph).alias("g"), "s", "p", "o"))


def drop_graph(store: DataFrame, graph: str) -> DataFrame:
    return store.where(F.col("g") != graph)


def stats(store: DataFrame) -> DataFrame:
    """Triples, subjects and predicates of each graph."""
    return store.groupBy("g").agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"))


def match(store: DataFrame, patterns: Iterable[Pattern], optional: Iterable[Pattern] = ()) -> DataFrame:
    """Solutions of a basic graph pattern: a column for each ``?name``; optional patterns are left joins.

    Every pattern filters the store before it joins, on the names it shares with those
    before it. Patterns must connect.
    """

    def one(pattern: Pattern) -> DataFrame:
        found, names = store, {}
        for column, term in zip(("s", "p", "o"), pattern):
            if not term.startswith("?"):
                found = found.where(F.col(column) == term)
            elif term[1:] in names:
                found = found.where(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        return found.select(*[F.col(c).alias(n) for n, c in names.items()]).distinct()

    def join(left: DataFrame, pattern: Pattern, how: str) -> DataFrame:
        right = one(pattern)
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError("the patterns do not connect")
        return left.join(right, shared, how)

    first, *rest = patterns
    found = reduce(lambda a, p: join(a, p, "inner"), rest, one(first))
    return reduce(lambda a, p: join(a, p, "left"), optional, found)


def from_graphs(store: DataFrame, graphs: Iterable[str]) -> DataFrame:
    """The triples of some named graphs as one, each once."""
    return store.where(F.col("g").isin(*graphs)).select(F.lit("default").alias("g"), "s", "p", "o").distinct()


def select(store: DataFrame, groups: Iterable[Iterable[Pattern]], optional: Iterable[Pattern] = (), where: Column | None = None, by: Iterable[str] = (), measures: Iterable[Column] = ()) -> DataFrame:
    """Solutions of any of several groups of patterns, filtered, and with measures also grouped.

    The groups are a union: a name that a group lacks is null in its solutions, and a solution
    of two groups counts twice. ``where`` and ``measures`` are expressions over the names; a
    solution for which ``where`` is null goes.
    """
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [match(store, g, optional) for g in groups])
    found = found if where is None else found.where(where)
    measures = list(measures)
    return found.groupBy(*by).agg(*measures) if measures else found


def add(store: DataFrame, facts: DataFrame, graph: str = "default") -> DataFrame:
    """The store with triples (s, p, o) added to a graph; what it holds already is not added again, and triples with a null part are left out."""
    fresh = facts.select(F.lit(graph).alias("g"), "s", "p", "o").dropna().distinct()
    return store.unionByName(fresh.join(store, ["g", "s", "p", "o"], "left_anti"))


def add_knowledge(store: DataFrame, facts: DataFrame, about: dict[str, str], graph: str = "default") -> DataFrame:
    """Add triples, and for each subject its metadata, under predicates of the metadata namespace."""
    said = F.array(*[F.struct(F.lit(f"http://example.com/metadata#{k}").alias("p"), F.lit(v).alias("o")) for k, v in about.items()])
    meta = facts.select("s").distinct().select("s", F.explode(said).alias("m")).select("s", "m.p", "m.o") if about else facts.limit(0)
    return add(store, facts.select("s", "p", "o").unionByName(meta.select("s", "p", "o")), graph)


def ask(store: DataFrame, patterns: Iterable[Pattern]) -> bool:
    return not match(store, patterns).isEmpty()


def construct(store: DataFrame, patterns: Iterable[Pattern], template: Iterable[Pattern]) -> DataFrame:
    """New triples (s, p, o) from the solutions of a pattern."""
    found = match(store, patterns)
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    return found.select(F.explode(F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template])).alias("t")).select("t.*").distinct()


def path_plus(store: DataFrame, predicate: str) -> DataFrame:
    """(s, o) joined by one step of a predicate or more.

    Each round joins the paths with themselves, so that their length doubles, until no pair
    is new.
    """
    reach = checkpointed(store.where(F.col("p") == predicate).select("s", "o").distinct())
    known = reach.count()
    while True:
        further = reach.join(reach.select(F.col("s").alias("o"), F.col("o").alias("end")), "o").select("s", F.col("end").alias("o"))
        reach = checkpointed(reach.union(further).distinct())
        before, known = known, reach.count()
        if before == known:
            return reach


def shape_violations(store: DataFrame) -> DataFrame:
    """(node, shape): nodes of a catalogue graph that break a shape."""
    typed = lambda kind: store.where((F.col("p") == "rdf:type") & (F.col("o") == kind)).select(F.col("s").alias("node"))
    having = lambda p: store.where(F.col("p") == p).select(F.col("s").alias("node"), F.col("o").alias("value"))
    lacks = lambda kind, p: typed(kind).join(having(p), "node", "left_anti").select("node", F.lit(f"{kind} without {p}").alias("shape"))
    classes = typed("owl:Class").withColumnRenamed("node", "value")
    dangling = having("referencedTable").join(classes, "value", "left_anti").select("node", F.lit("key to an unknown table").alias("shape"))
    columns = typed("owl:DatatypeProperty").withColumnRenamed("node", "value")
    missing = having("joinsTo").join(columns, "value", "left_anti").select("node", F.lit("key to an unknown column").alias("shape"))
    kinds = having("measureType").where(~F.col("value").isin("attribute", "additive", "semi_additive", "non_additive")).select("node", F.lit("unknown measure type").alias("shape"))
    parts = [lacks("owl:Class", "rowCount"), lacks("owl:DatatypeProperty", "rdfs:domain"), lacks("owl:DatatypeProperty", "rdfs:range"), lacks("owl:ObjectProperty", "referencedTable"), lacks("owl:ObjectProperty", "cardinality"), dangling, missing, kinds]
    return reduce(DataFrame.unionAll, parts)


# Characters of a literal and how they are written; the backslash comes first.
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def escape(text: str) -> str:
    """A literal's text inside quotes."""
    for plain, written in _ESCAPES:
        text = text.replace(plain, written)
    return text


def turtle_lines(store: DataFrame, base: str = "http://example.com/schema/") -> DataFrame:
    """One line of Turtle a triple; names of the catalogue become IRIs, numbers and other texts literals."""
    iri = lambda c: F.when(F.col(c).rlike("^[a-z]+:[A-Za-z]+$"), F.col(c)).otherwise(F.concat(F.lit(f"<{base}"), F.col(c), F.lit(">")))
    known = F.col("p").isin("rdf:type", "rdfs:domain", "referencedTable", "joinsTo")
    text = F.col("o")
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    literal = F.concat(F.lit('"'), text, F.lit('"'))
    return store.select(F.concat_ws(" ", iri("s"), iri("p"), F.when(known, iri("o")).otherwise(literal), F.lit(".")).alias("value"))


def read_turtle_lines(lines: DataFrame, base: str = "http://example.com/schema/") -> DataFrame:
    """The triples (s, p, o) of lines that turtle_lines wrote; a line of another form raises an error when it is read."""
    term = rf'(?:<{re.escape(base)}([^>]*)>|([a-z]+:[A-Za-z]+)|"((?:[^"\\]|\\.)*)")'
    whole = rf"^{term} {term} {term} \.$"

    def part(i: int) -> Column:
        text = F.replace(F.regexp_extract("value", whole, 3 * i + 3), F.lit("\\\\"), F.lit("\0"))
        for plain, written in _ESCAPES[1:]:
            text = F.replace(text, F.lit(written), F.lit(plain))
        return F.concat(*[F.regexp_extract("value", whole, 3 * i + k) for k in (1, 2)], F.replace(text, F.lit("\0"), F.lit("\\")))

    known = F.when(F.col("value").rlike(whole), True).otherwise(F.raise_error(F.concat(F.lit("not a line of a triple: "), F.col("value"))).cast("boolean"))
    return lines.where(known).select(part(0).alias("s"), part(1).alias("p"), part(2).alias("o"))


def rows_as_triples(rows: DataFrame, table: str, key: tuple[str, ...], links: dict[str, str], base: str = "http://example.com/data/") -> DataFrame:
    """The direct mapping of a table: a subject per row from its key, a triple per value, an IRI per foreign key."""
    subject = F.concat(F.lit(f"{base}{clean_name(table)}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in key]))
    value = lambda c: F.concat(F.lit(f"{base}{links[c]}/"), F.col(c).cast("string")) if c in links else F.col(c).cast("string")
    facts = [F.struct(F.lit(f"{clean_name(table)}#{c}").alias("p"), value(c).alias("o")) for c in rows.columns]
    return rows.select(subject.alias("s"), F.explode(F.filter(F.array(*facts), lambda t: t["o"].isNotNull())).alias("t")).select("s", "t.p", "t.o")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_as_triples(table(spark, sf_dir, "customer"), "customer", ("c_custkey",), {"c_nationkey": "nation"})


def _over(use: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the catalogue's triples, written once because it reads them several times."""
    return lambda spark, sf_dir: use(checkpointed(catalogue_triples(spark, sf_dir)))


_REFERS = [("?k", "rdfs:domain", "?a"), ("?k", "referencedTable", "?b")]
#: Numeric columns and keys, by table: a union of groups with a filter and a count.
_USED = [[("?c", "rdfs:domain", "?t"), ("?c", "rdfs:range", "?r")], [("?c", "rdfs:domain", "?t"), ("?c", "referencedTable", "?to")]]


def _kept_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples by graph and predicate after loads, a replacement, an addition and a deletion in a store of its own."""
    store = GraphStore(spark, f"{shared_folder(spark).rstrip('/')}/graphs-{uuid.uuid4().hex}")
    every = checkpointed(catalogue_triples(spark, sf_dir))
    store.load("catalogue", every)
    store.load("keys", every)
    store.load("passing", every)
    store.load("keys", store.read("catalogue").where(F.col("p").isin("rdfs:domain", "referencedTable")))
    store.add("keys", construct(store.read("keys"), _REFERS, [("?a", "refersTo", "?b"), ("?k", "rdfs:domain", "?a")]))
    store.delete("passing")
    return store.read().groupBy("g", "p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"))


def _turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples by predicate after the catalogue was written as Turtle, with a view's triples, and read again."""
    store = GraphStore(spark, f"{shared_folder(spark).rstrip('/')}/graphs-{uuid.uuid4().hex}")
    store.load("catalogue", catalogue_triples(spark, sf_dir))
    store.add("catalogue", view_triples(spark, {"big_orders": (["orders", "customer"], ["o_orderkey", "c_name"])}))
    path = f"{store.folder}/turtle"
    store.export("catalogue", path)
    found, malformed = read_turtle(spark, path)
    return compacted(found).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects")).unionAll(malformed.agg(F.lit("malformed"), F.count("*"), F.lit(0).cast("long"), F.lit(0).cast("long")))


def view_triples(spark: SparkSession, views: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(s, p, o) of views: a class each, its columns, and the tables it is derived from, where they are known."""
    rows = [t for name, (sources, columns) in sorted(views.items()) for t in [(name, "rdf:type", "View"), *[(name, "derivedFrom", s) for s in sources], *[x for c in columns for x in ((f"{name}.{c}", "rdf:type", "ViewColumn"), (f"{name}.{c}", "rdfs:domain", name))]]]
    return spark.createDataFrame(rows, "s string, p string, o string")


def _facts_only(store: DataFrame) -> DataFrame:
    """The store without the tables that have no key of their own, so that keys to them dangle."""
    owners = match(store, _REFERS).select(F.col("a").alias("t")).distinct()
    subject = F.split_part(F.col("s"), F.lit("."), F.lit(1))
    return store.withColumn("t", subject).join(owners, "t", "left_semi").drop("t")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "triples_graph_stats": lambda s, d: stats(catalogue_triples(s, d)),
        "triples_shape_violations": _over(shape_violations),
        "triples_shape_violations_facts": _over(lambda t: shape_violations(_facts_only(t))),
        "triples_union_filter_count": _over(lambda t: select(t, _USED, where=F.col("to").isNotNull() | F.col("r").isin("integer", "double"), by=["t"], measures=[F.count("*").alias("n"), F.countDistinct("c").alias("n_columns"), F.countDistinct("to").alias("n_targets")])),
        "triples_added_closure": _over(lambda t: select(add(t, construct(t, _REFERS, [("?a", "refersTo", "?b")]), "derived"), [[("?a", "refersTo", "?b"), ("?b", "rowCount", "?n")]], by=["a"], measures=[F.sum(F.col("n").cast("bigint")).alias("rows_referred")])),
        "triples_path_plus": _over(lambda t: path_plus(construct(t, _REFERS, [("?a", "refersTo", "?b")]), "refersTo")),
        "rows_as_triples_customer": _customers,
        "stored_graphs": _kept_graphs,
        "turtle_round_trip": _turtle_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    graph = catalog.oracle_sql()["triples_count_by_predicate"].removesuffix(catalog._COUNTS).removeprefix("WITH ")
    base = "'http://example.com/data/"
    return {
        "triples_graph_stats": f"WITH {graph} SELECT 'default' AS g, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates FROM triples",
        "triples_shape_violations": f"WITH {graph}, {_shapes_sql('triples')}",
        "triples_shape_violations_facts": f"WITH {graph}, facts AS (SELECT * FROM triples WHERE string_split(s, '.')[1] IN (SELECT b.o FROM triples a JOIN triples b ON a.s = b.s AND a.p = 'referencedTable' AND b.p = 'rdfs:domain')), {_shapes_sql('facts')}",
        "triples_union_filter_count": f"WITH {graph}, u AS (SELECT DISTINCT a.s AS c, a.o AS t, b.p AS p, b.o AS o FROM triples a JOIN triples b ON a.s = b.s AND a.p = 'rdfs:domain' AND b.p IN ('rdfs:range', 'referencedTable')) SELECT t, count(*) AS n, count(DISTINCT c) AS n_columns, count(DISTINCT CASE WHEN p = 'referencedTable' THEN o END) AS n_targets FROM u WHERE p = 'referencedTable' OR o IN ('integer', 'double') GROUP BY t",
        "triples_added_closure": f"WITH {graph} SELECT a, CAST(sum(n) AS BIGINT) AS rows_referred FROM (SELECT DISTINCT d.o AS a, k.o AS b, CAST(c.o AS BIGINT) AS n FROM triples k JOIN triples d ON k.s = d.s AND k.p = 'referencedTable' AND d.p = 'rdfs:domain' JOIN triples c ON c.s = k.o AND c.p = 'rowCount') q GROUP BY a",
        "triples_path_plus": f"WITH RECURSIVE {graph}, e AS (SELECT DISTINCT a.o AS s, b.o AS o FROM triples a JOIN triples b ON a.s = b.s WHERE a.p = 'rdfs:domain' AND b.p = 'referencedTable'), r(s, o, hop) AS (SELECT s, o, 1 FROM e UNION ALL SELECT r.s, e.o, hop + 1 FROM r JOIN e ON r.o = e.s WHERE hop < 12) SELECT DISTINCT s, o FROM r",
        "turtle_round_trip": f"WITH {graph}, v AS (SELECT DISTINCT s, p, o FROM triples UNION SELECT * FROM (VALUES ('big_orders', 'rdf:type', 'View'), ('big_orders', 'derivedFrom', 'orders'), ('big_orders', 'derivedFrom', 'customer'), ('big_orders.o_orderkey', 'rdf:type', 'ViewColumn'), ('big_orders.o_orderkey', 'rdfs:domain', 'big_orders'), ('big_orders.c_name', 'rdf:type', 'ViewColumn'), ('big_orders.c_name', 'rdfs:domain', 'big_orders')) k(s, p, o)) SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM v GROUP BY p UNION ALL SELECT 'malformed', 0, 0, 0",
        "stored_graphs": f"WITH {graph}, k AS (SELECT s, p, o FROM triples WHERE p IN ('rdfs:domain', 'referencedTable') UNION SELECT a.o, 'refersTo', b.o FROM triples a JOIN triples b ON a.s = b.s AND a.p = 'rdfs:domain' AND b.p = 'referencedTable') SELECT g, p, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT 'catalogue' AS g, s, p, o FROM (SELECT DISTINCT s, p, o FROM triples) t UNION ALL SELECT 'keys', s, p, o FROM k) q GROUP BY g, p",
        "rows_as_triples_customer": " UNION ALL ".join(f"SELECT {base}customer/' || c_custkey AS s, 'customer#{c}' AS p, {o} AS o FROM customer" for c, o in (("c_custkey", "CAST(c_custkey AS VARCHAR)"), ("c_name", "c_name"), ("c_nationkey", f"{base}nation/' || c_nationkey"), ("c_acctbal", "CAST(c_acctbal AS VARCHAR)"), ("c_mktsegment", "c_mktsegment"))),
    }


def _shapes_sql(store: str) -> str:
    """The eight shapes as anti-joins in SQL."""
    typed = lambda kind: f"(SELECT s FROM {store} WHERE p = 'rdf:type' AND o = '{kind}')"
    needed = [("owl:Class", "rowCount"), ("owl:DatatypeProperty", "rdfs:domain"), ("owl:DatatypeProperty", "rdfs:range"), ("owl:ObjectProperty", "referencedTable"), ("owl:ObjectProperty", "cardinality")]
    lacks = [f"SELECT s AS node, '{kind} without {p}' AS shape FROM {typed(kind)} x WHERE s NOT IN (SELECT s FROM {store} WHERE p = '{p}')" for kind, p in needed]
    dangling = [f"SELECT s, 'key to an unknown {what}' FROM {store} WHERE p = '{p}' AND o NOT IN {typed(kind)}" for what, p, kind in (("table", "referencedTable", "owl:Class"), ("column", "joinsTo", "owl:DatatypeProperty"))]
    kinds = f"SELECT s, 'unknown measure type' FROM {store} WHERE p = 'measureType' AND o NOT IN ('attribute', 'additive', 'semi_additive', 'non_additive')"
    return f"shapes AS ({' UNION ALL '.join([*lacks, *dangling, kinds])}) SELECT * FROM shapes"
