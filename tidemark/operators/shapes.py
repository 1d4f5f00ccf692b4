"""Shapes as data: a table of constraints joined with a store of triples, whatever their number, in a fixed number of shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.operators.catalog import triples as catalogue_triples
from tidemark.session import checkpointed

SHAPES = "shape string, target string, path string, least int, most int, datatype string, class string, pattern string, one_of array<string>, equals string"
TYPE = "rdf:type"
#: How a value of a datatype is written; other datatypes take any text.
LEXICAL = {
    "integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", "double": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?INF$|^NaN$",
    "boolean": r"^(true|false|0|1)$", "date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}$", "dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}",
}


def shape(name: str, target: str, path: str, least: int | None = None, most: int | None = None, datatype: str | None = None, class_: str | None = None, pattern: str | None = None, one_of: Iterable[str] | None = None, equals: str | None = None) -> tuple:
    """A row of ``SHAPES``: what the values at the end of ``path`` of every node of the class ``target`` must be.

    ``path`` is a predicate, two with a slash between them, or empty for the node itself.
    ``equals`` names a predicate of the node that must have the value too.
    """
    return (name, target, path, least, most, datatype, class_, pattern, None if one_of is None else list(one_of), equals)


def violations(store: DataFrame, shapes: DataFrame) -> DataFrame:
    """(node, shape, problem, n): each shape that a node breaks, by kind of problem, with the number of values at fault.

    ``less`` and ``more`` count all values of the path; ``datatype``, ``class``, ``pattern``, ``list``
    and ``equal`` those that break the constraint. Triples count once, whatever their graph;
    a constraint that is null holds. The store is joined with itself four times: for the
    nodes of a class, along the path's two steps and for the values' own triples. Shapes only add rows.
    """
    facts = store.select("s", "p", "o").distinct()
    steps = shapes.withColumns({"one": F.get(F.split("path", "/"), F.lit(0)), "two": F.get(F.split("path", "/"), F.lit(1))})
    nodes = facts.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("target")).join(steps, "target")
    first = nodes.join(facts.toDF("node", "one", "v1"), ["node", "one"], "left").withColumn("v1", F.when(F.col("path") == "", F.col("node")).otherwise(F.col("v1")))
    second = first.join(facts.toDF("v1", "two", "v2"), ["v1", "two"], "left")
    value = F.when(F.col("two").isNull(), F.col("v1")).otherwise(F.col("v2"))
    # a value's classes, and its mentions under the predicate it must equal, are both facts: one join answers both
    asked = second.select("node", "shape", "least", "most", "datatype", "class", "pattern", "one_of", "equals", value.alias("value")).distinct()
    wanted = F.array_compact(F.array(F.when(F.col("class").isNotNull(), F.struct(F.col("value").alias("s"), F.lit(TYPE).alias("p"), F.col("class").alias("o"), F.lit("class").alias("why"))), F.when(F.col("equals").isNotNull(), F.struct(F.col("node").alias("s"), F.col("equals").alias("p"), F.col("value").alias("o"), F.lit("equal").alias("why")))))
    needed = asked.where(F.col("value").isNotNull() & (F.size(wanted) > 0)).select("node", "shape", F.explode(wanted).alias("w")).select("node", "shape", "w.*")
    lacking = needed.join(facts, ["s", "p", "o"], "left_anti").groupBy("node", "shape", F.col("why").alias("problem")).agg(F.count("*").alias("n"))
    lexical = F.create_map(*[F.lit(x) for pair in LEXICAL.items() for x in pair])
    count = lambda c: F.count_if(F.col("value").isNotNull() & c)
    own = asked.groupBy("node", "shape").agg(
        F.max("least").alias("least"), F.max("most").alias("most"), F.count("value").alias("n"),
        count(~F.coalesce(F.regexp_like("value", F.get(F.array(lexical[F.col("datatype")]), F.lit(0))), F.lit(True))).alias("datatype"),
        count(~F.coalesce(F.regexp_like("value", F.col("pattern")), F.lit(True))).alias("pattern"), count(~F.coalesce(F.array_contains("one_of", F.col("value")), F.lit(True))).alias("list"),
    )
    found = F.array(
        F.struct(F.lit("less").alias("problem"), (F.col("n") < F.col("least")).alias("broken"), "n"), F.struct(F.lit("more").alias("problem"), (F.col("n") > F.col("most")).alias("broken"), "n"),
        *[F.struct(F.lit(k).alias("problem"), (F.col(k) > 0).alias("broken"), F.col(k).alias("n")) for k in ("datatype", "pattern", "list")],
    )
    return own.select("node", "shape", F.explode(found).alias("f")).where("f.broken").select("node", "shape", "f.problem", "f.n").unionByName(lacking)


XSD_NAMES = ("integer", "byte", "string", "dateTime", "date", "time", "float", "double", "decimal", "boolean", "base64Binary")
#: The catalogue's shapes: nine of nodes, and two that hold two places against each other.
CATALOGUE = [
    shape("table has a row count", "owl:Class", "rowCount", 1, 1, "integer"),
    shape("column has a table", "owl:DatatypeProperty", "rdfs:domain", 1, 1, class_="owl:Class"),
    shape("column has a range", "owl:DatatypeProperty", "rdfs:range", 1, 1, one_of=XSD_NAMES),
    shape("measure type is known", "owl:DatatypeProperty", "measureType", 0, 1, one_of=("attribute", "additive", "semi_additive", "non_additive")),
    shape("measure has a basis", "owl:DatatypeProperty", "measureBasis", None, 1, pattern="^(structural|name_pattern)$"),
    shape("key refers to a table", "owl:ObjectProperty", "referencedTable", 1, 1, class_="owl:Class"),
    shape("key joins a column", "owl:ObjectProperty", "joinsTo", 1, 1, class_="owl:DatatypeProperty"),
    shape("key has a cardinality", "owl:ObjectProperty", "cardinality", 1, 1, one_of=("one_to_one", "many_to_one")),
    shape("key is named by its column", "owl:ObjectProperty", "", pattern=r"^[a-z_0-9]+\.[a-z_0-9]+$"),
    shape("key joins the table it refers to", "owl:ObjectProperty", "joinsTo/rdfs:domain", equals="referencedTable"),
    shape("key's column exists", "owl:ObjectProperty", "", class_="owl:DatatypeProperty"),
]
# Triples taken from the catalogue by subject and predicate, and put into it, so that every shape is broken somewhere.
_GONE = [("region", "rowCount"), ("nation.n_name", "rdfs:domain"), ("labels.doc_id", "cardinality"), ("lineitem.l_suppkey", "joinsTo")]
_PUT = [
    ("part", "rowCount", "many"), ("part.p_size", "rdfs:domain", "nowhere"), ("part.p_name", "rdfs:range", "mystery"), ("orders.o_totalprice", "measureType", "weird"), ("orders.o_totalprice", "measureBasis", "guess"),
    ("orders.o_custkey", "referencedTable", "nobody"), ("events.user_id", "joinsTo", "customer.c_none"), ("lineitem.l_partkey", "joinsTo", "supplier.s_suppkey"), ("Loose key", "rdf:type", "owl:ObjectProperty"),
]


def _checked(broken: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = checkpointed(catalogue_triples(spark, sf_dir))
        if broken:
            gone = spark.createDataFrame(_GONE, "s string, p string")
            store = store.join(gone, ["s", "p"], "left_anti").select("s", "p", "o").union(spark.createDataFrame(_PUT, "s string, p string, o string"))
        return violations(store, spark.createDataFrame(CATALOGUE, SHAPES))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"shape_table_violations": _checked(True)}


def oracle_sql() -> dict[str, str]:
    graph = catalog.oracle_sql()["triples_count_by_predicate"].removesuffix(catalog._COUNTS).removeprefix("WITH ")
    rows = lambda x: ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in x)
    store = f"{graph}, f AS (SELECT s, p, o FROM triples WHERE (s, p) NOT IN (VALUES {rows(_GONE)}) UNION SELECT * FROM (VALUES {rows(_PUT)}) t(s, p, o))"
    has = lambda s, p, o: f"EXISTS (SELECT 1 FROM f z WHERE z.s = {s} AND z.p = {p} AND z.o = {o})"
    parts = []
    for name, target, path, least, most, datatype, kind, pattern, one_of, equals in CATALOGUE:
        name = name.replace("'", "''")
        nodes = f"SELECT s AS node FROM f WHERE p = 'rdf:type' AND o = '{target}'"
        if path == "":
            values = f"SELECT node, node AS v FROM ({nodes}) n"
        elif "/" in path:
            a, b = path.split("/")
            values = f"SELECT DISTINCT node, y.o AS v FROM ({nodes}) n LEFT JOIN f x ON x.s = node AND x.p = '{a}' LEFT JOIN f y ON y.s = x.o AND y.p = '{b}'"
        else:
            values = f"SELECT node, x.o AS v FROM ({nodes}) n LEFT JOIN f x ON x.s = node AND x.p = '{path}'"
        listed = ", ".join(f"'{x}'" for x in one_of or ())
        bad = {
            "datatype": datatype and f"NOT regexp_matches(v, '{LEXICAL[datatype]}')", "class": kind and f"NOT {has('v', chr(39) + TYPE + chr(39), chr(39) + kind + chr(39))}", "pattern": pattern and f"NOT regexp_matches(v, '{pattern}')",
            "list": one_of and f"v NOT IN ({listed})", "equal": equals and f"NOT {has('node', chr(39) + equals + chr(39), 'v')}",
        }
        parts += [f"SELECT node, '{name}' AS shape, '{problem}' AS problem, count(*) AS n FROM ({values}) w WHERE v IS NOT NULL AND {test} GROUP BY node" for problem, test in bad.items() if test]
        parts += [f"SELECT node, '{name}', '{problem}', count(v) FROM ({values}) w GROUP BY node HAVING count(v) {sign} {n}" for problem, sign, n in (("less", "<", least), ("more", ">", most)) if n is not None]
    return {"shape_table_violations": f"WITH {store} " + " UNION ALL ".join(parts)}
