"""The semantic catalogue: every column with its type, class and profile, and the same as triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import measure_class, type_kind, xsd_type
from tidemark.session import checkpointed
from tidemark.sources.keys import DRIVER, Registry
from tidemark.sources.tables import TABLES, table


def columns_of(spark: SparkSession, folder: str, registry: Registry = DRIVER, names: tuple[str, ...] = TABLES) -> list[tuple]:
    """(table, column, type, kind, xsd, class, basis, primary, foreign) from the schemas alone."""
    foreign = {(f.child, f.column) for f in registry.foreign}
    out = []
    for name in names:
        for f in table(spark, folder, name).schema.fields:
            kind, primary = f.dataType.simpleString(), f.name in registry.primary.get(name, ())
            out.append((name, f.name, kind, type_kind(kind), xsd_type(f.name, kind), *measure_class(f.name, kind, primary, (name, f.name) in foreign), primary, (name, f.name) in foreign))
    return out


def _footer_counts(spark: SparkSession, folder: str, name: str, columns: list[str]) -> dict[str, int] | None:
    """Rows (under the empty name) and non-null values of flat columns from the Parquet files' footers, read by Spark's tasks; None where footers don't tell."""
    session = spark.newSession()  # the settings hold for this read alone
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = table(session, folder, name).agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    try:
        row = counts.first()
    except Exception as e:  # a file whose footer lacks the counts makes the read fail, and the scan answers
        if "aggregatePushdown" not in str(e):
            raise
        return None
    return {"": row["n"] or 0, **{c: row[f"c{i}"] or 0 for i, c in enumerate(columns)}}  # no file, no sum


def profile(spark: SparkSession, folder: str, registry: Registry = DRIVER, names: tuple[str, ...] = TABLES) -> DataFrame:
    """A row per column: its classification, and rows and non-null values of its table.

    Both come from the files' footers, so no value of a flat column is read, texts included; a
    nested column, and a table whose footers have no counts, are scanned for them.
    """
    rows = []
    for name in names:
        own = columns_of(spark, folder, registry, (name,))
        flat = [c[1] for c in own if not any(k in c[2] for k in ("<", "variant"))]
        known = _footer_counts(spark, folder, name, flat) or {}
        left = [c[1] for c in own if c[1] not in known] if known else [c[1] for c in own]
        if left:
            sums = table(spark, folder, name).agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(left)]).first()
            known |= {"": sums["n"], **{c: sums[f"c{i}"] for i, c in enumerate(left)}}
        rows += [(c[0], c[1], c[3], c[4], c[5], c[6], known[""], known[c[1]]) for c in own]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string, xsd string, measure_class string, basis string, n long, n_values long")


def triples(spark: SparkSession, folder: str, registry: Registry = DRIVER) -> DataFrame:
    """(g, s, p, o) of the catalogue: tables as classes, columns as datatype properties, keys as object properties."""
    rows = profile(spark, folder, registry).withColumn("s", F.concat_ws(".", "table_name", "column_name"))
    tables = rows.groupBy("table_name").agg(F.max("n").alias("n"))
    fact = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    classes = tables.select(F.explode(F.array(fact(F.col("table_name"), "rdf:type", F.lit("owl:Class")), fact(F.col("table_name"), "rowCount", F.col("n")))).alias("t"))
    props = rows.select(F.explode(F.filter(F.array(
        fact(F.col("s"), "rdf:type", F.lit("owl:DatatypeProperty")), fact(F.col("s"), "rdfs:domain", F.col("table_name")), fact(F.col("s"), "rdfs:range", F.col("xsd")),
        fact(F.col("s"), "measureType", F.col("measure_class")), fact(F.col("s"), "measureBasis", F.col("basis")),
    ), lambda t: t["o"].isNotNull())).alias("t"))
    keys = []
    for f in registry.foreign:
        edge = f"{f.child}.{f.column}"
        keys += [(edge, "rdf:type", "owl:ObjectProperty"), (edge, "referencedTable", f.parent), (edge, "joinsTo", f"{f.parent}.{f.ref}"), (edge, "cardinality", "one_to_one" if f.unique else "many_to_one")]
    declared = spark.createDataFrame(keys, "s string, p string, o string").select(F.struct("s", "p", "o").alias("t"))
    return classes.unionAll(props).unionAll(declared).select(F.lit("default").alias("g"), "t.s", "t.p", "t.o")


# Basic graph patterns over triples, as joins.
_BGP = "SELECT a.s AS column_name, b.o AS target, c.o AS target_rows FROM triples a JOIN triples b ON a.s = b.s AND b.p = 'referencedTable' JOIN triples c ON c.s = b.o AND c.p = 'rowCount' WHERE a.p = 'rdf:type' AND a.o = 'owl:ObjectProperty'"
_OPTIONAL = "SELECT a.s AS column_name, b.o AS measure FROM triples a LEFT JOIN triples b ON a.s = b.s AND b.p = 'measureType' WHERE a.p = 'rdf:type' AND a.o = 'owl:DatatypeProperty'"
_COUNTS = "SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM triples GROUP BY p"


def _over_triples(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpointed(triples(spark, sf_dir)).createOrReplaceTempView("triples")  # read more than once; made by a scan of every table
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"column_profile": profile, "triples_count_by_predicate": _over_triples(_COUNTS), "triples_bgp_key_targets": _over_triples(_BGP), "triples_optional_measure": _over_triples(_OPTIONAL)}


def profiled_sql() -> str:
    """The classification restated as rules over the information schema, as the common tables ``cols``, ``counts`` and ``prof``."""
    from tidemark.functions import names as rules

    has = lambda parts: "(" + " OR ".join(f"contains(lower(column_name), '{p}')" for p in parts) + ")"
    primary = " OR ".join(f"(table_name = '{t}' AND column_name = '{c}')" for t, cs in DRIVER.primary.items() for c in cs)
    foreign = " OR ".join(f"(table_name = '{f.child}' AND column_name = '{f.column}')" for f in DRIVER.foreign)
    key = f"({primary} OR {foreign})"
    number = "data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'HUGEINT', 'SMALLINT')"
    family = f"CASE WHEN {has(rules.NON_ADDITIVE)} THEN 'non_additive' WHEN {has(rules.SEMI_ADDITIVE)} THEN 'semi_additive' WHEN {has(rules.ADDITIVE)} THEN 'additive' END"
    tables = ", ".join(f"'{t}'" for t in TABLES)
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, name AS column_name, n, v AS n_values FROM (SELECT count(*) AS n, {', '.join(f'count({c}) AS {c}' for c in cs)} FROM {t}) UNPIVOT (v FOR name IN ({', '.join(cs)}))" for t, cs in _COLUMNS.items())
    return f"""cols AS (SELECT table_name, column_name, CASE WHEN {number} THEN 'numeric' ELSE 'non_numeric' END AS kind,
  CASE WHEN data_type IN ('DOUBLE', 'FLOAT') AND {has(rules.QUANTITY)} THEN 'integer' WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'HUGEINT') THEN 'integer' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type LIKE 'TIMESTAMP%' THEN 'dateTime' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type LIKE 'FLOAT%' THEN 'float' ELSE 'string' END AS xsd,
  CASE WHEN {key} OR NOT {number} THEN 'attribute' ELSE {family} END AS measure_class,
  CASE WHEN {key} OR NOT {number} THEN 'structural' WHEN {family} IS NOT NULL THEN 'name_pattern' END AS basis
FROM information_schema.columns WHERE table_name IN ({tables})),
counts AS ({counts}),
prof AS (SELECT cols.*, n, n_values FROM cols JOIN counts USING (table_name, column_name))"""


def oracle_sql() -> dict[str, str]:
    profiled = profiled_sql()
    declared = ", ".join(f"('{f.child}.{f.column}', '{p}', '{o}')" for f in DRIVER.foreign for p, o in (("rdf:type", "owl:ObjectProperty"), ("referencedTable", f.parent), ("joinsTo", f"{f.parent}.{f.ref}"), ("cardinality", "one_to_one" if f.unique else "many_to_one")))
    graph = f"""{profiled}, triples AS (
SELECT DISTINCT table_name AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM prof UNION ALL SELECT DISTINCT table_name, 'rowCount', CAST(n AS VARCHAR) FROM prof
UNION ALL SELECT table_name || '.' || column_name, 'rdf:type', 'owl:DatatypeProperty' FROM prof UNION ALL SELECT table_name || '.' || column_name, 'rdfs:domain', table_name FROM prof
UNION ALL SELECT table_name || '.' || column_name, 'rdfs:range', xsd FROM prof UNION ALL SELECT table_name || '.' || column_name, 'measureType', measure_class FROM prof WHERE measure_class IS NOT NULL
UNION ALL SELECT table_name || '.' || column_name, 'measureBasis', basis FROM prof WHERE basis IS NOT NULL UNION ALL SELECT * FROM (VALUES {declared}) k(s, p, o))"""
    return {"column_profile": f"WITH {profiled} SELECT * FROM prof", "triples_count_by_predicate": f"WITH {graph} {_COUNTS}", "triples_bgp_key_targets": f"WITH {graph} {_BGP}", "triples_optional_measure": f"WITH {graph} {_OPTIONAL}"}


_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"],
    "embeddings": ["vec_id", "embedding", "label"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"], "conversations": ["conv_id", "turn", "role", "text"],
}
