"""Reports on a dataset's schema: implied keys, copied descriptions, coverage, compatibility, texts to search, context for a question.

They start from the column profile (one scan a table) and the keys that hold, and are joins and
aggregates over those, so that each figure is one of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import catalog, graph
from tidemark.operators.retrieval import tfidf
from tidemark.session import checkpointed
from tidemark.sources.keys import DRIVER, ForeignKey, Registry, integrity_sql, kept_edges
from tidemark.sources.tables import TABLES, register, table

#: The question that the registered retrieval queries ask.
QUESTION = "order total price of a customer and market segment by nation name"
#: Tokens that a table, a column and a join take in a prompt (fixed values).
TOKENS = {"tables": 200, "columns": 50, "joins": 100}


def implied_keys(spark: SparkSession, folder: str, registry: Registry = DRIVER, endings: tuple[str, ...] = ("key",)) -> DataFrame:
    """A row per undeclared foreign key that a column's name implies, with what the data say of it.

    ``endings`` are a key's endings beside the usual ones. ``orphans`` counts rows without a
    parent (nulls too), so a key holds where it is 0. Empty if no name implies a key.
    """
    primary = {t: registry.primary.get(t, ()) for t in TABLES}
    found, declared = [], {(f.child, f.column) for f in registry.foreign}
    for name, column, kind, *_ in catalog.columns_of(spark, folder, registry):
        if column in primary[name] or (name, column) in declared:
            continue
        implied = names.implied_key(name, column, primary, endings)
        if implied and implied[1] in (parent := table(spark, folder, implied[0])).columns:
            found.append((ForeignKey(name, column, *implied[:2]), implied[2], names.key_confidence(column, kind, implied[0], parent.schema[implied[1]].dataType.simpleString())))
    said = spark.createDataFrame([(f.child, f.column, f.parent, f.ref, p, c) for f, p, c in found], "src string, col string, dst string, ref_col string, pattern string, confidence string")
    if not found:
        return said.select("*", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("orphans"))
    register(spark, folder)
    return spark.sql(integrity_sql(Registry(foreign=[f for f, _, _ in found]))).drop("one_to_one").join(F.broadcast(said), ["src", "col", "dst", "ref_col"])


def denormalized_columns(spark: SparkSession, folder: str, registry: Registry = DRIVER) -> DataFrame:
    """A row per foreign key and text column beside it: of the keys with several rows, how many have one text only.

    A column with one text for (nearly) every key belongs to the parent. One grouping a key,
    partial in every task; nulls count as a text of their own.
    """
    parts = []
    for f in registry.foreign:
        own = [c.name for c in table(spark, folder, f.child).schema.fields if c.dataType.simpleString() == "string" and c.name != f.column]
        if not own:
            continue
        one = lambda c: (F.count(c).isin(0, F.count("*")) & F.min(c).eqNullSafe(F.max(c))).cast("int")
        keyed = table(spark, folder, f.child).where(F.col(f.column).isNotNull()).groupBy(f.column).agg(F.count("*").alias("n"), *[one(c).alias(f"one_{c}") for c in own]).where("n > 1")
        sums = keyed.agg(F.count("*").alias("n_keys"), *[F.sum(f"one_{c}").alias(f"s_{c}") for c in own])
        rows = [F.struct(F.lit(f.child).alias("table_name"), F.lit(f.column).alias("key_column"), F.lit(c).alias("column_name"), F.col("n_keys").alias("n_keys"), F.coalesce(F.col(f"s_{c}"), F.lit(0)).cast("bigint").alias("n_determined")) for c in own]
        parts.append(sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return reduce(DataFrame.unionAll, parts)


def _primary(spark: SparkSession, registry: Registry) -> DataFrame:
    return spark.createDataFrame([(t, c) for t, cs in registry.primary.items() for c in cs], "table_name string, column_name string")


def quality_report(profile: DataFrame, edges: DataFrame, primary: DataFrame) -> DataFrame:
    """(measure, value): counts of a catalogue's parts and of what it lacks."""
    tables = profile.groupBy("table_name").agg(F.max("n").alias("n"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("table_name")).distinct()
    counted = lambda df, label: df.agg(F.count("*").alias("value")).select(F.lit(label).alias("measure"), "value")
    numeric = F.col("kind") == "numeric"
    parts = {
        "tables": tables, "columns": profile, "keys that hold": edges,
        "tables without rows": tables.where("n = 0"), "tables without a primary key": tables.join(primary, "table_name", "left_anti"), "tables without a link": tables.join(linked, "table_name", "left_anti"),
        "numeric columns without a class": profile.where(numeric & F.col("measure_class").isNull()), "columns without values": profile.where("n > 0 AND n_values = 0"), "columns with nulls": profile.where("n_values < n"),
    }
    return reduce(DataFrame.unionAll, [counted(df, label) for label, df in parts.items()])


def enrichment_coverage(profile: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """(table_name, n_columns, classified, filled, described): shares of columns with a class, with a value, with a comment (table_name, column_name)."""
    said = profile.select("table_name", "column_name").limit(0) if comments is None else comments.select("table_name", "column_name").distinct()
    with_comment = profile.join(said.withColumn("said", F.lit(1)), ["table_name", "column_name"], "left")
    share = lambda c: F.round(F.count(c) / F.count("*"), 6)
    return with_comment.groupBy("table_name").agg(F.count("*").alias("n_columns"), share("measure_class").alias("classified"), share(F.when(F.col("n_values") > 0, 1)).alias("filled"), share("said").alias("described"))


def compatibility(ontology: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(table_name, side, matched, ontology_tables, pct, verdict): which tables of an ontology a catalogue has.

    Full when all of the ontology's tables are there, partial from half of them (of the rounded
    percentage), low below, none without any.
    """
    a, b = (df.select(F.lower("table_name").alias("table_name")).distinct() for df in (ontology, catalogue))
    both = a.withColumn("o", F.lit(1)).join(b.withColumn("c", F.lit(1)), "table_name", "full")
    sums = both.agg(F.count(F.when(F.col("o").isNotNull() & F.col("c").isNotNull(), 1)).alias("matched"), F.count("o").alias("ontology_tables"))
    pct = F.when(F.col("ontology_tables") == 0, 0).otherwise(F.round(100 * F.col("matched") / F.col("ontology_tables"))).cast("int")
    verdict = F.when(F.col("pct") == 100, "full_match").when(F.col("pct") >= 50, "partial_match").when(F.col("matched") > 0, "low_match").otherwise("no_match")
    side = F.when(F.col("o").isNull(), "catalogue only").when(F.col("c").isNull(), "ontology only").otherwise("both")
    return both.select("table_name", side.alias("side")).join(F.broadcast(sums.withColumn("pct", pct).withColumn("verdict", verdict)))


def graph_summary(store: DataFrame) -> DataFrame:
    """(place, line): a line per class with its rows, then one per key, in the order of names."""
    of = lambda p, o: store.where(F.col("p") == p).select("s", F.col("o").alias(o))
    classes = of("rowCount", "n").select(F.lit(1).alias("part"), F.concat("s", F.lit(" ("), "n", F.lit(" rows)")).alias("line"))
    links = of("referencedTable", "target").join(of("rdfs:domain", "domain"), "s").select(F.lit(2).alias("part"), F.concat("domain", F.lit(" -> "), "target").alias("line")).distinct()
    return classes.unionAll(links)


def axiom_triples(edges: DataFrame) -> DataFrame:
    """(s, p, o) that follow from the keys: inverse properties, disjoint siblings, chains of two keys without a direct one."""
    keys = edges.select("src", "dst", F.concat_ws(".", "src", "col").alias("key"), "one_to_one")
    fact = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    back = F.concat("key", F.lit("~"))
    count = F.when(F.col("one_to_one"), "one_to_one").otherwise("one_to_many")
    inverse = keys.select(F.explode(F.array(fact(F.col("key"), "owl:inverseOf", back), fact(back, "rdf:type", F.lit("owl:ObjectProperty")), fact(back, "rdfs:domain", F.col("dst")), fact(back, "rdfs:range", F.col("src")), fact(back, "cardinality", count))).alias("t")).select("t.*")
    direct = keys.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
    turned = direct.select(F.col("b").alias("a"), F.col("a").alias("b"))
    other = direct.select(F.col("a").alias("a2"), "b")
    siblings = direct.join(other, "b").where("a < a2").select("a", F.col("a2").alias("b")).distinct().join(direct.unionAll(turned), ["a", "b"], "left_anti").select(F.col("a").alias("s"), F.lit("owl:disjointWith").alias("p"), F.col("b").alias("o"))
    chains = direct.join(direct.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").groupBy("a", F.col("c").alias("to")).agg(F.min("b").alias("via"))
    chains = chains.join(direct.select("a", F.col("b").alias("to")), ["a", "to"], "left_anti").select(F.concat_ws(">", "a", "via").alias("s"), F.lit("owl:propertyChainAxiom").alias("p"), F.col("to").alias("o"))
    return inverse.unionAll(siblings).unionAll(chains)


def labels(profile: DataFrame) -> DataFrame:
    """(table_name, column_name, label, uri_name): names as a reader and as a URI wants them."""
    safe = F.regexp_replace("column_name", "[^A-Za-z0-9_]", "_")
    return profile.select("table_name", "column_name", F.initcap(F.replace("column_name", F.lit("_"), F.lit(" "))).alias("label"), F.when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe).alias("uri_name"))


def apply_names(elements: DataFrame, suggested: DataFrame) -> DataFrame:
    """The elements (table_name, column_name or null, label) with suggested labels (table_name, column_name, name) put in.

    Suggestions for no element, and empty ones, are left out; of several for one element the
    least counts. A label that would then be used twice becomes ``label (table column)``.
    """
    keys = ["table_name", "column_name"]
    wanted = suggested.where(F.length(F.trim("name")) > 0).groupBy(*keys).agg(F.min(F.trim("name")).alias("name"))
    same = reduce(Column.__and__, [elements[k].eqNullSafe(wanted[k]) for k in keys])
    put = elements.join(wanted, same, "left").select(elements["table_name"], elements["column_name"], F.coalesce("name", "label").alias("label"), F.col("name").isNotNull().alias("applied"))
    uses = put.groupBy(F.lower("label").alias("low")).agg(F.count("*").alias("uses"))
    clash = F.col("applied") & (F.col("uses") > 1)
    full = F.concat("label", F.lit(" ("), F.concat_ws(" ", *keys), F.lit(")"))
    return put.join(uses, F.lower("label") == F.col("low")).select(*keys, F.when(clash, full).otherwise(F.col("label")).alias("label"), "applied")


def upsert(index: DataFrame, fresh: DataFrame, key: str = "element") -> DataFrame:
    """An index of texts with entries replaced or added."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def element_texts(profile: DataFrame, edges: DataFrame) -> DataFrame:
    """(element, kind, words): the texts that are searched, one a table, a column and a key."""
    spaced = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    listed = F.array_join(F.sort_array(F.collect_list("column_name")), " ")
    tables = profile.groupBy("table_name").agg(listed.alias("all")).select(F.col("table_name").alias("element"), F.lit("table").alias("kind"), F.concat(spaced("table_name"), F.lit(" table "), spaced("all")).alias("words"))
    columns = profile.select(F.concat_ws(".", "table_name", "column_name").alias("element"), F.lit("column").alias("kind"), F.concat_ws(" ", spaced("column_name"), F.lit("column of"), spaced("table_name"), "kind", "measure_class").alias("words"))
    links = edges.select(F.concat(F.concat_ws(".", "src", "col"), F.lit(" -> "), "dst").alias("element"), F.lit("relationship").alias("kind"), F.concat(spaced("src"), F.lit(" joins "), spaced("dst"), F.lit(" on "), spaced("col")).alias("words"))
    return tables.unionAll(columns).unionAll(links)


def scored(elements: DataFrame, text: str) -> DataFrame:
    """(element, kind, score): TF-IDF cosine of every element that shares a word with the text."""
    asked = elements.sparkSession.createDataFrame([("?", "question", text.replace("_", " "))], "element string, kind string, words string")
    weights = checkpointed(tfidf(elements.unionAll(asked), "element", "words"))
    wanted = weights.where("element = '?'").select("term", F.col("weight").alias("q"))
    found = weights.where("element <> '?'").join(F.broadcast(wanted), "term").groupBy("element").agg(F.round(F.sum(F.col("weight") * F.col("q")), 4).alias("score"))
    return found.join(elements.select("element", "kind"), "element")


def relevant_tables(elements: DataFrame, edges: DataFrame, text: str, top: int = 3) -> DataFrame:
    """(table_name, role, score): the tables nearest to a text, and those one key away from them (score null)."""
    first = checkpointed(scored(elements, text).where("kind = 'table'").orderBy(F.desc("score"), "element").limit(top).select(F.col("element").alias("table_name"), F.lit("search").alias("role"), "score"))
    links = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    near = links.join(first, F.col("src") == F.col("table_name")).select(F.col("dst").alias("table_name")).distinct().join(first, "table_name", "left_anti")
    return first.unionAll(near.select("table_name", F.lit("related"), F.lit(None).cast("double")))


def relevant_schema(elements: DataFrame, edges: DataFrame, text: str, top: int = 3) -> DataFrame:
    """(part, name, other, detail, score): all that a question's tables bring with them.

    ``table`` and ``related``: as in ``relevant_tables``. ``community``: the members linked with a
    found table, under their least name. ``join path``: the conditions of the shortest path
    between two found tables, by direction. ``hint``: found tables with several keys, over
    which a sum of one parent's measure repeats.
    """
    tables = checkpointed(relevant_tables(elements, edges, text, top))
    none, chosen = F.lit(None).cast("string"), tables.where("role = 'search'").select("table_name")
    parts = [tables.select(F.when(F.col("role") == "search", "table").otherwise("related").alias("part"), F.col("table_name").alias("name"), none.alias("other"), none.alias("detail"), "score")]
    unscored = lambda df, part, name, other, detail: df.select(F.lit(part).alias("part"), name.alias("name"), other.alias("other"), detail.alias("detail"), F.lit(None).cast("double").alias("score"))
    members = checkpointed(graph.components(edges))
    theirs = members.join(chosen, F.col("node") == F.col("table_name"), "left_semi").select("component").distinct()
    parts.append(unscored(members.join(theirs, "component", "left_semi"), "community", F.col("component"), F.col("node"), none))
    ends = lambda c: chosen.withColumnRenamed("table_name", c)
    paths = graph.join_specs(edges).join(ends("origin"), "origin", "left_semi").join(ends("node"), "node", "left_semi").where("origin < node")
    parts.append(unscored(paths, "join path", F.col("origin"), F.col("node"), F.concat_ws(": ", "direction", "steps")))
    hubs = edges.join(ends("src"), "src", "left_semi").groupBy("src").agg(F.count("*").alias("n")).where("n > 1")
    parts.append(unscored(hubs, "hint", F.col("src"), none, F.concat(F.lit("has "), F.col("n").cast("string"), F.lit(" keys: sum each parent's measures before joining"))))
    return reduce(DataFrame.unionByName, parts)


def graph_nodes(profile: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_name, n_rows, n_columns, n_keys, n_referring): the key graph's nodes, tables without a key among them."""
    sizes = profile.groupBy("table_name").agg(F.max("n").alias("n_rows"), F.count("*").alias("n_columns"))
    out, into = edges.groupBy(F.col("src").alias("table_name")).agg(F.count("*").alias("n_keys")), edges.groupBy(F.col("dst").alias("table_name")).agg(F.count("*").alias("n_referring"))
    return sizes.join(out, "table_name", "left").join(into, "table_name", "left").fillna(0, ["n_keys", "n_referring"])


def overview(elements: DataFrame, profile: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, n): what is indexed, by kind, and the key graph's tables, links, communities and tables without a link."""
    nodes = graph_nodes(profile, edges)
    counted = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    parts = [elements.groupBy(F.concat(F.lit("elements: "), F.col("kind")).alias("part")).agg(F.count("*").alias("n"))]
    parts += [counted(nodes, "tables"), counted(nodes.where("n_keys + n_referring = 0"), "tables without a link"), counted(edges.select("src", "dst").distinct(), "links")]
    parts.append(counted(graph.components(edges).select("component").distinct(), "communities"))
    return reduce(DataFrame.unionByName, parts)


def query_context(tables: DataFrame, profile: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, n, tokens): tables, their columns and the keys between them, and about how much of a prompt they take."""
    chosen = tables.select("table_name").distinct()
    inside = edges.join(chosen.withColumnRenamed("table_name", "src"), "src").join(chosen.withColumnRenamed("table_name", "dst"), "dst")
    counted = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n", (F.col("n") * TOKENS[part]).alias("tokens"))
    return counted(chosen, "tables").unionAll(counted(profile.join(chosen, "table_name", "left_semi"), "columns")).unionAll(counted(inside, "joins"))


def _with(use: Callable[[SparkSession, DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the profile, written once because it is read several times, and the edges."""
    return lambda spark, sf_dir: use(spark, checkpointed(catalog.profile(spark, sf_dir)), kept_edges(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    linked = lambda e: e.select(F.explode(F.array("src", "dst")).alias("table_name"))
    return {
        "implied_keys": lambda s, d: implied_keys(s, d, Registry(primary=DRIVER.primary)),  # as if none had been declared
        "denormalized_columns": denormalized_columns,
        "ontology_quality": _with(lambda s, p, e: quality_report(p, e, _primary(s, DRIVER))),
        "enrichment_coverage": lambda s, d: enrichment_coverage(catalog.profile(s, d)),
        "catalogue_in_key_graph": _with(lambda s, p, e: compatibility(p, linked(e))),
        "graph_summary": lambda s, d: graph_summary(checkpointed(catalog.triples(s, d))),
        "axiom_triples": lambda s, d: axiom_triples(kept_edges(s, d)),
        "catalogue_labels": lambda s, d: labels(catalog.profile(s, d)),
        "element_texts": _with(lambda s, p, e: element_texts(p, e)),
        "element_scores": _with(lambda s, p, e: scored(element_texts(p, e), QUESTION)),
        "relevant_tables": _with(lambda s, p, e: relevant_tables(element_texts(p, e), e, QUESTION)),
        "relevant_schema": _with(lambda s, p, e: relevant_schema(element_texts(p, e), e, QUESTION)),
        "graph_nodes": _with(lambda s, p, e: graph_nodes(p, e)),
        "schema_overview": _with(lambda s, p, e: overview(checkpointed(element_texts(p, e)), p, e)),
        "query_context": _with(lambda s, p, e: query_context(relevant_tables(element_texts(p, e), e, QUESTION), p, e)),
    }


def oracle_sql() -> dict[str, str]:
    prof = catalog.profiled_sql()
    fk = f"fk AS (SELECT * FROM ({integrity_sql()}) q WHERE orphans = 0)"
    linked = "(SELECT src AS t FROM fk UNION SELECT dst FROM fk)"
    primary = ", ".join(f"('{t}', '{c}')" for t, cs in DRIVER.primary.items() for c in cs)
    tables = ", ".join(f"'{t}'" for t in TABLES)
    # the rule on names by itself: of tables and their singulars, the longest inside a column of another table, with a key's ending behind it
    candidates = [f for f in DRIVER.foreign if f.child != "labels"] + [ForeignKey("embeddings", "label", "labels", "doc_id")]
    implied = f"""WITH k(t, c) AS (VALUES {primary}), cols AS (SELECT table_name AS src, column_name AS col, data_type AS ty FROM information_schema.columns WHERE table_name IN ({tables}) AND (table_name, column_name) NOT IN (SELECT t, c FROM k)),
v AS (SELECT t, min(c) AS ref, t AS w FROM k GROUP BY t UNION ALL SELECT t, min(c), CASE WHEN t LIKE '%ies' THEN left(t, -3) || 'y' WHEN t LIKE '%es' THEN left(t, -2) WHEN t LIKE '%s' THEN left(t, -1) END FROM k GROUP BY t),
m AS (SELECT src, col, ty, t, ref, row_number() OVER (PARTITION BY src, col ORDER BY length(w) DESC, t) AS i FROM cols JOIN v ON t <> src AND length(w) >= 4 AND contains(col, w) AND substr(col, instr(col, w) + length(w)) IN ('id', '_id', 'sk', '_sk', 'key', '_key', '')),
q AS ({integrity_sql(Registry(foreign=candidates))})
SELECT q.src, q.col, q.dst, q.ref_col, 'embedded_table_name' AS pattern, CASE WHEN q.col = 'label' THEN 'high' WHEN ty IN ('INTEGER', 'BIGINT') THEN 'medium' ELSE 'low' END AS confidence, n, orphans FROM m JOIN q ON m.i = 1 AND q.src = m.src AND q.col = m.col AND q.dst = m.t AND q.ref_col = m.ref"""
    texts = {t: [c for c in cs if c in _TEXTS] for t, cs in catalog._COLUMNS.items()}
    repeated = " UNION ALL ".join(f"SELECT '{f.child}' AS table_name, '{f.column}' AS key_column, '{c}' AS column_name, count(*) AS n_keys, count(CASE WHEN k = 1 THEN 1 END) AS n_determined FROM (SELECT {f.column}, count(DISTINCT coalesce('=' || {c}, 'null')) AS k FROM {f.child} WHERE {f.column} IS NOT NULL GROUP BY {f.column} HAVING count(*) > 1) t" for f in DRIVER.foreign for c in texts[f.child] if c != f.column)
    t = "(SELECT table_name, max(n) AS n FROM prof GROUP BY table_name)"
    counts = {
        "tables": f"FROM {t}", "columns": "FROM prof", "keys that hold": "FROM fk", "tables without rows": f"FROM {t} WHERE n = 0",
        "tables without a primary key": f"FROM {t} WHERE table_name NOT IN (SELECT t FROM (VALUES {primary}) k(t, c))", "tables without a link": f"FROM {t} WHERE table_name NOT IN (SELECT t FROM {linked})",
        "numeric columns without a class": "FROM prof WHERE kind = 'numeric' AND measure_class IS NULL", "columns without values": "FROM prof WHERE n > 0 AND n_values = 0", "columns with nulls": "FROM prof WHERE n_values < n",
    }
    words = f"""w AS (SELECT table_name AS element, 'table' AS kind, table_name || ' table ' || replace(string_agg(column_name, ' ' ORDER BY column_name), '_', ' ') AS words FROM prof GROUP BY table_name
UNION ALL SELECT table_name || '.' || column_name, 'column', replace(column_name, '_', ' ') || ' column of ' || table_name || ' ' || kind || coalesce(' ' || measure_class, '') FROM prof
UNION ALL SELECT src || '.' || col || ' -> ' || dst, 'relationship', src || ' joins ' || dst || ' on ' || replace(col, '_', ' ') FROM fk)"""
    scores = f"""{words}, e AS (SELECT element, words FROM w UNION ALL SELECT '?', '{QUESTION}'), x AS (SELECT element, unnest(regexp_extract_all(lower(words), '(\\p{{L}}{{2,}})', 1)) AS term FROM e), c AS (SELECT element, term, count(*) AS tf FROM x GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
y AS (SELECT element, term, tf * (ln((1 + (SELECT count(*) FROM e)) / (1 + df)) + 1) AS z FROM c JOIN d USING (term)), n AS (SELECT element, sqrt(sum(z * z)) AS norm FROM y GROUP BY element), u AS (SELECT element, term, round(z / norm, 5) AS z FROM y JOIN n USING (element)),
s AS (SELECT w.element, kind, round(sum(a.z * b.z), 4) AS score FROM u a JOIN u b ON b.element = '?' AND a.term = b.term JOIN w ON w.element = a.element GROUP BY ALL)"""
    relevant = f"""{scores}, f AS (SELECT element AS table_name, 'search' AS role, score FROM s WHERE kind = 'table' ORDER BY score DESC, element LIMIT 3), l AS (SELECT src, dst FROM fk UNION SELECT dst, src FROM fk),
r AS (SELECT * FROM f UNION ALL SELECT DISTINCT dst, 'related', CAST(NULL AS DOUBLE) FROM l WHERE src IN (SELECT table_name FROM f) AND dst NOT IN (SELECT table_name FROM f))"""
    both = f"WITH {prof}, {fk}"
    return {
        "implied_keys": implied,
        "denormalized_columns": repeated,
        "ontology_quality": f"{both} " + " UNION ALL ".join(f"SELECT '{k}' AS measure, count(*) AS value {v}" for k, v in counts.items()),
        "enrichment_coverage": f"WITH {prof} SELECT table_name, count(*) AS n_columns, round(count(measure_class) / count(*), 6) AS classified, round(count(CASE WHEN n_values > 0 THEN 1 END) / count(*), 6) AS filled, CAST(0 AS DOUBLE) AS described FROM prof GROUP BY table_name",
        "catalogue_in_key_graph": f"{both}, b AS (SELECT table_name, t FROM {t} p LEFT JOIN {linked} l ON t = table_name) SELECT table_name, CASE WHEN t IS NULL THEN 'ontology only' ELSE 'both' END AS side, count(t) OVER () AS matched, count(*) OVER () AS ontology_tables, CAST(round(100 * count(t) OVER () / count(*) OVER ()) AS INT) AS pct, CASE WHEN count(t) OVER () = count(*) OVER () THEN 'full_match' WHEN 2 * count(t) OVER () >= count(*) OVER () THEN 'partial_match' WHEN count(t) OVER () > 0 THEN 'low_match' ELSE 'no_match' END AS verdict FROM b",
        "graph_summary": f"WITH {prof} SELECT DISTINCT 1 AS part, table_name || ' (' || n || ' rows)' AS line FROM prof UNION ALL SELECT DISTINCT 2, a || ' -> ' || b FROM (VALUES {', '.join(f"('{f.child}', '{f.parent}')" for f in DRIVER.foreign)}) k(a, b)",
        "axiom_triples": f"""WITH {fk}, k AS (SELECT DISTINCT src, dst FROM fk), i AS (SELECT src, dst, src || '.' || col AS key, src || '.' || col || '~' AS back, one_to_one FROM fk)
SELECT key AS s, 'owl:inverseOf' AS p, back AS o FROM i UNION ALL SELECT back, 'rdf:type', 'owl:ObjectProperty' FROM i UNION ALL SELECT back, 'rdfs:domain', dst FROM i UNION ALL SELECT back, 'rdfs:range', src FROM i UNION ALL SELECT back, 'cardinality', CASE WHEN one_to_one THEN 'one_to_one' ELSE 'one_to_many' END FROM i
UNION ALL SELECT DISTINCT a.src, 'owl:disjointWith', b.src FROM k a, k b WHERE a.dst = b.dst AND a.src < b.src AND NOT EXISTS (SELECT 1 FROM k WHERE (src, dst) IN ((a.src, b.src), (b.src, a.src)))
UNION ALL SELECT a.src || '>' || min(a.dst), 'owl:propertyChainAxiom', b.dst FROM k a, k b WHERE a.dst = b.src AND a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM k WHERE src = a.src AND dst = b.dst) GROUP BY a.src, b.dst""",
        "catalogue_labels": f"WITH {prof} SELECT table_name, column_name, list_aggregate(list_transform(string_split(column_name, '_'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', ' ') AS label, column_name AS uri_name FROM prof",
        "element_texts": f"{both}, {words} SELECT * FROM w",
        "element_scores": f"{both}, {scores} SELECT * FROM s",
        "relevant_tables": f"{both}, {relevant} SELECT * FROM r",
        "relevant_schema": f"WITH RECURSIVE {prof}, {fk}, {relevant}, uu AS ({graph._LOOSE}), rr(node, root) AS (SELECT src, src FROM uu UNION SELECT dst, root FROM rr JOIN uu ON node = src), cc AS (SELECT node, min(root) AS component FROM rr GROUP BY node), jj AS (SELECT * FROM ({graph._WALKS['join_specs']}) q) SELECT CASE role WHEN 'search' THEN 'table' ELSE 'related' END AS part, table_name AS name, NULL AS other, NULL AS detail, score FROM r UNION ALL SELECT 'community', component, node, NULL, NULL FROM cc WHERE component IN (SELECT component FROM cc WHERE node IN (SELECT table_name FROM f)) UNION ALL SELECT 'join path', origin, node, direction || ': ' || steps, NULL FROM jj WHERE origin < node AND origin IN (SELECT table_name FROM f) AND node IN (SELECT table_name FROM f) UNION ALL SELECT 'hint', src, NULL, 'has ' || count(*) || ' keys: sum each parent''s measures before joining', NULL FROM fk WHERE src IN (SELECT table_name FROM f) GROUP BY src HAVING count(*) > 1",
        "graph_nodes": f"{both} SELECT table_name, max(n) AS n_rows, count(*) AS n_columns, (SELECT count(*) FROM fk WHERE src = table_name) AS n_keys, (SELECT count(*) FROM fk WHERE dst = table_name) AS n_referring FROM prof GROUP BY table_name",
        "schema_overview": f"WITH RECURSIVE {prof}, {fk}, {words}, uu AS ({graph._LOOSE}), rr(node, root) AS (SELECT src, src FROM uu UNION SELECT dst, root FROM rr JOIN uu ON node = src) SELECT 'elements: ' || kind AS part, count(*) AS n FROM w GROUP BY kind UNION ALL SELECT 'tables', count(DISTINCT table_name) FROM prof UNION ALL SELECT 'tables without a link', count(DISTINCT table_name) FROM prof WHERE table_name NOT IN (SELECT src FROM uu) UNION ALL SELECT 'links', count(*) FROM (SELECT DISTINCT src, dst FROM fk) e UNION ALL SELECT 'communities', count(DISTINCT m) FROM (SELECT min(root) AS m FROM rr GROUP BY node) c",
        "query_context": f"{both}, {relevant}, g AS (SELECT 'tables' AS part, (SELECT count(*) FROM r) AS n UNION ALL SELECT 'columns', (SELECT count(*) FROM prof WHERE table_name IN (SELECT table_name FROM r)) UNION ALL SELECT 'joins', (SELECT count(*) FROM fk WHERE src IN (SELECT table_name FROM r) AND dst IN (SELECT table_name FROM r))) SELECT part, n, n * CASE part WHEN 'tables' THEN 200 WHEN 'columns' THEN 50 ELSE 100 END AS tokens FROM g",
    }


# The text columns of tables with foreign keys, as the SQL needs them.
_TEXTS = frozenset("n_name c_name c_mktsegment s_name o_orderstatus o_orderpriority l_returnflag l_linestatus event_type props".split())
