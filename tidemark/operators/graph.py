"""Graph questions over the key graph: reach, paths, degrees, components, siblings, chains.

Edges run from the finer to the coarser table. The graph is derived from the data (keys that
hold), verified once a state of the files, and then asked in SQL. Reach and paths are
found breadth first: each round steps from what the last one found, and ends when that is nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed
from tidemark.sources.keys import integrity_sql, kept_edges, uniqueness_sql
from tidemark.sources.tables import register

MAX_HOPS = 12
_LOOSE = "SELECT src, dst FROM fk UNION SELECT dst, src FROM fk"

QUESTIONS: dict[str, str] = {
    "related_tables_2hop": f"WITH u AS ({_LOOSE}) SELECT origin, node, min(hop) AS hop FROM (SELECT src AS origin, dst AS node, 1 AS hop FROM u UNION ALL SELECT a.src, b.dst, 2 FROM u a JOIN u b ON a.dst = b.src WHERE a.src <> b.dst) t GROUP BY origin, node",
    "degree_summary": f"WITH u AS ({_LOOSE}), o AS (SELECT src AS node, count(DISTINCT dst) AS k FROM fk GROUP BY src), i AS (SELECT dst AS node, count(DISTINCT src) AS k FROM fk GROUP BY dst), d AS (SELECT src AS node, count(*) AS k FROM u GROUP BY src) SELECT d.node AS node, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree, round(d.k / CAST(count(*) OVER () - 1 AS DOUBLE), 6) AS centrality FROM d LEFT JOIN o ON d.node = o.node LEFT JOIN i ON d.node = i.node",
    "disjoint_siblings": "SELECT DISTINCT a.src AS first_table, b.src AS second_table, a.dst AS target FROM fk a JOIN fk b ON a.dst = b.dst AND a.src < b.src WHERE NOT EXISTS (SELECT 1 FROM fk d WHERE (d.src = a.src AND d.dst = b.src) OR (d.src = b.src AND d.dst = a.src))",
    "two_hop_chains": "SELECT a.src AS start_table, min(a.dst) AS via, b.dst AS end_table FROM fk a JOIN fk b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM fk d WHERE d.src = a.src AND d.dst = b.dst) GROUP BY a.src, b.dst",
    "hub_hints": "SELECT src AS hub, count(*) AS n_keys FROM fk GROUP BY src HAVING count(*) > 1",
    # both ways, along the keys only, and against them only
    "related_by_direction": f"WITH u AS ({_LOOSE}), e AS (SELECT DISTINCT src, dst, 'outgoing' AS direction FROM fk UNION ALL SELECT DISTINCT dst, src, 'incoming' FROM fk UNION ALL SELECT src, dst, 'both' FROM u) SELECT origin, node, direction, min(hop) AS hop FROM (SELECT src AS origin, dst AS node, direction, 1 AS hop FROM e UNION ALL SELECT a.src, b.dst, a.direction, 2 FROM e a JOIN e b ON a.dst = b.src AND a.direction = b.direction WHERE a.src <> b.dst) t GROUP BY origin, node, direction",
    # a report of the five best linked tables
    "top_hubs": f"WITH u AS ({_LOOSE}), d AS (SELECT src AS node, count(*) AS k FROM u GROUP BY src) SELECT node, k AS degree, round(k / CAST(count(*) OVER () - 1 AS DOUBLE), 6) AS centrality FROM d ORDER BY degree DESC, node LIMIT 5",
    "graph_export": "SELECT src, dst, col, ref_col, n, one_to_one FROM fk",
}


def reach(edges: DataFrame, origins: DataFrame | None = None, direction: str = "outgoing", max_hops: int | None = None) -> DataFrame:
    """(origin, node, hop): what can be reached along the keys, against them (``incoming``) or both ways (``both``), with the least number of hops.

    ``origins`` has the column ``origin``; without it every node is one. An origin does not reach
    itself. There is no bound of hops unless one is given: a round steps from the pairs that
    the last one found and keeps those that are new, so cycles end and no walk is counted.
    """
    ways = {"outgoing": [("src", "dst")], "incoming": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    steps = checkpointed(reduce(DataFrame.union, [edges.select(F.col(a).alias("node"), F.col(b).alias("next")) for a, b in ways]).where("node <> next").distinct())
    starts = steps.select(F.col("node").alias("origin")).distinct() if origins is None else origins.select("origin").distinct()
    front = starts.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hop"))
    known, hop = checkpointed(front), 0
    while max_hops is None or hop < max_hops:
        hop += 1
        found = front.join(steps, "node").select("origin", F.col("next").alias("node"), F.lit(hop).alias("hop")).distinct()
        front = checkpointed(found.join(known, ["origin", "node"], "left_anti"))
        if front.isEmpty():
            break
        known = checkpointed(known.unionByName(front))
    return known.where("origin <> node")


def join_specs(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(origin, node, hop, direction, path, steps): the shortest path between two tables, with its join conditions.

    Of equally short paths one along the keys only (``forward``) goes before one against them only
    (``backward``), that before a mixed one (``undirected``), then the order of names and of
    conditions. A round keeps the best path of each direction for every pair that it is the
    first to reach, so no more than three a pair go on, however many paths there are.
    """
    text = F.concat(F.col("src"), F.lit("."), F.col("col"), F.lit(" = "), F.col("dst"), F.lit("."), F.col("ref_col"))
    way = lambda a, b, d: edges.select(F.col(a).alias("node"), F.col(b).alias("next"), text.alias("step"), F.lit(d).alias("turn"))
    steps = checkpointed(way("src", "dst", 0).union(way("dst", "src", 1)).where("node <> next").distinct())
    front = steps.select(F.col("node").alias("origin"), "node", F.lit(None).cast("int").alias("way"), F.col("node").alias("path"), F.lit("").alias("steps")).distinct()
    known = checkpointed(front.select("origin", "node", F.lit(0).alias("hop"), "way", "path", "steps"))
    for hop in range(1, max_hops + 1):
        mixed = F.when(F.col("way").isNull() | (F.col("way") == F.col("turn")), F.col("turn")).otherwise(2)
        found = front.join(steps, "node").select("origin", F.col("next").alias("node"), mixed.alias("way"), F.concat_ws(">", "path", "next").alias("path"), F.when(F.col("steps") == "", F.col("step")).otherwise(F.concat_ws(" AND ", "steps", "step")).alias("steps"))
        best = found.join(known.select("origin", "node").distinct(), ["origin", "node"], "left_anti").groupBy("origin", "node", "way").agg(F.min(F.struct("path", "steps")).alias("b"))
        front = checkpointed(best.select("origin", "node", "way", "b.path", "b.steps"))
        if front.isEmpty():
            break
        known = checkpointed(known.unionByName(front.withColumn("hop", F.lit(hop))))
    first = known.where("hop > 0").groupBy("origin", "node", "hop").agg(F.min(F.struct("way", "path", "steps")).alias("b"))
    names = F.element_at(F.array(*map(F.lit, ("forward", "backward", "undirected"))), F.col("b.way") + 1)
    return first.select("origin", "node", "hop", names.alias("direction"), "b.path", "b.steps")


def join_paths(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(origin, node, hop, path): the shortest path between two tables; of equally short ones, the first in order of names."""
    plain = edges.select("src", F.lit("").alias("col"), "dst", F.lit("").alias("ref_col"))
    both = plain.union(plain.select(F.col("dst").alias("src"), "col", F.col("src").alias("dst"), "ref_col"))  # each link along and against the keys, so that direction decides nothing
    return join_specs(both, max_hops).where("direction = 'forward'").select("origin", "node", "hop", "path")


#: Reach and paths over again as recursion in SQL: all walks shorter than there are tables, and all simple paths.
_WALKS = {
    "related_at_any_distance": f"WITH RECURSIVE u AS ({_LOOSE}), r(origin, node, hop) AS (SELECT src, dst, 1 FROM u UNION SELECT origin, dst, hop + 1 FROM r JOIN u ON node = src WHERE hop < (SELECT count(DISTINCT src) FROM u)) SELECT origin, node, min(hop) AS hop FROM r WHERE origin <> node GROUP BY origin, node",
    "reach_by_hop": f"WITH RECURSIVE r(origin, node, hop) AS (SELECT src, dst, 1 FROM (SELECT DISTINCT src, dst FROM fk) e UNION SELECT origin, dst, hop + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM fk) e ON node = src WHERE hop < (SELECT count(*) FROM (SELECT src FROM fk UNION SELECT dst FROM fk) n)) SELECT origin, node, min(hop) AS hop FROM r WHERE origin <> node GROUP BY origin, node",
    "dimension_reach_lineitem": f"WITH RECURSIVE r(node, hop) AS (SELECT dst, 1 FROM fk WHERE src = 'lineitem' UNION SELECT dst, hop + 1 FROM r JOIN fk ON node = src WHERE hop < (SELECT count(*) FROM (SELECT src FROM fk UNION SELECT dst FROM fk) n)) SELECT node, min(hop) AS hop FROM r GROUP BY node",
    "measure_reach_region": f"WITH RECURSIVE r(node, hop) AS (SELECT src, 1 FROM fk WHERE dst = 'region' UNION SELECT src, hop + 1 FROM r JOIN fk ON node = dst WHERE hop < (SELECT count(*) FROM (SELECT src FROM fk UNION SELECT dst FROM fk) n)) SELECT node, min(hop) AS hop FROM r GROUP BY node",
    "join_paths": f"WITH RECURSIVE u AS ({_LOOSE}), p(origin, node, hop, path) AS (SELECT src, dst, 1, concat(src, '>', dst) FROM u UNION ALL SELECT origin, dst, hop + 1, concat(path, '>', dst) FROM p JOIN u ON node = src WHERE hop < {MAX_HOPS} AND concat('>', path, '>') NOT LIKE concat('%>', dst, '>%')) SELECT origin, node, hop, path FROM (SELECT origin, node, hop, path, row_number() OVER (PARTITION BY origin, node ORDER BY hop, path) AS i FROM p) t WHERE i = 1",
    "join_specs": f"WITH RECURSIVE s AS (SELECT src, dst, concat(src, '.', col, ' = ', dst, '.', ref_col) AS step, 1 AS fwd FROM fk UNION ALL SELECT dst, src, concat(src, '.', col, ' = ', dst, '.', ref_col), 0 FROM fk), p(origin, node, hop, fwd, path, steps) AS (SELECT src, dst, 1, fwd, concat(src, '>', dst), step FROM s UNION ALL SELECT origin, dst, hop + 1, p.fwd + s.fwd, concat(path, '>', dst), concat(steps, ' AND ', step) FROM p JOIN s ON node = src WHERE hop < {MAX_HOPS} AND concat('>', path, '>') NOT LIKE concat('%>', dst, '>%')), d AS (SELECT origin, node, hop, path, steps, CASE WHEN fwd = hop THEN 'forward' WHEN fwd = 0 THEN 'backward' ELSE 'undirected' END AS direction FROM p WHERE origin <> node) SELECT origin, node, hop, direction, path, steps FROM (SELECT origin, node, hop, direction, path, steps, row_number() OVER (PARTITION BY origin, node ORDER BY hop, CASE direction WHEN 'forward' THEN 0 WHEN 'backward' THEN 1 ELSE 2 END, path, steps) AS i FROM d) t WHERE i = 1",
}


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least name that a node is linked with, found by passing names on until none changes."""
    links = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = links.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    while True:
        near = links.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("near"))
        fresh = checkpointed(labels.join(near, F.col("node") == F.col("src")).select("node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved")))
        labels = fresh.select("node", "component")
        if not fresh.where("moved").limit(1).count():
            return labels


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) by semi-synchronous label propagation, deterministic.

    Nodes get colours first: of those without one, each that has the least name among its
    neighbours without one takes the round's. The colours take turns: a node takes the label
    that most of its neighbours hold, keeps its own if that is among the most frequent, and else
    takes the least of those. Nodes of a colour are not linked, so a turn cannot swap labels to
    and fro, and the number of links between equal labels grows until nothing changes.
    """
    links = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    left, colours = links.select(F.col("src").alias("node")).distinct(), []
    while True:
        lower = links.join(left, F.col("dst") == F.col("node")).where("dst < src").select(F.col("src").alias("node"))
        chosen = checkpointed(left.join(lower, "node", "left_anti"))
        if chosen.isEmpty():
            break
        colours.append(chosen)
        left = checkpointed(left.join(chosen, "node", "left_anti"))
    labels = links.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    moved = True
    while moved:
        moved = False
        for chosen in colours:
            held = links.join(chosen, F.col("src") == F.col("node")).drop("node").join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"), "community").agg(F.count("*").alias("votes"))
            best = held.groupBy("node").agg(F.max("votes").alias("votes"))
            most = held.join(best, ["node", "votes"]).groupBy("node").agg(F.collect_set("community").alias("most"))
            turn = checkpointed(labels.join(most, "node", "left").select("node", "community", F.when(F.array_contains("most", F.col("community")), F.col("community")).otherwise(F.coalesce(F.array_min("most"), "community")).alias("fresh")))
            moved = moved or not turn.where("fresh <> community").isEmpty()
            labels = turn.select("node", F.col("fresh").alias("community"))
    return labels


def _local_moves(links: DataFrame) -> DataFrame | None:
    """(node, community) after moves that each raise the modularity of weighted links (src, dst, w), both ways and loops; None if there is no such move.

    In a round every node looks for the neighbouring community that gains most; of the moves
    that touch a community the best alone is made, the least node at a tie, so that no two
    change each other's gain. Gains are whole numbers, twice the links' weight times the change.
    """
    total = links.agg(F.sum("w").cast("decimal(38,0)")).first()[0]
    degrees = checkpointed(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    labels, moved = degrees.select("node", "k", F.col("node").alias("community")), False
    number = lambda c: F.col(c).cast("decimal(19,0)")
    while True:
        sums = labels.groupBy("community").agg(F.sum("k").alias("total"))
        held = links.where("src <> dst").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("near")), "dst").groupBy(F.col("src").alias("node"), "near").agg(F.sum("w").alias("w"))
        own = labels.join(sums, "community").join(held.select("node", F.col("near").alias("community"), "w"), ["node", "community"], "left")
        own = own.select("node", "k", "community", (F.lit(total) * F.coalesce(number("w"), F.lit(0)) - number("k") * (number("total") - number("k"))).alias("stay"))
        there = held.join(sums.select(F.col("community").alias("near"), "total"), "near").join(own, "node").where("near <> community")
        gains = there.select("node", "community", "near", (F.lit(total) * number("w") - number("k") * number("total") - F.col("stay")).alias("gain")).where("gain > 0")
        best = checkpointed(gains.groupBy("node", "community").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "near")).alias("b")).select("node", "community", "b.near", (-F.col("b.loss")).alias("gain")))
        if best.isEmpty():
            return labels.select("node", "community") if moved else None
        touched = best.select("node", "gain", F.explode(F.array("community", "near")).alias("c")).groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "node"))["node"].alias("first"))
        first = lambda c: touched.select(F.col("c").alias(c), F.col("first").alias(f"by_{c}"))
        made = best.join(first("community"), "community").join(first("near"), "near").where("node = by_community AND node = by_near").select("node", F.col("near").alias("to"))
        labels = checkpointed(labels.join(made, "node", "left").select("node", "k", F.coalesce("to", "community").alias("community")))
        moved = True


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community) by Louvain's method: local moves, contraction of the communities to nodes, and again until nothing moves.

    Links count once, whatever their number and direction; a community has the name of its
    least node. The same graph gives the same result in every run.
    """
    pairs = edges.select("src", "dst").where("src <> dst")
    links = checkpointed(pairs.union(pairs.select("dst", "src")).distinct().withColumn("w", F.lit(1).cast("long")))
    members = links.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    while not links.isEmpty() and (labels := _local_moves(links)) is not None:
        names = labels.groupBy("community").agg(F.min("node").alias("name"))
        labels = checkpointed(labels.join(names, "community").select("node", F.col("name").alias("community")))
        of = lambda side: labels.select(F.col("node").alias(side), F.col("community").alias(f"{side}_c"))
        links = checkpointed(links.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("w").alias("w")))
        members = checkpointed(members.join(labels.select(F.col("node").alias("community"), F.col("community").alias("fresh")), "community").select("node", F.col("fresh").alias("community")))
    least = members.groupBy("community").agg(F.min("node").alias("name"))
    return members.join(least, "community").select("node", F.col("name").alias("community"))


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """The share of links inside communities less what their degrees would give by chance."""
    pairs = edges.select("src", "dst").where("src <> dst")
    links = pairs.union(pairs.select("dst", "src")).distinct().join(members.toDF("src", "a"), "src").join(members.toDF("dst", "b"), "dst")
    by = links.groupBy("a").agg(F.count("*").alias("k"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    row = by.agg(F.sum("k").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk")).first()
    return row["inside"] / row["m"] - row["kk"] / row["m"] ** 2 if row["m"] else 0.0


def community_summary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, n_nodes, central, central_degree, mean_degree, domain): the best linked member, the least name at a tie, and the word that most members' names hold, of three letters or more."""
    links = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    held = members.join(links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "node", "left").fillna(0, ["degree"])
    first = F.min_by("node", F.struct(-F.col("degree"), F.col("node")))
    sizes = held.groupBy("community").agg(F.count("*").alias("n_nodes"), first.alias("central"), F.max("degree").alias("central_degree"), F.round(F.avg("degree"), 6).alias("mean_degree"))
    words = held.select("community", F.explode(F.split(F.lower("node"), "_")).alias("word")).where(F.length("word") > 2).groupBy("community", "word").agg(F.count("*").alias("k"))
    named = words.groupBy("community").agg(F.concat(F.initcap(F.min_by("word", F.struct(-F.col("k"), F.col("word")))), F.lit(" Domain")).alias("domain"))
    return sizes.join(named, "community", "left").fillna("Domain", ["domain"])


#: Questions that are answered in rounds, by name.
ROUNDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "components": components, "reach_by_hop": reach, "related_at_any_distance": lambda e: reach(e, None, "both"), "join_paths": join_paths, "join_specs": join_specs,
    "dimension_reach_lineitem": lambda e: reach(e, _one(e, "lineitem")).select("node", "hop"), "measure_reach_region": lambda e: reach(e, _one(e, "region"), "incoming").select("node", "hop"),
}


def _one(edges: DataFrame, name: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(name,)], "origin string")


def ask(edges: DataFrame, text: str) -> DataFrame:
    """Ask the graph a question in SQL, as the view ``fk``."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("fk")
    return spark.sql(text)


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ask(kept_edges(spark, sf_dir), text)


def _check(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    checks = {"referential_integrity": _check(integrity_sql()), "key_uniqueness": _check(uniqueness_sql())}
    iterated = {
        "communities_label_propagation": lambda s, d: communities(kept_edges(s, d)),
        "communities_louvain": lambda s, d: louvain(kept_edges(s, d)),
        "community_summary": lambda s, d: community_summary(kept_edges(s, d), components(kept_edges(s, d)).withColumnRenamed("component", "community")),
    }
    iterated |= {k: lambda s, d, f=f: f(kept_edges(s, d)) for k, f in ROUNDS.items()}
    return checks | iterated | {k: _runner(v) for k, v in QUESTIONS.items()}


def oracle_sql() -> dict[str, str]:
    fk = f"fk AS (SELECT * FROM ({integrity_sql()}) q WHERE orphans = 0)"
    found = {"referential_integrity": integrity_sql(), "key_uniqueness": uniqueness_sql().replace("struct(", "row(")}
    found["components"] = f"WITH RECURSIVE {fk}, u AS ({_LOOSE}), r(node, root) AS (SELECT src, src FROM u UNION SELECT dst, root FROM r JOIN u ON node = src) SELECT node, min(root) AS component FROM r GROUP BY node"
    found["community_summary"] = f"WITH RECURSIVE {fk}, u AS ({_LOOSE}), r(node, root) AS (SELECT src, src FROM u UNION SELECT dst, root FROM r JOIN u ON node = src), m AS (SELECT node, min(root) AS community FROM r GROUP BY node), g AS (SELECT m.node, community, count(*) AS degree FROM m JOIN u ON u.src = m.node GROUP BY ALL), w AS (SELECT community, unnest(string_split(lower(node), '_')) AS word FROM m), k AS (SELECT community, word, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, word) AS i FROM w WHERE length(word) > 2 GROUP BY community, word), c AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS i FROM g) SELECT g.community, count(*) AS n_nodes, max(CASE WHEN c.i = 1 THEN g.node END) AS central, max(g.degree) AS central_degree, round(avg(g.degree), 6) AS mean_degree, upper(left(max(word), 1)) || substr(max(word), 2) || ' Domain' AS domain FROM g JOIN c ON g.node = c.node JOIN k ON k.community = g.community AND k.i = 1 GROUP BY g.community"
    for name, text in (QUESTIONS | _WALKS).items():
        if text.startswith("WITH RECURSIVE "):
            found[name] = f"WITH RECURSIVE {fk}, {text.removeprefix('WITH RECURSIVE ')}"
        elif text.startswith("WITH "):
            found[name] = f"WITH {fk}, {text.removeprefix('WITH ')}"
        else:
            found[name] = f"WITH {fk} {text}"
    return found
