"""Relational coverage: joins, aggregates, windows, sets, ordering, scalars and nested values.

Each query is one SQL text over the tables. Where Spark and DuckDB spell a thing
differently, the second text is DuckDB's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import TABLES, register

money = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18, 2))) AS DOUBLE)"

PORTABLE: dict[str, str] = {
    # projection and predicates
    "project_alias_filter": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_quantity < 24 AND l_returnflag <> 'A'",
    "predicate_between_in_like": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') AND p_name LIKE '%a%'",
    "predicate_null_safe": "SELECT count(*) AS n, count(lang) AS n_lang, count(CASE WHEN lang IS DISTINCT FROM 'en' THEN 1 END) AS n_other FROM documents",
    "subquery_in": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "subquery_exists_correlated": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "subquery_not_exists": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)",
    "subquery_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)",
    "safe_correlated_scalar": f"SELECT c_custkey, (SELECT {money('o_totalprice')} FROM orders WHERE o_custkey = c_custkey) AS order_total, (SELECT {money('value')} FROM events WHERE user_id = c_custkey) AS event_value FROM customer",
    "cte_siblings": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE n >= 12) SELECT c_mktsegment, count(*) AS customers FROM customer JOIN top ON c_custkey = o_custkey GROUP BY c_mktsegment",
    # joins
    "join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'",
    "join_left": "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": "SELECT coalesce(a.user_id, b.o_custkey) AS customer, a.n_events, b.n_orders FROM (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id) a FULL JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) b ON a.user_id = b.o_custkey",
    "join_comma_where": f"SELECT r_name, {money('o_totalprice')} AS total FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name",
    "join_using": "SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
    "join_natural": "SELECT quality, count(*) AS n FROM documents NATURAL JOIN labels GROUP BY quality",
    "join_range_bands": "SELECT band, count(*) AS n, min(p_size) AS smallest FROM part JOIN (VALUES ('low', 1, 11), ('mid', 11, 31), ('high', 31, 1000)) b(band, lo, hi) ON p_size >= lo AND p_size < hi GROUP BY band",
    "join_cross": "SELECT r_name, p_brand FROM region CROSS JOIN (SELECT DISTINCT p_brand FROM part) b",
    "join_self": "SELECT a.n_name AS nation, count(*) AS neighbours FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_name",
    # aggregation
    "agg_five": f"SELECT l_returnflag, l_linestatus, {money('l_extendedprice')} AS sum_price, count(*) AS n, round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type",
    "agg_case_when": f"SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished, {money('CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0 END')} AS large FROM orders GROUP BY o_orderpriority",
    "agg_filter_clause": "SELECT source, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 2000) AS long_docs FROM documents GROUP BY source",
    "agg_rollup": f"SELECT n_regionkey, c_mktsegment, {money('c_acctbal')} AS balance, CAST(grouping(n_regionkey) AS INT) AS g_region, CAST(grouping(c_mktsegment) AS INT) AS g_segment FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, CAST(date_trunc('day', ts) AS DATE)), (event_type), ())",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "safe_preagg_orders_lineitem": f"WITH o AS (SELECT o_custkey, {money('o_totalprice')} AS order_total FROM orders GROUP BY o_custkey), l AS (SELECT o_custkey, {money('l_quantity')} AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT c_custkey, order_total, quantity FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey",
    "safe_union_facts": f"SELECT c_mktsegment, {money('order_total')} AS order_total, {money('event_value')} AS event_value FROM (SELECT c_mktsegment, o_totalprice AS order_total, CAST(NULL AS DOUBLE) AS event_value FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_mktsegment, CAST(NULL AS DOUBLE), value FROM events JOIN customer ON user_id = c_custkey) f GROUP BY c_mktsegment",
    "safe_window_preagg": "SELECT o_orderkey, o_custkey, lines, CAST(sum(lines) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_lines FROM (SELECT o_orderkey, o_custkey, o_orderdate, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate) t",
    # windows
    "window_rank_family": "SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS i, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)",
    "window_lag_lead": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_event FROM events",
    "window_rows_frame": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three FROM orders",
    "window_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part",
    "window_share_of_total": "SELECT n_name, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) t",
    "qualify_top_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) t WHERE i <= 2",
    "order_by_top": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
    # sets
    "set_union_all": "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier",
    "set_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT o_custkey AS customer FROM orders INTERSECT SELECT user_id FROM events",
    "set_except": "SELECT c_custkey AS customer FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_except_all": "SELECT l_suppkey AS supplier FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier",
    # scalars
    "scalar_string": "SELECT c_custkey, upper(c_mktsegment) AS up, substring(c_name, 1, 8) AS head, length(c_name) AS n, replace(c_name, '#', '-') AS swapped, trim(concat(' ', c_mktsegment, ' ')) AS trimmed, left(c_name, 3) AS l3, right(c_name, 4) AS r4, lpad(CAST(c_nationkey AS VARCHAR(4)), 4, '0') AS padded, reverse(c_mktsegment) AS rev FROM customer",
    "scalar_math": "SELECT p_partkey, round(p_retailprice, 1) AS r, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, abs(p_size - 25) AS a, p_size % 7 AS m, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, CAST(sign(p_size - 25) AS INT) AS g, greatest(p_size, 10) AS hi, least(p_size, 10) AS lo FROM part",
    "scalar_conditional": "SELECT event_id, coalesce(event_type, 'none') AS kind, nullif(event_type, 'view') AS other, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band FROM events",
    "label_measure_names": "SELECT DISTINCT p_type, lower(replace(p_type, ' ', '_')) AS clean, length(p_type) AS n FROM part",
    # result shaping
    "chart_bar_sum": f"SELECT c_mktsegment AS x, {money('o_totalprice')} AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment",
    "chart_stacked_sum": f"SELECT o_orderpriority AS x, o_orderstatus AS color, {money('o_totalprice')} AS y FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority, o_orderstatus",
    "chart_multi_measure": f"SELECT l_returnflag AS x, {money('l_quantity')} AS quantity, {money('l_extendedprice')} AS price, {money('l_tax')} AS tax FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag",
    "chart_scatter": "SELECT p_size AS x, p_retailprice AS y FROM part",
    "chart_heatmap_correlation": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qty_price, round(corr(l_quantity, l_discount), 6) AS qty_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem",
    "pass_through_rows": "SELECT page_id, url, length(html) AS n FROM pages",
}

DIALECT: dict[str, tuple[str, str]] = {
    # how many are richer, by rank: the same as a range join of the table with itself, whose pairs grow with its square
    "join_theta_range": (
        "SELECT s_suppkey, CAST(r - 1 AS BIGINT) AS richer FROM (SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL) t WHERE r > 1",
        "SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal AND b.s_nationkey = a.s_nationkey GROUP BY a.s_suppkey",
    ),
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_broadcast_hint": ("SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "scalar_date": (
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS days, CAST(quarter(o_orderdate) AS INT) AS q, CAST(o_orderdate + INTERVAL 7 DAYS AS DATE) AS week_on FROM orders",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(quarter(o_orderdate) AS INT) AS q, CAST(o_orderdate + INTERVAL 7 DAYS AS DATE) AS week_on FROM orders",
    ),
    "scalar_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "scalar_regexp": ("SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_like(url, 'utm_') AS tracked FROM pages", "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_matches(url, 'utm_') AS tracked FROM pages"),
    "nested_array": (
        "SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 5) AS hi, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS total, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings",
        "SELECT vec_id, len(embedding) AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS hi, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings",
    ),
    "nested_map": (
        "SELECT user_id, kinds['view'] AS views, kinds['purchase'] AS purchases FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) a GROUP BY user_id) b",
        "SELECT user_id, max(CASE WHEN event_type = 'view' THEN n END) AS views, max(CASE WHEN event_type = 'purchase' THEN n END) AS purchases FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) a GROUP BY user_id",
    ),
    "explode_words": (
        "SELECT word, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS word FROM benchmark) w GROUP BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) w GROUP BY word",
    ),
    "chart_pivot_long": (
        "SELECT x, y, coalesce(v, 0) AS v FROM (SELECT * FROM (SELECT o_orderpriority AS y, o_orderstatus, 1 AS one FROM orders) PIVOT (count(one) FOR o_orderstatus IN ('F' AS F, 'O' AS O, 'P' AS P))) UNPIVOT INCLUDE NULLS (v FOR x IN (F, O, P))",
        "SELECT s.x AS x, y, count(CASE WHEN o_orderstatus = s.x THEN 1 END) AS v FROM (SELECT o_orderpriority AS y, o_orderstatus FROM orders) o, (VALUES ('F'), ('O'), ('P')) s(x) GROUP BY s.x, y",
    ),
    "chart_line_two_axes": (
        "SELECT CAST(date_trunc('day', ts) AS DATE) AS x, count(*) AS events, round(100 * avg(CASE WHEN event_type = 'error' THEN 1.0D ELSE 0.0D END), 4) AS error_pct FROM events GROUP BY CAST(date_trunc('day', ts) AS DATE) ORDER BY x",
        "SELECT CAST(date_trunc('day', ts) AS DATE) AS x, count(*) AS events, round(100 * avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS error_pct FROM events GROUP BY CAST(date_trunc('day', ts) AS DATE) ORDER BY x",
    ),
    "recursive_chain": (
        "WITH RECURSIVE chain(conv_id, turn, depth) MAX RECURSION LEVEL 1000 AS (SELECT conv_id, turn, 1 FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM chain JOIN conversations c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1) SELECT conv_id, max(depth) AS turns FROM chain GROUP BY conv_id",
        "WITH RECURSIVE chain(conv_id, turn, depth) AS (SELECT conv_id, turn, 1 FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM chain JOIN conversations c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1) SELECT conv_id, max(depth) AS turns FROM chain GROUP BY conv_id",
    ),
}


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, used)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _runner(v) for k, v in PORTABLE.items()} | {k: _runner(v[0]) for k, v in DIALECT.items()}


def oracle_sql() -> dict[str, str]:
    return PORTABLE | {k: v[1] for k, v in DIALECT.items()}
