"""Keys and redundancy found in the data: inclusion dependencies, implied keys that hold, repeated descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.keys import DRIVER, Registry
from tidemark.sources.tables import register

# Integer columns that may refer to another table; single-column primary keys are the targets.
REFERENCES = [
    ("nation", "n_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"),
    ("lineitem", "l_suppkey"), ("lineitem", "l_linenumber"), ("events", "user_id"), ("part", "p_size"), ("labels", "doc_id"), ("embeddings", "label"),
]


def inclusion_sql(registry: Registry = DRIVER) -> str:
    """For each reference and target: how many of its distinct values the target has, where it has all.

    Values are made distinct before they meet, so a join row is one value of one pair.
    """
    targets = [(t, ks[0]) for t, ks in registry.primary.items() if len(ks) == 1]
    used = " UNION ALL ".join(f"SELECT DISTINCT '{t}.{c}' AS child, CAST({c} AS BIGINT) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in REFERENCES)
    keys = " UNION ALL ".join(f"SELECT '{t}.{c}' AS parent, CAST({c} AS BIGINT) AS v FROM {t}" for t, c in targets)
    return f"WITH u AS ({used}), k AS ({keys}), n AS (SELECT child, count(*) AS n_values FROM u GROUP BY child) SELECT u.child AS child, parent, n_values, count(*) AS n_found FROM u JOIN k ON u.v = k.v JOIN n ON u.child = n.child WHERE u.child <> parent GROUP BY u.child, parent, n_values HAVING count(*) = n_values"


#: A text column that only repeats what its key already tells: one value a key, over several rows.
REDUNDANT = "SELECT 'part.p_type' AS column_name, count(*) AS n_keys, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_determined FROM (SELECT p_brand, p_size, count(DISTINCT p_type) AS k FROM part GROUP BY p_brand, p_size) a UNION ALL SELECT 'documents.lang', count(*), CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT source, count(DISTINCT lang) AS k FROM documents GROUP BY source) b"


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"inclusion_dependencies": _run(inclusion_sql()), "determined_columns": _run(REDUNDANT)}


def oracle_sql() -> dict[str, str]:
    return {"inclusion_dependencies": inclusion_sql(), "determined_columns": REDUNDANT}
