"""Vector and text retrieval: exact cosine and distance top-k, TF-IDF vectors, search over schema elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a vector of norm 0 counts as norm 1."""
    norm = lambda v: F.sqrt(F.when(dot(v, v) == 0, 1.0).otherwise(dot(v, v)))
    return dot(a, b) / (norm(a) * norm(b))


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int, threshold: float = 0.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors of one query, a frame of one row ``q``: each task keeps its own k best, so nothing else is shuffled."""
    score = F.round(cosine(F.col(vector), F.col("q")), 5)
    return vectors.join(F.broadcast(query.limit(1))).select(F.col(id_column), score.alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), id_column).limit(k)


def _first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_topk(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10)


def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of an approximate store, 1 / (1 + squared distance), computed exactly."""
    gap = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    near = table(spark, sf_dir, "embeddings").join(F.broadcast(_first_vector(spark, sf_dir).limit(1)))
    return near.select("vec_id", F.round(1 / (1 + gap), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def tfidf(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, term, weight): smoothed idf ln((1 + n) / (1 + df)) + 1 and L2 norm over words of two letters or more.

    Terms are counted before they are shuffled; the document's norm is a window over its
    own terms.
    """
    n = docs.select(F.count("*").alias("n_docs"))
    words = docs.select(id_column, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("term"))
    counts = words.groupBy(id_column, "term").agg(F.count("*").alias("tf"))
    seen = counts.groupBy("term").agg(F.count("*").alias("df"))
    weighed = counts.join(seen, "term").join(F.broadcast(n)).select(id_column, "term", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weighed.groupBy(id_column).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, id_column).select(id_column, "term", F.round(F.col("w") / F.col("norm"), 5).alias("weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"cosine_topk": _cosine, "distance_topk": _distance, "tfidf_benchmark": lambda s, d: tfidf(table(s, d, "benchmark"), "item_id", "text")}


def oracle_sql() -> dict[str, str]:
    query = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
    return {
        "cosine_topk": f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {query}), 5) AS score FROM embeddings WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), {query}) >= 0 ORDER BY score DESC, vec_id LIMIT 10",
        "distance_topk": f"SELECT vec_id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {query}) * list_distance(CAST(embedding AS DOUBLE[]), {query})), 5) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10",
        "tfidf_benchmark": "WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '(\\p{L}{2,})', 1)) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY item_id, term), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), x AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM c JOIN d USING (term)), n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY item_id) SELECT item_id, term, round(w / norm, 5) AS weight FROM x JOIN n USING (item_id)",
    }
