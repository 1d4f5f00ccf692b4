"""Databases and views of a session, what a view reads, and an index of texts kept with a fingerprint."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Databases of the system.
SYSTEM = frozenset(["information_schema", "pg_catalog", "sys", "system", "pg_toast"])


def databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.lower() not in SYSTEM)


def sources(df: DataFrame, folder: str) -> list[str]:
    """The tables of a folder that a frame reads, by the files of its scans; files from elsewhere are left out."""
    root = folder.rstrip("/") + "/"
    inside = {f.split(root, 1)[1].split("/", 1)[0] for f in df.inputFiles() if root in f}
    return sorted(n.removesuffix(".parquet") for n in inside)


def views(spark: SparkSession, folder: str) -> list[dict]:
    """Every view but the plain names of tables: its name, its text where the catalogue keeps one, its columns and the tables it reads."""
    found = []
    for t in spark.catalog.listTables():
        if t.tableType not in ("VIEW", "TEMPORARY"):
            continue
        df = spark.table(t.name)
        read = sources(df, folder)
        if read == [t.name]:
            continue
        text = None if t.isTemporary else next((r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{t.name}`").collect() if r.col_name == "View Text"), None)
        found.append({"name": t.name, "definition": text, "columns": df.columns, "derived_from": read})
    return sorted(found, key=lambda v: v["name"])


def save_index(index: DataFrame, place: str, fingerprint: str) -> None:
    """Keep an index with the fingerprint of the schema that it was made from."""
    index.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").partitionBy("fingerprint").parquet(place)


def load_index(spark: SparkSession, place: str, fingerprint: str) -> DataFrame | None:
    """The index, or None if there is none or it belongs to another schema."""
    try:
        kept = spark.read.parquet(place).where(F.col("fingerprint").cast("string") == fingerprint).drop("fingerprint")
    except AnalysisException:
        return None
    return None if kept.isEmpty() else kept
