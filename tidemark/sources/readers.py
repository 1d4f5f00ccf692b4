"""Readers by kind of source, and the sink for schemas."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

FILES = ("parquet", "orc", "json", "csv", "text")
# JDBC drivers and URL forms; their jars must be on the class path.
JDBC = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}"),
    "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://{host}:{port}/{database}"),
    "dremio": ("org.apache.arrow.driver.jdbc.ArrowFlightJdbcDriver", "jdbc:arrow-flight-sql://{host}:{port}"),
    "duckdb": ("org.duckdb.DuckDBDriver", "jdbc:duckdb:{database}"),
    "databricks": ("com.databricks.client.jdbc.Driver", "jdbc:databricks://{host}:{port}"),
}
CONNECTORS = {"snowflake": "net.snowflake.spark.snowflake", "bigquery": "bigquery"}


def kinds() -> list[str]:
    return sorted([*FILES, *JDBC, *CONNECTORS])


def reader(spark: SparkSession, kind: str, **options: str) -> Callable[[str], DataFrame]:
    """A function from a path or table name to a lazy DataFrame.

    A JDBC read takes ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` among its options, without which one task reads everything.
    """
    if kind in FILES:
        configured: DataFrameReader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
        return configured.load
    if kind in JDBC:
        driver, url = JDBC[kind]
        parts = {k: options.pop(k, "") for k in ("host", "port", "database")}
        return lambda name: spark.read.format("jdbc").options(driver=driver, url=url.format(**parts), dbtable=name, **options).load()
    if kind in CONNECTORS:
        return lambda name: spark.read.format(CONNECTORS[kind]).options(**options).option("dbtable" if kind == "snowflake" else "table", name).load()
    raise LookupError(f"no reader for {kind}; known: {', '.join(kinds())}")


def schema_json(description: dict[str, list[dict]]) -> str:
    """The tables' columns and keys as JSON."""
    return json.dumps(description, indent=2, sort_keys=True)
