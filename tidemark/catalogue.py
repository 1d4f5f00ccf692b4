"""The registered queries and their SQL, from all parts of the library but the optional one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import catalog, discovery, graph, inference, mapping, relational, retrieval, schema, shapes, shaping, text_vectors, triplestore, vector_index
from tidemark.plans import composite
from tidemark.streaming import events

_PARTS = (relational, graph, composite, catalog, retrieval, shaping, events, triplestore, inference, schema, discovery, vector_index, text_vectors, shapes, mapping)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, run in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.oracle_sql().items()}
