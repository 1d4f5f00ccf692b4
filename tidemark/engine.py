"""The facade: a dataset with its keys, and the questions it answers."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import time
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import catalog, discovery, graph, schema, text_vectors
from tidemark.plans import composite, rules, safety
from tidemark.sources.keys import DRIVER, Registry, kept_edges
from tidemark.session import checkpointed
from tidemark.sources import views
from tidemark.sources.tables import TABLES, register, table


def plain(value: Any) -> Any:
    """A value as JSON can hold it: decimals as floats, times in ISO form, bytes in hex."""
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return value if value is None or isinstance(value, (bool, int, float, str, list, dict)) else str(value)


class Engine:
    """A folder of Parquet tables with a key registry. Everything stays lazy until rows are asked for."""

    def __init__(self, spark: SparkSession, folder: str, registry: Registry = DRIVER, names: tuple[str, ...] = TABLES):
        self.spark, self.folder, self.registry, self.names = spark, folder, registry, names
        self._elements: DataFrame | None = None
        self._profile: DataFrame | None = None
        register(spark, folder, names)

    def tables(self) -> list[str]:
        return sorted(self.names)

    def describe(self, name: str) -> list[dict]:
        keys = self.registry.primary.get(name, ())
        links = {f.column: f for f in self.registry.foreign if f.child == name}
        return [
            {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "primary_key": f.name in keys, "references": f"{links[f.name].parent}.{links[f.name].ref}" if f.name in links else None}
            for f in table(self.spark, self.folder, name).schema.fields
        ]

    def sample(self, name: str, rows: int = 10) -> list[dict]:
        if not safety.identifier(name):
            raise ValueError("not a table name")
        return [{k: plain(v) for k, v in r.asDict().items()} for r in table(self.spark, self.folder, name).limit(min(max(rows, 1), 1000)).collect()]

    def validate(self, sql: str, allow_fan_out: bool = False) -> rules.Verdict:
        return rules.validate(self.spark, sql, self.registry, allow_fan_out)

    def frame(self, sql: str, allow_fan_out: bool = False) -> DataFrame:
        """The query's DataFrame, if the gate and the rules let it pass."""
        passed = safety.gate(self.spark, sql)
        if not passed.allowed:
            raise PermissionError(passed.reason)
        verdict = self.validate(sql, allow_fan_out)
        if not verdict.is_valid:
            raise ValueError("; ".join(f"{f.issue}: {f.message}" for f in verdict.findings if f.severity == "ERROR"))
        return self.spark.sql(sql)

    def query(self, sql: str, limit: int = safety.DEFAULT_ROWS, allow_fan_out: bool = False) -> dict:
        """Run a query and return its first rows with the verdict, or why it did not run."""
        began = time.time()
        passed = safety.gate(self.spark, sql)
        if not passed.allowed:
            return {"success": False, "error": passed.reason, "error_type": "security", "data": []}
        verdict = self.validate(sql, allow_fan_out)
        said = [{"issue": f.issue, "severity": f.severity, "message": f.message} for f in verdict.findings]
        trap = {"evaluated": verdict.fan_trap_evaluated, "blocking": verdict.fan_trap_blocking, "overridden": verdict.fan_trap_overridden}
        if not verdict.is_valid:
            return {"success": False, "error": "the query is not valid", "error_type": "validation", "findings": said, "fan_trap": trap, "data": []}
        try:
            df = safety.limited(self.spark.sql(sql), limit)
        except AnalysisException as e:
            return {"success": False, "error": str(e).split("\n")[0], "error_type": "analysis", "findings": said, "fan_trap": trap, "data": []}
        found = df.collect()
        rows = [{k: plain(v) for k, v in r.asDict(True).items()} for r in found[:limit]]
        return {"success": True, "data": rows, "columns": df.columns, "row_count": len(rows), "truncated": len(found) > limit, "execution_time_ms": (time.time() - began) * 1000, "findings": said, "fan_trap": trap}

    def edges(self) -> DataFrame:
        return kept_edges(self.spark, self.folder, self.registry)

    def reachable_from(self, name: str, max_hops: int | None = None) -> dict[str, int]:
        """Dimensions of a table and their distance."""
        found = {k: len(v) for k, v in composite.reachable(self.registry, name).items()}
        return {k: v for k, v in found.items() if max_hops is None or v <= max_hops}

    def measurable_from(self, name: str) -> dict[str, int]:
        """Tables whose rows lead to this one, and their distance."""
        return {t: len(p[name]) for t in {f.child for f in self.registry.foreign} if name in (p := composite.reachable(self.registry, t))}

    def plan_composite(self, facts: list[str], dimensions: list[str] | None = None, via: dict[tuple[str, str], str] | None = None) -> composite.Composite:
        return composite.plan_composite(facts, dimensions, self.registry, via)

    def triples(self) -> DataFrame:
        return catalog.triples(self.spark, self.folder, self.registry)

    def ask_graph(self, question: str) -> DataFrame:
        return graph.ROUNDS[question](self.edges()) if question in graph.ROUNDS else graph.ask(self.edges(), graph.QUESTIONS[question])

    def elements(self) -> DataFrame:
        """The texts that are searched, one a table, column and key; made once an engine."""
        if self._elements is None:
            self._elements = checkpointed(schema.element_texts(self.profile(), self.edges()))
        return self._elements

    def profile(self) -> DataFrame:
        """The column profile of the tables, scanned once an engine."""
        if self._profile is None:
            self._profile = checkpointed(catalog.profile(self.spark, self.folder, self.registry, self.names))
        return self._profile

    def search(self, text: str, top: int = 5, kind: str | None = None, embed: text_vectors.Embed | None = None) -> list[dict]:
        """Tables, columns and keys (or one of these kinds) whose names and roles are nearest to a text, by TF-IDF or by the vectors of ``embed``."""
        if embed is not None:
            chosen = self.elements() if kind is None else self.elements().where(F.col("kind") == kind)
            near = text_vectors.search(chosen.select(F.col("element").alias("id"), "words"), text, embed, top)
            return [r.asDict() for r in near.join(chosen, F.col("id") == F.col("element")).select("element", "score", "kind").orderBy(F.desc("score"), "element").collect()]
        found = schema.scored(self.elements(), text)
        return [r.asDict() for r in (found if kind is None else found.where(F.col("kind") == kind)).orderBy(F.desc("score"), "element").limit(top).collect()]

    def context(self, text: str, top: int = 3) -> dict:
        """What a question needs: tables, their columns, the keys between them, and about how many tokens that takes."""
        tables = checkpointed(schema.relevant_tables(self.elements(), self.edges(), text, top))
        chosen = tables.select("table_name")
        inside = self.edges().join(chosen.withColumnRenamed("table_name", "src"), "src").join(chosen.withColumnRenamed("table_name", "dst"), "dst")
        columns = self.profile().join(chosen, "table_name", "left_semi").select("table_name", "column_name", "kind", "measure_class")
        size = {r.part: r.tokens for r in schema.query_context(tables, self.profile(), self.edges()).collect()}
        as_dicts = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]
        return {"tables": as_dicts(tables, F.desc("score"), "table_name"), "columns": as_dicts(columns, "table_name", "column_name"), "joins": as_dicts(inside.select("src", "col", "dst", "ref_col"), "src", "col"), "token_estimate": sum(size.values())}

    def relevant(self, text: str, top: int = 3) -> DataFrame:
        """All that the tables nearest to a question bring: related ones, communities, join paths between them, hints."""
        return schema.relevant_schema(self.elements(), self.edges(), text, top)

    def overview(self) -> DataFrame:
        """What is indexed, and the key graph in numbers."""
        return schema.overview(self.elements(), self.profile(), self.edges())

    def discover(self, what: str, **options: int) -> DataFrame:
        """``inclusions``, ``keys`` or ``dependencies`` found in the data of all tables; options as in ``operators.discovery``."""
        found = {"inclusions": discovery.inclusions, "keys": discovery.keys, "dependencies": discovery.dependencies}[what]
        return found({t: table(self.spark, self.folder, t) for t in self.names}, **options)

    def databases(self) -> list[str]:
        return views.databases(self.spark)

    def views(self) -> list[dict]:
        return views.views(self.spark, self.folder)

    def analyze(self, name: str) -> dict | None:
        """A table's columns, keys, rows and columns' comments; None if there is no such table."""
        if name not in self.names:
            return None
        fields = table(self.spark, self.folder, name).schema.fields
        rows = self.profile().where(F.col("table_name") == name).agg(F.max("n")).first()[0]
        return {"name": name, "row_count": rows, "primary_key": list(self.registry.primary.get(name, ())), "columns": [d | {"comment": f.metadata.get("comment")} for d, f in zip(self.describe(name), fields)]}

    def fingerprint(self) -> str:
        """16 hex digits over the tables' names, columns and types."""
        parts = sorted(f"{t}({','.join(sorted(f'{f.name} {f.dataType.simpleString()}' for f in table(self.spark, self.folder, t).schema.fields))})" for t in self.names)
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]
