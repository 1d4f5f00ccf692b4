"""Composite queries over several facts: legs at their own grain, tied to dimensions by named roles."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.keys import DRIVER, ForeignKey, Registry
from tidemark.sources.tables import register, table

Path = tuple[ForeignKey, ...]


def role_name(path: Path) -> str:
    """A role's name: the key columns on the way to the dimension."""
    return ">".join(k.column for k in path)


def roles(registry: Registry, start: str) -> dict[str, list[Path]]:
    """Every way from a table up its keys, by the table it ends at; the shortest first, then by name. No way meets a table twice."""
    found: dict[str, list[Path]] = {}
    open_: list[Path] = [(k,) for k in registry.foreign if k.child == start and k.parent != start]
    while open_:
        path = open_.pop()
        found.setdefault(path[-1].parent, []).append(path)
        met = {start, *(k.parent for k in path)}
        open_ += [(*path, k) for k in registry.foreign if k.child == path[-1].parent and k.parent not in met]
    return {d: sorted(ways, key=lambda p: (len(p), role_name(p))) for d, ways in found.items()}


def reachable(registry: Registry, start: str) -> dict[str, list[ForeignKey]]:
    """The dimensions of a table, each with its shortest way."""
    return {d: list(ways[0]) for d, ways in roles(registry, start).items()}


@dataclass(frozen=True)
class Leg:
    """A fact that is aggregated on its own: the way to each dimension it reaches, and those it pads with nulls."""

    fact: str
    ways: dict[str, Path]
    null_pad: frozenset[str]


@dataclass(frozen=True)
class Composite:
    """Legs and what they share. ``ambiguous`` names the choices that nobody made: (fact, dimension) and the names of its roles."""

    legs: tuple[Leg, ...]
    ambiguous: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)

    @property
    def required(self) -> bool:
        return len(self.legs) > 1

    @property
    def conformed(self) -> frozenset[str]:
        """Dimensions that every leg reaches by a way that is the only one, or was named."""
        shared = frozenset.intersection(*(frozenset(leg.ways) for leg in self.legs))
        return shared - {d for _, d in self.ambiguous}


def plan_composite(facts: list[str], dimensions: list[str] | None = None, registry: Registry = DRIVER, via: Mapping[tuple[str, str], str] | None = None) -> Composite:
    """The legs that facts need, with a role for each dimension.

    A fact above another fact's keys is at a coarser grain of that fact's leg and needs
    none of its own. ``via`` names the role of a (fact, dimension) by the first of its key
    columns, or by all of them; where a fact has several roles and none is named, the
    shortest stands in the plan and the choice is reported as ambiguous.
    """
    named = set(registry.primary).union(*((k.child, k.parent) for k in registry.foreign))
    missing = sorted({*facts, *(dimensions or ())} - named)
    if missing:
        raise LookupError(f"no such tables: {', '.join(missing)}")
    if not facts:
        raise ValueError("a composite has at least one fact")
    ways = {fact: roles(registry, fact) for fact in facts}
    coarser = {above for reached in ways.values() for above in reached}
    legs, ambiguous = [], {}
    for fact in ways:
        if fact in coarser:
            continue
        wanted = set(dimensions) - {fact} if dimensions is not None else {d for reached in ways.values() for d in reached}
        chosen: dict[str, Path] = {}
        for dimension in sorted(wanted & set(ways[fact])):
            options, name = ways[fact][dimension], (via or {}).get((fact, dimension))
            if name is not None:
                options = [p for p in options if name in (p[0].column, role_name(p))]
                if not options:
                    raise LookupError(f"{fact} has no role {name} of {dimension}")
            if len(options) > 1:
                ambiguous[fact, dimension] = tuple(map(role_name, options))
            chosen[dimension] = options[0]
        legs.append(Leg(fact, chosen, frozenset(wanted - set(chosen))))
    return Composite(tuple(legs), ambiguous)


def _tag(path: Path, column: str) -> str:
    return f"{role_name(path)}:{column}"


def leg_rows(leg: Leg, by: dict[str, list[str]], read: Callable[[str], DataFrame]) -> DataFrame:
    """The fact's rows with the wanted columns of its dimensions; ways that start alike are joined once, and each join reads only what is needed."""
    needs: dict[Path, set[str]] = {}
    for dimension, path in leg.ways.items():
        for i, key in enumerate(path):
            needs.setdefault(path[: i + 1], set()).update({key.ref}, by.get(dimension, ()) if i + 1 == len(path) else {path[i + 1].column})
    df = read(leg.fact)
    for path in sorted(needs, key=lambda p: (len(p), role_name(p))):
        key = path[-1]
        side = read(key.parent).select(*[F.col(c).alias(_tag(path, c)) for c in sorted(needs[path])])
        own = df[key.column] if len(path) == 1 else df[f"`{_tag(path[:-1], key.column)}`"]
        df = df.join(side, own == side[f"`{_tag(path, key.ref)}`"], "left")
    return df


def run_composite(spark: SparkSession, folder: str, measures: dict[str, dict[str, Callable[[], Column]]], by: dict[str, list[str]], registry: Registry = DRIVER, via: Mapping[tuple[str, str], str] | None = None) -> DataFrame:
    """Aggregate measures of several facts by columns of dimensions.

    Each fact is aggregated at its own grain before the legs meet, so that a leg ships
    one row a group; a dimension that a fact does not reach is null in its leg. A
    dimension with several roles must have one named in ``via``.
    """
    read = lambda name: table(spark, folder, name)
    legs = []
    for fact, own in measures.items():
        plan = plan_composite([fact], list(by), registry, via)
        if plan.ambiguous:
            raise ValueError("; ".join(f"name the role of {d} for {f}: {', '.join(names)}" for (f, d), names in plan.ambiguous.items()))
        [leg] = plan.legs
        df = leg_rows(leg, by, read)
        group = []
        for dimension, columns in by.items():
            for c in columns:
                found = F.col(c) if dimension == fact else F.col(f"`{_tag(leg.ways[dimension], c)}`") if dimension in leg.ways else F.lit(None).cast(read(dimension).schema[c].dataType)
                group.append(found.alias(c))
        legs.append(df.groupBy(*group).agg(*[F.sum(make()).alias(m) for m, make in own.items()]))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs)
    return both.groupBy(*[c for columns in by.values() for c in columns]).agg(*[F.sum(m).cast("double").alias(m) for own in measures.values() for m in own])


def _cents(name: str) -> Callable[[], Column]:
    return lambda: F.col(name).cast("decimal(18,2)")


# Measures of a coarser table that a join to a finer one repeats.
_INFLATED = [("orders", "o_totalprice", "lineitem"), ("customer", "c_acctbal", "orders"), ("customer", "c_acctbal", "events"), ("supplier", "s_acctbal", "lineitem"), ("part", "p_retailprice", "lineitem"), ("documents", "n_chars", "labels")]


def inflation_sql(registry: Registry = DRIVER) -> str:
    """For each measure and finer table: its total alone, over the joined rows, and over the rows that join, once each."""
    parts = []
    for one, measure, many in _INFLATED:
        key = registry.between(one, many)[0]
        total = f"CAST(sum(CAST({measure} AS DECIMAL(18, 2))) AS DOUBLE)"
        naive = f"(SELECT {total} FROM {one} JOIN {many} ON {one}.{key.ref} = {many}.{key.column})"
        safe = f"(SELECT {total} FROM {one} WHERE {key.ref} IN (SELECT {key.column} FROM {many}))"
        parts.append(f"SELECT '{one}.{measure}' AS measure, '{many}' AS joined, (SELECT {total} FROM {one}) AS alone, {naive} AS naive, {safe} AS safe, {naive} <> {safe} AS inflated")
    return " UNION ALL ".join(parts)


def _inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(inflation_sql())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    order, event = {"orders": {"order_total": _cents("o_totalprice")}}, {"events": {"event_value": _cents("value")}}
    line = {"lineitem": {"quantity": _cents("l_quantity")}}
    return {
        "composite_orders_events_by_segment": lambda s, d: run_composite(s, d, order | event, {"customer": ["c_mktsegment"]}),
        "composite_lineitem_events_null_pad": lambda s, d: run_composite(s, d, line | event, {"customer": ["c_mktsegment"], "part": ["p_brand"]}),
        "composite_three_facts_by_region": lambda s, d: run_composite(s, d, order | event | line, {"region": ["r_name"]}, via={("lineitem", "region"): "l_suppkey"}),
        "composite_three_facts_by_customer_region": lambda s, d: run_composite(s, d, order | event | line, {"region": ["r_name"]}, via={("lineitem", "region"): "l_orderkey"}),
        "joined_path_revenue_by_region": lambda s, d: run_composite(s, d, {"lineitem": {"revenue": _cents("l_extendedprice")}}, {"region": ["r_name"]}, via={("lineitem", "region"): "l_suppkey"}),
        "fan_out_inflation_report": _inflation,
    }


def oracle_sql() -> dict[str, str]:
    cents = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18, 2))) AS DOUBLE)"
    region = "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    null = "CAST(NULL AS DOUBLE)"
    return {
        "composite_orders_events_by_segment": f"SELECT c_mktsegment, {cents('o')} AS order_total, {cents('e')} AS event_value FROM (SELECT c_mktsegment, o_totalprice AS o, {null} AS e FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_mktsegment, {null}, value FROM events JOIN customer ON user_id = c_custkey) t GROUP BY c_mktsegment",
        "composite_lineitem_events_null_pad": f"SELECT c_mktsegment, p_brand, {cents('q')} AS quantity, {cents('e')} AS event_value FROM (SELECT c_mktsegment, p_brand, l_quantity AS q, {null} AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey UNION ALL SELECT c_mktsegment, NULL, {null}, value FROM events JOIN customer ON user_id = c_custkey) t GROUP BY c_mktsegment, p_brand",
        "composite_three_facts_by_region": f"SELECT r_name, {cents('o')} AS order_total, {cents('e')} AS event_value, {cents('q')} AS quantity FROM (SELECT r_name, o_totalprice AS o, {null} AS e, {null} AS q FROM orders JOIN customer ON o_custkey = c_custkey {region} UNION ALL SELECT r_name, {null}, value, {null} FROM events JOIN customer ON user_id = c_custkey {region} UNION ALL SELECT r_name, {null}, {null}, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t GROUP BY r_name",
        "composite_three_facts_by_customer_region": f"SELECT r_name, {cents('o')} AS order_total, {cents('e')} AS event_value, {cents('q')} AS quantity FROM (SELECT r_name, o_totalprice AS o, {null} AS e, {null} AS q FROM orders JOIN customer ON o_custkey = c_custkey {region} UNION ALL SELECT r_name, {null}, value, {null} FROM events JOIN customer ON user_id = c_custkey {region} UNION ALL SELECT r_name, {null}, {null}, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {region}) t GROUP BY r_name",
        "joined_path_revenue_by_region": f"SELECT r_name, {cents('l_extendedprice')} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "fan_out_inflation_report": inflation_sql(),
    }
