"""Shapes for charts whose order is not that of the values: quarters, weekdays, hours, months; heat maps; titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

# Names in calendar order.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def quarter_rank(label: Column) -> Column:
    """``Q1 2024``, ``Q1-2024``, ``Q1/2024`` or ``2024 Q1`` (with the same separators) as year * 4 + quarter; else null."""
    front = F.regexp_extract(label, r"^\s*[Qq]([1-4])[\s/-]*(\d{4})\s*$", 1), F.regexp_extract(label, r"^\s*[Qq]([1-4])[\s/-]*(\d{4})\s*$", 2)
    back = F.regexp_extract(label, r"^\s*(\d{4})[\s/-]*[Qq]([1-4])\s*$", 2), F.regexp_extract(label, r"^\s*(\d{4})[\s/-]*[Qq]([1-4])\s*$", 1)
    rank = lambda q, y: F.when(q != "", F.try_to_number(y, F.lit("9999")).cast("int") * 4 + F.try_to_number(q, F.lit("9")).cast("int"))
    return F.coalesce(rank(*front), rank(*back))


def name_rank(label: Column, names: list[str]) -> Column:
    """The place of a full or three-letter name in a list; else null."""
    low = F.lower(F.trim(label))
    at = F.array_position(F.array(*map(F.lit, names)), low)
    short = F.array_position(F.array(*[F.lit(n[:3]) for n in names]), low)
    return F.nullif(F.greatest(at, short), F.lit(0))


def hour_rank(label: Column) -> Column:
    """``12AM`` to ``11 PM``, with minutes or without, as minutes of the day; else null."""
    part = lambda i: F.regexp_extract(F.upper(F.trim(label)), r"^(1[0-2]|0?[1-9])(?::([0-5]\d))?\s*([AP])M$", i)
    return F.when(part(1) != "", (part(1).cast("int") % 12 + F.when(part(3) == "P", 12).otherwise(0)) * 60 + F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(0)))


def ordered_sum(df: DataFrame, x: str, y: Column) -> DataFrame:
    """Bars in calendar order if every label fits one calendar kind, else by falling sum; ``place`` is 1, 2, ...

    The labels are few; ranks are computed after the sum.
    """
    bars = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.sum(y).alias("y"))
    kinds = {"q": quarter_rank(F.col("x")), "w": name_rank(F.col("x"), WEEKDAYS), "h": hour_rank(F.col("x")), "m": name_rank(F.col("x"), MONTHS)}
    bars = bars.select("x", "y", *[r.cast("int").alias(k) for k, r in kinds.items()])
    fits = bars.agg(*[(F.count(k) == F.count("*")).alias(f"all_{k}") for k in kinds])
    both = bars.join(F.broadcast(fits))
    order = F.coalesce(*[F.when(F.col(f"all_{k}"), F.col(k)) for k in kinds])
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(order.asc_nulls_last(), F.desc("y"), "x"))
    return both.select("x", F.col("y").cast("double").alias("y"), place.alias("place"))


def month_ordered(df: DataFrame, x: str, y: Column) -> DataFrame:
    """Points of a line in order of months as soon as one label is a month, labels of no month last; else in order of labels.

    A point a label; Spark sorts them by range, so no task holds all labels.
    """
    points = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias("x")).agg(F.sum(y).cast("double").alias("y"))
    ranked = points.withColumn("month", name_rank(F.col("x"), MONTHS).cast("int"))
    return ranked.orderBy(F.col("month").asc_nulls_last(), "x")


def is_time_axis(df: DataFrame, x: str, probes: int = 10) -> bool:
    """Whether a column is one of times: by its type, or when any of its first non-null values reads as a date or a time."""
    kind = df.schema[x].dataType.simpleString()
    if kind == "date" or kind.startswith("timestamp"):
        return True
    if kind != "string":
        return False
    read = F.coalesce(*[F.try_to_timestamp(F.col(x), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss")], F.try_to_timestamp(F.col(x)))
    return not df.where(F.col(x).isNotNull()).select(x).limit(probes).where(read.isNotNull()).isEmpty()


def axis(values: list) -> dict:
    """Label settings: slanted when there are over 8 labels or one has over 10 characters."""
    long = len(values) > 8 or any(len(str(v)) > 10 for v in values)
    return {"rotation": 45 if long else 0, "labels": [str(v) for v in values]}


def measure_axes(names: list[str]) -> dict[str, int]:
    """The axis of each measure: shares go to the second."""
    return {n: 2 if n.lower().endswith(("_pct", "_percent", "_percentage")) else 1 for n in names}


def _cents(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    orders = lambda s, d: table(s, d, "orders")
    return {
        "chart_quarter_order": lambda s, d: ordered_sum(orders(s, d).withColumn("q", F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate"))), "q", _cents("o_totalprice")),
        "chart_weekday_order": lambda s, d: ordered_sum(table(s, d, "events").withColumn("w", F.date_format("ts", "EEEE")), "w", _cents("value")),
        "chart_month_order": lambda s, d: ordered_sum(orders(s, d).withColumn("m", F.date_format("o_orderdate", "MMM")), "m", _cents("o_totalprice")),
        "chart_month_line": lambda s, d: month_ordered(orders(s, d).withColumn("m", F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.date_format("o_orderdate", "MMMM"))), "m", _cents("o_totalprice")),
        "chart_value_order": lambda s, d: ordered_sum(table(s, d, "events"), "event_type", _cents("value")),
    }


def oracle_sql() -> dict[str, str]:
    def text(label: str, value: str, source: str, order: str) -> str:
        return f"SELECT x, CAST(y AS DOUBLE) AS y, CAST(row_number() OVER (ORDER BY {order}, y DESC, x) AS INT) AS place FROM (SELECT {label} AS x, min(k) AS k, sum(CAST({value} AS DECIMAL(18, 2))) AS y FROM (SELECT *, {source[1]} AS k FROM {source[0]}) t GROUP BY {label}) u"

    return {
        "chart_quarter_order": text("'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)", "o_totalprice", ("orders", "year(o_orderdate) * 4 + quarter(o_orderdate)"), "k"),
        "chart_weekday_order": text("dayname(ts)", "value", ("events", "isodow(ts)"), "k"),
        "chart_month_order": text("left(monthname(o_orderdate), 3)", "o_totalprice", ("orders", "month(o_orderdate)"), "k"),
        "chart_month_line": "SELECT x, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS y, min(k) AS month FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE monthname(o_orderdate) END AS x, CASE WHEN o_orderstatus <> 'P' THEN CAST(month(o_orderdate) AS INT) END AS k FROM orders) t GROUP BY x",
        "chart_value_order": text("event_type", "value", ("events", "1"), "k"),
    }
