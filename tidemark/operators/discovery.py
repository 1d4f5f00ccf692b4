"""Keys, inclusions and functional dependencies found in the data of any tables, with no list of names.

What cannot hold is ruled out first by cheap evidence that is never wrong about a refusal:
theta sketches (hashes kept of a column that another lacks) and duplicates or
contradictions inside a bounded sample, then inside whole classes picked by hash. Whatever
survives is checked over all rows, so nothing that holds is missed and nothing that does not
is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.catalog import _COLUMNS
from tidemark.session import checkpointed
from tidemark.sources.tables import TABLES, table

SAMPLE = 20_000  # rows of a table that candidates are tried on first, only ever to refute
SLICE = 100_000  # rows, about, whose classes are looked at next, a combination of columns; a smaller table is looked at whole
ENTRIES = 1 << 20  # hashes that meet in one group, about, and that a task gathers before it sends them
SUSPECTS = 1_000_000  # classes that are broadcast (24 bytes each); more are joined
BITS = 62  # columns in a mask
WHOLE, REAL, SIZED = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}, ("decimal",)


def comparable(df: DataFrame, name: str) -> tuple[str, Column]:
    """(class, value) of a column: values of a class can equal each other, and are of one type that sketches take."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
    if kind in WHOLE:
        return "integer", c.cast("long")
    if kind in REAL or kind.startswith(SIZED):
        return "number", c.cast("double")
    if kind.startswith("timestamp"):
        return "time", F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return "date", F.unix_date(c).cast("long")
    if kind == "boolean":
        return "boolean", c.cast("int").cast("long")
    if kind.startswith(("string", "varchar", "char")):
        return "text", c.cast("string")
    return kind, F.base64(c) if kind == "binary" else F.to_json(F.struct(c))


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def column_sketches(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, class, n_rows, n_filled, sketch) of every column, from one scan a table; sketches are merged from the tasks'."""
    parts = []
    for t, df in tables.items():
        known = {c: comparable(df, c) for c in df.columns}
        sums = df.select(*[v.alias(f"v{i}") for i, (_, v) in enumerate(known.values())]).agg(F.count("*").alias("n"), *[a for i in range(len(known)) for a in (F.count(f"v{i}").alias(f"c{i}"), F.theta_sketch_agg(f"v{i}").alias(f"s{i}"))])
        rows = [F.struct(F.lit(f"{t}.{c}").alias("name"), F.lit(k).alias("class"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_filled"), F.col(f"s{i}").alias("sketch")) for i, (c, (k, _)) in enumerate(known.items())]
        parts.append(sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return _stacked(parts)


def inclusion_candidates(sketches: DataFrame) -> DataFrame:
    """(child, parent, class): pairs of one class that the sketches do not refute; a pair that holds is always among them.

    Both sketches know all hashes of their column below the lesser of their thresholds. Where
    the child keeps one there that the parent lacks, the difference is not empty.
    """
    child = sketches.where("n_filled > 0").select("class", F.col("name").alias("child"), F.col("sketch").alias("a"))
    parent = sketches.where("n_filled > 0").select("class", F.col("name").alias("parent"), F.col("sketch").alias("b"))
    return child.join(parent, "class").where("child <> parent").where(F.theta_sketch_estimate(F.theta_difference("a", "b")) == 0).select("child", "parent", "class")


def inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every pair of columns of which one has all values of the other: child, parent, n_values, n_parent, parent_key.

    ``n_values`` and ``n_parent`` count distinct values; ``parent_key``: the parent has no
    null and no value twice, so that the child can refer to it. Nulls are no values; a
    column without values is in no pair. One shuffle by value for all columns of a class:
    each value meets once a task with a mask of the columns that have it, and only the
    counts of equal masks go on.
    """
    spark = next(iter(tables.values())).sparkSession
    sketches = checkpointed(column_sketches(tables))  # a row a column, read twice
    pairs = inclusion_candidates(sketches).collect()  # names of columns
    sizes = sketches.select(F.col("name").alias("parent"), "n_rows")
    found = []
    for kind in sorted({p["class"] for p in pairs}):
        names = sorted({n for p in pairs if p["class"] == kind for n in (p["child"], p["parent"])})
        masks = [f"m{k}" for k in range(-(-len(names) // BITS))]
        parts = []
        for t, df in tables.items():
            own = [(i, comparable(df, n.removeprefix(f"{t}."))[1]) for i, n in enumerate(names) if n.split(".", 1)[0] == t]
            if own:
                rows = [F.struct(v.alias("v"), *[F.lit(1 << i % BITS if i // BITS == k else 0).cast("long").alias(m) for k, m in enumerate(masks)]) for i, v in own]
                parts.append(df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("v IS NOT NULL"))
        shared = _stacked(parts).groupBy("v").agg(*[F.bit_or(m).alias(m) for m in masks]).groupBy(*masks).agg(F.count("*").alias("n"))
        holds = lambda i: F.col(masks[i // BITS]).bitwiseAND(F.lit(1 << i % BITS)) != 0
        have = F.filter(F.array(*[F.when(holds(i), F.lit(n)) for i, n in enumerate(names)]), lambda c: c.isNotNull())
        met = shared.select(have.alias("have"), "n").select(F.explode("have").alias("child"), "have", "n").select("child", F.explode("have").alias("parent"), "n").groupBy("child", "parent").agg(F.sum("n").alias("n"))
        own = met.where("child = parent").select("child", F.col("n").alias("n_values"))
        theirs = met.where("child = parent").select("parent", F.col("n").alias("n_parent"))
        found.append(met.where("child <> parent").join(own, "child").where("n = n_values").join(theirs, "parent").select("child", "parent", "n_values", "n_parent"))
    if not found:
        return spark.createDataFrame([], "child string, parent string, n_values long, n_parent long, parent_key boolean")
    return _stacked(found).join(sizes, "parent").select("child", "parent", "n_values", "n_parent", (F.col("n_parent") == F.col("n_rows")).alias("parent_key"))


@dataclass
class _Sampled:
    """A table with small codes of its sample's values, a column each; a null is a value like another."""

    name: str
    df: DataFrame
    columns: list[str]
    codes: np.ndarray

    def classes(self, columns: Iterable[int]) -> np.ndarray:
        """The number of each sampled row's class in the partition by some columns."""
        out = np.zeros(len(self.codes), np.int64)
        for c in columns:
            out = np.unique(out * (len(self.codes) + 1) + self.codes[:, c], return_inverse=True)[1]
        return out

    def hashes(self) -> DataFrame:
        """Two hashes of each column's values, a0 and b0 of the first, telling nulls apart."""
        return self.df.select(*[F.xxhash64(F.lit(seed), _plain(self.df, c), F.col(f"`{c}`").isNull()).alias(f"{k}{i}") for i, c in enumerate(self.columns) for seed, k in enumerate("ab")])


def _hash(x: tuple[int, ...], of: str = "a") -> str:
    """The hash of a combination of columns."""
    return f"xxhash64({', '.join(f'{of}{c}' for c in (x if of == 'a' else x[::-1])) or '0L'})"


def _name(x: tuple[int, ...]) -> str:
    return ",".join(map(str, x))


def _classes(t: _Sampled, tried: Mapping[tuple[int, ...], Iterable[int]], part: int) -> DataFrame:
    """(x, a, b, a0 ...): every row's class by 128 bits in each combination, of one class in ``part`` only, and the hashes of all columns tried."""
    each = [f"CASE WHEN pmod({_hash(x)}, {part}) = 0 THEN named_struct('x', '{_name(x)}', 'a', {_hash(x)}, 'b', {_hash(x, 'b')}) END" for x in tried]
    columns = [f"a{a}" for a in sorted({a for own in tried.values() for a in own})]
    return t.hashes().selectExpr(f"explode(array({', '.join(each)})) AS r", *columns).where("r IS NOT NULL").select("r.*", *columns)


def _judged(t: _Sampled, tried: Mapping[tuple[int, ...], Iterable[int]], rows: DataFrame) -> DataFrame:
    """(t, x, repeats, split): whether a class has several rows, and the columns of which it has several values, over all classes given."""
    columns = [c for c in rows.columns if c not in ("x", "a", "b")]
    split = rows.groupBy("x", "a", "b").agg(F.count("*").alias("n"), *[(F.min(c) != F.max(c)).alias(c) for c in columns])
    sums = split.groupBy("x").agg((F.max("n") > 1).alias("repeats"), *[F.bool_or(c).alias(c) for c in columns])
    return sums.select(F.lit(t.name).alias("t"), "x", "repeats", F.filter(F.array(*[F.when(F.col(c), F.lit(int(c[1:]))) for c in columns]).cast("array<int>"), lambda c: c.isNotNull()).alias("split"))


def _two(h: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """At most two entries of each class h, by rising h: its first ones, or its least and greatest g if they differ."""
    if not len(h):
        return h, g
    if g is None:
        h = np.sort(h)
        return h[np.r_[True, True, h[2:] != h[:-2]][: len(h)]], None
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    first = np.r_[True, h[1:] != h[:-1]]
    last = np.r_[first[1:], True]
    keep = first | last & (g != g[first][np.cumsum(first) - 1])
    return h[keep], g[keep]


def _packed(batches: Iterator[pa.RecordBatch], alone: list[bool], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """(x, bucket, data): a task's hashes of each combination as bytes, by range of hash; a class that the task has seen twice or in two values needs no more."""
    held: list[list[tuple]] = [[] for _ in alone]

    def sent() -> pa.RecordBatch:
        rows = []
        for x, parts in enumerate(held):
            h, g = _two(np.concatenate([p[0] for p in parts]), None if alone[x] else np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), None)
            ends = np.searchsorted(h, np.array([k * 2**64 // buckets - 2**63 for k in range(1, buckets)], np.int64))
            for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(h)])):
                if b > a:
                    rows.append((x, k, h[a:b].tobytes() + (b"" if g is None else g[a:b].tobytes())))
            parts.clear()
        columns = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["x", "bucket", "data"])

    n = 0
    for batch in batches:
        columns = iter(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for x, a in enumerate(alone):
            held[x].append((next(columns), None if a else next(columns)))
        n += batch.num_rows * len(alone)
        if n > most:
            yield sent()
            n = 0
    yield sent()


def _suspects(t: _Sampled, n: int, tried: Mapping[tuple[int, ...], Iterable[int]], alone: set[tuple[int, ...]]) -> DataFrame:
    """(t, x, h): the classes of 64 bits that have several rows, for combinations in ``alone``, or else several values of the columns tried.

    A row costs 8 bytes a combination in the shuffle, or 16 with a hash of its columns
    together. Every class that is split is among them; a chance collision may be too.
    """
    names = [_name(x) for x in tried]
    flags = [x in alone for x in tried]
    columns = [c for i, (x, own) in enumerate(tried.items()) for c in ([f"{_hash(x)} AS h{i}"] + ([] if x in alone else [f"{_hash(tuple(own))} AS g{i}"]))]
    buckets, most = -(-n // ENTRIES), 2 * ENTRIES

    def met(rows: pa.Table) -> pa.Table:
        x, hs, gs = rows.column("x")[0].as_py(), [], []
        for data in rows.column("data").to_pylist():
            own = np.frombuffer(data, np.int64)
            hs.append(own if flags[x] else own[: len(own) // 2])
            gs.append(own[len(hs[-1]) :])
        h, _ = _two(np.concatenate(hs), None if flags[x] else np.concatenate(gs))
        twice = h[1:][h[1:] == h[:-1]]
        return pa.table({"x": pa.array([names[x]] * len(twice), pa.string()), "h": pa.array(twice, pa.int64())})

    packed = t.hashes().selectExpr(*columns).mapInArrow(lambda b: _packed(b, flags, buckets, most), "x int, bucket int, data binary")
    return packed.groupBy("x", "bucket").applyInArrow(met, "x string, h long").select(F.lit(t.name).alias("t"), "x", "h")


def _checked(known: list[_Sampled], counts: Mapping[str, int], tried: Mapping[str, Mapping[tuple[int, ...], list[int]]]) -> dict[tuple[str, tuple[int, ...]], tuple[bool, set[int]]]:
    """For each table's combinations, over all rows: whether one repeats, and which of the columns tried it does not give.

    All tables in one job a step. First about ``SLICE`` rows a combination, as whole
    classes picked by hash, so that what fails often leaves; a table of fewer rows is done by it.
    What is left is told by packed hashes, and the classes that these suspect, few
    as they passed the first step, are looked at by 128 bits.
    """
    place = lambda x: tuple(map(int, filter(None, x.split(","))))
    by_name = {t.name: t for t in known}
    parts = {t: -(-counts[t] // SLICE) if any(own) else 1 for t, own in tried.items() if own}
    out = {(t, x): (False, set()) for t, own in tried.items() for x in own}

    def note(found: DataFrame) -> None:
        for r in found.collect():
            repeats, split = out[r["t"], place(r["x"])]
            out[r["t"], place(r["x"])] = repeats or r["repeats"], split | set(r["split"]) & set(tried[r["t"]][place(r["x"])])

    if parts:
        note(_stacked([_judged(by_name[t], tried[t], _classes(by_name[t], tried[t], max(p, 1))) for t, p in parts.items()]))
    left: dict[str, dict[tuple[int, ...], list[int]]] = {}
    for t, p in parts.items():
        # a combination that repeats and has no column left is settled
        own = {x: [a for a in columns if a not in out[t, x][1]] for x, columns in tried[t].items()}
        own = {x: columns for x, columns in own.items() if columns or not tried[t][x] and not out[t, x][0]}
        if p > 1 and own:
            left[t] = own
    if left:
        suspects = checkpointed(_stacked([_suspects(by_name[t], counts[t], own, {x for x in own if not out[t, x][0]}) for t, own in left.items()]))
        sizes = {(r["t"], place(r["x"])): r["count"] for r in suspects.groupBy("t", "x").count().collect()}
        checks = []
        for t, own in left.items():
            if own := {x: columns for x, columns in own.items() if (t, x) in sizes}:
                some = suspects.where(F.col("t") == t).select("x", F.col("h").alias("a"))
                checks.append(_judged(by_name[t], own, _classes(by_name[t], own, 1).join(F.broadcast(some) if sum(sizes.values()) <= SUSPECTS else some, ["x", "a"], "left_semi")))
        if checks:
            note(_stacked(checks))
    return out


def _plain(df: DataFrame, name: str) -> Column:
    """A column as hashes take it: zero of one sign, maps as text."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
    return F.to_json(F.struct(c)) if "map<" in kind else c + F.lit(0).cast(kind) if kind in REAL else c


def _sampled(tables: Mapping[str, DataFrame], rows: int) -> list[_Sampled]:
    out = []
    for name, df in tables.items():
        hashes = df.select(*[F.xxhash64(_plain(df, c), F.col(f"`{c}`").isNull()).alias(f"h{i}") for i, c in enumerate(df.columns)]).limit(rows).toPandas().to_numpy()
        codes = np.stack([np.unique(hashes[:, i], return_inverse=True)[1] for i in range(hashes.shape[1])], 1) if hashes.size else np.zeros((0, len(df.columns)), np.int64)
        out.append(_Sampled(name, df, df.columns, codes))
    return out


def keys(tables: Mapping[str, DataFrame], most: int = 3, sample: int = SAMPLE) -> DataFrame:
    """Minimal keys of up to ``most`` columns: table_name, key_columns (sorted, joined by ", "), n_rows.

    A key has no null and no combination twice; no part of it is a key. An empty table has
    none. Level by level: combinations that hold a smaller key, a column with nulls or a
    repetition inside the sample leave; the others of all tables are checked over all rows,
    first some of their classes, then all.
    """
    spark = next(iter(tables.values())).sparkSession
    known = _sampled(tables, sample)
    filled = _stacked([t.df.agg(F.count("*").alias("n"), F.array(*[F.count(F.col(f"`{c}`")) for c in t.columns]).alias("filled")).select(F.lit(t.name).alias("t"), "n", "filled") for t in known])
    counts = {r["t"]: r for r in filled.collect()}
    found: dict[str, list[tuple[int, ...]]] = {t.name: [] for t in known}
    for size in range(1, most + 1):
        tried: dict[str, dict[tuple[int, ...], list[int]]] = {}
        for t in known:
            full = [i for i, n in enumerate(counts[t.name]["filled"]) if n == counts[t.name]["n"] > 0]
            tried[t.name] = {x: [] for x in combinations(full, size) if not any(set(k) <= set(x) for k in found[t.name]) and t.classes(x).max(initial=0) + 1 == len(t.codes)}
        for (t, x), (repeats, _) in _checked(known, {t: r["n"] for t, r in counts.items()}, tried).items():
            if not repeats:
                found[t].append(x)
    rows = [(t.name, ", ".join(sorted(t.columns[i] for i in x)), counts[t.name]["n"]) for t in known for x in found[t.name]]
    return spark.createDataFrame(rows, "table_name string, key_columns string, n_rows long")


def dependencies(tables: Mapping[str, DataFrame], most: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Minimal functional dependencies with up to ``most`` columns on the left: table_name, determinant (sorted, joined by ", "), column_name.

    Rows that agree in the determinant agree in the column; null is a value that equals
    itself. No part of the determinant does as well; a constant column depends on the
    empty determinant, and in an empty table every column does. Partitions are refined level by
    level: a determinant of which one part gives another is not tried, nor a column that a
    part gives already, nor what two rows of the sample contradict. What is left is checked
    over all rows, first in some classes of the determinant's partition, then in all: a class is
    split when the least and greatest hash of the column differ in it.
    """
    spark = next(iter(tables.values())).sparkSession
    known = _sampled(tables, sample)
    counts = {r["t"]: r["n"] for r in _stacked([t.df.agg(F.count("*").alias("n")).select(F.lit(t.name).alias("t"), "n") for t in known]).collect()}
    found: dict[str, set[tuple[tuple[int, ...], int]]] = {t.name: set() for t in known}
    for size in range(most + 1):
        tried: dict[str, dict[tuple[int, ...], list[int]]] = {}
        for t in known:
            given = found[t.name]
            own = tried[t.name] = {}
            for x in combinations(range(len(t.columns)), size):
                parts = [p for k in range(size) for p in combinations(x, k)]
                if any((p, c) in given for p in parts for c in x):
                    continue
                classes = t.classes(x)
                first = np.zeros(classes.max(initial=-1) + 1, np.int64)
                first[classes[::-1]] = np.arange(len(classes))[::-1]
                open_ = [a for a in range(len(t.columns)) if a not in x and not any((p, a) in given for p in parts)]
                if left := [a for a in open_ if (t.codes[:, a] == t.codes[first[classes], a]).all()]:
                    own[x] = left
        for (t, x), (_, split) in _checked(known, counts, tried).items():
            found[t] |= {(x, a) for a in tried[t][x] if a not in split}
    rows = [(t.name, ", ".join(sorted(t.columns[i] for i in x)), t.columns[a]) for t in known for x, a in sorted(found[t.name])]
    return spark.createDataFrame(rows, "table_name string, determinant string, column_name string")


def _over_all(use: Callable[[Mapping[str, DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: use({t: table(spark, sf_dir, t) for t in TABLES})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"discovered_inclusions": _over_all(inclusions), "discovered_keys": _over_all(lambda t: keys(t, 2)), "functional_dependencies": _over_all(dependencies)}


def _sets_sql(most: int) -> str:
    """Rows of every table, and the distinct combinations of up to ``most`` of its columns."""
    rows = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n, list_filter([{', '.join(f'CASE WHEN count({c}) = count(*) THEN {c!r} END' for c in cs)}], lambda e: e IS NOT NULL) AS filled FROM {t}" for t, cs in _COLUMNS.items())
    sets = [f"SELECT '{t}' AS t, [{', '.join(map(repr, x))}] AS c, count(*) AS n FROM (SELECT DISTINCT {', '.join(x)} FROM {t}) q" for t, cs in _COLUMNS.items() for k in range(1, most + 1) for x in combinations(sorted(cs), k)]
    return f"rws AS ({rows}), sets AS ({' UNION ALL '.join(sets)} UNION ALL SELECT t, CAST([] AS VARCHAR[]), least(n, 1) FROM rws)"


def oracle_sql() -> dict[str, str]:
    kind = lambda c: f"CASE WHEN typeof({c}) IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'integer' WHEN typeof({c}) IN ('DOUBLE', 'FLOAT') THEN 'number' WHEN typeof({c}) LIKE 'TIMESTAMP%' THEN 'time' ELSE typeof({c}) END"
    values = " UNION ALL ".join(f"SELECT '{t}.{c}' AS name, {kind(c)} AS k, CAST({c} AS VARCHAR) AS v FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL) q" for t, cs in _COLUMNS.items() for c in cs)
    sizes = " UNION ALL ".join(f"SELECT '{t}.{c}' AS name, count(*) AS n FROM {t}" for t, cs in _COLUMNS.items() for c in cs)
    return {
        "discovered_inclusions": f"WITH v AS ({values}), s AS ({sizes}), d AS (SELECT name, count(*) AS n FROM v GROUP BY name), m AS (SELECT a.name AS child, b.name AS parent, count(*) AS n FROM v a JOIN v b ON a.k = b.k AND a.v = b.v AND a.name <> b.name GROUP BY a.name, b.name) SELECT child, parent, x.n AS n_values, y.n AS n_parent, y.n = s.n AS parent_key FROM m JOIN d x ON x.name = child JOIN d y ON y.name = parent JOIN s ON s.name = parent WHERE m.n = x.n",
        "discovered_keys": f"WITH {_sets_sql(2)}, k AS (SELECT t, c, n FROM sets JOIN rws USING (t, n) WHERE n > 0 AND len(c) > 0 AND list_has_all(filled, c)) SELECT t AS table_name, array_to_string(c, ', ') AS key_columns, n AS n_rows FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.t = a.t AND len(b.c) < len(a.c) AND list_has_all(a.c, b.c))",
        "functional_dependencies": f"WITH {_sets_sql(3)}, f AS (SELECT x.t AS t, x.c AS lhs, list_filter(y.c, lambda e: NOT list_contains(x.c, e))[1] AS rhs FROM sets x JOIN sets y ON x.t = y.t AND x.n = y.n AND len(y.c) = len(x.c) + 1 AND list_has_all(y.c, x.c)) SELECT t AS table_name, array_to_string(lhs, ', ') AS determinant, rhs AS column_name FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.t = a.t AND b.rhs = a.rhs AND len(b.lhs) < len(a.lhs) AND list_has_all(a.lhs, b.lhs))",
    }
