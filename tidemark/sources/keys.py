"""The constraint registry: primary and foreign keys, which Parquet and Spark's catalog lack, and their verification."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder
from tidemark.sources.tables import register


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    ref: str
    unique: bool = False  # the child's column is unique: one to one


@dataclass
class Registry:
    """Primary keys by table and foreign keys; names are matched without regard to case."""

    primary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: list[ForeignKey] = field(default_factory=list)

    def edges(self) -> list[tuple[str, str]]:
        return sorted({(f.child, f.parent) for f in self.foreign})

    def between(self, a: str, b: str) -> list[ForeignKey]:
        """Keys that join two tables, in either direction."""
        return [f for f in self.foreign if {f.child, f.parent} == {a.lower(), b.lower()}]

    def many_side(self, one: str, many: str) -> bool:
        """Whether a row of ``one`` can have several of ``many``."""
        return any(f.child == many.lower() and f.parent == one.lower() and not f.unique for f in self.foreign)

    def disjoint(self) -> list[tuple[str, str]]:
        """Siblings: tables with keys to a common parent and none between them."""
        direct = {frozenset(e) for e in self.edges()}
        found = {tuple(sorted((a.child, b.child))) for a in self.foreign for b in self.foreign if a.parent == b.parent and a.child < b.child}
        return sorted(p for p in found if frozenset(p) not in direct)


DRIVER = Registry(
    primary={
        "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
        "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "embeddings": ("vec_id",),
        "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"),
    },
    foreign=[
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"), ForeignKey("events", "user_id", "customer", "c_custkey"),
        ForeignKey("labels", "doc_id", "documents", "doc_id", unique=True),
    ],
)


def integrity_sql(registry: Registry = DRIVER) -> str:
    """A row per foreign key: rows, rows without a parent, and whether the child's column is unique."""
    parts = [
        f"SELECT '{f.child}' AS src, '{f.column}' AS col, '{f.parent}' AS dst, '{f.ref}' AS ref_col, count(*) AS n, count(*) - count(p.{f.ref}) AS orphans, count(DISTINCT c.{f.column}) = count(c.{f.column}) AS one_to_one FROM {f.child} c LEFT JOIN {f.parent} p ON c.{f.column} = p.{f.ref}"
        for f in registry.foreign
    ]
    return " UNION ALL ".join(parts)


def uniqueness_sql(registry: Registry = DRIVER) -> str:
    """A row per declared primary key: rows, distinct keys and nulls."""
    parts = []
    for name, keys in registry.primary.items():
        null = " OR ".join(f"{k} IS NULL" for k in keys)
        parts.append(f"SELECT '{name}' AS name, '{', '.join(keys)}' AS key_columns, count(*) AS n, count(DISTINCT {keys[0] if len(keys) == 1 else 'struct(' + ', '.join(keys) + ')'}) AS n_distinct, count(CASE WHEN {null} THEN 1 END) AS n_null FROM {name}")
    return " UNION ALL ".join(parts)


def verified_edges(spark: SparkSession, folder: str, registry: Registry = DRIVER) -> DataFrame:
    """The foreign keys that hold in the data, as edges from the finer to the coarser table; every key is kept."""
    register(spark, folder, tuple({t for f in registry.foreign for t in (f.child, f.parent)}))
    return spark.sql(f"SELECT src, col, dst, ref_col, n, one_to_one FROM ({integrity_sql(registry)}) WHERE orphans = 0")


def kept_edges(spark: SparkSession, folder: str, registry: Registry = DRIVER) -> DataFrame:
    """The verified edges, checked once a state of the files and then read from the shared folder.

    The state is the keys, and the path, length and time of every file; listing them reads no
    content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    state = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    name = hashlib.sha256(repr((sorted(map(repr, registry.foreign)), state["n"], state["h"])).encode()).hexdigest()[:24]
    place = f"{shared_folder(spark)}/edges-{name}"
    try:
        spark.read.text(f"{place}/_SUCCESS").schema
    except AnalysisException:
        # written aside and published by one rename, as another session may verify the same keys; the first one's stays
        draft, path = f"{place}-{uuid.uuid4().hex}", spark._jvm.org.apache.hadoop.fs.Path
        verified_edges(spark, folder, registry).write.parquet(draft)
        files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path(place)) or not files.rename(path(draft), path(place)):
            place = draft
    return spark.read.schema("src string, col string, dst string, ref_col string, n bigint, one_to_one boolean").parquet(place)
