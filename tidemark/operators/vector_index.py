"""A vector index: k-means cells with inverted lists, kept as a table, searched by nearest cells or exactly."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed, shared_folder
from tidemark.sources.tables import table

TRIED = 300  # rows on which the number of cells to visit is measured
SAMPLE_A_CELL = 64  # rows that the cells are fitted on, for each cell at most
BLOCK, QUERIES = 5_000, 1_000  # rows of a cell, and queries, that one task compares at once
ROUNDS = 12
HELD = 1 << 22  # numbers of one array that a task holds while it looks for cells


@dataclass(frozen=True)
class VectorIndex:
    """Cells' centres, their radii and sizes, and the folder of the lists: ``lists``, with id, vector and cell."""

    folder: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    id: str
    kind: str
    probes: int = 8  # cells that a search visits unless told otherwise

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"`{self.id}` {self.kind}, v array<double>, salt long, cell int").parquet(f"{self.folder}/lists")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches so small that ``size`` numbers for each of their rows are not too many."""
    step = max(HELD // max(size, 1), 1)
    for batch in batches:
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds from distinct rows that are spread in it; a cell that loses its rows goes."""
    start = np.unique(sample, axis=0)
    centres = start[np.linspace(0, len(start) - 1, min(cells, len(start))).astype(int)]
    for _ in range(ROUNDS):
        near = _gaps(sample, centres).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _usable(vectors: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return vectors.select(F.col(id), v.alias("v")).where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def build_index(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cells: int | None = None, folder: str | None = None, recall: float = 0.95) -> VectorIndex:
    """Index every row; ``cells`` defaults to the square root of their number, in 1 to 4096.

    The cells are fitted on at most ``SAMPLE_A_CELL`` rows for each, those of the least hashes
    of id and vector; all rows are then assigned to their nearest cell and written once,
    a file a task in order of cells, with a random number each by which a search deals a large cell to several
    tasks, so that no cell, however many rows or copies it has, meets in one. Rows whose vector is null, of another length than
    most, or holds null or non-finite entries are left out. Centres travel in the tasks:
    cells * dimension doubles. How many cells a search visits is measured: enough that
    ``recall`` of the ten nearest others of at most ``TRIED`` indexed rows lie in them.
    """
    spark = vectors.sparkSession
    common = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim, kind = common["d"] if common else 0, vectors.schema[id].dataType.simpleString()
    rows = _usable(vectors, id, vector, dim)
    total = rows.count()
    cells = cells or min(max(int(total**0.5), 1), 4096)
    folder = folder or f"{shared_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    take = min(1.0, cells * SAMPLE_A_CELL / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64(id, "v"), F.lit(1 << 20)) < take * (1 << 20)).select("v").toArrow().column("v").combine_chunks()
    points = _matrix(sample, dim) if len(sample) else np.zeros((0, dim))
    if not len(points) and total:
        points = np.array([rows.first()["v"]])
    centres = _cells(points, cells) if len(points) else np.zeros((0, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, len(centres)):
            if batch.num_rows:
                gaps = _gaps(_matrix(batch.column(1), dim), centres)
                near = gaps.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(np.sqrt(gaps[np.arange(len(near)), near]))], ["id", "v", "cell", "gap"])

    assigned = rows.mapInArrow(assign, f"id {kind}, v array<double>, cell int, gap double")
    salted = assigned.select(F.col("id").alias(id), "v", "gap", F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "cell")
    salted.sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/lists")
    known = {r["cell"]: r for r in spark.read.parquet(f"{folder}/lists").groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()} if total else {}
    at = lambda name: np.array([float(known[c][name]) if c in known else 0.0 for c in range(len(centres))])
    index = VectorIndex(folder, centres, at("radius"), at("n").astype(int), id, kind)
    return replace(index, probes=_measured_probes(spark, index, recall)) if total else index


def _measured_probes(spark: SparkSession, index: VectorIndex, recall: float) -> int:
    """The least number of nearest cells that hold ``recall`` of the true neighbours of some indexed rows."""
    share = min(1.0, TRIED / index.sizes.sum())
    tried = index.lists(spark).where(F.pmod("salt", F.lit(1 << 20)) < share * (1 << 20)).select(index.id, "v")
    found = _ranked(index, tried, 11, 8, True, index.id, "v").where("rank > 1").select("q", "cell").toPandas()
    if not len(found):
        return 1
    order = np.argsort(np.where(index.sizes > 0, _gaps(np.stack(found.q.to_numpy()), index.centres), np.inf), 1, kind="stable")
    place = (order == found.cell.to_numpy()[:, None]).argmax(1)
    return int(np.quantile(place, recall, method="higher")) + 1


def _compare(k: int, dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest of some vectors for each of some queries; equal distances go by id."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows, ids, gaps, cells = [], [], [], []
        if vectors.num_rows and queries.num_rows:
            v, q = _matrix(vectors.column("v").combine_chunks(), dim), _matrix(queries.column("q").combine_chunks(), dim)
            cell = vectors.column("cell")[0].as_py()
            names, own = vectors.column("id").to_pylist(), queries.column("row").to_pylist()
            rough = _gaps(q, v)
            kth = np.partition(rough, min(k, len(v)) - 1, 1)[:, min(k, len(v)) - 1]
            slack = 1e-9 * (1 + (q * q).sum(1) + (v * v).sum(1).max())
            for i in range(len(q)):  # the products round: whatever may be among the k is measured again
                near = np.flatnonzero(rough[i] <= kth[i] + slack[i])
                exact = ((v[near] - q[i]) ** 2).sum(1)
                best = sorted(zip(exact.tolist(), map(names.__getitem__, near)), key=lambda x: (x[0], x[1] is None, x[1]))[:k]
                rows += [own[i]] * len(best)
                gaps += [g for g, _ in best]
                ids += [n for _, n in best]
                cells += [cell] * len(best)
        return pa.table({"row": pa.array(rows, pa.int64()), "id": pa.array(ids, vectors.schema.field("id").type), "gap": pa.array(gaps, pa.float64()), "cell": pa.array(cells, pa.int32())})

    return run


def _searched(index: VectorIndex, pairs: DataFrame, k: int) -> DataFrame:
    """(row, id, gap, cell): for pairs (row, q, cell) the nearest of each block of each cell."""
    spark = pairs.sparkSession
    asked = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}
    parts = [(c, -(-int(index.sizes[c]) // BLOCK), -(-n // QUERIES)) for c, n in asked.items()]
    sized = F.broadcast(spark.createDataFrame(parts, "cell int, blocks int, chunks int"))  # a row a cell
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = index.lists(spark).join(sized, "cell").select("cell", F.pmod("salt", F.col("blocks")).cast("int").alias("block"), each("chunks").alias("chunk"), F.col(index.id).alias("id"), "v")
    queries = pairs.join(sized, "cell").select("cell", each("blocks").alias("block"), F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("chunk"), "row", "q")
    keys = ["cell", "block", "chunk"]
    return vectors.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(_compare(k, index.centres.shape[1]), f"row long, id {index.kind}, gap double, cell int")


def nearest(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest indexed vectors of every query: query_id, id, score = 1 / (1 + squared distance), rank from 1.

    A query goes to its ``probes`` nearest cells, by default as many as the index measured.
    ``exact`` then visits every other cell that its centre and radius do not rule out by the
    k-th distance found so far, so that no nearer vector is missed. Equal distances go by
    id. Queries meet each block of a cell in parts of about ``QUERIES``; only each part's k best
    go on. A query row that is null, of another length or not finite has no result; one
    that is repeated has its results each time.
    """
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema[id].dataType.simpleString()}, id {index.kind}, score double, rank int")
    return _ranked(index, queries, k, probes or index.probes, exact, id, vector).select("query_id", "id", (1 / (1 + F.col("gap"))).alias("score"), "rank")


def _ranked(index: VectorIndex, queries: DataFrame, k: int, probes: int, exact: bool, id: str, vector: str) -> DataFrame:
    """(query_id, q, id, gap, cell, rank): the k nearest vectors of every query with their squared distances and cells."""
    dim = index.centres.shape[1]
    centres, radii, filled = index.centres, index.radii, index.sizes > 0
    asked = checkpointed(_usable(queries, id, vector, dim).select(F.col(id).alias("query_id"), F.col("v").alias("q"), F.monotonically_increasing_id().alias("row")))
    tasks = max(-(-asked.count() * centres.size // (2 * HELD)), 1)
    dealt = lambda rows: rows.repartition(tasks, "row")  # by what the queries become with their cells: alone they are small and would share a task

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each query: its nearest ones, or, where a bound came with it, the others within the bound."""
        for batch in _pieces(batches, len(centres) * dim):  # a query goes out with each of its cells
            if not batch.num_rows:
                continue
            gaps = np.where(filled, _gaps(_matrix(batch.column(1), dim), centres), np.inf)
            near = np.zeros(gaps.shape, bool)
            np.put_along_axis(near, np.argsort(gaps, 1, kind="stable")[:, :probes], True, 1)
            if batch.num_columns == 3:
                bound = np.sqrt(batch.column(2).to_numpy(zero_copy_only=False))[:, None] + 1e-6
                near = ~near & (np.sqrt(gaps) - radii <= bound)
            at, cell = np.nonzero(near & filled)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cell.astype(np.int32))], ["row", "q", "cell"])

    kinds = "row long, q array<double>, cell int"
    best = Window.partitionBy("row").orderBy("gap", F.col("id").asc_nulls_last())
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = top(_searched(index, dealt(asked.select("row", "q")).mapInArrow(probe, kinds), k))
    if exact:
        found = checkpointed(found)
        bounds = found.groupBy("row").agg(F.when(F.count("*") == k, F.max("gap")).otherwise(float("inf")).alias("bound"))
        others = dealt(asked.join(bounds, "row").select("row", "q", "bound")).mapInArrow(probe, kinds)
        found = top(found.drop("rank").unionByName(_searched(index, others, k)))
    return found.join(asked, "row").select("query_id", "q", "id", "gap", "cell", "rank")


def _search(exact: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Every vector whose id is divisible by 50 against all of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings")
        index = build_index(rows)
        found = nearest(index, rows.where("vec_id % 50 = 0"), 10, None, exact)
        return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), "rank")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"index_nearest_exact": _search(True), "index_nearest_probed": _search(False)}


def oracle_sql() -> dict[str, str]:
    gap = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return {"index_nearest_exact": f"SELECT query_id, vec_id, round(1 / (1 + gap), 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {gap} AS gap, row_number() OVER (PARTITION BY a.vec_id ORDER BY {gap}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) q WHERE rank <= 10"}
