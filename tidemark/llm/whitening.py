"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, written

SCALE, SHIFT = 64, 1_000_000  # x = floor(64 * entry) + 1000000
LARGEST = 2**40  # rows with an entry whose |x - 1000000| reaches this are left out, so that sums fit 38 digits


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: the fit list's size and sums, and the components with their eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # a unit vector a row
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower triangular factor and an order with ``matrix[order][:, order] = factor @ factor.T``; as many columns as the rank."""
    a, d = matrix.copy(), len(matrix)
    order, factor = np.arange(d), np.zeros((d, d), a.dtype)
    least = d * np.finfo(a.dtype).eps * max(a.diagonal().max(), 0.0) if d else 0.0
    for k in range(d):
        left = a.diagonal()[k:]
        p = k + int(np.argmax(left))
        if a[p, p] <= least:
            return factor[:, :k], order
        for rows in (a, factor):
            rows[[k, p]] = rows[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _tournament(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which every two of n (even) players meet once."""
    ring, rounds = list(range(1, n)), []
    for _ in range(n - 1):
        row = [0, *ring]
        rounds.append((np.array(row[: n // 2]), np.array(row[: n // 2 - 1 : -1])))
        ring = ring[1:] + ring[:1]
    return rounds


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns rotated, disjoint pairs at once, until all are orthogonal to each other."""
    u = np.hstack([factor, np.zeros((len(factor), factor.shape[1] % 2), factor.dtype)])
    if u.shape[1] < 2:
        return factor
    eps, rounds = np.finfo(u.dtype).eps, _tournament(u.shape[1])
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            x, y = u[:, p], u[:, q]
            a, b, g = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            do = np.abs(g) > 4 * eps * np.sqrt(a * b)
            if not do.any():
                continue
            turned = True
            tau = (b - a)[do] / (2 * g[do])
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau))
            c = 1 / np.sqrt(1 + t * t)
            x, y, p, q = x[:, do], y[:, do], p[do], q[do]
            u[:, p], u[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return u[:, : factor.shape[1]]


def principal_components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter matrix, falling, and its unit eigenvectors as rows; only those of its numerical rank.

    A matrix of wide floats is worked in them, so that small components keep their digits beside large ones.
    """
    factor, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    rank = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(rank), len(scatter)))
    vectors[:, order] = (turned[:, rank] / norms[rank]).T
    return (norms[rank] ** 2).astype(float), vectors


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that count, and their x - 1000000 as rows."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * values)
        good = (np.abs(scaled) < LARGEST).all(1)  # never true of null or non-finite entries
    return at[good], scaled[good].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each distinct row once, in the fewest bytes an entry that hold it: 2, 4 or 8."""
    top = np.abs(x).max(1) if x.size else np.zeros(0)
    out: dict[bytes, None] = {}
    for low, high, kind in ((0, 2**15, "<i2"), (2**15, 2**31, "<i4"), (2**31, LARGEST, "<i8")):
        rows = x[(top >= low) & (top < high)].astype(kind)
        raw, width = rows.tobytes(), rows.shape[1] * rows.itemsize
        out.update(dict.fromkeys(raw[k : k + width] for k in range(0, len(raw), width)))
    return list(out)


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), dim), np.int64)
    for k, one in enumerate(raw):
        out[k] = np.frombuffer(one, f"<i{len(one) // dim}")
    return out


def _products(m: np.ndarray) -> np.ndarray:
    """``m.T @ m``, exact."""
    top = int(np.abs(m).max(initial=0))
    if top * top * len(m) < 2**53:
        m = m.astype(float)
        return (m.T @ m).astype(np.int64).astype(object)
    return m.astype(object).T @ m.astype(object)


def _distinct(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _packed(usable(batch.column(0), dim)[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["x"])


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Per task: the number of rows under -1, then each dimension's sum of x - 1000000."""
    n, total = 0, np.zeros(dim, object)
    for batch in batches:
        x = _unpacked(batch.column(0), dim)
        n, total = n + len(x), total + x.sum(0).astype(object)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dim)], pa.int32()), pa.array([Decimal(n), *map(Decimal, total.tolist())], pa.decimal128(38, 0))], ["i", "v"])


def _scatter(batches: Iterator[pa.RecordBatch], dim: int, centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per task: the upper triangle of the products of x less the whole part of its mean, exact."""
    total = np.zeros((dim, dim), object)
    for batch in batches:
        total = total + _products(_unpacked(batch.column(0), dim) - centre)
    i, j = np.triu_indices(dim)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "v"])


def _moments(batches: Iterator[pa.RecordBatch], dim: int, centre: np.ndarray, rest: np.ndarray, scaled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per task: sums (under j = -1) and products of whitened rows."""
    k = len(scaled)
    first, second = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        w = (_unpacked(batch.column(0), dim) - centre - rest) @ scaled.T
        first, second = first + w.sum(0), second + w.T @ w
    i, j = np.indices((k, k))
    yield pa.RecordBatch.from_arrays([pa.array([*range(k), *i.ravel()], pa.int32()), pa.array([-1] * k + j.ravel().tolist(), pa.int32()), pa.array([*first, *second.ravel()], pa.float64())], ["i", "j", "v"])


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The whole part of each mean of x - 1000000, and the rest, in 0 to 1."""
    whole = [(s - n * SHIFT) // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * SHIFT - n * w) / n for s, w in zip(sums, whole)])


def fit_whitening(vectors: DataFrame, column: str = "embedding", dim: int | None = None, components: int = 16) -> Whitening | None:
    """Fit on each distinct x vector once; None if no row counts.

    A row counts if its vector has ``dim`` entries (the commonest length, of several the
    greatest, when not given), none of them null, non-finite or of a size near 2**34. The
    distinct vectors meet by Spark's aggregation, packed to two bytes an entry where they
    fit, equal ones of a batch once. Sums and the products of centred vectors are whole
    numbers added exactly, so every run gives the same components. Only sums of a
    dimension or a pair of dimensions reach the driver. At most ``components`` are kept,
    none with an eigenvalue that is zero to double precision.
    """
    chosen = vectors.select(F.col(column).alias("v"))
    if dim is None:
        common = chosen.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = common["d"] if common else 0
    if not dim:
        return None
    fit = written(chosen.mapInArrow(partial(_distinct, dim=dim), "x binary").distinct())
    added = {r["i"]: int(r["v"]) for r in fit.mapInArrow(partial(_sums, dim=dim), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    n = added.get(-1, 0)
    if not n:
        discard(fit)
        return None
    sums = tuple(added[i] + n * SHIFT for i in range(dim))
    centre, rest = _centre(n, sums)
    scatter = np.zeros((dim, dim), object)
    for r in fit.mapInArrow(partial(_scatter, dim=dim, centre=centre), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = int(r["v"])
    over = np.array([s - n * SHIFT - n * int(c) for s, c in zip(sums, centre)], object)  # n times what the centre leaves of the mean
    scatter = (n * scatter - np.outer(over, over)).astype(np.longdouble) / n
    values, found = principal_components(scatter)
    values, found = values[:components] / n, found[:components]
    scaled = found / np.sqrt(values)[:, None]
    first, second = np.zeros(len(values)), np.zeros((len(values), len(values)))
    for r in fit.mapInArrow(partial(_moments, dim=dim, centre=centre, rest=rest, scaled=scaled), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["j"] < 0:
            first[r["i"]] = r["v"] / n
        else:
            second[r["i"], r["j"]] = r["v"] / n
    error = np.abs(second - np.outer(first, first) - np.eye(len(values))).max(initial=0.0)
    discard(fit)
    return Whitening(n, sums, found, values, float(scatter.trace() / n), float(error))


def _deviation(m: np.ndarray, n: int, left: np.ndarray) -> list[int | None]:
    """Per row the sum of (n * x - S)**2, exact; None beyond a long."""
    top = (int(np.abs(m).max(initial=0)) + 1) * n
    y = m * n - left if top < 2**62 else m.astype(object) * n - left.astype(object)
    if top * top * m.shape[1] >= 2**63:
        y = y.astype(object)
    return [v if v < 2**63 else None for v in map(int, (y * y).sum(1))]


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    dim, scaled = len(model.sums), model.components / np.sqrt(model.eigenvalues)[:, None]
    centre, rest = _centre(model.n, model.sums)
    left = np.array([s - model.n * SHIFT - model.n * int(c) for s, c in zip(model.sums, centre)], np.int64)
    for batch in batches:
        at, x = usable(batch.column(1), dim)
        m = x - centre
        w = (m - rest) @ scaled.T
        offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(_deviation(m, model.n, left), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["id", "deviation", "whitened"])


def whiten(vectors: DataFrame, model: Whitening, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Every row whose vector counts: its id, its exact ``deviation`` and the array of its ``whitened`` components.

    Ids may be null or repeat; a row is given for each. ``deviation`` is null where it is beyond a long.
    """
    chosen = vectors.select(F.col(id).alias("id"), F.col(column).alias("v"))
    return chosen.mapInArrow(partial(_whitened, model=model), f"id {chosen.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>").withColumnRenamed("id", id)


def whitened_components(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = 16) -> DataFrame:
    """A row for each vector that counts and each component: ``id``, component, n, deviation, whitened, explained, identity_error.

    Nothing is returned where no vector counts, or where all are the same, as there is no
    component then. Other columns are not read, whatever their names.
    """
    model = fit_whitening(vectors, column, None, components)
    kind = vectors.schema[id].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    rows = whiten(vectors, model, id, column).select(id, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(id, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", (F.get(explained, F.col("at")) if len(model.eigenvalues) else F.lit(0.0)).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
