"""Whitening of flow feature vectors: exact covariances by polarisation, then eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import id_type
from .vectors import finite_vector, matrices

STEPS = 64  # fixed-point steps to one unit of a feature
SHIFT = 1_000_000
RANGE = 1 << 40  # steps from zero within which an entry can be held
DIGITS = 10**38
NO_VARIANCE = 1e-12  # eigenvalues up to this share of the trace have no direction to scale


@dataclass(frozen=True)
class Whitener:
    """Fitted on ``n`` fixed-point vectors: their exact sums, and unit eigenvectors by falling eigenvalue.

    ``centre`` is each dimension's mean rounded to a whole number and ``rest`` what the n vectors sum to
    beside it, so that n * x - S = n * (x - centre) - rest, without large numbers that cancel.
    """

    steps: int
    shift: int
    n: int
    centre: tuple[int, ...]
    rest: tuple[int, ...]
    values: tuple[float, ...]
    vectors: np.ndarray
    trace: float

    def centred(self, entries: np.ndarray) -> np.ndarray:
        return fixed_point(entries, self.steps, self.shift) - np.array(self.centre, np.int64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred - np.array([r / self.n for r in self.rest])) @ self.vectors / np.sqrt(self.values)

    def deviations(self, centred: np.ndarray) -> list[Decimal | None]:
        """For each row the sum of (n * x - S)**2 over the dimensions, exact; None beyond 38 digits."""
        most = max(self.n * int(np.abs(centred).max(initial=0)) + max(map(abs, self.rest)), 1)
        kind = np.int64 if most * most * len(self.rest) < 1 << 62 else object
        apart = centred.astype(kind) * self.n - np.array(self.rest, kind)
        return [Decimal(v) if v < DIGITS else None for v in map(int, (apart * apart).sum(axis=1))]


def fixed_point(entries: np.ndarray, steps: int, shift: int) -> np.ndarray:
    return np.floor(entries * steps).astype(np.int64) + shift


def vectors_of(flows: DataFrame, id_col: str, vector_col: str, steps: int) -> DataFrame:
    rows = flows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    return rows.filter(finite_vector(F.col("v")) & F.forall("v", lambda v: F.abs(v.cast("double")) * steps < RANGE))


def totals(rows: DataFrame, sums) -> dict[tuple[int, int], int]:
    """Exact sums over all rows of what ``sums(batch)`` yields as (key, place, whole number).

    A task adds up its batches; tasks are added up by key and place, whose number follows the dimensions only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, place, value in sums(batch):
                held[key, place] = held.get((key, place), 0) + int(value)
        columns = [pa.array([k[i] for k in held], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(map(Decimal, held.values()), pa.decimal128(38, 0))], names=["key", "place", "total"])

    added = rows.mapInArrow(run, "key int, place int, total decimal(38,0)").groupBy("key", "place").agg(F.sum("total").alias("total"))
    return {(r.key, r.place): int(r.total) for r in added.collect()}


def square_sums(centred: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, sum of (x_i + x_j)**2) for i < j and (i, i, sum of x_i**2) over the rows, exact."""
    size = centred.shape[1]
    most = 2 * int(np.abs(centred).max(initial=0))
    kind = np.int64 if most * most * max(1, len(centred)) < 1 << 62 else object
    columns = np.ascontiguousarray(centred.T).astype(kind)
    for i in range(size):
        pair = columns[i:] + columns[i]
        pair[0] = columns[i]
        for j, value in enumerate((pair * pair).sum(axis=1), i):
            yield i, j, value


def fit_whitener(flows: DataFrame, id_col: str = "flow_id", vector_col: str = "features", steps: int = STEPS, shift: int = SHIFT) -> Whitener | None:
    """Whitener of the feature vectors of all flows; None without a vector.

    A vector is left out if it is null or holds null, a non-finite entry or one of 2**40 steps or more, or
    if its length is not the one of most vectors (of equally frequent ones, the longest). Entries become
    whole numbers floor(steps * c) + shift. One pass counts and adds up; a second adds up, in whole numbers, the
    squared centred values of every dimension and of every sum of two. As Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b),
    these variances give all covariances exactly; divisor n. Only these sums, d * (d + 1) / 2 of them, reach the driver.
    """
    rows = vectors_of(flows, id_col, vector_col, steps)

    def plain(batch: pa.RecordBatch):
        for at, entries in matrices(batch, 1):
            size = entries.shape[1]
            yield size, size, len(at)
            for place, value in enumerate(fixed_point(entries, steps, 0).sum(axis=0)):
                yield size, place, value

    found = totals(rows, plain)
    if not found:
        return None
    n, d = max((count, size) for (size, place), count in found.items() if size == place)
    sums = [found[d, i] + n * shift for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]

    def squares(batch: pa.RecordBatch):
        for _, entries in matrices(batch, 1, d):
            yield from square_sums(fixed_point(entries, steps, shift) - np.array(centre, np.int64))

    found = totals(rows, squares)
    # The sum of (n * x - S)**2 over the rows, from that of x - centre; all in whole numbers.
    spread = lambda i, j: n * found[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2
    own = [spread(i, i) for i in range(d)]
    covariance = np.empty((d, d))
    for i in range(d):
        covariance[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            covariance[i, j] = covariance[j, i] = (spread(i, j) - own[i] - own[j]) / (2 * n**2)
    values, vectors = np.linalg.eigh(covariance)
    trace = sum(own) / n**2
    kept = [k for k in range(d - 1, -1, -1) if values[k] > NO_VARIANCE * trace]
    return Whitener(steps, shift, n, tuple(centre), tuple(rest), tuple(values[kept].tolist()), vectors[:, kept], trace)


def identity_error(rows: DataFrame, model: Whitener, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            for _, entries in matrices(batch, 1, len(model.centre)):
                made = model.whiten(model.centred(entries))[:, :components]
                total += made.sum(axis=0)
                products += made.T @ made
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, products.ravel()]).tolist()], pa.list_(pa.float64()))], names=["sums"])

    summed = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v"))
    flat = np.array([r.v for r in sorted(summed.collect())]) / model.n
    mean, products = flat[:components], flat[components:].reshape(components, components)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(components)).max())


def whiten_flows(
    flows: DataFrame, id_col: str = "flow_id", vector_col: str = "features", components: int = 32, steps: int = STEPS, shift: int = SHIFT
) -> DataFrame:
    """Whitened feature vectors of flows: uncorrelated components of unit variance, the strongest first.

    Fits on all usable vectors (see ``fit_whitener``) and returns a row for each of them, repeated rows and null ids
    included: ``flow_id``, ``n`` (vectors of the fit), ``deviation`` decimal(38,0) (sum over dimensions of (n * x - S)**2,
    exact; null beyond 38 digits), ``whitened`` and ``explained`` (share of the whole variance), arrays with an entry for each
    component up to ``components``, and ``identity_error``, the largest absolute entry of the whitened vectors'
    covariance minus the identity. Directions without variance (eigenvalues up to 1e-12 of the trace) have no component;
    if no direction has any, the arrays are empty and the error 0. No usable vector, no row. Other columns are not read.
    """
    kind = id_type(flows, id_col)
    schema = f"{id_col} {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    model = fit_whitener(flows, id_col, vector_col, steps, shift)
    if model is None:
        return flows.sparkSession.createDataFrame([], schema)
    rows = vectors_of(flows, id_col, vector_col, steps)
    components = min(components, len(model.values))
    error = identity_error(rows, model, components) if components else 0.0
    shares = [v / model.trace for v in model.values[:components]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, entries in matrices(batch, 1, len(model.centre)):
                centred = model.centred(entries)
                made = model.whiten(centred)[:, :components]
                doubles = pa.list_(pa.float64())
                columns = [
                    batch.column(0).take(pa.array(at)), pa.array([model.n] * len(at), pa.int64()), pa.array(model.deviations(centred), pa.decimal128(38, 0)),
                    pa.array(list(made), doubles), pa.array([shares] * len(at), doubles), pa.array([error] * len(at), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
