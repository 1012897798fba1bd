"""Whitened principal components of an embedding table.

Every entry c becomes the integer x = floor(1024 c) + 100000. Two passes give the exact
count and sums and then the covariance of the centred vectors: tasks add up their rows, the
matrices (dimensions squared, one a task) are added in a tree. The leading components come
from ``feast.largest`` on that one matrix; a pass over the whitened rows measures how far
their covariance is from the identity, and a map gives one row per vector and component.

What reaches the driver has the size of the matrix: documented bound MAX_DIMENSIONS.

Cases:

* Rows whose vector is NULL, empty, or holds NULL or non-finite entries are left out, as are
  rows whose number of entries is not the most frequent one (ties: the larger); the rest is the fit list.
* Repeated rows and ids count as often as they occur, and each gives its rows. A NULL id stays NULL.
* An empty table, or none left, gives an empty result. Fewer dimensions than ``k`` give fewer components.
* A component without variance (eigenvalue at rounding level: constant or linearly dependent
  dimensions, one row) can't be whitened and is left out, so there may be fewer than ``k``, or none.
* Equal eigenvalues: any orthonormal basis of their space, the same for all rows.
* ``deviation`` that exceeds a long is NULL (n * n * variance above 9.2e18). An entry whose x
  exceeds 2**50 in size counts as non-finite.
* Columns of the input aside from the id don't matter; results have their own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import feast

FACTOR, SHIFT = 1024, 100_000
MAX_DIMENSIONS = 2048
_ROWS = 4096  # rows of one matrix product
_LIMIT = float(2**50)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: exact count and sums, and the components (columns, by falling eigenvalue)."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole part and a rest below one, both exact to the last bit of a double."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def white(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return (((x - whole) - rest) @ self.components) / np.sqrt(self.eigenvalues)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * FACTOR).astype(np.int64) + SHIFT).reshape(len(column), dims)


def whole_vectors(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, vector as doubles) of the rows whose vector is not empty and holds finite entries only."""
    doubles = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < _LIMIT / FACTOR, F.lit(False)))  # NaN is above all
    return doubles.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def count_and_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums of the integers per dimension, of the most frequent vector length; (0, ()) without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}  # whole numbers of any size
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                same = batch.column(0).filter(pa.array(lengths == dims))
                for i in range(0, len(same), _ROWS):
                    x = _matrix(same.slice(i, _ROWS), dims)
                    n, s = sums.get(dims, (0, np.zeros(dims, object)))
                    sums[dims] = n + len(x), s + x.sum(0)
        for dims, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dims, dims)), pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(list(s), pa.decimal128(38, 0))],
                ["dims", "at", "n", "s"])

    parts = rows.select("v").mapInArrow(add, "dims bigint, at bigint, n bigint, s decimal(38,0)")
    per_place = parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    first = (per_place.groupBy("dims").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums"))
             .orderBy(F.col("n").desc(), F.col("dims").desc()).first())
    return (0, ()) if first is None else (first["n"], tuple(int(r["s"]) for r in first["sums"]))


def _tree_sum(parts: DataFrame, fan: int = 64) -> list[float] | None:
    """Elementwise sum of the one array column of ``parts`` (rows of one length) over two levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in range(batch.num_rows):
                values = batch.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                total = values.copy() if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    schema = "s array<double>"
    spread = max(1, min(fan, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    row = parts.repartition(spread).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema).first()
    return None if row is None else row["s"]


def covariance(rows: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Covariance (divisor ``n``) of the integers of ``rows``, which all have ``len(sums)`` entries."""
    dims = len(sums)
    whole, rest = Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0).centre()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                centred = (_matrix(batch.column(0).slice(i, _ROWS), dims) - whole) - rest
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["s"])

    return np.array(_tree_sum(rows.select("v").mapInArrow(products, "s array<double>"))).reshape(dims, dims) / n


def fit(rows: DataFrame, n: int, sums: tuple[int, ...], k: int) -> Whitening:
    """Components from the fit list ``rows``; their identity error is measured on the whitened rows."""
    dims, v = len(sums), covariance(rows, n, sums)
    values, vectors = feast.largest(v, k)
    real = values > values[:1].max(initial=0) * dims * np.finfo(float).eps * 16
    model = Whitening(n, sums, values[real], vectors[:, real], float(np.trace(v)))
    count = len(model.eigenvalues)
    if count == 0:
        return model

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                w = model.white(_matrix(batch.column(0).slice(i, _ROWS), dims))
                total += w.T @ w
                first += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total.ravel(), first])])], ["s"])

    got = np.array(_tree_sum(rows.select("v").mapInArrow(moments, "s array<double>"))) / n
    second, mean = got[: count * count].reshape(count, count), got[count * count :]
    error = np.abs(second - np.outer(mean, mean) - np.eye(count)).max()
    return Whitening(n, sums, model.eigenvalues, model.components, model.trace, float(error))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over the dimensions of (n x - sum)^2 per row, exact."""
    whole = [s // n for s in sums]
    near = x - np.array(whole, np.int64)  # n x - s = n (x - whole) - (s - whole n): small numbers
    rest = [s - w * n for s, w in zip(sums, whole)]
    reach = (int(np.abs(near).max(initial=0)) + 1) * n
    if reach * reach * len(sums) < 2**63:
        return ((near * n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((int(a) * n - r) ** 2 for a, r in zip(row, rest)) for row in near]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, k: int = 8, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per vector of the fit list and component."""
    rows = whole_vectors(vectors, vector_col, id_col)
    n, sums = count_and_sums(rows)
    dims = len(sums)
    if dims > MAX_DIMENSIONS:
        raise ValueError(f"{dims} dimensions: one task holds the covariance of at most {MAX_DIMENSIONS}")
    rows = rows.where(F.size("v") == dims)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(rows, n, sums, k) if n else None
    if model is None or len(model.eigenvalues) == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    count, share = len(model.eigenvalues), model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                x = _matrix(part.column(1), dims)
                take = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(take)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(take), model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(take)),
                    pa.array(model.white(x).ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(take), model.identity_error)),
                ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("id").alias(id_col), "v").mapInArrow(project, schema)
