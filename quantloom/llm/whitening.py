"""Whitening of embeddings by the singular values of their centred rows.

1. Components become whole numbers; equal vectors count once.  They are packed into bytes, so that finding the distinct ones moves little, and stored.
2. Exact count and sums.  Rows are centred with them, as whole numbers, before anything is multiplied.
3. Blockwise QR: a task folds its rows into one triangle R, triangles are folded group by group; the last few reach the driver.  R is dimension x dimension,
   whatever the number of rows, and R'R is the covariance times n without ever being formed.
4. R is bidiagonalised by Householder reflections, dqds finds the singular values, twisted factorisations the directions.
5. One pass whitens all rows.  One pass over the distinct vectors measures how far the covariance of the result is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.bidiagonal_svd import EPS, right_singular
from quantloom.llm.common import checkpointed
from quantloom.llm.vectors import as_python_ints, column_sums, finite_rows, matrix, one_dimension, pack, unpack, whole

SCALE, OFFSET, COMPONENTS, FAN = 64, 1_000_000, 16, 32


@dataclass
class Whitener:
    """What a task needs to whiten rows: some dimension x components numbers."""
    n: int
    sums: list[int]                 # exact sums of the whole numbers without the offset, over the distinct vectors
    directions: np.ndarray          # dimension x components: unit eigenvectors over the roots of their eigenvalues
    explained: np.ndarray
    identity_error: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; an offset of all x falls out."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < 1 << 61:
            return x * self.n - np.array(self.sums, np.int64)
        return as_python_ints(x) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2; None beyond 63 bits."""
        y = self.scaled(x)
        if y.dtype != object and len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63:
            y = as_python_ints(y)
        return [v if v < 1 << 63 else None for v in map(int, (y * y).sum(axis=1))]


def fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of all rows behind r and the given ones."""
    return np.linalg.qr(rows if r is None else np.vstack((r, rows)), mode="r")


def triangle(fit: DataFrame, packed: str, dimension: int, centre: Whitener, fan: int = FAN) -> np.ndarray:
    """R of the centred distinct rows: one triangle for each task, then one for each of `fan` groups of tasks, the rest on the driver."""
    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        r = None
        for b in batches:
            if b.num_rows:
                r = fold(r, centre.centred(unpack(b.column(0), dimension)))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % fan], pa.int32()), pa.array([r.tobytes()])], ["k", "r"])

    def by_group(f: pd.DataFrame) -> pd.DataFrame:
        r = None
        for v in f["r"]:
            r = fold(r, np.frombuffer(v).reshape(-1, dimension))
        return pd.DataFrame({"r": [r.tobytes()]})

    tasks = fit.select(packed).mapInArrow(by_task, "k int, r binary")
    groups = tasks.groupBy("k").applyInPandas(by_group, "r binary").collect()          # at most `fan` triangles
    r = None
    for g in groups:
        r = fold(r, np.frombuffer(g.r).reshape(-1, dimension))
    out = np.zeros((dimension, dimension))
    if r is not None:
        out[:len(r)] = r
    return out


def identity_error(fit: DataFrame, packed: str, dimension: int, model: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = model.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, square = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = model.centred(unpack(b.column(0), dimension)) @ model.directions
            mean += w.sum(axis=0)
            square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate((mean, square.ravel())))], ["at", "v"])

    sums = fit.select(packed).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    all_ = np.zeros(k * k + k)
    all_[sums["at"].to_numpy()] = sums["v"].to_numpy() / model.n
    mean, square = all_[:k], all_[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_whitener(rows: DataFrame, vector: str, dimension: int, components: int = COMPONENTS, scale: int = SCALE) -> Whitener:
    """The whitener of the distinct whole-number vectors.  Directions without variance (numerically) are left out, so there may be fewer than `components`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pack(whole(matrix(b.column(0), dimension), scale))], ["packed"])

    fit = checkpointed(rows.select(vector).mapInArrow(run, "packed binary").distinct())
    n, sums = column_sums(fit, "packed", dimension)
    centre = Whitener(n, sums, np.zeros((dimension, 0)), np.zeros(0))
    if not n:
        return centre
    values, vectors = right_singular(triangle(fit, "packed", dimension, centre))
    kept = [i for i in range(min(components, dimension)) if values[i] > (16 * dimension * EPS) ** 2 * values[0]]
    model = Whitener(n, sums, vectors[:, kept] / np.sqrt(values[kept] / n), values[kept] / values.sum() if kept else np.zeros(0))
    model.identity_error = identity_error(fit, "packed", dimension, model) if kept else 0.0
    return model


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, for vectors that are given, not empty, finite and without nulls.

    Whole numbers are floor(scale * c) + 1,000,000, the first held within 62 bits; the offset falls out of all results and is never added.  Vectors of another dimension than the
    smallest key's (null keys last, ties by the vector) are dropped like null ones.  Repeated rows count once in the fit and are all returned; equal vectors under different keys
    get equal values.  Where fewer directions have variance, fewer components are returned: none for an empty table or where all vectors are equal.  A deviation beyond 63 bits is null.
    """
    rows = finite_rows(df, key, vector)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    first = rows.orderBy(F.col(key).asc_nulls_last(), vector).limit(1).collect()
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    dimension = len(first[0][vector])
    rows = one_dimension(rows, vector, dimension)
    model = fit_whitener(rows, vector, dimension, components, scale)
    k = model.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(matrix(b.column(1), dimension), scale)
            rows, m = np.repeat(np.arange(len(x)), k), len(x) * k
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(rows)), pa.array((model.centred(x) @ model.directions).ravel()),
                pa.array(np.tile(model.explained, len(x))), pa.array(np.full(m, model.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
