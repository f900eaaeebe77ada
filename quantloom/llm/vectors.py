"""What the operators on embedding tables share: which rows count, whole-number components, sums that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import pick_columns

LARGEST = 1 << 62       # whole-number components are held within this
SAFE = 1 << 25          # below it, squared distances of up to 2,048 components fit 64 bits


def finite_rows(df: DataFrame, key: str, vector: str, *further: str) -> DataFrame:
    """(key, further..., vector) of the rows whose vector is given, not empty and has neither null nor non-finite components.  Components are floats or doubles, others become doubles."""
    kind = df.schema[vector].dataType.simpleString()
    v = F.col(vector).cast(kind if kind == "array<float>" else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return pick_columns(df, key, vector, *further).select(key, *further, v.alias(vector)).where((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)))


def one_dimension(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    return df.where(F.size(vector) == dimension)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The lists of an Arrow column as rows of a numpy matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def lists(a: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))


def whole(x: np.ndarray, scale: int, offset: int = 0) -> np.ndarray:
    """floor(scale * x) + offset, held within 62 bits."""
    y = np.floor(x.astype(np.float64) * scale)
    return np.clip(y, -float(LARGEST), float(LARGEST)).astype(np.int64) + offset


def pack(x: np.ndarray) -> pa.Array:
    """Each row as bytes: 16-, 32- or 64-bit numbers, the narrowest that hold it, so equal rows have equal bytes."""
    size = np.abs(x).max(axis=1, initial=0)
    out = np.empty(len(x), object)
    for low, high, kind in ((-1, 1 << 15, "<i2"), ((1 << 15) - 1, 1 << 31, "<i4"), ((1 << 31) - 1, None, "<i8")):
        at = np.flatnonzero((size > low) & (size < high) if high else size > low)
        flat = x[at].astype(kind)
        out[at] = [r.tobytes() for r in flat]
    return pa.array(out.tolist(), pa.binary())


def unpack(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.to_pylist()
    width = np.fromiter(map(len, values), np.int64, len(values)) // dimension
    out = np.zeros((len(values), dimension), np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join([values[i] for i in at]), f"<i{w}").reshape(len(at), dimension)
    return out


def as_python_ints(a: np.ndarray) -> np.ndarray:
    """Python integers where 64 bits may not be enough for what follows."""
    return a.astype(object)


def decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def column_sums(rows: DataFrame, column: str, dimension: int) -> tuple[int, list[int]]:
    """Row count and exact sum of each component of packed rows; a task adds up its rows, so one row for each task and component is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for b in batches:
            x = unpack(b.column(0), dimension)
            n += len(x)
            if len(x):
                safe = int(np.abs(x).max()) < (1 << 62) // len(x)
                sums = [s + int(t) for s, t in zip(sums, (x if safe else as_python_ints(x)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), decimals([n, *sums])], ["pos", "s"])

    added = rows.select(column).mapInArrow(run, "pos int, s decimal(38,0)").groupBy("pos").agg(F.sum("s").alias("s")).collect()
    found = {r.pos: int(r.s) for r in added}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimension)]
