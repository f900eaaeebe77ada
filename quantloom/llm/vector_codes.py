"""Vector codes by product quantisation, nearest entries found through LAESA pivots.

Components become whole numbers, vectors are cut into equal parts, every part position has a codebook of 16 entries.  The pivots of a position are a few of
the starting entries, far from each other, and stay fixed: the distance of every part to them is computed once and stored beside the parts.  A round
computes the distances of the entries to the pivots; |d(part, pivot) - d(entry, pivot)| then bounds d(part, entry) from below for every entry.  Entries are
tried by rising bound, in exact whole numbers, until the bound passes the best distance found; ties go to the lower index.

A round is one pass over the stored parts.  Tasks add up counts and sums by (part, entry), so a vector that holds a third of all rows is shuffled nowhere, and
what reaches the driver is 8 x 16 sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import checkpointed
from quantloom.llm.vectors import SAFE, as_python_ints, decimals, finite_rows, lists, matrix, one_dimension, whole

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 8, 16, 6, 4096, 3
MOST = (1 << 63) - 1
#: Pivot distances are stored as 32-bit floats; a bound is trusted only beyond this share of the two distances it is the difference of.
SLACK = 1e-6


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the last axis; Python integers where 64 bits may not do."""
    if a.dtype != object and a.size and b.size and max(abs(int(v)) for v in (a.min(), a.max(), b.min(), b.max())) >= SAFE:
        a, b = as_python_ints(a), as_python_ints(b)
    d = a - b
    return (d * d).sum(axis=-1)


def choose_pivots(entries: np.ndarray, m: int = PIVOTS) -> np.ndarray:
    """Up to m different entries, each the one with the largest sum of distances to those before it (the first: to all)."""
    found: list[int] = []
    total = np.sqrt(squared(entries[:, None], entries[None]).astype(float)).sum(axis=1)
    for _ in range(min(m, len(entries))):
        k = int(np.argmax(total))
        if found and total[k] <= 0:
            break
        away = np.sqrt(squared(entries, entries[k]).astype(float))
        total = away if not found else total + away
        found.append(k)
        total[found] = -1
    return entries[found]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows x pivots."""
    return np.sqrt(squared(x[:, None], pivots[None]).astype(np.float64))


def nearest(x: np.ndarray, away: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and exact squared distance of the nearest entry of each row of x, and how many distances were evaluated."""
    n = len(x)
    between = pivot_distances(entries, pivots)                                  # entries x pivots
    bound = np.zeros((n, len(entries)))
    for j in range(len(pivots)):
        a, b = away[:, j, None].astype(np.float64), between[None, :, j]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(n)
    index = order[:, 0]
    best = squared(x, entries[index])
    done = n
    for k in range(1, len(entries)):
        rows = rows[bound[rows, order[rows, k]] <= best[rows].astype(np.float64) * (1 + 1e-12)]       # the order is rising: who stops, stops for good
        if not len(rows):
            break
        e = order[rows, k]
        d = squared(x[rows], entries[e])
        if d.dtype == object:
            best = best.astype(object)
        nearer = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
        best[rows[nearer]], index[rows[nearer]] = d[nearer], e[nearer]
        done += len(rows)
    return index, best, done


class Codebooks:
    """Entries and pivots of all part positions: at most 8 x 16 and 8 x 3 parts, whatever the table."""

    def __init__(self, entries: np.ndarray, scale: int, pivots: list[np.ndarray] | None = None):
        self.entries, self.scale = entries, scale                               # entries: parts x entries x width
        self.pivots = pivots if pivots is not None else [choose_pivots(e) for e in entries]

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def parts(self, column: pa.Array) -> np.ndarray:
        """Rows x parts x width whole numbers."""
        return whole(matrix(column, self.dimension), self.scale).reshape(len(column), self.entries.shape[0], -1)

    def away(self, column: pa.Array) -> np.ndarray:
        return matrix(column, sum(map(len, self.pivots)))

    def assign(self, x: np.ndarray, away: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(part, index, squared distance, evaluations) of each part position; x is rows x parts x width."""
        at = 0
        for p, pivots in enumerate(self.pivots):
            yield p, *nearest(x[:, p], away[:, at:at + len(pivots)], self.entries[p], pivots)
            at += len(pivots)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.reshape(-1)).encode()).hexdigest()


def first_codebooks(rows: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the smallest keys' vectors; ties by the vector, null keys last."""
    top = rows.orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    if not top:
        return None
    width, rest = divmod(len(top[0][0]), parts)
    if rest:
        raise ValueError(f"{len(top[0][0])} components can't be cut into {parts} equal parts")
    x = whole(np.array([r[0] for r in top if len(r[0]) == width * parts]), scale)
    return Codebooks(x.reshape(len(x), parts, width).transpose(1, 0, 2).copy(), scale)


def with_pivot_distances(rows: DataFrame, books: Codebooks, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, vector, away): `away` holds the distances of all parts to their pivots; stored, so that they are computed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = books.parts(b.column(2))
            away = np.concatenate([pivot_distances(x[:, p], pivots) for p, pivots in enumerate(books.pivots)], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(away)], [key, label, vector, "away"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(key, label, vector).schema)
    return checkpointed(rows.select(key, label, vector).mapInArrow(run, schema + ", away array<float>"))


def next_codebooks(stored: DataFrame, books: Codebooks, vector: str) -> tuple[Codebooks, int]:
    """One round: every part goes to its nearest entry, every used entry becomes floor(sum / count); and the number of distances evaluated."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), object)
        tried = 0
        for b in batches:
            x, away = books.parts(b.column(0)), books.away(b.column(1))
            if not len(x):
                continue
            wide = max(abs(int(x.max())), abs(int(x.min()))) >= (1 << 62) // len(x)
            for p, index, _, done in books.assign(x, away):
                counts[p] += np.bincount(index, minlength=entries)
                order = np.argsort(index, kind="stable")
                used, start = np.unique(index[order], return_index=True)
                part = x[order, p]
                sums[p, used] += np.add.reduceat(as_python_ints(part) if wide else part, start, axis=0).astype(object)
                tried += done
        p, e = np.nonzero(counts)
        cells = [decimals(sums[p, e, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array([*p, -1], pa.int32()), pa.array([*e, -1], pa.int32()), pa.array([*counts[p, e], tried], pa.int64()),
                                          *(pa.concat_arrays([c, decimals([0])]) for c in cells)], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width))
    added = stored.select(vector, "away").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
    out, tried = books.entries.copy(), 0
    for r in added.collect():                                                   # 8 x 16 rows and one
        if r.part < 0:
            tried = r.n
        else:
            out[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return Codebooks(out, books.scale, books.pivots), tried


def encode(stored: DataFrame, books: Codebooks, key: str, label: str) -> DataFrame:
    """(key, label, code, error) with the given codebooks."""
    parts = len(books.entries)
    named = {f.name: f.dataType.simpleString() for f in stored.schema}
    hexa = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, away = books.parts(b.column(2)), books.away(b.column(3))
            code, error = np.full(len(x), "", f"<U{2 * parts}"), np.zeros(len(x), np.int64)
            for _, index, best, _ in books.assign(x, away):
                code = np.char.add(code, hexa[index])
                error = error + best
            if error.dtype == object:
                error = np.array([min(int(v), MOST) for v in error], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code.tolist(), pa.string()), pa.array(error)], [key, label, "code", "error"])

    return stored.mapInArrow(run, f"`{key}` {named[key]}, `{label}` {named[label]}, code string, error bigint")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), one row for each row whose vector is given, not empty, finite and without nulls.

    Components are floor(scale * x), held within 62 bits.  All vectors must have the dimension of the smallest key's; rows of another one are dropped like null vectors, and a
    dimension that can't be cut into `parts` raises ValueError.  Fewer than `entries` rows give smaller codebooks.  Equal keys are ordered by their vectors; null keys come last;
    repeated rows count as often as they stand; null labels are one label.  An empty table gives an empty result.  Errors beyond 63 bits are given as 2**63 - 1.
    """
    rows = finite_rows(df, key, vector, label)
    books = first_codebooks(rows, key, vector, parts, entries, scale)
    if books is None:
        none = F.lit(None).cast("bigint")
        return rows.where("false").select(key, F.lit("").alias("code"), none.alias("error"), none.alias("label_error"), F.lit("").alias("codebooks_sha256"))
    stored = with_pivot_distances(one_dimension(rows, vector, books.dimension), books, key, vector, label)
    for _ in range(rounds):
        new, _ = next_codebooks(stored, books, vector)
        if np.array_equal(new.entries, books.entries):          # every further round would give the same
            break
        books = new
    coded = checkpointed(encode(stored, books, key, label))
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"))
    out = coded.join(sums, coded[label].eqNullSafe(sums["__label"]), "left")
    return out.select(key, "code", "error", F.least("__sum", F.lit(MOST).cast("decimal(38,0)")).cast("bigint").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))
