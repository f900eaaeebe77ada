"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the number of features.  Trained on a bounded sample of labelled
rows on the driver (`per_class` documents of each label at most, each of `longest` bytes at most); the weights are a fixed few MB, whatever the corpus.
Scoring runs over all rows inside tasks, whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import pick_columns

BUCKETS, RANK = 1 << 15, 8
#: Classes of bytes that the structure statistics count.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, HIGH = range(8)
CLASS = np.full(256, MARK, np.uint8)
for _c, _chars in ((LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, (32, 9, 11, 12, 13)), (LINE, (10,)),
                   (STOP, b".,;:'\"-()"), (HIGH, range(128, 256))):
    CLASS[list(_chars)] = _c
STATS = 16


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of the words (unit length) and the raw structure statistics of a whole text."""
    raw = (text or "").encode()
    words = Counter(raw.lower().split())
    n, total = max(1, len(raw)), max(1, words.total())
    at = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in words), np.int64, len(words))
    x = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    share = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    letters = share[LOWER] + share[UPPER] + 1e-9
    lines = raw.count(b"\n") + 1
    stats = np.array([*share, share[UPPER] / letters, np.log1p(n), np.log1p(total / lines), np.log(n / total), len(words) / total,
                      max(words.values(), default=0) / total, np.log1p(lines), np.log1p(max(0, n_chars or 0))])
    return at, x, stats


@dataclass
class Machine:
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def join(self, parts) -> tuple[np.ndarray, np.ndarray]:
        at, x, stats = parts
        z = np.clip((stats - self.mean) / self.spread, -4, 4) / np.sqrt(STATS)
        return np.concatenate((at, BUCKETS + np.arange(STATS))), np.concatenate((x, z))

    def score(self, text: str | None, n_chars: int | None) -> float:
        at, x = self.join(features(text, n_chars))
        xv = x[:, None] * self.v[at]
        s = self.bias + x @ self.w[at] + 0.5 * ((xv.sum(0) ** 2).sum() - (xv * xv).sum())
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def train(rows: list[tuple[str | None, int | None, int]], epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Fits by Adagrad on the log loss.  Without rows of both labels the score is the smoothed share of label 1, for every text."""
    y = np.array([r[2] for r in rows], float)
    size = BUCKETS + STATS
    if len(set(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Machine(np.zeros(STATS), np.ones(STATS), float(np.log(p / (1 - p))), np.zeros(size), np.zeros((size, RANK)))
    rng = np.random.default_rng(seed)
    parts = [features(t, n) for t, n, _ in rows]
    stats = np.array([p[2] for p in parts])
    m = Machine(stats.mean(0), stats.std(0) + 1e-6, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    joined = [m.join(p) for p in parts]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            mine = order[k:k + batch]
            at = np.concatenate([joined[i][0] for i in mine])
            x = np.concatenate([joined[i][1] for i in mine])
            lens = np.array([len(joined[i][0]) for i in mine])
            starts, row = np.cumsum(lens) - lens, np.repeat(np.arange(len(mine)), lens)
            xv = x[:, None] * m.v[at]
            sums = np.add.reduceat(xv, starts)
            s = m.bias + np.add.reduceat(x * m.w[at], starts) + 0.5 * ((sums ** 2).sum(1) - np.add.reduceat(xv * xv, starts).sum(1))
            d = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[mine]) * weight[mine] / len(mine)
            dx = d[row] * x
            where, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, dx) + decay * m.w[where]
            dv = np.empty((len(where), RANK))
            part = dx[:, None] * (sums[row] - xv)
            for f in range(RANK):
                dv[:, f] = np.bincount(inverse, part[:, f])
            dv += decay * m.v[where]
            gw[where] += dw * dw
            gv[where] += dv * dv
            gb += d.sum() ** 2
            m.w[where] -= rate * dw / np.sqrt(gw[where])
            m.v[where] -= rate * dv / np.sqrt(gv[where])
            m.bias -= rate * d.sum() / np.sqrt(gb)
    return m


def sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], per_class: int, longest: int, key: str = "doc_id") -> list:
    """Labelled rows for training: of each label the `per_class` keys with the least hash, then those of at most `longest` bytes.  Null labels and keys are left out,
    so is a key with different labels; of a key's different texts the smallest is learnt."""
    known = pick_columns(labels, key, label).toDF("__id", "__y").where("__id IS NOT NULL AND __y IS NOT NULL")
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__most")).where("__y = __most").drop("__most")
    picked = [known.where(F.col("__y") == v).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for v in (0, 1)]
    ids = picked[0].unionAll(picked[1])                          # at most 2 * per_class rows
    rows = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= longest).join(F.broadcast(ids), docs[key] == F.col("__id"))
    rows = rows.groupBy("__id", "__y").agg(F.min(F.struct(*columns)).alias("__row")).select("__id", "__row.*", "__y").collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r[0])]


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 16384, label: str = "quality") -> Machine:
    """`labels` must hold the rows to learn from only.  `docs` needs doc_id, text and n_chars."""
    return train(sample(docs, labels, label, ["text", "n_chars"], per_class, longest))


def score_quality(df: DataFrame, model: Machine, score: str = "score", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns of `df` and the score; a column of that name is replaced.  Null and empty texts are scored from their statistics."""
    keep = [c for c in df.columns if c != score]
    shared = df.sparkSession.sparkContext.broadcast(model)         # a few MB, whatever the corpus
    at, size = keep.index(text), keep.index(n_chars)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(t, n) for t, n in zip(b.column(at).to_pylist(), b.column(size).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*keep, score])

    return df.select(*[df[c] for c in keep]).mapInArrow(run, schema)
