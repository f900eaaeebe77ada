"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5, with word marks) and of itself, all hashed; a passage of `WINDOW` words is the mean of its
words; a linear softmax tells the classes.  Unseen spellings share n-grams with known ones.  Labels belong to whole documents, so training first gives a document's
label to its passages, then goes on with the most toxic-looking passage of each toxic document and the most toxic-looking ones of the others.
A document's score is a logistic function, fitted on the training documents, of its highest passage logit over all places, so length doesn't dilute it.
Embeddings and softmax are linear: a word's contribution is one number, which each worker works out once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.quality import sample

BUCKETS, DIM, WINDOW = 1 << 16, 16, 8
EDGE = b".,;:!?|\"'()[]{}<>#$%&*+-/=@^_`~\\"
CACHE = 400_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def subwords(word: bytes) -> list[int]:
    """Buckets of the word and its n-grams of characters, punctuation at the ends left off."""
    bare = "<" + (word.strip(EDGE) or word).decode(errors="replace") + ">"
    grams = [bare] + [bare[i:i + n] for n in (3, 4, 5) for i in range(len(bare) - n + 1)]
    return [zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams]


@dataclass
class Bag:
    e: np.ndarray                 # BUCKETS x DIM
    u: np.ndarray                 # DIM: difference of the two softmax columns
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    cache: dict = field(default_factory=dict, repr=False)
    _values: np.ndarray | None = field(default=None, repr=False)

    def values(self) -> np.ndarray:
        """The logit of each bucket alone."""
        if self._values is None:
            self._values = self.e @ self.u
        return self._values

    def worth(self, words: list[bytes]) -> np.ndarray:
        """Each word's contribution to the logit of a passage."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [w for w in set(words) if w not in self.cache]
        if new:
            grams = [subwords(w) for w in new]
            lens = np.fromiter(map(len, grams), np.int64, len(grams))
            value = self.values()[np.concatenate(grams)]
            self.cache.update(zip(new, (np.add.reduceat(value, np.cumsum(lens) - lens) / lens).tolist()))
        return np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))

    def logit(self, text: str | None) -> float:
        """Highest logit of a passage of WINDOW words; of the whole text if it is shorter; of an empty text the bias."""
        value = self.worth(tokens(text))
        if len(value) <= WINDOW:
            return self.bias + (float(value.sum()) / max(len(value), WINDOW // 3) if len(value) else 0.0)
        total = np.concatenate(([0.0], np.cumsum(value)))
        return self.bias + float((total[WINDOW:] - total[:-WINDOW]).max()) / WINDOW

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(text) + self.shift, -30, 30))))


def _fit(e, w, b, words_of, lens_of, passages, y, weight, epochs, rate, rng, ge, gw) -> None:
    """Adagrad steps on the softmax loss; `passages` are arrays of word numbers, words_of / lens_of the n-gram lists of words."""
    first = np.cumsum(lens_of) - lens_of
    for _ in range(epochs):
        order = rng.permutation(len(passages))
        for k in range(0, len(order), 1024):
            mine = order[k:k + 1024]
            flat = np.concatenate([passages[i] for i in mine])
            n = np.array([len(passages[i]) for i in mine])
            vocab, inv = np.unique(flat, return_inverse=True)
            count = lens_of[vocab]
            grams = words_of[np.repeat(first[vocab] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            at = np.cumsum(count) - count
            vec = np.add.reduceat(e[grams], at) / count[:, None]
            starts = np.cumsum(n) - n
            bag = np.add.reduceat(vec[inv], starts) / n[:, None]
            z = bag @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(mine)), y[mine]] -= 1
            p *= weight[mine][:, None]
            dw, db = bag.T @ p, p.sum(0)
            dbag = (p @ w.T) / n[:, None]      # summed over the batch, not averaged: steps are scaled by their own history
            dword = np.empty((len(vocab), DIM))
            spread = np.repeat(dbag, n, axis=0)
            for d in range(DIM):
                dword[:, d] = np.bincount(inv, spread[:, d], len(vocab))
            dgram = np.repeat(dword / count[:, None], count, axis=0)
            where, inv2 = np.unique(grams, return_inverse=True)
            de = np.empty((len(where), DIM))
            for d in range(DIM):
                de[:, d] = np.bincount(inv2, dgram[:, d], len(where))
            ge[where] += de * de
            gw += dw * dw
            e[where] -= rate * de / np.sqrt(ge[where])
            w -= rate * dw / np.sqrt(gw)
            b -= 0.01 * rate * db


def train(rows: list[tuple[str | None, int]], start: int = 20_000, rounds: int = 4, hard: int = 3, epochs: int = 2, rate: float = 0.2, seed: int = 11) -> Bag:
    """A first fit on `start` passages drawn at random, then `rounds` of mining: the best passage of every toxic document against the `hard` most
    toxic-looking ones of every other document.  Without rows of both labels the score is the smoothed share of label 1, for every text."""
    y = np.array([r[1] for r in rows], int)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Bag(np.zeros((BUCKETS, DIM)), np.zeros(DIM), 0.0, 0.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(t, len(number)) for t in tokens(text)], np.int64) for text, _ in rows]
    passages = [ids[s:s + WINDOW] for ids in texts for s in range(0, max(1, len(ids)), WINDOW // 2) if len(ids)]
    owner = np.repeat(np.arange(len(rows)), [len(range(0, len(ids), WINDOW // 2)) for ids in texts])
    grams = [subwords(w) for w in number]
    lens_of = np.array([len(g) for g in grams])
    words_of = np.concatenate(grams)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    label, flat = y[owner], np.concatenate(passages)
    lens = np.array([len(p) for p in passages])
    use = rng.permutation(len(passages))[:start]
    calm = use[label[use] == 0]                       # stays in every round, so that nothing learnt is forgotten
    ge, gw = np.full(e.shape, 1e-4, np.float32), np.full(w.shape, 1e-3, np.float32)
    for _ in range(rounds + 1):
        lab = label[use]
        weight = np.where(lab == 1, 0.5 / max(1, (lab == 1).sum()), 0.5 / max(1, (lab == 0).sum())) * len(lab)
        _fit(e, w, b, words_of, lens_of, [passages[i] for i in use], lab, weight, epochs, rate, rng, ge, gw)
        value = np.add.reduceat((e @ (w[:, 1] - w[:, 0]))[words_of], np.cumsum(lens_of) - lens_of) / lens_of
        z = np.add.reduceat(value[flat], np.cumsum(lens) - lens) / lens
        order = np.lexsort((-z, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        best = order[place < np.where(label[order] == 1, 1, hard)]
        calm = np.union1d(calm, best[label[best] == 0])
        use = np.concatenate((best[label[best] == 1], calm))
    m = Bag(e, w[:, 1] - w[:, 0], float(b[1] - b[0]))
    top = np.array([m.logit(t) for t, _ in rows])
    m.cache.clear()
    m.slope, m.shift = _logistic(top, y)
    return m


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic function of one variable; Newton steps with a little ridge, both classes of equal weight."""
    mid, wide = x.mean(), x.std() + 1e-9
    d = np.stack([(x - mid) / wide, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ c, -30, 30)))
        ridge = np.diag([1e-2, 1e-6])
        h = (d * (weight * p * (1 - p))[:, None]).T @ d + ridge
        c += np.linalg.solve(h, d.T @ (weight * (y - p)) - ridge @ c)
    return float(c[0] / wide), float(c[1] - c[0] * mid / wide)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 8192, label: str = "toxic") -> Bag:
    """`labels` must hold the rows to learn from only.  `docs` needs doc_id and text.  The sample is bounded as for the quality classifier."""
    return train(sample(docs, labels, label, ["text"], per_class, longest))


def score_toxicity(df: DataFrame, model: Bag, score: str = "score", text: str = "text") -> DataFrame:
    """All rows and columns of `df` and the score; a column of that name is replaced.  Null texts count as empty."""
    keep = [c for c in df.columns if c != score]
    shared = df.sparkSession.sparkContext.broadcast(model)         # some MB, whatever the corpus
    at = keep.index(text)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*keep, score])

    return df.select(*[df[c] for c in keep]).mapInArrow(run, schema)
