"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give idf weights (a fixed table, whatever the corpus).
2. A randomised SVD of the TF-IDF passages of the benchmark: every pass (sketch, power steps, small Gram matrix) is a Spark job whose rows are summed by
   feature with map-side combine; what reaches the driver is features x rank numbers.  Every benchmark item is indexed.
3. Windows of 16, 32 and 64 words of every whole document, a quarter apart.  Windows with at least `coverage` of their squared idf mass in benchmark words are projected
   and compared by cosine with all items of a block; a block holds a bounded number of items, and every document meets every block.
4. A candidate stands if the longest common subsequence of words reaches `least` of the item, or `paraphrase` of it while the item's answer (its last
   sentence) is found to `least`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import checkpointed, pick_columns

BUCKETS, RANK, EXTRA = 1 << 16, 64, 16
WINDOWS = (16, 32, 64)
BLOCK = 4096            # items of a block, on average
#: Bytes that end a word become spaces, A-Z lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "array<struct<item_id: {kind}, start: int, cosine: double, lcs: double, answer: double>>"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


FOLDED = np.frombuffer(FOLD, np.uint8)
FACTOR, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)      # odd, so powers can be divided out modulo 2^64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """FACTOR^i and FACTOR^-i modulo 2^64 for i < n at least."""
    if len(_POWERS[0]) < n:
        for k, f in enumerate((FACTOR, INVERSE)):
            _POWERS[k] = np.full(1 << (n - 1).bit_length(), f, np.uint64)
            _POWERS[k][0] = 1
            np.cumprod(_POWERS[k], out=_POWERS[k])
    return _POWERS


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word of the texts, one after the other, and the number of words of each text; words are those of `tokens`.

    A word's hash is the difference of two running sums of bytes x powers, divided by the power at its start.
    """
    folded = FOLDED[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    power, back = _powers(len(folded))
    edge = np.flatnonzero(np.diff((folded != 32).astype(np.int8), prepend=np.int8(0)))
    first, last = edge[::2], edge[1::2]
    total = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(folded * power[:len(folded)], out=total[1:])
    code = (total[last] - total[first]) * back[first]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return (code >> np.uint64(48)).astype(np.int64), np.diff(np.searchsorted(first, starts))


def in_chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts of about `size` bytes at a time (one text at least), their words' buckets and their numbers of words."""
    part, held = [], 0
    for t in column.cast(pa.binary()).to_pylist():
        part.append(t or b"")
        held += len(part[-1])
        if held >= size:
            yield part, *buckets(part)
            part, held = [], 0
    if part:
        yield part, *buckets(part)


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log((1 + N) / (1 + documents with the bucket)) over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for texts, words, count in in_chunks(b.column(0)):
                once = np.unique(np.repeat(np.arange(len(texts)) * BUCKETS, count) + words)
                seen[:BUCKETS] += np.bincount(once & (BUCKETS - 1), minlength=BUCKETS)
                seen[BUCKETS] += len(texts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    counts = docs.select(docs[text]).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(BUCKETS + 1)
    seen[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1e-3


def vectors(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """(item_id, raw, bucket, weight): unit TF-IDF vectors of the items that have words."""
    kind = items.schema["item_id"].dataType.simpleString()
    shared = items.sparkSession.sparkContext.broadcast(idf)           # half a MB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t in zip(f["item_id"], f["text"]):
                b, n = np.unique(buckets([(t or "").encode()])[0], return_counts=True)
                x = n * shared.value[b]
                if len(b):
                    out.append((i, t, b, x / np.sqrt((x * x).sum())))
            yield pd.DataFrame(out, columns=["item_id", "raw", "bucket", "weight"])

    return items.mapInPandas(run, f"item_id {kind}, raw string, bucket array<long>, weight array<double>")


def _times(rows: DataFrame, place: np.ndarray, m: np.ndarray, gram: bool) -> np.ndarray:
    """A'(A m), or (A m)'(A m) with `gram`, summed over all rows by Spark.  Row place[b] of m belongs to bucket b."""
    width, shared = m.shape[1], rows.sparkSession.sparkContext.broadcast((place, m))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        square = np.zeros((width, width))
        place, m = shared.value
        for f in frames:
            for b, x in zip(f["bucket"], f["weight"]):
                b = place[b]
                y = x @ m[b]
                if gram:
                    square += np.outer(y, y)
                else:
                    for k, v in zip(b, x):
                        acc[k] = acc.get(k, 0) + v * y
        if gram:
            acc = dict(enumerate(square))
        if acc:                 # a task without words has nothing to add
            yield pd.DataFrame({"at": list(acc), "v": list(acc.values())})

    parts = rows.select("bucket", "weight").mapInPandas(run, "at long, v array<double>")
    sums = parts.select("at", F.posexplode("v")).groupBy("at", "pos").agg(F.sum("col").alias("v")).toArrow()
    shared.destroy()
    out = np.zeros((width if gram else m.shape[0], width))
    out[sums["at"].to_numpy(), sums["pos"].to_numpy()] = sums["v"].to_numpy()
    return out


def randomised_svd(rows: DataFrame, rank: int = RANK, extra: int = EXTRA, power: int = 2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the matrix whose rows are given: (place, basis), basis[place[b]] is the row of bucket b.

    Buckets without a word of the benchmark share the last row, which is zero; so the basis is as small as the benchmark's vocabulary.
    """
    used = np.sort(rows.select(F.explode("bucket").alias("b")).distinct().toArrow()["b"].to_numpy())       # at most BUCKETS numbers
    place = np.full(BUCKETS, len(used), np.int32)
    place[used] = np.arange(len(used))
    q = np.random.default_rng(seed).normal(size=(len(used) + 1, rank + extra))
    for _ in range(power + 1):
        q, _ = np.linalg.qr(_times(rows, place, q, False))
    value, turn = np.linalg.eigh(_times(rows, place, q, True))
    order = [k for k in np.argsort(-value)[:rank] if value[k] > 1e-9 * max(value.max(), 1e-30)]
    basis = (q @ turn[:, order]).astype(np.float32)
    basis[-1] = 0
    return place, basis


def positions(words: list[bytes]) -> dict[bytes, int]:
    """The places of each word as the bits of a number."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(words):
        where[w] = where.get(w, 0) | 1 << i
    return where


def shared_places(where: dict[bytes, int], words: list[bytes]) -> list[int]:
    """The places of those `words` that occur at all, in their order; a common subsequence is no longer than this list."""
    return [m for m in map(where.get, words) if m]


def common_length(n: int, places: list[int]) -> int:
    """Length of the longest common subsequence of a text of n words with the words at `places`, bit-parallel in the text."""
    full = s = (1 << n) - 1
    for m in places:
        u = s & m
        s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of words."""
    return common_length(len(a), shared_places(positions(a), b))


def answer(text: str) -> list[bytes]:
    """The words of the last sentence that has any."""
    parts = [tokens(p) for p in re.split(r"[.!?:\n]+", text)]
    return next((p for p in reversed(parts) if p), [])


@dataclass
class Index:
    """A block of the benchmark: what every task needs to search it."""
    idf: np.ndarray
    place: np.ndarray
    basis: np.ndarray
    known: np.ndarray           # buckets of the block's words
    ids: list
    words: list[list[bytes]]
    answers: list[list[bytes]]
    latent: np.ndarray          # items x rank, unit length
    where: dict = field(default_factory=dict)       # positions of the words of the items met so far, filled in each worker

    def search(self, text: bytes, b: np.ndarray, coverage: float, cosine: float, least: float, paraphrase: float) -> list[tuple]:
        """(id, start, cosine, lcs, answer) of the items that the text, whose words have the buckets b, holds."""
        n = len(b)
        if not n or not self.ids:
            return []
        w = self.idf[b]
        mass = np.concatenate(([0.0], np.cumsum(w * w)))
        known = np.concatenate(([0.0], np.cumsum(w * w * self.known[b])))
        spans = []
        for size in WINDOWS:
            s = np.arange(0, max(1, n - size + size // 4), size // 4)
            e = np.minimum(s + size, n)
            ok = known[e] - known[s] >= coverage * (mass[e] - mass[s])
            spans.append(np.stack((s[ok], e[ok]), 1))
            if n <= size:
                break
        spans = np.concatenate(spans)
        best: dict[int, tuple] = {}
        words = None                # cut out where a window is near an item
        tried = set()               # windows of three sizes lead to the same stretch of text again and again
        for i, at, end, c in self._near(spans, b, w, cosine):
            item = self.words[i]
            lo, hi = max(0, at - len(item) // 2), min(n, max(end, at + len(item)) + len(item) // 2)
            floor = best[i][3] if i in best else 0.0
            if floor >= 1 or (i, lo, hi) in tried:
                continue
            tried.add((i, lo, hi))
            words = words or text.translate(FOLD).split()
            part = words[lo:hi]
            if i not in self.where:
                self.where[i] = positions(item)
            places = shared_places(self.where[i], part)
            most = len(places) / len(item)
            if most < paraphrase or most <= floor:              # the subsequence can't be longer
                continue
            share = common_length(len(item), places) / len(item)
            if share < paraphrase or share <= floor:
                continue
            said = lcs(self.answers[i], part) / len(self.answers[i])
            if share >= least or said >= least:
                best[i] = (self.ids[i], lo, float(c), share, said)
        return [best[i] for i in sorted(best)]

    def _near(self, spans, b, w, cosine) -> Iterator[tuple]:
        """(item, start, end, cosine) of the windows near an item.  The words of all windows are projected once, windows are differences of running sums."""
        if not len(spans):
            return
        edge = np.zeros(len(b) + 1, np.int64)
        np.add.at(edge, spans[:, 0], 1)
        np.add.at(edge, spans[:, 1], -1)
        inside = np.cumsum(edge)[:-1] > 0
        place = np.concatenate(([0], np.cumsum(inside)))        # a window's words follow each other among those inside
        rows = self.basis[self.place[b[inside]]] * w[inside, None]
        total = np.zeros((len(rows) + 1, self.basis.shape[1]))
        np.cumsum(rows, axis=0, out=total[1:])
        first, last = place[spans[:, 0]], place[spans[:, 1]]
        for k in range(0, len(spans), 256):
            x = total[last[k:k + 256]] - total[first[k:k + 256]]
            x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
            c = x.astype(np.float32) @ self.latent.T
            for r, i in zip(*np.nonzero(c >= cosine)):
                yield int(i), int(spans[k + r, 0]), int(spans[k + r, 1]), c[r, i]


def indexes(benchmark: DataFrame, idf: np.ndarray, block: int = BLOCK) -> Iterator[Index]:
    """The benchmark's index in blocks of about `block` items.  Null items and items without words can't be found and are left out."""
    items = pick_columns(benchmark, "item_id", "text").where("text IS NOT NULL")
    rows = checkpointed(vectors(items, idf))
    total = rows.count()
    if not total:
        return
    place, basis = randomised_svd(rows)
    blocks = math.ceil(total / block)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("raw"), F.lit(blocks)) == k).toArrow()
        ids, part = part["item_id"].to_pylist(), part.to_pandas()          # ids as they are: pandas turns null integers to NaN
        known = np.zeros(BUCKETS, np.float32)
        latent = np.zeros((len(part), basis.shape[1]), np.float32)
        for r, (b, x) in enumerate(zip(part["bucket"], part["weight"])):
            known[b] = 1
            latent[r] = x @ basis[place[b]]
        latent /= np.linalg.norm(latent, axis=1, keepdims=True) + 1e-12
        yield Index(idf, place, basis, known, ids, [tokens(t) for t in part["raw"]], [answer(t) for t in part["raw"]], latent)


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", matches: str = "leaks", coverage: float = 0.5, cosine: float = 0.5,
               least: float = 0.8, paraphrase: float = 0.6, block: int = BLOCK) -> DataFrame:
    """All rows and columns of `docs` and the array `matches` of (item_id, start, cosine, lcs, answer), one for each benchmark item that the whole text holds.

    Null and empty texts and an empty benchmark give empty arrays; an item with a null id is reported under null; equal rows get equal arrays; a column of that name is replaced.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out = docs.drop(matches).withColumn(matches, F.array().cast(MATCH.format(kind=kind)))
    for index in indexes(benchmark, inverse_frequencies(docs, text), block):
        out = _search(out, index, text, matches, kind, (coverage, cosine, least, paraphrase))
    return out


def _search(docs: DataFrame, index: Index, text: str, matches: str, kind: str, limits: tuple) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)          # bounded by the block, not by corpus or benchmark
    names = docs.columns
    at, put = names.index(text), names.index(matches)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names if c != matches] + [f"`{matches}` {MATCH.format(kind=kind)}"])
    fields = ("item_id", "start", "cosine", "lcs", "answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for texts, words, count in in_chunks(b.column(at)):
                new += [shared.value.search(t, words[z - n:z], *limits) for t, n, z in zip(texts, count, np.cumsum(count))]
            found = [old + [dict(zip(fields, m)) for m in more] for old, more in zip(b.column(put).to_pylist(), new)]
            rest = [c for k, c in enumerate(b.columns) if k != put]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, b.column(put).type)], [*(c for c in names if c != matches), matches])

    return docs.mapInArrow(run, schema)
