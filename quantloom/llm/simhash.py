"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints of all texts are 64 bits.  Distinct fingerprints are laid out in tiles: a cell is the vector of bit counts of the four 16-bit
words, and a large cell is dealt over several tiles.  Two fingerprints within r bits of each other have bit-count vectors within r in sum, so
tile pairs beyond that are skipped without losing a pair (a pair of whole counts 17 apart and a pair whose words differ are skipped
alike).  What remains is compared in full: numpy exclusive-or of the two tiles and bit counts.  Tiles hold a bounded number of fingerprints, the
pairs are rows of a Spark join, nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import checkpointed, is_empty, pick_columns, pieces
from quantloom.llm.components import connected_components

SEED = 42                # fixed by the contract
CHUNK = 1 << 17          # shingles whose bits are counted at once: bounds the memory of a very long text
WORDS, WIDTH = 4, 16     # words of a fingerprint whose bit counts name a cell


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint; texts without words give 0."""
    words = (text or "").encode().lower().split()      # bytes: ASCII white space and A-Z only
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        h = np.array([digest(data[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): fp as a signed long.  One row per input row; null texts count as empty."""
    docs = pick_columns(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, fp long")


def neighbour_steps(radius: int) -> list[list[int]]:
    """Steps between the bit-count vectors of tiles that can hold a link; of a step and its opposite only one."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, s)) <= radius]
    return [list(s) for s in steps if s >= (0,) * WORDS]


def _compare(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            left, right = [], []
            for a, b, same in zip(f["a"], f["b"], f["same"]):
                x, y = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if same:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                left.append(x[i].view(np.int64))
                right.append(y[j].view(np.int64))
            yield pd.DataFrame({"u": np.concatenate(left or [np.empty(0, np.int64)]), "v": np.concatenate(right or [np.empty(0, np.int64)])})
    return run


def near_pairs(distinct: DataFrame, fp: str = "fp", radius: int = 2, tile: int = 1024) -> DataFrame:
    """(u, v): every pair of different fingerprints within `radius` bits, once.  `distinct` has each fingerprint once."""
    word = lambda k: F.bit_count(F.shiftrightunsigned(F.col(fp), WIDTH * k).bitwiseAND(F.lit(2 ** WIDTH - 1)))
    cells = distinct.select(F.col(fp).alias("fp"), F.array(*[word(k) for k in range(WORDS)]).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))      # at most 17 ** 4 rows: safe to broadcast
    tiles = (cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
             .groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")))
    tiles = checkpointed(tiles)
    steps = F.array(*[F.array(*map(F.lit, s)) for s in neighbour_steps(radius)])
    left = tiles.select("cell", F.col("part").alias("pa"), F.col("fps").alias("a"), F.explode(steps).alias("step"))
    left = left.select("pa", "a", F.zip_with("cell", "step", lambda c, s: c + s).alias("cell"), (F.array_max(F.transform("step", F.abs)) == 0).alias("own"))
    right = tiles.select("cell", F.col("part").alias("pb"), F.col("fps").alias("b"))
    pairs = left.join(right, "cell").where("NOT own OR pa <= pb")
    pairs = pairs.select("a", "b", (F.col("own") & (F.col("pa") == F.col("pb"))).alias("same"))
    return pairs.mapInPandas(_compare(radius), "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """(key, fingerprint, component_id), one row per input row; component_id is the smallest key that links reach.

    Links are between fingerprints at `radius` or fewer differing bits.  Copies share a fingerprint and so a component.  Null and word-less
    texts have fingerprint zero, which links like any other.  Repeated keys get a row each.  Null keys are never smallest; a component
    of null keys only has component_id null.  An empty table gives an empty result.
    """
    docs = checkpointed(fingerprints(df, key, text, shingle).toDF("rid", "fp"))
    distinct = checkpointed(docs.groupBy("fp").agg(F.min("rid").alias("least")))
    roots = connected_components(near_pairs(distinct.select("fp"), "fp", radius))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = docs.join(named, "fp")
    return out.select(F.col("rid").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of `df` that stay: of each component the one with the smallest key, all columns.  Of rows that repeat a kept key one stays;
    of null keys, which no component id names, all stay."""
    return keep_least(df, near_duplicates(df, key, text, radius, shingle), key)


def keep_least(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose key is the component_id that `found` gives it, each key once, and all rows with a null key."""
    kept = found.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("__n"))
    kept = checkpointed(kept.select(F.col(key).alias("__key"), "__n"))
    rows = df.join(kept, df[key] == kept["__key"]).drop("__key")
    out = rows.drop("__n")
    if not is_empty(kept.where("__n > 1")):
        out = rows.where("__n = 1").drop("__n").unionByName(rows.where("__n > 1").drop("__n").dropDuplicates([key]))
    if not is_empty(found.where(F.col(key).isNull())):
        out = out.unionByName(df.where(df[key].isNull()))
    return out
