"""Extendible hashing: shards are the leaves of a directory indexed by hash-prefix bits.

A bucket splits on the next bit only while its bytes exceed the limit.  A round extends the oversized buckets by `step` bits at once: bytes are summed by
the longer prefixes (map-side combine), the sums of all prefixes between give the depth at which each first fits.  Documents meet the directory by hash
prefix, which is uniform.  Equal keys have equal hashes; where they alone exceed the limit, bits of a row number go on splitting them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from quantloom.llm.common import checkpointed, is_empty

KEY_BITS = 60


def _bits(hexa) -> F.Column:
    return F.lpad(F.conv(F.substring(hexa, 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def byte_size(*columns: str):
    """UTF-8 bytes of the columns as text, nulls as none."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))


def limit_for(df: DataFrame, shards: int, counted: Sequence[str] = ("text",)) -> int:
    """The limit at which shards of even size would be `shards` in number: all bytes over their number, 1 at least."""
    return max(1, (df.agg(F.sum(byte_size(*counted)).alias("n")).first().n or 0) // shards)


def assign_shards(df: DataFrame, key: str = "doc_id", counted: Sequence[str] = ("text",), limit: int = 64 << 20, step: int = 6) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_docs, shard_bytes), one row per input row; an empty table gives none.

    shard is the leaf's prefix as a bit string ("" if everything fits one shard), n_bytes the UTF-8 bytes of the `counted` columns (0 for null).  Every shard holds at
    most `limit` bytes unless it is a single document that is longer.  Null keys hash as the empty text.  Repeated keys share a shard while they fit.
    """
    docs = df.select(F.col(key).alias("rid"), byte_size(*counted).alias("n"))
    docs = docs.select("rid", "n", _bits(F.md5(F.coalesce(F.col("rid").cast("string"), F.lit("")).cast("binary"))).alias("bits"), F.monotonically_increasing_id().alias("row"))
    return _leaves(checkpointed(docs), key, limit, step)         # from here on row numbers stand


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", counted: Sequence[str] | None = None, limit: int = 64 << 20, step: int = 6) -> DataFrame:
    """Writes all rows and columns of `df` under the shared `folder`, a subfolder `shard=...` for each shard with one file, and returns (shard, depth, shard_docs, shard_bytes).

    `counted` names the columns whose bytes make up a shard's size (all columns by default).  The rows of a shard meet in one task, which the limit bounds; equal rows stay as often as
    they stand.  Rows with the same key go to one shard where its rows fit, and are told apart by a row number where they don't.  `df` is stored once, so that numbers stand.  The folder must not exist.
    """
    names = df.columns
    if "shard" in names:
        raise ValueError("a column named shard would clash with the folders")
    stored = checkpointed(df.select(F.struct(*[df[c] for c in names]).alias("__all"), F.monotonically_increasing_id().alias("row")))
    row = F.col("__all")
    bytes_ = sum((F.coalesce(F.octet_length(row[c].cast("string") if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else
                                            (row[c] if isinstance(df.schema[c].dataType, T.BinaryType) else F.to_json(F.struct(row[c].alias("v"))))), F.lit(0)).cast("long")
                  for c in (counted or names)), F.lit(0).cast("long"))
    docs = stored.select(F.col("row").alias("rid"), bytes_.alias("n"), _bits(F.md5(F.coalesce(row[key].cast("string"), F.lit("")).cast("binary"))).alias("bits"), "row")
    placed = checkpointed(_leaves(checkpointed(docs), "row", limit, step))
    out = stored.join(placed.select(F.col("row").alias("__row"), F.concat(F.lit("p"), "shard").alias("__shard")), F.col("row") == F.col("__row"))
    out = out.select("__all", "__shard").repartition("__shard")
    out.select(F.col("__shard").alias("shard"), *[row[c].alias(c) for c in names]).write.partitionBy("shard").parquet(folder)
    return placed.select(F.concat(F.lit("p"), "shard").alias("shard"), "depth", "shard_docs", "shard_bytes").distinct()


def _leaves(docs: DataFrame, key: str, limit: int, step: int) -> DataFrame:
    """The leaf of every row of a stored table (rid, n, bits, row)."""
    docs = docs.withColumn("bits", F.concat("bits", _bits(F.md5(F.col("row").cast("string").cast("binary")))))
    open_, depth, leaves = docs, 0, []
    while True:
        deeper = min(depth + step, 2 * KEY_BITS)
        sums = open_.groupBy(F.substring("bits", 1, deeper).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
        cells = checkpointed(sums)
        levels = cells.select("cell", "n", "docs", F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth"))
        levels = levels.withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sizes = levels.groupBy("depth", "shard").agg(F.sum("n").alias("bytes"), F.sum("docs").alias("docs"))
        fits = sizes.where((F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("depth") == 2 * KEY_BITS))
        at = levels.select("cell", "depth", "shard").join(fits, ["depth", "shard"]).groupBy("cell").agg(
            F.min_by(F.struct("shard", "depth", "bytes", "docs"), "depth").alias("leaf"))
        directory = checkpointed(cells.select("cell").join(at, "cell", "left"))
        placed = open_.withColumn("cell", F.substring("bits", 1, deeper)).join(directory, "cell")
        leaves.append(placed.where("leaf IS NOT NULL").select("rid", "n", "leaf"))
        if is_empty(directory.where("leaf IS NULL")):
            break
        open_, depth = checkpointed(placed.where("leaf IS NULL").select("rid", "n", "bits", "row")), deeper
    out = reduce(DataFrame.unionAll, leaves)
    return out.select(F.col("rid").alias(key), F.col("n").alias("n_bytes"), F.col("leaf.shard").alias("shard"), F.col("leaf.depth").alias("depth"),
                      F.col("leaf.docs").alias("shard_docs"), F.col("leaf.bytes").alias("shard_bytes"))
