"""Exact duplicates by a distributed most-significant-byte-first radix partitioning.

All texts start in one bucket.  A round cuts the next run of bytes from the front of every text that is still open, groups by
(bucket, run, "the text ends here") and counts.  A group of one row is finished, so is a group whose texts end inside the run: those texts are
equal byte by byte, no digest is compared.  Every other group is a bucket of the next round.  Runs grow by a factor, so a text of n bytes takes
part in about log(n) rounds, and each byte is looked at once.

Groups are counted with map-side combine and joined back to their rows; a group that holds a third of all rows is one aggregate row, and its
rows are spread by the planner's skew join, never gathered.  Each round is checkpointed, so lost executors cost one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import ASCII_SPACE, checkpointed, is_empty, pick_columns


def normalised(text: str):
    """White-space runs become one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ASCII_SPACE, " ")


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", first_run: int = 64, growth: int = 8) -> DataFrame:
    """One row per input row: key, keep (smallest key of the equal texts), group_size, kept, text_sha256 (of the normalised text, for output only).

    Null texts equal empty ones.  Repeated keys: every row that bears the smallest key of its group is kept.  Null keys are never smallest; a
    group of null keys only has keep null and keeps its rows.  An empty table gives an empty result.
    """
    docs = pick_columns(df, key, text).toDF("rid", "raw")
    rest = normalised("raw").cast("binary")
    state = docs.select("rid", F.lit(0).cast("long").alias("bucket"), rest.alias("rest"))
    state = state.withColumn("sha", F.sha2("rest", 256))
    done, run = [], first_run
    while True:
        cut = state.withColumn("piece", F.substring("rest", 1, run)).withColumn("ends", F.length("rest") <= run)
        keys = ["bucket", "piece", "ends"]
        groups = cut.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rid").alias("keep")).where("n > 1")
        groups = checkpointed(groups.withColumn("next", F.when(~F.col("ends"), F.monotonically_increasing_id())))
        joined = cut.join(groups, keys, "left")
        open_ = F.col("next").isNotNull()
        tail = F.expr(f"substring(rest, {run + 1})")
        joined = checkpointed(joined.select(
            "rid", "sha", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.when(F.col("n").isNull(), F.col("rid")).otherwise(F.col("keep")).alias("keep"),
            F.col("next").alias("bucket"), F.when(open_, tail).alias("rest")))
        done.append(joined.where("bucket IS NULL").select("rid", "keep", "n", "sha"))
        state = joined.where("bucket IS NOT NULL").select("rid", "bucket", "rest", "sha")
        if is_empty(state):
            break
        run *= growth
    out = reduce(DataFrame.unionAll, done)
    return out.select(F.col("rid").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
                      F.col("rid").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
