"""Structured Streaming forms of bar building, de-duplication and running experiment sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.sources.files import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; the event time is cast because watermarks need a zoned timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_bars(ticks: DataFrame, size="1 hour", slide=None, delay="2 hours", key="symbol", price="price", order=("ts", "event_id")) -> DataFrame:
    """Open, high, low, close and volume per tumbling or sliding window; a window closes when the watermark passes it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    seq = F.struct(*order, price)
    return (ticks.withWatermark("ts", delay).groupBy(w.alias("window"), key)
            .agg(F.min(seq)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(seq)[price].alias("close"),
                 F.count(F.lit(1)).alias("volume"))
            .select(key, F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume"))


def session_counts(ticks: DataFrame, gap="30 minutes", delay="2 hours", key="symbol") -> DataFrame:
    """Rows and span of each activity session of a key."""
    return (ticks.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n"))


def without_repeats(rows: DataFrame, keys, delay="2 hours") -> DataFrame:
    """First row per key inside the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def repeated_rows(rows: DataFrame, keys) -> DataFrame:
    """Batch form: how often each key was seen, for those seen more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def running_moments(scores: DataFrame) -> DataFrame:
    """n, sum and sum of squares per (test, arm): all an A/B test needs."""
    return scores.groupBy("test", "arm").agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"))


def test_from_moments(moments: DataFrame) -> DataFrame:
    """Pooled t statistic of arm A against arm B from the running sums."""
    pick = lambda c, a: F.max(F.when(F.col("arm") == a, F.col(c)))
    m = moments.groupBy("test").agg(*[pick(c, a).alias(f"{c}_{a}") for c in ("n", "s", "ss") for a in ("A", "B")])
    mean = lambda a: F.col(f"s_{a}") / F.col(f"n_{a}")
    left = lambda a: F.col(f"ss_{a}") - F.col(f"s_{a}") * mean(a)
    pooled = F.sqrt((left("A") + left("B")) / (F.col("n_A") + F.col("n_B") - 2))
    diff = mean("A") - mean("B")
    return m.select("test", "n_A", "n_B", diff.alias("difference"), F.try_divide(diff, pooled * F.sqrt(1 / F.col("n_A") + 1 / F.col("n_B"))).alias("statistic"))


def run_available(stream: DataFrame, mode: str = "append", write=None) -> DataFrame:
    """Process what is there and return the stored result.

    Append goes to a file sink; other modes pass each batch to `write(df, path, batch_id)` (default: one folder per
    batch).  State and results live in the shared folder, so the query restarts from its checkpoint.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append" and write is None:
        query = sink.format("parquet").option("path", f"{folder}/rows").start()
    else:
        def each(df, batch_id):
            df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/rows/b={batch_id}")
        query = sink.foreachBatch(write or each).start()
    query.awaitTermination()
    return spark.read.schema(stored_schema(stream, mode, write)).parquet(f"{folder}/rows")


def stored_schema(stream: DataFrame, mode: str, write):
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    if mode == "append" and write is None:
        return stream.schema
    return StructType([*stream.schema.fields, StructField("batch", LongType()), StructField("b", IntegerType())])


def newest(rows: DataFrame, keys) -> DataFrame:
    """Newest stored state of each key of a query in update mode, open windows included."""
    values = [c for c in rows.columns if c not in (*keys, "b", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "b").alias("_v")).select(*keys, "_v.*")


def last_batch(rows: DataFrame) -> DataFrame:
    """Result of the newest batch of a query in complete mode."""
    newest = rows.agg(F.max("b").alias("_b"))
    return rows.join(F.broadcast(newest), F.col("b") == F.col("_b")).drop("_b", "b", "batch")
