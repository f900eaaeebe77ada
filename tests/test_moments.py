"""Rolling moments by batch equal Spark's frames."""

import math
import random

from pyspark.sql import Window, functions as F

from quantloom.operators import rolling as R
from quantloom.operators.indicators.statistical import unbiased_kurt, unbiased_skew


def test_moments_by_batch_equal_spark_frames(spark):
    draw = random.Random(3)
    rows = []
    for symbol, n in (("a", 130), ("b", 3), ("c", 60), ("d", 25)):
        for i in range(n):
            x = None if symbol == "a" and i in (40, 41) else math.nan if symbol == "a" and i == 90 else 0.1 if symbol == "c" and i < 30 else draw.gauss(1e5, 0.5)
            rows.append((symbol, i, x))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, ts int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")           # windows reach over batches
    try:
        got = {(r.symbol, r.ts): r for r in R.rolling_features(df, ["x"], (5, 20), [*R.MOMENTS, "median"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cols, plain = [], {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    for n in (5, 20):
        w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
        full = F.count("x").over(w) == n
        cols += [F.when(full, f("x").over(w)).alias(f"x_rolling_{n}_{op}") for op, f in plain.items()]
        cols += [F.when(full, f(F.col("x"), w, n)).alias(f"x_rolling_{n}_{op}") for op, f in (("skew", unbiased_skew), ("kurt", unbiased_kurt))]
    want = df.select("symbol", "ts", *cols).collect()
    assert len(want) == len(got) == len(rows)
    for r in want:
        for name, v in r.asDict().items():
            g = got[r.symbol, r.ts][name]
            if name in ("symbol", "ts"):
                continue
            assert (v is None) == (g is None), (r.symbol, r.ts, name, v, g)
            assert v is None or (math.isnan(v) and math.isnan(g)) or math.isclose(v, g, rel_tol=1e-6, abs_tol=1e-6), (r.symbol, r.ts, name, v, g)
