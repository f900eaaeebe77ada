"""The checks of a signal table read the signals twice, and all that goes by symbol stays where its series lie."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quantloom.operators import signals as SG


def test_signal_checks_take_two_passes(spark):
    rows, start = [], datetime(2024, 1, 1)
    for strategy in ("a", "b"):
        for symbol in ("x", "y", None):
            for i in range(50 if symbol != "y" else 12):
                rows.append((strategy, symbol, start + timedelta(days=i + (20 if i > 30 else 0)), "BUY" if i % 3 else "HOLD", (i % 7) / 10, 0.5 + (i % 5) / 10))
    rows += [rows[0], rows[0], ("a", "x", rows[3][2], "SELL", 0.2, 0.4), ("b", "y", None, "BUY", -30.0, None), ("b", "y", None, "BUY", 0.1, 0.3)]
    df = spark.createDataFrame(rows, "strategy string, symbol string, ts timestamp, signal_type string, strength double, confidence double")
    reads = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            reads.add(len(f))
            yield f
    seen = df.coalesce(1).mapInPandas(count, df.schema)
    made = SG.validate_signals(seen, df)
    got = {(r.strategy, r.rule): r.value for r in made.collect()}
    assert reads.value <= 2 * len(rows)                                            # seven before
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*signal_type", plan)              # no exchange of all signals for the duplicates
    assert [got[s, "duplicates"] for s in "ab"] == [2, 1]
    assert [got[s, "gaps"] for s in "ab"] == [2, 2]
    assert [got[s, "outliers"] for s in "ab"] == [0, 1]
    m, x = [], [abs(r[4]) for r in sorted((r for r in rows if r[:2] == ("b", "x")), key=lambda r: r[2])]
    m = [sum(x[i - 10:i]) / 10 for i in range(10, len(x))]
    mean = sum(m) / len(m)
    assert abs(got["b", "signal_stability"] - (1 - (sum((v - mean) ** 2 for v in m) / len(m)) ** 0.5 / mean)) < 1e-9
    assert made.where(F.col("rule") == "duplicates").where("passed").isEmpty()
