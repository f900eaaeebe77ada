"""User aggregates in two phases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import user as US


def chunks():
    # a local class: the tests' folder is not on the workers' path
    class Chunks(US.Aggregate):
        """Sum, rows, and the most rows that a single task has folded for the key."""

        def start(self):
            return {"sum": 0.0, "rows": 0, "most": 0}

        def add(self, state, rows):
            n = state["rows"] + len(rows)
            return {"sum": state["sum"] + rows["x"].sum(), "rows": n, "most": n}

        def merge(self, a, b):
            return {"sum": a["sum"] + b["sum"], "rows": a["rows"] + b["rows"], "most": max(a["most"], b["most"])}

        def finish(self, state):
            return [state["sum"], float(state["rows"]), float(state["most"])]
    return Chunks()


def test_hot_key_is_never_in_one_task(spark):
    n, parts = 30000, 24
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000 + 100).alias("key"), F.col("id").cast("double").alias("x")).repartition(parts)
    got = {r.key: r.value for r in US.partial_aggregate(df, ["key"], ["x"], chunks(), kind="array<double>", fan=4).collect()}
    want = df.groupBy("key").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()
    assert {k: v[:2] for k, v in got.items()} == {r.key: [r.s, r.n] for r in want}
    assert got[7][1] == n / 3 and got[7][2] <= 2 * n / 3 / parts                   # a task folds its share only


def test_equals_the_one_phase_form(spark, monkeypatch):
    from quantloom.plans.datasets import TickSpread
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"a": rng.integers(0, 5, 900), "quantity": rng.integers(1, 50, 900).astype(float), "price": rng.normal(size=900) + 1e6})
    df = spark.createDataFrame(d).repartition(7)
    got = {r.a: r.value for r in US.partial_aggregate(df, ["a"], ["quantity", "price"], TickSpread(), fan=3).collect()}
    for k, g in d.groupby("a"):
        m = np.average(g.price, weights=g.quantity)
        assert got[k] == pytest.approx(np.average((g.price - m) ** 2, weights=g.quantity) ** .5)


def test_keys_of_any_kind(spark):
    big = (1 << 62) + 1                                                             # does not survive a float
    rows = [(big, "x", 1.0), (big, None, 2.0), (None, "x", 3.0), (None, "x", 4.0), (big - 1, "x", None), (None, None, 5.0)]
    df = spark.createDataFrame(rows, "a long, b string, x double").repartition(3)
    got = {(r.a, r.b): r.value[0] for r in US.partial_aggregate(df, ["a", "b"], ["x"], chunks(), kind="array<double>").collect()}
    assert got == {(big, "x"): 1.0, (big, None): 2.0, (None, "x"): 7.0, (big - 1, "x"): 0.0, (None, None): 5.0}
    assert US.partial_aggregate(df.limit(0), ["a"], ["x"], chunks(), kind="array<double>").collect() == []


def test_states_are_put_out_early(spark, monkeypatch):
    monkeypatch.setattr(US, "MOST_STATES", 10)
    df = spark.range(2000).select((F.col("id") % 400).alias("key"), F.lit(1.0).alias("x")).coalesce(2)
    got = US.partial_aggregate(df, ["key"], ["x"], chunks(), kind="array<double>").collect()
    assert len(got) == 400 and all(r.value[0] == 5.0 for r in got)


def test_search_says_why_a_run_failed(spark):
    def objective(pdf, level):
        if level > 1:
            raise ValueError("too high")
        return pdf.x.mean() * level
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "symbol long, x double")
    got = {r.level: r for r in US.search_parameters(df, "symbol", "level", [1, 2], objective).collect()}
    assert got[1.0].score == 3.0 and got[1.0].error is None and got[2.0].score == float("-inf") and got[2.0].error == "ValueError: too high"


def test_state_after_many_actions_is_that_of_each_in_turn():
    from itertools import product

    from quantloom.streaming.monitor import next_state, state_after
    for start in ("none", "active", "acknowledged", "cleared"):
        for n in range(5):
            for some in product(("open", "ack", "clear"), repeat=n):
                want = start
                for a in some:
                    want = next_state(want, a)
                assert state_after(start, np.array(some, dtype=object)) == want


def test_rows_of_a_key_are_folded_together(spark):
    """Keys that come back in every batch are not added a few rows at a time."""
    calls = spark.sparkContext.accumulator(0)
    base = type(chunks())

    class Counted(base):
        def add(self, state, rows):
            calls.add(1)
            return base.add(self, state, rows)
    df = spark.range(30000, numPartitions=6).select((F.col("id") % 300).alias("key"), F.lit(1.0).alias("x"))
    got = US.partial_aggregate(df, ["key"], ["x"], Counted(), kind="array<double>").collect()
    assert len(got) == 300 and all(r.value[0] == 100 for r in got) and calls.value <= 330           # was 1,800: a call for each key of each task
