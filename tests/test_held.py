"""Covariances of all held pairs by tiles, against plain pandas and the form by rows."""

import time

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import held as HE, metrics as M


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), int(d), float(np.round(rng.normal(s % 3, 1), 2))) for s in range(30) for d in range(80) if rng.random() < .6]
    rows += [(90, 1, 2.0), (90, 2, 2.0), (90, 3, 2.0), (91, 300, 1.0), (3, 5, 9.0), (3, 5, 8.0), (4, 6, None)]           # constant, no day in common, repeated and null
    weights = [("p", s) for s in [*range(30), 90, 91, 92, 7]] + [("q", s) for s in (1, 2, 90)]
    return spark.createDataFrame(rows, "symbol long, ts long, ret double").repartition(3), spark.createDataFrame(weights, "portfolio string, symbol long")


def close(got, want, keys, values):
    a, b = (d.select(*keys, "n", *values).toPandas().sort_values(keys).reset_index(drop=True) if hasattr(d, "select") else d for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12, atol=1e-13)


@pytest.mark.parametrize("tile, days", [(512, 1024), (7, 16)])
def test_tiles_equal_the_form_by_rows(spark, tables, monkeypatch, tile, days):
    monkeypatch.setattr(HE, "DAYS", days)
    returns, weights = tables
    pairs = M.held_pairs(weights)
    want = M.asset_covariance(returns, pairs)
    close(HE.held_asset_covariance(returns, weights, tile=tile), want, ["i", "j"], ["cov", "corr"])
    keys = ["portfolio", "i", "j"]
    once = returns.dropDuplicates(["symbol", "ts"]).localCheckpoint()
    a = HE.held_shrunk_covariance(once, weights, tile=tile).toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, M.shrunk_asset_covariance(M.asset_covariance(once, pairs), pairs).toPandas().sort_values(keys).reset_index(drop=True), check_exact=False, rtol=1e-12)
    robust = HE.held_robust_covariance(HE.day_lists(returns), weights, 2.0, tile=tile)
    close(robust, M.robust_asset_covariance(returns, weights, threshold=2.0), keys, ["cov"])
    assert HE.held_asset_covariance(returns.limit(0), weights, tile=tile).collect() == []


def test_no_row_per_pair_and_day(spark, tables):
    """The rows that meet in a task are assets, not pairs x days."""
    plan = HE.held_covariance(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "covar" not in plan


def test_a_list_is_sorted_once_for_its_median(spark):
    lists = spark.createDataFrame([(1, [0, 1, 2, 3], [4.0, 1.0, 3.0, 2.0]), (2, [5], [7.0]), (3, [0, 1, 2], [9.0, 9.0, 1.0])], "symbol long, days array<int>, values array<double>")
    x = HE.around_middle(lists.repartition(2))
    assert {r.symbol: (r.days, r["values"]) for r in x.collect()} == {1: ([0, 1, 2, 3], [2.0, -1.0, 1.0, 0.0]), 2: ([5], [0.0]), 3: ([0, 1, 2], [0.0, 0.0, -8.0])}
    long = spark.range(2).selectExpr("id AS symbol", "sequence(0, 39999) AS days", "transform(sequence(0, 39999), i -> CAST((i * 7919 + id) % 40000 AS DOUBLE)) AS values")
    start = time.time()
    assert HE.around_middle(long).selectExpr("aggregate(values, 0D, (a, v) -> a + v) AS s").collect() == [(20000.0,)] * 2
    assert time.time() - start < 20           # some ms a list; sorted once for each of its values, it took minutes
