"""Regression imputation from products of gap patterns against the row-by-row form."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import clean as CL


def row_by_row(x, rounds, ridge=1e-3):
    """The sequential form: every fit reads the rows as the fits before have left them."""
    gap = np.isnan(x)
    z = np.where(gap, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        for k in range(x.shape[1]):
            others = [i for i in range(x.shape[1]) if i != k]
            have = ~gap[:, k]
            a, y = z[have][:, others], z[have][:, k]
            c = np.cov(a.T, bias=True).reshape(len(others), -1)
            q = ((a - a.mean(axis=0)) * (y - y.mean())[:, None]).mean(axis=0)
            b = np.linalg.solve(c + ridge * np.diag(np.diag(c)), q)
            z[gap[:, k], k] = y.mean() + (z[gap[:, k]][:, others] - a.mean(axis=0)) @ b
    return z


@pytest.fixture(scope="module")
def gaps():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + [1e5, -3, 0, 40]
    x[rng.random(x.shape) < 0.25] = np.nan
    return x


def frame(spark, x, names):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names)).repartition(5)


@pytest.mark.parametrize("rounds", [1, 4])
def test_fills_as_row_by_row(spark, gaps, rounds):
    df = frame(spark, gaps, "abcd")
    got = CL.regression_fill(df, list("abcd"), rounds=rounds).toPandas().sort_values("id")
    assert got.columns.tolist() == df.columns and len(got) == len(gaps)
    np.testing.assert_allclose(got[list("abcd")].to_numpy(), row_by_row(gaps, rounds), rtol=1e-7, atol=1e-6)


def test_fills_of_many_columns(spark, gaps):
    """Beyond 12 columns every fit is a job over the patterns."""
    rng = np.random.default_rng(7)
    x = np.hstack([gaps, rng.normal(size=(500, 10)) + np.nan_to_num(gaps[:, 1:2])])
    x[rng.integers(0, 500, 40), rng.integers(4, 14, 40)] = np.nan
    names = [f"c{k}" for k in range(14)]
    got = CL.regression_fill(frame(spark, x, names), names, rounds=1).toPandas().sort_values("id")
    np.testing.assert_allclose(got[names].to_numpy(), row_by_row(x, 1), rtol=1e-6, atol=1e-5)


def test_rows_are_read_twice_whatever_the_rounds(spark, gaps):
    df = frame(spark, gaps, "abcd")
    plan = CL.regression_fill(df, list("abcd"), rounds=6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("LogicalRDD") <= 2


def test_fills_on_odd_columns(spark):
    schema = "id int, a double, b double, c double, n int"
    df = spark.createDataFrame([(1, 1.0, 2.0, None, 5), (2, 2.0, None, None, None), (3, None, None, None, 7), (4, 4.0, 8.0, None, 8), (4, 4.0, 8.0, None, 8)], schema)
    rows = {(r.id): r for r in CL.regression_fill(df, ["a", "b", "c"], rounds=50, ridge=0.0).collect()}
    assert rows[2].b == pytest.approx(4.0) and rows[2].c is None and rows[2].n is None and rows[1].a == 1.0 and rows[3].a is not None
    one = CL.regression_fill(df, ["a"], rounds=2).collect()
    assert sorted(r.a for r in one) == [1.0, 2.0, 2.75, 4.0, 4.0]
    flat = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, None), (3, 3.0, 5.0)], "id int, a double, b double")
    assert {r.id: r.b for r in CL.regression_fill(flat, ["a", "b"]).collect()}[2] == pytest.approx(3.0)          # a constant column explains nothing
    assert CL.regression_fill(df.limit(0), ["a", "b"]).collect() == []
