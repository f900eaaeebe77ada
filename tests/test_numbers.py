import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.functions.scalar import business_days_between
from quantloom.functions.stats import chi2_tail_even, chi2_tail_odd, kolmogorov_tail, normal_tail, student_tail
from quantloom.operators import drift, ranks, risk, weights as W
from quantloom.operators.selection import factor_analysis, poisson_weights
from quantloom.operators.stress import normal_draw, uniform


def test_distribution_tails(spark):
    r = spark.range(1).select(
        student_tail(F.lit(2.228138852), F.lit(10)).alias("t"), normal_tail(F.lit(1.959963985)).alias("z"), chi2_tail_even(F.lit(18.307038), 10).alias("c10"),
        chi2_tail_odd(F.lit(11.070498), 5).alias("c5"), chi2_tail_odd(F.lit(3.841459), 1).alias("c1"), kolmogorov_tail(F.lit(1.358099)).alias("k"),
        risk.student_quantile(0.05, F.lit(10.0)).alias("q"), drift.student_critical(F.lit(10.0)).alias("crit")).first()
    for got, want in ((r.t, .05), (r.z, .05), (r.c10, .05), (r.c5, .05), (r.c1, .05), (r.k, .05)):
        assert abs(got - want) < 1e-5
    assert abs(r.q + 1.8124611) < 1e-6 and abs(r.crit - 2.2281389) < 1e-6


def test_business_days(spark):
    days = pd.date_range("2021-01-01", periods=30)
    rows = [(a.date(), b.date(), len(pd.bdate_range(a, b))) for a in days[:10] for b in days[10:]]
    df = spark.createDataFrame(rows, "a date, b date, n long").select("n", business_days_between("a", "b").alias("m"))
    assert df.where("n <> m").count() == 0


def test_hash_draws(spark):
    d = spark.range(20000).select(uniform(F.lit(1), F.col("id")).alias("u"), normal_draw(F.lit(1), F.col("id")).alias("z"))
    a = d.select(F.avg("u").alias("u"), F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(a.u - .5) < .01 and abs(a.m) < .03 and abs(a.s - 1) < .03
    assert abs(poisson_weights(np.arange(20000), np.arange(1, 3), 1).mean() - 1) < .03


def test_ranks_and_quantiles_of_a_hot_key(spark):
    pdf = pd.DataFrame({"k": ["hot"] * 900 + ["cold"] * 50, "v": list(np.round(np.random.default_rng(1).normal(size=950), 1))})
    df = spark.createDataFrame(pdf)
    r = ranks.count_below(df, ["k"], "v").toPandas()
    for k, g in r.groupby("k"):
        assert (g["below"] + 1 == g["v"].rank(method="min")).all() and (g["total"] == len(g)).all()
    q = ranks.exact_quantiles(df, ["k"], "v", [.01, .5, .9], parts=5).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(q.loc[k].to_numpy(float), np.quantile(g["v"], [.01, .5, .9]), atol=1e-12)


def problem(n=4, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 3 * n))
    return rng.uniform(.01, .1, n), a @ a.T / (3 * n) * .04


def test_weights_meet_their_conditions():
    mu, sigma = problem()
    for objective in ("mean_variance", "min_variance", "max_diversification", "equal_risk"):
        w = W.solve_weights(objective, mu, sigma, risk_aversion=5.0)
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    w = W.solve_weights("equal_risk", mu, sigma)
    c = w * (sigma @ w)
    np.testing.assert_allclose(c / c.sum(), .25, atol=1e-8)
    w = W.solve_weights("min_variance", mu, sigma)
    grad = sigma @ w
    assert (grad[w > 1e-6].max() - grad.min()) < 1e-6
    w = W.solve_weights("mean_variance", mu, sigma, risk_aversion=5.0)
    grad = 5 * sigma @ w - mu
    assert (grad[w > 1e-5].max() - grad.min()) < 1e-5
    sd = np.sqrt(np.diag(sigma))
    ratio = lambda x: (x @ sd) / np.sqrt(x @ sigma @ x)
    w = W.solve_weights("max_diversification", mu, sigma)
    rng = np.random.default_rng(0)
    assert all(ratio(w) >= ratio(x) - 1e-7 for x in rng.dirichlet(np.ones(4), 500))
    b = np.array([[1.0, 0.0, -1.0, .5]])
    w = W.solve_weights("factor_exposure", mu, sigma, loadings=b, target=[.2], tolerance=.05)
    assert .15 - 1e-5 <= (b @ w)[0] <= .25 + 1e-5
    t = (mu.min() + mu.max()) / 2
    assert abs(W.solve_weights("target_return", mu, sigma, target=t) @ mu - t) < 1e-6


def test_black_litterman_without_views_on_an_asset(spark):
    mu, sigma = problem()
    names = list("abcd")
    rows = [(1, names[i], names[j], float(sigma[i, j]), float(mu[i]), .25) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "problem long, i string, j string, cov double, mean double, w double")
    out = W.black_litterman(df, [{"asset": "a", "expected_return": .3, "confidence": 1e-9}]).toPandas().set_index("symbol")
    np.testing.assert_allclose(out["prior"], 2.5 * sigma @ np.full(4, .25), rtol=1e-10)
    assert abs(out.loc["a", "posterior"] - .3) < 1e-6
    shift = .05 * sigma[:, 0] / (.05 * sigma[0, 0]) * (.3 - out.loc["a", "prior"])       # conditional normal mean
    np.testing.assert_allclose(out["posterior"], out["prior"] + shift, rtol=1e-5)


def test_factor_analysis_reproduces_correlations(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(size=4000)
    pdf = pd.DataFrame({c: w * f + math.sqrt(1 - w * w) * rng.normal(size=4000) for c, w in (("a", .9), ("b", .7), ("c", .5))})
    got = factor_analysis(spark.createDataFrame(pdf), ["a", "b", "c"], 1).toPandas().set_index("feature")
    np.testing.assert_allclose(abs(got["loading"].loc[["a", "b", "c"]]), [.9, .7, .5], atol=.05)


def test_mann_whitney_of_millions_of_ties(spark):
    rows = spark.range(2_200_000).select(F.lit("x").alias("feature"), F.when(F.col("id") % 2 == 0, "baseline").otherwise("current").alias("side"),
                                         F.when(F.col("id") < 10, 2.0).otherwise(1.0).alias("x"))
    r = drift.mann_whitney(rows).first()
    assert r.statistic == 1_100_000 ** 2 / 2 and r.effect == 0 and r.p_value == 1


def test_ranges_down_to_a_price_of_zero(spark):
    from quantloom.operators.indicators import compute
    from quantloom.plans.kit import rounded
    days = pd.date_range("2020-01-01", periods=40)
    df = pd.DataFrame({"symbol": 1, "ts": days, "open": 2.0, "high": 4.0, "low": 1.0, "close": 3.0, "volume": 1.0})
    df.loc[35, "low"] = 0.0
    for name in ("GarmanKlass", "RogersSatchell", "GarmanKlassTextbook"):
        out = compute(spark.createDataFrame(df), name).orderBy("ts")
        last = out.select(rounded(out.columns[-1])).collect()
        assert [r[0] for r in last[:29]] == [None] * 29 and 0 < last[34][0] < 100 and all(r[0] == math.inf for r in last[35:])


def test_rounding_of_numbers_beyond_a_long(spark):
    from quantloom.plans.kit import rounded
    df = spark.createDataFrame([(1e20,), (-1e20,), (float("-inf"),), (1.23456789,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(rounded("x")).collect()] == [1e20, -1e20, -math.inf, 1.234568, None, None]


def test_a_value_at_the_mean_does_not_hang_on_the_order_of_rows(spark):
    from quantloom.operators import learning as L
    rows = [(1, k, 0.1 * k if k != 3 else 0.3, float(k)) for k in (1, 2, 3)]           # 0.1 + 0.2 + 0.3 is above 0.6 in this order only
    for r in (rows, rows[::-1]):
        got = L.directional_accuracy(spark.createDataFrame(r, "symbol int, ts int, y_true double, y_pred double").coalesce(1), "changes").first()
        assert (got.up_accuracy, got.down_accuracy) == (1.0, 0.5)
