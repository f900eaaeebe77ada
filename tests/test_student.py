"""Grouped Student-t fits against a plain search of the likelihood."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.stats import digamma, log_gamma, trigamma
from quantloom.operators import risk as RK
from quantloom.operators.student import student_fit


def test_gamma_functions(spark):
    xs = [0.02, 0.3, 0.5, 1.0, 2.5, 7.7, 30.0, 4000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma("x").alias("l"), digamma("x").alias("d"), trigamma("x").alias("t")).collect()
    for r in got:
        assert r.l == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-13)
        h = 1e-5 * max(r.x, 0.02)
        assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-4, abs=1e-5)
    values = {r.x: r for r in got}
    assert values[1.0].d == pytest.approx(-0.57721566490153286, abs=1e-14) and values[1.0].t == pytest.approx(math.pi ** 2 / 6, abs=1e-14)
    assert values[0.5].d == pytest.approx(-0.57721566490153286 - 2 * math.log(2), abs=1e-13) and values[0.5].t == pytest.approx(math.pi ** 2 / 2, abs=1e-13)


def likelihood(x, nu, mu, s):
    z = (x - mu) / s
    return len(x) * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - .5 * math.log(nu * math.pi) - math.log(s)) - (nu + 1) / 2 * np.log1p(z * z / nu).sum()


def plain_fit(x):
    p, step = np.array([np.median(x), math.log(x.std() * .8), math.log(4)]), np.array([x.std() * .3, .5, .5])
    f = lambda p: likelihood(x, math.exp(p[2]), p[0], math.exp(p[1]))
    v = f(p)
    while step.max() > 1e-9:
        moved = False
        for i in range(3):
            for sign in (1, -1):
                q = p.copy()
                q[i] += sign * step[i]
                if f(q) > v:
                    p, v, moved = q, f(q), True
        if not moved:
            step = step / 2
    return math.exp(p[2]), p[0], math.exp(p[1]), v


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(1)
    return {"a": rng.standard_t(4, 300) * .02 + .001, "b": rng.standard_t(2.2, 4000) + 1000, "c": rng.standard_t(1, 150), "d": np.round(rng.standard_t(3, 252), 1), None: rng.standard_t(2, 90) * 1e6,
            "normal": np.sort(rng.normal(size=200)).clip(-1.5, 1.5), "two": np.tile([-1., 1.], 50), "flat": np.full(40, 3.0), "one": np.array([2.0])}


def test_fit_as_by_plain_search(spark, samples):
    rows = pd.concat([pd.DataFrame({"symbol": [k] * len(v), "ret": v}) for k, v in samples.items()]).sample(frac=1, random_state=2)
    df = spark.createDataFrame([(k, float(v)) for k, v in rows.itertuples(index=False)] + [("a", None), ("none", None)], "symbol string, ret double").repartition(4)
    trace = []
    got = {r.symbol: r for r in student_fit(df, trace=trace).collect()}
    assert set(got) == set(samples)
    for k in ("a", "b", "c", "d", None):
        dof, location, scale, best = plain_fit(samples[k])
        spread = samples[k].std()
        assert got[k].dof == pytest.approx(dof, rel=1e-5) and abs(got[k].location - location) < 1e-6 * spread and got[k].scale == pytest.approx(scale, rel=1e-5)
        assert got[k].log_likelihood >= best - 1e-8 and got[k].rounds < 30 and got[k].n == len(samples[k])
    for k in ("normal", "two"):                         # short tails: the likelihood rises with the degrees of freedom for ever
        assert got[k].dof is None and got[k].location == pytest.approx(samples[k].mean(), abs=1e-12) and got[k].scale == pytest.approx(samples[k].std())
        assert got[k].log_likelihood == pytest.approx(-len(samples[k]) / 2 * (1 + math.log(2 * math.pi * samples[k].var())))
    assert got["flat"].scale == 0 and got["flat"].dof is None and got["flat"].log_likelihood is None and got["one"].scale == 0
    steps = {}
    for t in trace:                                     # the accepted likelihood never falls, converged keys are read no more
        for r in t.collect():
            steps.setdefault(r._key.symbol, []).append(r._like)
    assert all(b >= a - 1e-9 * abs(a) for v in steps.values() for a, b in zip(v, v[1:]))
    assert min(map(len, steps.values())) < max(map(len, steps.values())) == len(trace)
    assert student_fit(df.limit(0)).collect() == []


def test_student_var_of_the_fit(spark, samples):
    rows = pd.concat([pd.DataFrame({"symbol": k, "ts": pd.date_range("2020-01-01", periods=len(samples[k])), "ret": samples[k]}) for k in ("a", "c", "two")])
    df = spark.createDataFrame(rows)
    got = {r.symbol: r for r in RK.student_var(df, rows=1000).collect()}
    dof, location, scale, _ = plain_fit(samples["a"])
    q = spark.range(1).select(RK.student_quantile(.05, F.lit(dof)).alias("q")).first().q
    assert got["a"].dof == pytest.approx(dof, rel=1e-5) and got["a"].var_95 == pytest.approx(-(location + scale * q), rel=1e-5)
    draws = location + scale * np.random.default_rng(4).standard_t(dof, 2_000_000)
    assert got["a"].cvar_95 == pytest.approx(-draws[draws <= np.quantile(draws, .05)].mean(), rel=.02)
    assert got["c"].dof < 1.2 and got["c"].var_95 > 0 and (got["c"].dof > 1 or got["c"].cvar_95 is None)            # without a mean there is no mean beyond the quantile
    assert got["two"].dof is None
    moments = {r.symbol: r for r in RK.student_var(df, rows=1000, fit="moments").collect()}
    assert moments["a"].dof > 4
    with pytest.raises(ValueError):
        RK.student_var(df, fit="guess")
