"""Student-t fits by maximum likelihood, for all keys at once.

A round is one pass: every row meets its key's trial parameters, and a dozen sums per key (combined map-side) give the log likelihood there, its gradient and its
second derivatives in location, log scale and log degrees of freedom.  A trial that lowers the likelihood is taken back and its step cut; otherwise the next trial is a
Newton step, or, where the likelihood is not concave, an expectation-maximisation step with a gradient step in the degrees.  The table of keys, one row each, is
stored after every round; keys that have converged leave, so the rows of the others are all that is read.  The size of a key does not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.functions.linear import dot, solve_symmetric
from quantloom.functions.stats import digamma, log_gamma, trigamma
from quantloom.operators.series import Layers
from quantloom.session import checkpointed

#: Beyond so many degrees of freedom the likelihood is taken to rise without end: the normal limit.  Below the least the fit is held there.
MOST, LEAST = 10_000.0, 0.2
_A, _D = "_a", "_b"         # log of the squared scale, log of the degrees of freedom


def _start(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Moments: (keys, n, mean, population deviation, parameters to start from)."""
    m = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.kurtosis(x).alias("_k"))
    dof = F.when(F.col("_k") > 0, F.least(4 + 6 / F.col("_k"), F.lit(100.0))).otherwise(100.0)
    return m.select(*keys, "n", "mean", "sd", F.when(F.col("sd") > 0, F.ln(F.col("sd") * F.col("sd") * (dof - 2) / dof)).alias(_A), F.ln(dof).alias(_D))


def _sums(x: Column, mean: Column, a: Column, nu: Column) -> dict[str, Column]:
    """What a row adds to its key's derivatives; u is its squared distance in scales."""
    s2 = F.exp(a)
    d = x - mean
    u = d * d / s2
    r = 1 / (nu + u)
    w = (nu + 1) * r
    return {"log": F.log1p(u / nu), "w": w, "wd": w * d, "wu": w * u, "r": r, "mm": w / s2 * (2 * r * u - 1), "ma": w * d / s2 * (r * u - 1), "aa": 0.5 * w * u * (r * u - 1),
            "mn": r * (1 - w) * d / s2, "an": 0.5 * r * (1 - w) * u}


def _derivatives(ly: Layers) -> tuple[Column, list[Column], list[list[Column]]]:
    """Log likelihood, gradient and second derivatives at the trial parameters, in (location, log squared scale, log degrees)."""
    n, nu, s2 = F.col("n").cast("double"), ly.let(F.exp(F.col("_tb"))), ly.let(F.exp(F.col("_ta")))
    S = {k: F.col(f"_s_{k}") for k in ("log", "w", "wd", "wu", "r", "mm", "ma", "aa", "mn", "an")}
    like = n * (log_gamma((nu + 1) / 2) - log_gamma(nu / 2) - 0.5 * (F.ln(nu * math.pi) + F.col("_ta"))) - (nu + 1) / 2 * S["log"]
    g_nu = ly.let(0.5 * (n * (digamma((nu + 1) / 2) - digamma(nu / 2) - 1 / nu) - S["log"] + S["wu"] / nu))
    h_nu = 0.5 * (n * (0.5 * trigamma((nu + 1) / 2) - 0.5 * trigamma(nu / 2) + 1 / (nu * nu) + 1 / nu) - S["r"] + 2 * S["an"] / nu - S["wu"] / (nu * nu))
    gradient = [ly.let(S["wd"] / s2), ly.let(0.5 * S["wu"] - 0.5 * n), ly.let(nu * g_nu)]
    mm, ma, mb, aa, ab = S["mm"], S["ma"], ly.let(nu * S["mn"]), S["aa"], ly.let(nu * S["an"])
    bb = ly.let(nu * nu * h_nu + nu * g_nu)
    return like, gradient, [[mm, ma, mb], [ma, aa, ab], [mb, ab, bb]]


def _advance(state: DataFrame, sums: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The open keys after a round: accepted parameters and likelihood, the next trial, and whether the key is done."""
    ly = Layers(state.join(sums, keys))
    like, g, h = _derivatives(ly)
    like = ly.let(like)
    slack = 1e-12 * F.abs(F.coalesce(F.col("_like"), F.lit(0.0))) + 1e-12            # rounding is no fall
    better = ly.let(F.col("_like").isNull() | (like >= F.col("_like") - slack))
    minus = [[ly.let(-v) for v in row] for row in h]
    m2 = minus[0][0] * minus[1][1] - minus[0][1] * minus[0][1]
    m3 = (minus[0][0] * (minus[1][1] * minus[2][2] - minus[1][2] * minus[1][2]) - minus[0][1] * (minus[0][1] * minus[2][2] - minus[1][2] * minus[0][2])
          + minus[0][2] * (minus[0][1] * minus[1][2] - minus[1][1] * minus[0][2]))
    concave = ly.let((minus[0][0] > 0) & (m2 > 0) & (m3 > 0))
    newton = solve_symmetric(ly.let, minus, g)
    n, nu = F.col("n").cast("double"), F.exp(F.col("_tb"))
    # expectation-maximisation of location and scale; the degrees go up or down their gradient
    move = F.col("_s_wd") / F.col("_s_w")
    em = [move, F.ln((F.col("_s_wu") * F.exp(F.col("_ta")) - move * F.col("_s_wd")) / F.col("_s_w")) - F.col("_ta"), F.signum(g[2]) * F.least(F.abs(g[2]) / n * 4, F.lit(0.7))]
    step = [ly.let(F.when(concave, a).otherwise(b)) for a, b in zip(newton, em)]
    longest = ly.let(F.greatest(F.abs(step[0]) / F.exp(F.col("_ta") / 2), F.abs(step[1]), F.abs(step[2])))
    cut = ly.let(F.when(longest > 1.5, 1.5 / longest).otherwise(1.0))
    gain = ly.let(dot(step, g))                                                        # rise to expect, twice over
    names = {"mean": "_tm", _A: "_ta", _D: "_tb"}
    out = {"_like": F.when(better, like).otherwise(F.col("_like"))}
    for k, (own, trial) in enumerate(names.items()):
        out[own] = F.when(better, F.col(trial)).otherwise(F.col(own))
        out[f"_step{k}"] = F.when(better, step[k] * cut).otherwise(F.col(f"_step{k}") / 4)
    out["dof_like"] = nu
    out["done"] = (F.when(better, (F.abs(gain) < tolerance) & concave).otherwise(F.greatest(*[F.abs(f"_step{k}") for k in (1, 2)]) < 1e-9)
                   | (better & (F.col("_tb") >= math.log(MOST))) | (better & (F.col("_tb") <= math.log(LEAST)) & (g[2] < 0)))
    d = ly.frame({f"_n{c}": e for c, e in out.items()}, keep=[*keys, "n", "rounds", "sd"])
    d = d.select(*keys, "n", "sd", (F.col("rounds") + 1).alias("rounds"), *[F.col(f"_n{c}").alias(c) for c in out if c != "dof_like"])
    held = lambda c: F.least(F.greatest(c, F.lit(math.log(LEAST))), F.lit(math.log(MOST)))
    return d.withColumns({"_tm": F.col("mean") + F.col("_step0"), "_ta": F.col(_A) + F.col("_step1"), "_tb": held(F.col(_D) + F.col("_step2"))})


def student_fit(rows: DataFrame, keys=("symbol",), x: str = "ret", rounds: int = 80, tolerance: float = 1e-12, trace: list | None = None) -> DataFrame:
    """(keys, n, dof, location, scale, log_likelihood, rounds): the maximum likelihood fit of a Student-t to each key's values.

    Where the likelihood rises without end in the degrees of freedom, dof is null and location, scale and log_likelihood are those of the normal limit (mean, population
    deviation).  A constant key has scale 0 and null dof and log_likelihood.  Null values are left out; a key without values is not returned; null keys are a key.  The start are the
    moments, and of several maxima the one reached from there is returned.  A key that has not converged after `rounds` keeps its best parameters.  `trace` receives each round's table.
    """
    keys = list(keys)
    present = F.struct(*[F.col(k) for k in keys])                       # one struct, so that null keys meet
    d = checkpointed(rows.where(F.col(x).isNotNull()).select(present.alias("_key"), F.col(x).cast("double").alias("_x")))
    start = checkpointed(_start(d, ["_key"], "_x"))
    flat = start.where(F.col(_A).isNull())
    none = F.lit(None).cast("double")
    state = start.where(F.col(_A).isNotNull()).select("_key", "n", "sd", F.lit(0).alias("rounds"), none.alias("_like"), "mean", _A, _D, *[F.lit(0.0).alias(f"_step{k}") for k in range(3)],
                                                      F.lit(False).alias("done"), F.col("mean").alias("_tm"), F.col(_A).alias("_ta"), F.col(_D).alias("_tb"))
    finished = []
    for _ in range(rounds):
        trial = state.select("_key", "_tm", "_ta", F.exp("_tb").alias("_nu"))
        parts = _sums(F.col("_x"), F.col("_tm"), F.col("_ta"), F.col("_nu"))
        sums = d.join(trial, "_key").select("_key", *[e.alias(f"_s_{k}") for k, e in parts.items()]).groupBy("_key").agg(*[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in parts])
        after = checkpointed(_advance(state, sums, ["_key"], tolerance))
        if trace is not None:
            trace.append(after)
        finished.append(after.where("done"))
        state = after.where("NOT done")
        if not state.take(1):
            break
    else:
        finished.append(state)
    done = finished[0]
    for f in finished[1:]:
        done = done.unionByName(f)
    dof = F.exp(_D)
    normal = dof >= MOST * 0.999
    limit = -F.col("n") / 2 * (1 + math.log(2 * math.pi) + 2 * F.ln("sd"))
    moments = start.select(F.col("_key").alias("_k2"), F.col("mean").alias("_mean"))
    done = done.join(moments, F.col("_key").eqNullSafe(F.col("_k2")), "left")
    out = done.select("_key", "n", F.when(~normal, dof).alias("dof"), F.when(normal, F.col("_mean")).otherwise(F.col("mean")).alias("location"),
                      F.when(normal, F.col("sd")).otherwise(F.exp(F.col(_A) / 2)).alias("scale"), F.when(normal, limit).otherwise(F.col("_like")).alias("log_likelihood"), "rounds")
    out = out.unionByName(flat.select("_key", "n", none.alias("dof"), F.col("mean").alias("location"), F.col("sd").alias("scale"), none.alias("log_likelihood"), F.lit(0).alias("rounds")))
    return out.select(*[F.col("_key")[k].alias(k) for k in keys], "n", "dof", "location", "scale", "log_likelihood", "rounds")
