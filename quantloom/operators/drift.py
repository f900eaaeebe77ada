"""Distribution drift, performance drift and controlled experiments.

Samples are rows (feature, side in {baseline, current}, x).  Distinct values are counted map-side and ranked in value
ranges, so a feature with very many rows never meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.functions.scalar import change_severity, div, equal_width_bin, p_value_severity
from quantloom.functions.stats import kolmogorov_tail, normal_tail, student_tail
from quantloom.operators.ranks import average_ranks, cumulative_counts
from quantloom.operators.selection import bootstrap_sums



def _side_counts() -> dict[str, Column]:
    return {"a": F.count_if(F.col("side") == "baseline"), "b": F.count_if(F.col("side") == "current")}


def ks_test(samples: DataFrame, key="feature", minimum=30, level=0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the asymptotic p value."""
    c = cumulative_counts(samples.dropna(subset=["x"]), [key], "x", _side_counts())
    n = c.groupBy(key).agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    gap = F.abs((F.col("a_below") + F.col("a")) / F.col("_na") - (F.col("b_below") + F.col("b")) / F.col("_nb"))
    d = c.join(n.where((F.col("_na") >= minimum) & (F.col("_nb") >= minimum)), key).groupBy(key).agg(
        F.max(gap).alias("statistic"), F.max("_na").alias("n_baseline"), F.max("_nb").alias("n_current"))
    na, nb = F.col("n_baseline"), F.col("n_current")
    p = kolmogorov_tail(F.sqrt(na * nb / (na + nb)) * F.col("statistic"))
    return d.withColumn("p_value", p).withColumn("drift", F.col("p_value") < level)


def mann_whitney(samples: DataFrame, key="feature", level=0.05) -> DataFrame:
    """U of the baseline, normal approximation with tie and continuity correction, effect 1 - 2U/(nm)."""
    r = average_ranks(samples.dropna(subset=["x"]), [key], "x", _side_counts())
    t = (F.col("a") + F.col("b")).cast("double")        # the cube of some 2 million ties is beyond a long
    s = r.groupBy(key).agg(F.sum("a").alias("_n"), F.sum("b").alias("_m"), F.sum(F.col("a") * F.col("rank")).alias("_r"), F.sum(t * t * t - t).alias("_t"))
    n, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    u = F.col("_r") - n * (n + 1) / 2
    total = n + m
    sd = F.sqrt(n * m / 12 * ((total + 1) - F.col("_t") / (total * (total - 1))))
    big = F.greatest(u, n * m - u)
    z = div(big - n * m / 2 - 0.5, sd)
    s = s.select(key, u.alias("statistic"), z.alias("z"), (1 - 2 * u / (n * m)).alias("effect"))
    return s.withColumn("p_value", F.least(normal_tail(F.greatest("z", F.lit(0.0))), F.lit(1.0))).withColumn("drift", F.col("p_value") < level)


def chi_square(samples: DataFrame, key="feature", bins=10) -> DataFrame:
    """Equal-width bins over both samples, counts plus one, expected counts rescaled to the current total."""
    d = samples.dropna(subset=["x"])
    edges = d.groupBy(key).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    b = d.join(edges, key).groupBy(key, equal_width_bin(F.col("x"), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(*[c.alias(n) for n, c in _side_counts().items()])
    every = edges.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    c = every.join(b, [key, "bin"], "left").fillna(0, ["a", "b"]).select(key, (F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"))
    t = c.groupBy(key).agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    e = F.col("a") * F.col("_b") / F.col("_a")
    return c.join(t, key).groupBy(key).agg(F.sum(F.pow(F.col("b") - e, 2) / e).alias("statistic"), F.lit(bins - 1).cast("long").alias("dof"))


def performance_drift(current: DataFrame, baseline: DataFrame, threshold=0.10, keys=("model", "metric")) -> DataFrame:
    """Relative change of a metric against its baseline; drift beyond the threshold."""
    j = current.select(*keys, "value").join(baseline.select(*keys, F.col("value").alias("baseline")), list(keys))
    change = div(F.col("value") - F.col("baseline"), F.abs("baseline"))
    return j.withColumn("change", change).withColumns({"drift": F.abs("change") > threshold, "severity": change_severity("change")})


def drift_alerts(samples: DataFrame, metric_changes: DataFrame) -> DataFrame:
    """Alert rows (kind, entity, severity, value, threshold) for drifting features and metrics."""
    k = ks_test(samples).where("drift").select(F.when(F.col("feature") == "target", "target").otherwise("feature").alias("kind"), F.col("feature").alias("entity"),
                                               p_value_severity("p_value").alias("severity"), F.col("p_value").alias("value"), F.lit(0.05).alias("threshold"))
    p = metric_changes.where("drift").select(F.lit("performance").alias("kind"), F.concat_ws(".", "model", "metric").alias("entity"), "severity",
                                             F.abs("change").alias("value"), F.lit(0.10).alias("threshold"))
    return k.unionByName(p)


# ---- experiments: rows (test, arm in {A, B}, score) --------------------------------------------------------------------------
def student_critical(dof, level=0.95) -> Column:
    """Two-sided critical value by bisection on the distribution; runs on one row per test."""
    @F.pandas_udf("double")
    def f(nu: pd.Series) -> pd.Series:
        nodes, weights = np.polynomial.legendre.leggauss(200)

        def tail(t, n):
            low = math.atan(t / math.sqrt(n))
            half = (math.pi / 2 - low) / 2
            body = np.cos(low + half * (nodes + 1)) ** (n - 1)
            return 2 * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) * half * float(body @ weights)
        out = []
        for n in nu:
            lo, hi = 0.0, 1000.0
            for _ in range(100):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if tail(mid, n) > 1 - level else (lo, mid)
            out.append((lo + hi) / 2)
        return pd.Series(out)
    return f(dof)


def ab_test(scores: DataFrame, level=0.95, minimum=30, minimum_effect=0.0, lower_is_better=False) -> DataFrame:
    """Pooled t test from the moments of both arms: statistic, p, interval, Cohen's d and the winner.

    No winner below the minimum sample, without significance, or below the minimum effect.
    """
    arm = lambda f, a: f(F.when(F.col("arm") == a, F.col("score")))
    m = scores.groupBy("test").agg(*[arm(f, a).alias(f"{n}_{a.lower()}") for a in ("A", "B") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    dof = na + nb - 2
    pooled = F.sqrt(((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b")) / dof)
    m = m.withColumns({"difference": F.col("m_a") - F.col("m_b"), "_pooled": pooled, "_dof": dof})
    se = F.col("_pooled") * F.sqrt(1 / na + 1 / nb)
    m = m.withColumns({"_se": se, "statistic": div("difference", se), "effect": div("difference", "_pooled")})
    m = m.withColumns({"p_value": student_tail("statistic", F.col("_dof")), "_crit": student_critical(F.col("_dof"), level)})
    clear = (F.col("p_value") < 1 - level) & (F.abs("effect") >= minimum_effect) & (F.least("n_a", "n_b") >= minimum)
    better = F.col("difference") < 0 if lower_is_better else F.col("difference") > 0
    return m.select("test", "n_a", "n_b", "difference", "statistic", "p_value", "effect", (F.col("difference") - F.col("_crit") * F.col("_se")).alias("low"),
                    (F.col("difference") + F.col("_crit") * F.col("_se")).alias("high"), F.when(clear, F.when(better, "A").otherwise("B")).alias("winner"))


def bootstrap_difference(scores: DataFrame, id_columns, replicates=1000, seed=42) -> DataFrame:
    """Percentile interval of the mean difference over Poisson bootstraps; weights are hashes of the row ids."""
    r = bootstrap_sums(scores.where(F.col("score").isNotNull()), ["test", *id_columns], ["test", "arm"], ["score"], replicates, seed)
    mean = lambda k: div(F.sum(F.when(F.col("arm") == k, F.col("score"))), F.sum(F.when(F.col("arm") == k, F.col("n"))))
    d = r.groupBy("test", "rep").agg((mean("A") - mean("B")).alias("d"))
    p = F.percentile("d", F.array(F.lit(.025), F.lit(.975)))
    return d.groupBy("test").agg(F.avg("d").alias("difference"), p.alias("_p")).select("test", "difference", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def sample_size(effect, power=0.8, significance=0.05) -> Column:
    """Rows per arm: 2 ((z1 + z2) / effect)^2, rounded up."""
    from statistics import NormalDist
    z = NormalDist().inv_cdf(1 - significance / 2) + NormalDist().inv_cdf(power)
    return F.ceil(2 * F.pow(z / effect, 2)).cast("long")
