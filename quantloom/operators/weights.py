"""Portfolio weights: simple schemes on Spark, small convex problems in batches, risk decomposition, checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import div
from quantloom.operators.sets import top_per_key

# ---- closed forms -----------------------------------------------------------------------------------------------------


def share_of(df: DataFrame, raw: Column, keys, out="w") -> DataFrame:
    """raw / sum of raw per key; sums are combined map-side and joined back."""
    d = df.withColumn("_raw", raw)
    t = d.groupBy(*keys).agg(F.sum("_raw").alias("_t"))
    return d.join(t, list(keys)).withColumn(out, div("_raw", "_t")).drop("_raw", "_t")


def equal_weights(members: DataFrame, keys=("portfolio",)) -> DataFrame:
    return share_of(members, F.lit(1.0), keys)


def inverse_volatility_weights(returns: DataFrame, members: DataFrame, keys=("portfolio",)) -> DataFrame:
    vol = returns.groupBy("symbol").agg(F.stddev_samp("ret").alias("volatility"))
    return share_of(members.join(vol, "symbol"), div(F.lit(1.0), "volatility"), keys)


def risk_contributions(weights: DataFrame, cov: DataFrame, keys=("problem",)) -> DataFrame:
    """(keys, symbol i, w) with (keys, i, j, cov): w (Sw) / variance, (Sw) / volatility and concentration.

    A join and a sum per asset; the covariance table has as many rows as asset pairs of the universe.
    """
    k = list(keys)
    wj = weights.select(*k, F.col("symbol").alias("j"), F.col("w").alias("_wj"))
    m = cov.join(wj, [*k, "j"]).groupBy(*k, "i").agg(F.sum(F.col("cov") * F.col("_wj")).alias("_m"))
    r = weights.join(m.withColumnRenamed("i", "symbol"), [*k, "symbol"])
    v = r.groupBy(*k).agg(F.sum(F.col("w") * F.col("_m")).alias("variance"))
    return r.join(v, k).select(*k, "symbol", "w", div(F.col("w") * F.col("_m"), F.col("variance")).alias("contribution"),
                               div("_m", F.sqrt("variance")).alias("marginal"), F.sqrt("variance").alias("volatility"))


def risk_budget(contributions: DataFrame, keys=("problem",)) -> DataFrame:
    c = F.col("contribution")
    return contributions.groupBy(*keys).agg(F.max("volatility").alias("total_risk"), F.sum(c * c).alias("risk_concentration"),
                                            div(F.lit(1.0), F.sum(c * c)).alias("effective_bets"), F.max(c).alias("largest"), F.min(c).alias("smallest"))


def factor_exposures(weights: DataFrame, loadings: DataFrame, keys=("problem",)) -> DataFrame:
    """(keys, factor, exposure) from long loadings (symbol, factor, b)."""
    return weights.join(loadings, "symbol").groupBy(*keys, "factor").agg(F.sum(F.col("w") * F.col("b")).alias("exposure"))


def factor_decomposition(exposures: DataFrame, factor_cov: DataFrame, variance: DataFrame, keys=("problem",)) -> DataFrame:
    """exposure^2 x own factor variance over the portfolio variance, per factor, and what is left as specific."""
    own = factor_cov.where("i = j").select(F.col("i").alias("factor"), F.col("cov").alias("_v"))
    f = exposures.join(F.broadcast(own), "factor").join(variance, list(keys)).select(
        *keys, "factor", div(F.col("exposure") ** 2 * F.col("_v"), "variance").alias("share"))
    rest = f.groupBy(*keys).agg((1 - F.sum("share")).alias("share")).select(*keys, F.lit("specific").alias("factor"), "share")
    return f.unionByName(rest)


# ---- batches of small convex problems -----------------------------------------------------------------------------------
def quadratic(p, q, a, low, high, rounds=3000, tol=1e-9):
    """min x'Px/2 + q'x with low <= Ax <= high by operator splitting; one factorisation per problem."""
    scale = max(np.abs(np.diag(p)).max(), 1e-300)
    p, q = p / scale, q / scale
    size = np.linalg.norm(a, axis=1)
    a, low, high = a / size[:, None], low / size, high / size
    rho = np.where(high - low < 1e-12, 100.0, 1.0)
    k = np.linalg.inv(p + 1e-9 * np.eye(len(q)) + a.T @ (rho[:, None] * a))
    x, z, y = np.zeros(len(q)), np.zeros(len(low)), np.zeros(len(low))
    for _ in range(rounds):
        old = x
        x = k @ (1e-9 * x - q + a.T @ (rho * z - y))
        ax = a @ x
        z = np.clip(ax + y / rho, low, high)
        y = y + rho * (ax - z)
        if np.abs(x - old).max() < tol and np.abs(ax - z).max() < tol * 10:
            break
    return x


def simplex_rows(n, extra=None, low=(), high=()):
    a = np.vstack([np.ones(n), np.eye(n), *([extra] if extra is not None else [])])
    return a, np.r_[1.0, np.zeros(n), low], np.r_[1.0, np.ones(n), high]


def tidy(w):
    w = np.maximum(w, 0.0)
    return w / w.sum()


def solve_weights(objective, mu, sigma, risk_aversion=1.0, loadings=None, target=None, tolerance=0.1):
    """Long-only weights that sum to one."""
    n = len(mu)
    zero = np.zeros(n)
    if objective == "mean_variance":
        return tidy(quadratic(risk_aversion * sigma, -mu, *simplex_rows(n)))
    if objective in ("min_variance", "equal_marginal"):
        return tidy(quadratic(sigma, zero, *simplex_rows(n)))
    if objective == "max_diversification":
        sd = np.sqrt(np.diag(sigma))
        return tidy(tidy(quadratic(sigma / np.outer(sd, sd), zero, *simplex_rows(n))) / sd)
    if objective in ("equal_risk", "risk_budget"):
        budget = np.full(n, 1.0 / n) if objective == "equal_risk" else np.asarray(target, float) / np.sum(target)
        x = np.sqrt(budget / np.diag(sigma))
        for _ in range(500):                                   # coordinate minimum of x'Sx/2 - sum b ln x
            before = x.copy()
            for i in range(n):
                c = sigma[i] @ x - sigma[i, i] * x[i]
                x[i] = (-c + np.sqrt(c * c + 4 * sigma[i, i] * budget[i])) / (2 * sigma[i, i])
            if np.abs(x - before).max() < 1e-13 * x.max():
                break
        return tidy(x)
    if objective == "factor_exposure":
        b, t = np.atleast_2d(loadings), np.atleast_1d(target)
        return tidy(quadratic(risk_aversion * sigma, -mu, *simplex_rows(n, b, t - tolerance, t + tolerance)))
    if objective == "target_return":
        return tidy(quadratic(sigma, zero, *simplex_rows(n, mu[None, :], [target], [target])))
    raise ValueError(f"unknown objective {objective}")


def _problem(pdf: pd.DataFrame):
    names = sorted(pdf["i"].unique())
    sigma = pdf.pivot(index="i", columns="j", values="cov").loc[names, names].to_numpy(float)
    mu = pdf[pdf["i"] == pdf["j"]].set_index("i")["mean"].loc[names].to_numpy(float)
    return names, mu, sigma


def optimal_weights(problems: DataFrame, objectives=("mean_variance", "min_variance", "max_diversification", "equal_risk"),
                    key="problem", **settings) -> DataFrame:
    """(key, i, j, cov, mean of i) to (key, objective, symbol, w).

    Means and covariances come from Spark aggregates; one group is one problem, of the size of its universe.
    """
    kind = dict(problems.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, mu, sigma = _problem(pdf)
        out = [pd.DataFrame({key: pdf[key].iloc[0], "objective": o, "symbol": names, "w": solve_weights(o, mu, sigma, **settings)})
               for o in objectives]
        return pd.concat(out)
    return problems.groupBy(key).applyInPandas(run, f"{key} {kind}, objective string, symbol string, w double")


def efficient_frontier(problems: DataFrame, points: int = 100, key="problem") -> DataFrame:
    """Least risk for `points` target returns between the smallest and the largest mean."""
    kind = dict(problems.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, mu, sigma = _problem(pdf)
        rows = []
        for k, t in enumerate(np.linspace(mu.min(), mu.max(), points)):
            w = solve_weights("target_return", mu, sigma, target=t)
            rows.append((pdf[key].iloc[0], k, float(t), float(w @ mu), float(np.sqrt(w @ sigma @ w))))
        return pd.DataFrame(rows, columns=[key, "point", "target", "expected_return", "risk"])
    return problems.groupBy(key).applyInPandas(run, f"{key} {kind}, point long, target double, expected_return double, risk double")


def black_litterman(problems: DataFrame, views: list[dict], delta=2.5, tau=0.05, key="problem") -> DataFrame:
    """(key, i, j, cov, mean, market weight of i) to prior and posterior means per asset.

    Views are absolute {asset, expected_return}, relative {asset_a, asset_b, expected_outperformance} or portfolio
    {weights, expected_return}, each with an uncertainty `confidence` (default 0.01).
    """
    kind = dict(problems.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, _, sigma = _problem(pdf)
        at = {n: i for i, n in enumerate(names)}
        w = pdf[pdf["i"] == pdf["j"]].set_index("i")["w"].loc[names].to_numpy(float)
        prior = delta * sigma @ w
        pick, value, doubt = np.zeros((len(views), len(names))), [], []
        for row, v in zip(pick, views):
            legs = v.get("weights") or ({v["asset"]: 1.0} if "asset" in v else {v["asset_a"]: 1.0, v["asset_b"]: -1.0})
            for name, size in legs.items():
                row[at[name]] = size
            value.append(v.get("expected_return", v.get("expected_outperformance")))
            doubt.append(v.get("confidence", 0.01))
        spread = tau * sigma @ pick.T                    # updates by view, so a singular covariance needs no inverse
        posterior = prior + spread @ np.linalg.solve(pick @ spread + np.diag(doubt), np.asarray(value) - pick @ prior)
        return pd.DataFrame({key: pdf[key].iloc[0], "symbol": names, "prior": prior, "posterior": posterior})
    return problems.groupBy(key).applyInPandas(run, f"{key} {kind}, symbol string, prior double, posterior double")


# ---- checks of weight tables -----------------------------------------------------------------------------------------------
def violation(name, kind, value, limit, excess, hit) -> Column:
    return F.when(hit, F.struct(name.cast("string").alias("constraint"), F.lit(kind).alias("kind"), value.cast("double").alias("value"),
                                limit.cast("double").alias("limit"), excess.cast("double").alias("excess")))


def position_violations(w: DataFrame, low=0.0, high=0.1, volatility_factor=0.0, liquidity_factor=0.0, key="portfolio") -> DataFrame:
    """Weights outside [low, high]; the upper bound shrinks with volatility and with missing liquidity."""
    top = F.lit(high)
    if volatility_factor:
        top = top * F.greatest(1 - F.col("volatility") * volatility_factor, F.lit(0.1))
    if liquidity_factor:
        top = top * F.greatest(1 - (1 - F.col("liquidity")) * liquidity_factor, F.lit(0.1))
    x = F.col("w")
    hits = F.array_compact(F.array(violation(F.col("symbol"), "position_min", x, F.lit(low), low - x, x < low),
                                   violation(F.col("symbol"), "position_max", x, top, x - top, x > top)))
    return w.select(key, F.inline(hits))


def group_violations(w: DataFrame, limits: dict, group="sector", correlations: dict | None = None, key="portfolio") -> DataFrame:
    """Group weights outside their (low, high); a mean correlation above .7 lowers the upper bound."""
    table = F.create_map(*[x for g, (lo, hi) in limits.items() for x in (F.lit(g), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))])
    corr = F.lit(0.0)
    if correlations:
        corr = F.coalesce(F.create_map(*[F.lit(v) for kv in correlations.items() for v in kv])[F.col(group)], F.lit(0.0))
    a = w.where(F.col(group).isin(*limits)).groupBy(key, group).agg(F.sum("w").alias("_w"))
    # a limited group that a portfolio does not hold at all has weight zero
    every = w.select(key).distinct().select(key, F.explode(F.array(*[F.lit(g) for g in limits])).alias(group))
    a = every.join(a, [key, group], "left").fillna(0.0, ["_w"])
    lo, hi = table[F.col(group)]["lo"], table[F.col(group)]["hi"] * F.when(corr > 0.7, 1 - (corr - 0.7) * 0.5).otherwise(1.0)
    x = F.col("_w")
    return a.select(key, F.inline(F.array_compact(F.array(violation(F.col(group), f"{group}_min", x, lo, lo - x, x < lo),
                                                          violation(F.col(group), f"{group}_max", x, hi, x - hi, x > hi)))))


def turnover_metrics(pairs: DataFrame, key="portfolio") -> DataFrame:
    """(key, symbol, current, target) to total, one-way, buy, sell, net turnover, largest and number of trades."""
    t = F.col("target") - F.col("current")
    buy, sell = F.sum(F.greatest(t, F.lit(0.0))), F.sum(F.greatest(-t, F.lit(0.0)))
    return pairs.groupBy(key).agg(F.sum(F.abs(t)).alias("total_turnover"), buy.alias("one_way_turnover"), sell.alias("sell_turnover"), F.sum(t).alias("net_turnover"),
                                  F.max(F.abs(t)).alias("largest_trade"), F.count_if(F.abs(t) > 1e-6).alias("trades"))


def turnover_violations(pairs: DataFrame, limit: float, one_way=False, key="portfolio") -> DataFrame:
    kind = "one_way_turnover" if one_way else "total_turnover"
    m = turnover_metrics(pairs, key)
    x = F.col(kind)
    return m.select(key, F.inline(F.array_compact(F.array(violation(F.lit("turnover"), kind, x, F.lit(limit), x - limit, x > limit)))))


ESG_SCORES = ("esg", "environmental", "social", "governance", "carbon", "controversy")


def esg_metrics(w: DataFrame, key="portfolio") -> DataFrame:
    """Weighted scores, and the weight of green and of excluded assets."""
    flag = lambda c: F.sum(F.when(F.col(c), F.col("w")).otherwise(0.0))
    return w.groupBy(key).agg(*[F.sum(F.col("w") * F.coalesce(c, F.lit(0.0))).alias(c) for c in ESG_SCORES], flag("green").alias("green"), flag("excluded").alias("excluded"))


def esg_violations(metrics: DataFrame, minimum_score: float, maximum_carbon: float, key="portfolio") -> DataFrame:
    e, c, x = F.col("esg"), F.col("carbon"), F.col("excluded")
    return metrics.select(key, F.inline(F.array_compact(F.array(
        violation(F.lit("esg"), "esg_score", e, F.lit(minimum_score), minimum_score - e, e < minimum_score),
        violation(F.lit("esg"), "exclusions", x, F.lit(0.0), x, x > 0),
        violation(F.lit("esg"), "carbon", c, F.lit(maximum_carbon), c - maximum_carbon, c > maximum_carbon)))))


def whole_violations(w: DataFrame, max_leverage=1.0, top_n=5, max_top=0.5, key="portfolio") -> DataFrame:
    """Sum of |w| above the leverage, negative weights, and the weight of the n largest."""
    a = w.groupBy(key).agg(F.sum(F.abs("w")).alias("_l"), F.min("w").alias("_min"))
    top = top_per_key(w.select(key, "symbol", "w"), [key], [F.desc("w"), "symbol"], top_n).groupBy(key).agg(F.sum("w").alias("_top"))
    j = a.join(top, key)
    lev, low, t = F.col("_l"), F.col("_min"), F.col("_top")
    return j.select(key, F.inline(F.array_compact(F.array(
        violation(F.lit("leverage"), "leverage", lev, F.lit(max_leverage), lev - max_leverage, lev > max_leverage + 1e-6),
        violation(F.lit("leverage"), "short", low, F.lit(0.0), -low, low < -1e-6),
        violation(F.lit("concentration"), "top_n", t, F.lit(max_top), t - max_top, t > max_top + 1e-6)))))


def adjusted_limits(limits: DataFrame, conditions: DataFrame) -> DataFrame:
    """Position, sector and turnover limits (kind, limit, sensitivity) under each market condition row.

    Both tables are small by nature (rules, regimes), so one of them is broadcast.
    """
    d = conditions.join(F.broadcast(limits), F.lit(True))
    s, stress, vol = F.col("sensitivity"), F.col("stress"), F.col("volatility")
    one = F.lit(1.0)
    position = F.greatest(F.lit(0.5), 1 - stress * s) * F.when(vol > 0.3, F.greatest(F.lit(0.7), 1 - vol * s * 0.5)).otherwise(one)
    sector = F.when(stress > 0.5, F.greatest(F.lit(0.7), 1 - stress * s * 0.3)).otherwise(one) * F.when(F.col("correlation_regime") == "high", 1 - s * 0.2).otherwise(one)
    turnover = F.greatest(F.lit(0.3), F.least(1 - vol * s * 0.5, F.col("liquidity"), 1 - stress * s * 0.3))
    factor = F.when(F.col("kind") == "position", position).when(F.col("kind") == "sector", sector).otherwise(turnover)
    return d.withColumn("adjusted", F.col("limit") * F.when(s == 0, one).otherwise(factor))


# Default cost rates.
LINEAR_COST, IMPACT_COST, FIXED_COST = 0.001, 0.0001, 0.0


def rebalance_costs(pairs: DataFrame, value: float = 1.0, linear=LINEAR_COST, impact=IMPACT_COST, fixed=FIXED_COST, key="portfolio") -> DataFrame:
    """Turnover, linear + quadratic + fixed cost, distance of the weights, and the parts of the shortfall."""
    t = F.col("target") - F.col("current")
    a = pairs.groupBy(key).agg(F.sum(F.abs(t)).alias("turnover"), F.sum(t * t).alias("_sq"), F.count_if(F.abs(t) > 1e-6).alias("_n"))
    u = F.col("turnover")
    return a.select(key, "turnover", (u * value).alias("traded_value"), (linear * u + impact * F.col("_sq") + fixed * F.col("_n")).alias("cost"),
                    F.sqrt("_sq").alias("distance"), (impact * u).alias("temporary_impact"), (0.5 * impact * u).alias("permanent_impact"),
                    (0.001 * u).alias("timing_risk"), (linear * u).alias("opportunity_cost"),
                    ((1.5 * impact + 0.001 + linear) * u).alias("shortfall"))


def rebalance_trades(pairs: DataFrame, value: float) -> DataFrame:
    t = F.col("target") - F.col("current")
    return pairs.withColumns({"trade": t, "trade_value": t * value, "side": F.when(t > 0, "BUY").when(t < 0, "SELL").otherwise("HOLD")})


def validate_weights(w: DataFrame, key="portfolio") -> DataFrame:
    """Totals and the four checks: sum near one, negatives, a weight above one half, many tiny positions."""
    x = F.col("w")
    a = w.groupBy(key).agg(F.sum(x).alias("total"), F.count_if(F.abs(x) > 1e-6).alias("positions"), F.max(x).alias("largest"), F.min(x).alias("smallest"),
                           F.count_if((F.abs(x) > 0) & (F.abs(x) < 0.01)).alias("_tiny"), F.count(F.lit(1)).alias("_n"))
    return a.select(key, "total", "positions", "largest", "smallest", (F.abs(F.col("total") - 1) <= 0.01).alias("is_valid"), (F.col("smallest") < 0).alias("negative"),
                    (F.col("largest") > 0.5).alias("concentrated"), (F.col("_tiny") > 0.3 * F.col("_n")).alias("many_tiny"))
