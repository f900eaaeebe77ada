"""Time-aware joins: as-of, adjustment by later events, window assignment, key alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import TRADING_DAYS, div
from quantloom.operators.sets import top_per_key


def align(frames: list[DataFrame], on, minimum: int = 0, keys=()) -> DataFrame:
    """Inner time alignment of several frames without nulls; keys with fewer rows than `minimum` are left out."""
    out = reduce(lambda a, b: a.join(b, on), frames).dropna()
    if minimum and keys:
        enough = out.groupBy(*keys).count().where(F.col("count") >= minimum).select(*keys)
        out = out.join(enough, list(keys), "left_semi")
    return out


def align_outer(a: DataFrame, b: DataFrame, on, values, fill=0.0) -> DataFrame:
    """Union of keys; a value that one side lacks is `fill`."""
    return a.join(b, on, "full_outer").fillna(fill, list(values))


def asof_join(left: DataFrame, right: DataFrame, keys, ts: str, values, direction: str = "backward",
              bucket: str = "month") -> DataFrame:
    """Each left row with the right row of its key at the same time, or the nearest one in the given direction.

    `direction` is backward, forward or nearest (ties go forward).  Right rows are reduced to one per (key, time), the largest; left rows travel with all their columns, so nothing
    is joined back.  Rows are cut into time buckets: inside a bucket a window carries the value, across buckets a table of one row per (key, bucket) does, so a hot key is
    spread over its buckets.  Rows with a null key or time match nothing.  Both sides are read twice.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    keys, values = list(keys), list(values)
    named = [f"_k{i}" for i in range(len(keys))]
    head = [*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col(ts).alias("_t")]
    seen = F.struct(F.col(ts).alias("at"), *values)
    kind, row = right.select(seen.alias("v")).schema["v"].dataType, F.struct(*left.columns)
    row_kind = left.select(row.alias("l")).schema["l"].dataType
    marks = right.where(F.col(ts).isNotNull()).groupBy(*head).agg(F.max(seen).alias("_v"))
    both = left.select(*head, row.alias("_l"), F.lit(None).cast(kind).alias("_v")).unionByName(marks.withColumn("_l", F.lit(None).cast(row_kind)))
    both = both.withColumn("_b", F.date_trunc(bucket, F.col("_t")))
    per = both.groupBy(*named, "_b").agg(F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    across, upto = Window.partitionBy(*named).orderBy("_b"), (Window.unboundedPreceding, Window.currentRow)
    found = {}          # each direction is a running value, forward in falling order of time; rows of one time see each other
    if direction != "forward":
        found["back"] = (F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)),
                         F.last("_v", True).over(Window.partitionBy(*named, "_b").orderBy("_t").rangeBetween(*upto)))
    if direction != "backward":
        found["fwd"] = (F.last("_first", True).over(Window.partitionBy(*named).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)),
                        F.last("_v", True).over(Window.partitionBy(*named, "_b").orderBy(F.desc("_t")).rangeBetween(*upto)))
    carry = per.select(*named, "_b", *[far.alias(f"_far_{n}") for n, (far, _) in found.items()])
    j = both.withColumns({f"_near_{n}": near for n, (_, near) in found.items()}).where("_l IS NOT NULL").join(carry, [*named, "_b"], "left")
    value = {n: F.coalesce(f"_near_{n}", f"_far_{n}") for n in found}
    if direction == "nearest":
        back, fwd = value["back"], value["fwd"]
        gap = lambda v: F.abs(F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(v["at"].cast("timestamp")))
        hit = F.when(back.isNull(), fwd).when(fwd.isNull(), back).when(gap(fwd) <= gap(back), fwd).otherwise(back)
    else:
        hit, = value.values()
    known = F.col("_t").isNotNull()
    for n in named:
        known = known & F.col(n).isNotNull()
    return j.select("_l", F.when(known, hit).alias("_hit")).select(
        *[F.col("_l")[c].alias(c) for c in left.columns], F.col("_hit.at").alias("matched_ts"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def adjust_for_actions(bars: DataFrame, actions: DataFrame, inclusive: bool = True, end=None,
                       prices=("open", "high", "low", "close")) -> DataFrame:
    """Prices and volumes restated for later splits and cash dividends, newest action first.

    A split with ratio r maps a price p to p/r and a volume v to v*r, a dividend d maps p to p-d.  Both are affine, so
    the actions after a bar compose to one pair (scale, shift), which follows from running products and sums over the
    actions of the symbol: no range join and no list of actions per bar.  With `inclusive` the bar of the ex-date
    itself is restated too.
    """
    if end is not None:
        actions = actions.where(F.col("ex_date") <= F.lit(end).cast("timestamp_ntz"))
    is_split = F.col("action_type") == "SPLIT"
    steps = actions.select("symbol", F.col("ex_date").alias("ts"), F.lit(1 if inclusive else 0).alias("_kind"),
                           F.when(is_split, 1.0 / F.col("split_ratio")).otherwise(1.0).alias("_m"),
                           F.when(is_split, 0.0).otherwise(F.col("amount")).alias("_d"))
    marks = bars.select("symbol", "ts", F.lit(0 if inclusive else 1).alias("_kind"), F.lit(1.0).alias("_m"), F.lit(0.0).alias("_d"))
    w = Window.partitionBy("symbol").orderBy("ts", "_kind")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("symbol")
    u = steps.unionByName(marks).withColumn("_p", F.coalesce(F.product("_m").over(before), F.lit(1.0)))
    u = u.withColumn("_dp", F.col("_d") * F.col("_p"))
    u = u.select("symbol", "ts", "_kind", "_p", (F.product("_m").over(whole) / F.col("_p")).alias("_scale"),
                 (-(F.sum("_dp").over(whole) - F.coalesce(F.sum("_dp").over(before), F.lit(0.0))) / F.col("_p")).alias("_shift"))
    pairs = u.where(F.col("_kind") == (0 if inclusive else 1)).select("symbol", "ts", "_scale", "_shift")
    j = bars.join(pairs, ["symbol", "ts"])
    out = {c: F.col(c) * F.col("_scale") + F.col("_shift") for c in prices}
    out["volume"] = F.col("volume") / F.col("_scale")
    return j.withColumns(out).select(*bars.columns)


# Fixed value: share of the parent price given to a spun-off position that has no quote.
SPIN_OFF_SHARE = 0.1


def apply_actions(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Positions (portfolio, symbol, qty, avg_cost, price) after the actions of the day, cash rows included.

    One event yields one or two rows; moved positions are merged cost-weighted.  A position matches at most one
    action, so the join is an equi join by symbol.
    """
    j = positions.join(actions, "symbol", "left")
    q, c, p, ratio = F.col("qty"), F.col("avg_cost"), F.col("price"), F.col("ratio")
    row = lambda sym, qty, cost, price, cash=F.lit(0.0): F.struct(
        sym.alias("symbol"), qty.cast("double").alias("qty"), cost.cast("double").alias("avg_cost"),
        price.cast("double").alias("price"), cash.cast("double").alias("cash"))
    own = F.col("symbol")
    kind = F.col("action_type")
    rows = (F.when(kind == "SPLIT", F.array(row(own, q * ratio, c / ratio, p)))
            .when(kind == "DIVIDEND", F.array(row(own, q, c, p, q * F.col("amount"))))
            .when(kind == "SPIN_OFF", F.array(row(own, q, c, p * (1 - SPIN_OFF_SHARE)),
                                              row(F.col("new_symbol"), q * ratio, p * SPIN_OFF_SHARE, p * SPIN_OFF_SHARE)))
            .when(kind == "MERGER", F.array(row(F.col("new_symbol"), q * ratio, c, p)))
            .otherwise(F.array(row(own, q, c, p))))
    e = j.select("portfolio", F.inline(rows))
    return e.groupBy("portfolio", "symbol").agg(
        F.sum("qty").alias("qty"), div(F.sum(F.col("qty") * F.col("avg_cost")), F.sum("qty")).alias("avg_cost"),
        F.sum("cash").alias("cash"))


def walk_forward_rows(rows: DataFrame, start: str | None = None, end: str | None = None, train_days=360, gap_days=1, test_days=90, step_days=30,
                      ts="ts") -> DataFrame:
    """Each row once per window and side (train or test) that holds it, with inclusive date ranges.

    Window i starts i steps after `start`; those whose test ends after `end` do not exist.  The first and last day of the rows (a one-row
    aggregate) stand in for what is not given.  The windows of a row form
    a range of i, so the assignment is arithmetic on the row: no join and no window table.
    """
    out = rows.columns
    span = rows.agg(F.min(ts).cast("date").alias("_first"), F.max(ts).cast("date").alias("_last"))
    rows = rows.join(F.broadcast(span), F.lit(True)) if start is None or end is None else rows
    first = F.col("_first") if start is None else F.lit(start).cast("date")
    final = F.col("_last") if end is None else F.lit(end).cast("date")
    day = F.datediff(F.col(ts), first)
    length = train_days + gap_days + test_days
    last = F.floor((F.datediff(final, first) - length) / step_days)

    def windows(offset, days) -> Column:
        lo = F.greatest(F.ceil((day - offset - days) / step_days), F.lit(0))
        hi = F.least(F.floor((day - offset) / step_days), last)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    side = lambda name, ids: F.transform(ids, lambda i: F.struct(i.alias("window"), F.lit(name).alias("side")))
    both = F.concat(side("train", windows(0, train_days)), side("test", windows(train_days + gap_days, test_days)))
    return rows.select(*out, F.inline(both))


def parameter_grid(spark, **lists) -> DataFrame:
    """All combinations of short parameter lists in a stable order."""
    df = spark.range(1).select()
    for name, values in lists.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_{name}", name))
    return df.orderBy(*[f"_{n}" for n in lists]).select(*lists)


def correlated_pairs(correlations: DataFrame, threshold=0.95) -> DataFrame:
    """Upper triangle of a column correlation table (i, j, corr) beyond the threshold."""
    return correlations.where((F.col("i") < F.col("j")) & (F.abs("corr") > threshold))


def survivorship(tested: DataFrame, initial: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """One row: share of the first universe that vanished, share of the tested one that survived, both verdicts."""
    def share(a, b, how, name):
        part = a.join(b, key, how).agg(F.count(F.lit(1)).alias("_k"))
        return a.agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(part), F.lit(True)).select(div("_k", "_n").alias(name))
    tested, initial, final = (d.select(key).distinct() for d in (tested, initial, final))
    gone = share(initial, final, "left_anti", "disappeared")
    kept = share(tested, final, "left_semi", "survivor_overlap")
    return gone.join(F.broadcast(kept), F.lit(True)).withColumns(
        {"vanished_flag": F.col("disappeared") > 0.2, "survivor_flag": F.col("survivor_overlap") > 0.9})


def trades_before_data(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trades of a known symbol that precede its first bar."""
    first = bars.groupBy("symbol").agg(F.min("ts").alias("_first"))
    return trades.join(first, "symbol").where(F.col("ts") < F.col("_first")).drop("_first")


def future_signals(signals: DataFrame, data: DataFrame) -> DataFrame:
    """Signals later than the last data row (a one-row scalar)."""
    last = data.agg(F.max("ts").alias("_last"))
    return signals.join(F.broadcast(last), F.lit(True)).where(F.col("ts") > F.col("_last")).drop("_last")


def latest_per_strategy(signals: DataFrame, order: str = "seq") -> DataFrame:
    """One signal per (symbol, ts, strategy): the last in `order`."""
    rest = [c for c in signals.columns if c not in ("symbol", "ts", "strategy", order)]
    last = signals.groupBy("symbol", "ts", "strategy").agg(F.max(F.struct(order, *rest)).alias("_r"))
    return last.select("symbol", "ts", "strategy", *[F.col(f"_r.{c}").alias(c) for c in rest])


# Reference sectors in the order of suggestion.
REFERENCE_SECTORS = ("Technology", "Healthcare", "Financials", "Consumer Discretionary", "Consumer Staples",
                     "Industrials", "Energy", "Utilities", "Real Estate", "Materials", "Communication Services")


def missing_sectors(sector_weights: DataFrame, minimum=0.05, n=5) -> DataFrame:
    """Per portfolio the first `n` reference sectors that are absent or below `minimum`."""
    wanted = F.posexplode(F.array(*[F.lit(s) for s in REFERENCE_SECTORS])).alias("_pos", "sector")
    all_pairs = sector_weights.select("portfolio").distinct().select("portfolio", wanted)
    low = all_pairs.join(sector_weights, ["portfolio", "sector"], "left").where(F.coalesce("w", F.lit(0.0)) < minimum)
    return top_per_key(low, ["portfolio"], ["_pos"], n).select("portfolio", "sector", F.col("rank").cast("long").alias("rank"))


def window_performance(rows: DataFrame, keys=("symbol",)) -> DataFrame:
    """(keys, window, side): rows, annualised return and Sharpe ratio."""
    a = rows.groupBy(*keys, "window", "side").agg(
        F.count(F.lit(1)).alias("n"), F.product(1 + F.col("ret")).alias("_g"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    return a.select(*keys, "window", "side", "n", (F.pow("_g", TRADING_DAYS / F.col("n")) - 1).alias("annual"),
                    F.coalesce(div("_m", "_s") * TRADING_DAYS ** 0.5, F.lit(0.0)).alias("sharpe"))


def walk_forward_summary(perf: DataFrame, keys=("symbol",)) -> DataFrame:
    """Out-of-sample mean, population deviation, consistency and the loss against the training side."""
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    w = perf.groupBy(*keys, "window").agg(*[side(s, c).alias(f"{s}_{c}") for s in ("train", "test") for c in ("annual", "sharpe")])
    w = w.dropna().withColumns({"_dr": F.col("train_annual") - F.col("test_annual"), "_ds": F.col("train_sharpe") - F.col("test_sharpe")})
    return w.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.avg("test_annual").alias("mean_return"), F.stddev_pop("test_annual").alias("sd_return"),
        F.avg("test_sharpe").alias("mean_sharpe"), F.avg((F.col("test_annual") > 0).cast("double")).alias("consistency"),
        F.avg("_dr").alias("return_degradation"), F.avg("_ds").alias("sharpe_degradation"),
        F.avg((F.col("_dr") > 0).cast("double")).alias("degradation_consistency"), F.count_if(F.col("_ds") > 1).alias("severe_windows"))


def parameter_stability(best: DataFrame, name="parameter", value="value") -> DataFrame:
    """Mean, population deviation and coefficient of variation of the chosen values per parameter."""
    a = best.groupBy(name).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return a.where("n > 1").withColumn("cv", div("sd", "mean"))
