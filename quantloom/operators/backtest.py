"""Orders, costs, positions and results as table jobs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions.scalar import div
from quantloom.operators.joins import asof_join
from quantloom.operators.series import Series


def position_size(signal_value, price, strength, confidence, cash, held, signal_type, max_share=0.1) -> Column:
    """Shares for one signal against a snapshot: bounded by the largest share, the cash and the holding."""
    wanted = F.least(signal_value * F.abs(strength) * confidence, signal_value * max_share) / price
    shares = (F.when(signal_type == "BUY", F.least(wanted, cash / price))
              .when(signal_type == "SELL", F.least(wanted, F.coalesce(held, F.lit(0.0)))).otherwise(wanted))
    return F.greatest(shares, F.lit(0.0))


def trigger_band(orders: DataFrame) -> DataFrame:
    """Price band [low, high] in which an order executes; a missing bound is open."""
    t, buy = F.col("order_type"), F.col("side") == "BUY"
    limit, stop = F.col("price"), F.col("stop_price")
    low = (F.when((t == "LIMIT") & ~buy, limit).when((t == "STOP") & buy, stop)
           .when((t == "STOP_LIMIT") & buy, stop).when((t == "STOP_LIMIT") & ~buy, limit))
    high = (F.when((t == "LIMIT") & buy, limit).when((t == "STOP") & ~buy, stop)
            .when((t == "STOP_LIMIT") & buy, limit).when((t == "STOP_LIMIT") & ~buy, stop))
    return orders.withColumns({"_low": low, "_high": high})


SLOT, CELLS = 20_000, 1 << 22          # orders of a symbol that meet its bars at once; order x bar cells compared at once


def first_executions(orders: DataFrame, bars: DataFrame, order_keys=("order_id",)) -> DataFrame:
    """First bar after each order whose close lies in its band, and the execution price; orders without one are left out, as are those with a null key.

    Orders and bars meet by symbol, and those of a symbol with many orders in slots, of which each gets the symbol's bars, a list bounded by the calendar.  An order travels once and is
    compared in arrays with the bars of its symbol: no row is made per order and bar or month.
    """
    keys, names = list(order_keys), orders.columns
    slots = orders.groupBy("symbol").agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("int").alias("_slots"))
    o = trigger_band(orders.dropna(subset=keys)).withColumns({"_low": F.col("_low").cast("double"), "_high": F.col("_high").cast("double")})
    o = o.join(slots, "symbol").withColumn("_slot", F.pmod(F.xxhash64(*keys), "_slots").cast("int")).select(*names, "_low", "_high", "_slot")
    b = bars.select("symbol", F.col("ts").alias("bar_ts"), F.col("close").cast("double").alias("close")).join(slots, "symbol")
    b = b.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))).select("symbol", "_slot", "bar_ts", "close")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bar_ts")
        days, close = right["bar_ts"].to_numpy(), right["close"].to_numpy()
        ts, low, high = (left[c].to_numpy()[:, None] for c in ("ts", "_low", "_high"))
        hit = np.full(left.num_rows, -1)
        step = max(CELLS // max(len(days), 1), 1)
        for at in range(0, left.num_rows if len(days) else 0, step):
            t, lo, hi = (x[at:at + step] for x in (ts, low, high))
            ok = (days > t) & (np.isnan(lo) | (close >= lo)) & (np.isnan(hi) | (close <= hi))
            hit[at:at + step] = np.where(ok.any(axis=1), ok.argmax(axis=1), -1)
        found = np.flatnonzero(hit >= 0)
        bar = right.take(hit[found])
        out = left.take(found).select(names)
        return out.append_column("fill_ts", bar["bar_ts"]).append_column("_hit", bar["close"])
    schema = StructType([*orders.schema.fields, StructField("fill_ts", bars.schema["ts"].dataType), StructField("_hit", DoubleType())])
    j = o.groupBy("symbol", "_slot").cogroup(b.groupBy("symbol", "_slot")).applyInArrow(run, schema)
    close, limit, buy = F.col("_hit"), F.col("price"), F.col("side") == "BUY"
    bounded = F.col("order_type").isin("LIMIT", "STOP_LIMIT")
    price = F.when(bounded & buy, F.least(close, limit)).when(bounded, F.greatest(close, limit)).otherwise(close)
    return j.select(*names, "fill_ts", price.alias("fill_price"))


LARGE_ORDER = 10_000


def fill_steps(orders: DataFrame, qty="qty") -> DataFrame:
    """A large order fills by half of the rest per step until at most 10,000 remain, then in full."""
    q = F.col(qty)
    halvings = F.when(q > LARGE_ORDER, F.ceil(F.log2(q / LARGE_ORDER))).otherwise(0)
    step = F.explode(F.sequence(F.lit(0).cast("long"), halvings.cast("long"))).alias("step")
    d = orders.select("*", halvings.alias("_h"), step)
    part = F.when(F.col("step") < F.col("_h"), q / F.pow(F.lit(2.0), F.col("step") + 1)).otherwise(q / F.pow(F.lit(2.0), F.col("_h")))
    return d.withColumn("fill_qty", part).drop("_h")


# Fixed values of the cost model.
COST = {"per_share": 0.005, "percent": 0.001, "minimum": 1.0, "maximum": 50.0, "spread_bps": 5, "spread_share": 0.5,
        "impact": 0.1, "exponent": 0.6, "sell_factor": 1.1, "adv": 1_000_000.0, "slippage_bps": 2.0, "volatility": 0.2}


def rolling_volatility(bars: DataFrame, window=20) -> DataFrame:
    """(symbol, ts, volatility) of the last changes, annualised."""
    s = Series(bars.select("symbol", "ts", "close"))
    change = s.let(s.pct(s.close))
    return s.frame({"volatility": F.stddev_samp(change).over(s.last_rows(window)) * math.sqrt(252)}, keep=["symbol", "ts"])


def fill_costs(fills: DataFrame, bars: DataFrame, adv: DataFrame | None = None, c=COST) -> DataFrame:
    """Commission, spread, impact and slippage of each fill (symbol, ts, side, qty, price)."""
    d = asof_join(fills, rolling_volatility(bars), ["symbol"], "ts", ["volatility"], "nearest").drop("matched_ts")
    d = d.join(adv.select("symbol", "adv"), "symbol", "left") if adv is not None else d.withColumn("adv", F.lit(None).cast("double"))
    q, v = F.col("qty"), F.coalesce("volatility", F.lit(c["volatility"]))
    value = q * F.col("price")
    commission = F.least(F.greatest(q * c["per_share"], value * c["percent"], F.lit(c["minimum"])), F.lit(c["maximum"]))
    spread = value * F.floor(c["spread_bps"] * (1 + v)) / 10000 * c["spread_share"]
    rate = q / F.coalesce("adv", F.lit(c["adv"]))
    impact = c["impact"] * F.pow(rate, c["exponent"]) * (1 + 0.5 * v) * F.when(F.col("side") == "SELL", c["sell_factor"]).otherwise(1.0)
    slip = value * c["slippage_bps"] * (1 + v) / 10000
    out = d.withColumns({"commission": commission, "spread_cost": spread, "impact_cost": value * impact * 100 / 10000, "slippage": slip})
    return out.withColumn("total_cost", F.col("commission") + F.col("spread_cost") + F.col("impact_cost") + F.col("slippage"))


def daily_values(fills: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """(portfolio, ts, cash, holdings, total) on every calendar day from the first to the last fill of a portfolio.

    A position's value changes on days with a fill or a price; only these days are rows, of which each gives the change to the position's day before.  The changes are added
    up per portfolio and day, and the calendar is laid out over the portfolios alone.  Prices count from a position's first fill on; until the first one it is worth nothing.
    """
    flow = F.col("qty") * F.col("price") + F.coalesce("cost", F.lit(0.0))       # signed quantity: buying pays
    net = fills.groupBy("portfolio", "symbol", "ts").agg(F.sum("qty").alias("_q"), F.sum(flow).alias("_f"))
    first = net.groupBy("portfolio", "symbol").agg(F.min("ts").alias("_from"), F.max("ts").alias("_last"))
    span = first.groupBy("portfolio").agg(F.min("_from").alias("_start"), F.max("_last").alias("_to"))
    bars = first.join(span, "portfolio").join(prices.select("symbol", "ts", "close"), "symbol").where("ts BETWEEN _from AND _to")
    none = F.lit(None).cast("double")
    rows = bars.select("portfolio", "symbol", "ts", "close", none.alias("_q"), none.alias("_f")).unionByName(
        net.select("portfolio", "symbol", "ts", none.alias("close"), F.col("_q").cast("double").alias("_q"), F.col("_f").cast("double").alias("_f")))
    rows = rows.groupBy("portfolio", "symbol", "ts").agg(F.max("close").alias("close"), F.sum("_q").alias("_q"), F.sum("_f").alias("_f"))
    s = Series(rows, ["portfolio", "symbol"])
    held = s.let(s.running_sum(F.coalesce("_q", F.lit(0.0))))
    price = s.let(F.last("close", ignorenulls=True).over(s.order.rowsBetween(Window.unboundedPreceding, 0)))
    worth = s.let(F.coalesce(held * price, F.lit(0.0)))
    change = s.frame({"_d": worth - F.coalesce(s.lag(worth), F.lit(0.0))}, keep=["portfolio", "ts", "_f"])
    change = change.groupBy("portfolio", "ts").agg(F.sum("_d").alias("_d"), F.sum("_f").alias("_f"))
    days = span.select("portfolio", F.explode(F.sequence(F.col("_start"), F.col("_to"), F.expr("INTERVAL 1 DAY"))).alias("ts"))
    p = Series(days.join(change, ["portfolio", "ts"], "left"), ["portfolio"])
    holdings = p.let(p.running_sum(F.coalesce("_d", F.lit(0.0))))
    cash = p.let(capital - p.running_sum(F.coalesce("_f", F.lit(0.0))))
    return p.frame({"holdings": holdings, "cash": cash, "total": cash + holdings}, keep=["portfolio", "ts"]).select("portfolio", "ts", "holdings", "cash", "total")


def result_summary(values: DataFrame, trades: DataFrame, capital: float) -> DataFrame:
    """Final capital, total return, trades, winners and losers per portfolio."""
    end = values.groupBy("portfolio").agg(F.max_by("total", "ts").alias("final_capital"))
    t = trades.groupBy("portfolio").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("winning"),
                                        F.count_if(F.col("pnl") < 0).alias("losing"))
    return end.join(t, "portfolio", "left").select("portfolio", "final_capital", (F.col("final_capital") / capital - 1).alias("total_return"),
                                                   "trades", "winning", "losing")


def signal_log_value(signals: DataFrame, capital: float = 1.0, keys=("strategy", "symbol")) -> DataFrame:
    """Value that grows by one percent of the strength per signal."""
    s = Series(signals, list(keys))
    return s.frame({"value": capital * s.running_product(s.let(1 + 0.01 * F.col("strength")))}, keep=[*keys, "ts"])
