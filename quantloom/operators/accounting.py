"""Money, positions, average cost and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quantloom.functions.scalar import div, equal_width_bin, is_currency_code
from quantloom.operators.indicators.statistical import gated_mean
from quantloom.operators.series import ROW, Series


def to_currency(money: DataFrame, rates: DataFrame, out: str, value="value", currency="currency") -> DataFrame:
    """Value times the rate of its currency.  Codes are three letters; there are fewer than two hundred of them, so
    the rate table is small by nature."""
    valid = rates.where(is_currency_code(currency))
    return money.join(F.broadcast(valid), currency).withColumn(out, F.col(value) * F.col("rate"))


def position_values(positions: DataFrame, cash: float = 0.0, cash_symbol="CASH") -> DataFrame:
    """Market value, profit and weight per position, with one cash row per portfolio that has cash."""
    p = positions.select("portfolio", "symbol", (F.col("qty") * F.col("price")).alias("market_value"),
                         ((F.col("price") - F.col("avg_cost")) * F.col("qty")).alias("pnl"))
    totals = p.groupBy("portfolio").agg((F.sum("market_value") + cash).alias("_total"))
    rows = p.join(totals, "portfolio")
    if cash > 0:
        rows = rows.unionByName(totals.select(
            "portfolio", F.lit(cash_symbol).alias("symbol"), F.lit(cash).alias("market_value"), F.lit(0.0).alias("pnl"),
            "_total"))
    return rows.select("portfolio", "symbol", "market_value", "pnl", div("market_value", "_total").alias("weight"))


def average_cost(fills: DataFrame, keys=("portfolio", "symbol"), ts="ts", sell_neutral=False, block_rows=None,
                 chunk=None) -> DataFrame:
    """Quantity held and average cost after each fill (signed qty, price), and the realised profit of each sale.

    A sale enters the cost average like a purchase, so cost x quantity is a running sum that starts anew whenever the
    position is closed.  With `sell_neutral` a sale leaves the cost as it is; the average is then a gated mean whose
    gain is the bought share of the new quantity.
    """
    s = Series(fills, keys, ts, block_rows=block_rows, lookback=1, chunk=chunk)
    qty, price = F.col("qty"), F.col("price")
    held, spent = (s.let(c) for c in s.running_all([(F.sum, qty, None), (F.sum, qty * price, None)]))
    if sell_neutral:
        gain = F.when(qty > 0, F.least(div(qty, held), F.lit(1 - 1e-15))).otherwise(F.lit(0.0))
        cost = s.let(gated_mean(s, price, s.let(gain), 1))
    else:
        # spent up to the last closing (a closing row itself has no cost)
        mark = s.let(F.when(held == 0, F.struct(s.row.alias("row"), spent.alias("spent"))))
        base = s.let(s.running_max(mark)["spent"])
        cost = s.let(div(spent - F.coalesce(base, F.lit(0.0)), held))
    pnl = F.when(qty < 0, -qty * (price - s.lag(cost)))
    return s.frame({"fill": s.row, "held": held, "avg_cost": cost, "pnl": pnl})


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) over equal-width bins between the smallest and the largest value."""
    edges = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))      # one row
    binned = df.select(value).join(F.broadcast(edges), F.lit(True)).select(
        equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
