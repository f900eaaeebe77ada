"""Limit monitoring, alert life cycle and online model weights."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_breaches(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(portfolio, limit_type, value, threshold, severity) where a metric exceeds an enabled limit.

    A limit with a `portfolio` column holds for that portfolio, one without or with a null for all.  The metrics may be a stream; the planner
    broadcasts the limits where their size allows.
    """
    on = [metrics["limit_type"] == limits["limit_type"], metrics["value"] > limits["threshold"]]
    if "portfolio" in limits.columns:
        on.append(limits["portfolio"].isNull() | (limits["portfolio"] == metrics["portfolio"]))
    j = metrics.join(limits.where("enabled"), on)
    return j.select(metrics["portfolio"], metrics["limit_type"], metrics["ts"], metrics["value"], limits["threshold"], limits["severity"])


def portfolio_metrics(weights: DataFrame, risk: DataFrame) -> DataFrame:
    """Long (portfolio, limit_type, value): largest weight, largest sector, leverage, value at risk, volatility, drawdown."""
    w = weights.groupBy("portfolio").agg(F.max("w").alias("max_weight"), F.sum(F.abs("w")).alias("leverage"))
    sec = weights.groupBy("portfolio", "sector").agg(F.sum("w").alias("_s")).groupBy("portfolio").agg(F.max("_s").alias("max_sector"))
    j = w.join(sec, "portfolio").join(risk.select("portfolio", "var_95", "volatility", F.abs("max_drawdown").alias("max_drawdown")), "portfolio")
    names = ("max_weight", "leverage", "max_sector", "var_95", "volatility", "max_drawdown")
    return j.select("portfolio", F.inline(F.array(*[F.struct(F.lit(n).alias("limit_type"), F.col(n).alias("value")) for n in names])))


def next_state(state: str, action: str) -> str:
    """open activates, ack marks an active alert, clear ends one; anything else leaves the state."""
    if action == "open":
        return "active"
    if action == "ack":
        return "acknowledged" if state == "active" else state
    return "cleared" if state in ("active", "acknowledged") else state


def state_after(state: str, actions: np.ndarray) -> str:
    """`next_state` of all actions in turn.  Only what follows the last open counts, so none is replayed: a clear after it decides, else an ack does."""
    opens = np.flatnonzero(actions == "open")
    if len(opens):
        state, actions = "active", actions[opens[-1] + 1:]
    if state in ("active", "acknowledged") and (actions == "clear").any():
        return "cleared"
    return "acknowledged" if state == "active" and (actions == "ack").any() else state


def alert_states(actions: DataFrame) -> DataFrame:
    """Streaming state per alert id from (alert, ts, seq, action) rows; emits the state after each batch."""
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, seen = state.get if state.exists else ("none", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        current, seen = state_after(current, rows["action"].to_numpy()), seen + len(rows)
        state.update((current, seen))
        yield pd.DataFrame({"alert": [key[0]], "state": [current], "actions": [seen]})
    return actions.groupBy("alert").applyInPandasWithState(
        run, "alert long, state string, actions long", "state string, actions long", "update", GroupStateTimeout.NoTimeout)


def alert_states_batch(actions: DataFrame) -> DataFrame:
    """Batch form: clear decides until the next open; an ack counts only after an open that was not cleared.

    The last open of an alert splits its history; what follows it decides the state.  Two map-side aggregates.
    """
    order = F.struct("ts", "seq")
    last = actions.groupBy("alert").agg(F.max(F.when(F.col("action") == "open", order)).alias("_open"), F.count(F.lit(1)).alias("actions"))
    after = actions.join(last, "alert").where(order > F.col("_open")).groupBy("alert").agg(
        F.max((F.col("action") == "clear").cast("int")).alias("_c"), F.max((F.col("action") == "ack").cast("int")).alias("_k"))
    state = F.when(F.col("_open").isNull(), "none").when(F.col("_c") == 1, "cleared").when(F.col("_k") == 1, "acknowledged").otherwise("active")
    return last.join(after, "alert", "left").select("alert", state.alias("state"), "actions")


def adapt(weights, errors: np.ndarray, before: int = 0, keep: int = 100, rate=0.1, floor=0.01) -> np.ndarray:
    """Weights after one step per row of `errors` (rows x models) from row `before` on, each towards the inverse mean of the last `keep` errors.

    Means come from running sums; the steps are a fading sum of the targets, so no row is handled on its own.
    """
    n, k = errors.shape
    total = np.vstack([np.zeros(k), np.cumsum(errors, axis=0)])
    end = np.arange(before + 1, n + 1)
    start = np.maximum(end - keep, 0)
    new = 1.0 / ((total[end] - total[start]) / (end - start)[:, None] + 1e-8)
    new = np.maximum(new / new.sum(1, keepdims=True), floor)
    new /= new.sum(1, keepdims=True)
    fade = (1 - rate) ** np.arange(len(end) - 1, -1, -1)
    return (1 - rate) ** len(end) * np.asarray(weights) + rate * (fade[:, None] * new).sum(0)


def online_weights(errors: DataFrame, models: list[str], keep: int = 100, rate=0.1, floor=0.01) -> DataFrame:
    """(ensemble, ts, seq, one squared error column per model) to weights per ensemble, one step per row.

    State is the last `keep` errors of each model and the current weights: of fixed size, however long the stream.
    """
    k = len(models)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights, flat, n = state.get if state.exists else ([1.0 / k] * k, [], 0)
        old = np.array(flat, float).reshape(-1, k)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])[models].to_numpy(float)
        every = np.vstack([old, rows])
        weights, n = adapt(weights, every, len(old), keep, rate, floor), n + len(rows)
        state.update(([float(w) for w in weights], [float(v) for v in every[-keep:].ravel()], n))
        yield pd.DataFrame({"ensemble": [key[0]] * k, "model": models, "w": list(weights), "updates": [n] * k})
    return errors.groupBy("ensemble").applyInPandasWithState(
        run, "ensemble string, model string, w double, updates long", "weights array<double>, errors array<double>, n long", "update",
        GroupStateTimeout.NoTimeout)
