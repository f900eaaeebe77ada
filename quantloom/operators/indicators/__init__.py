"""Indicator library: 79 named indicators over bar series.

An indicator is a function `(series, **params) -> {output: Column}` registered with `@indicator`.  Because every one
of them only adds columns to a shared `Series`, a batch of indicators plans as one exchange by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame

from quantloom.operators.series import Series


@dataclass(frozen=True)
class Indicator:
    name: str
    build: Callable
    needs: tuple[str, ...]
    params: dict = field(default_factory=dict)
    lookback: Callable | None = None    # rows before the current one, None = not bounded

    def columns(self, series: Series, **params) -> dict:
        unknown = set(params) - set(self.params)
        if unknown:
            raise ValueError(f"{self.name}: unknown parameters {sorted(unknown)}")
        return self.build(series, **{**self.params, **params})


REGISTRY: dict[str, Indicator] = {}


def indicator(name: str, needs=("close",), lookback=None, **params):
    """Register a user or built-in indicator under `name`."""
    def add(f):
        REGISTRY[name] = Indicator(name, f, tuple(needs), params, lookback)
        return f
    return add


def require_columns(df: DataFrame, needs) -> None:
    missing = [c for c in needs if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def compute(df: DataFrame, name: str, keys=("symbol",), ts="ts", keep=None, block_rows=None, lookback=0,
            **params) -> DataFrame:
    """One indicator beside the key columns."""
    ind = REGISTRY[name]
    require_columns(df, [*keys, ts, *ind.needs])
    s = Series(df.select(*dict.fromkeys([*keys, ts, *(keep or []), *ind.needs])), keys, ts,
               block_rows=block_rows, lookback=lookback)
    return s.frame(ind.columns(s, **params), keep=keep or [*keys, ts])


from quantloom.operators.indicators import (  # noqa: E402,F401
    cross_section, momentum, oscillators, statistical, trend, volatility, volume)
