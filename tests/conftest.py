import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from quantloom.session import local_session
    s = local_session(8, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(n=150, symbols=(1, 2), seed=42, drop=()):
    rng = np.random.default_rng(seed)
    frames = []
    for k in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.005, n))
        frames.append(pd.DataFrame({
            "symbol": k, "ts": pd.date_range("2020-01-01", periods=n), "open": open_,
            "high": np.maximum(open_, close) * (1 + abs(rng.normal(0, 0.005, n))),
            "low": np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.005, n))), "close": close,
            "volume": rng.integers(1, 1000, n).astype(float), "benchmark": 50 + np.cumsum(rng.normal(0, 0.5, n)),
            "market_return": rng.normal(0, 0.01, n)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars_pdf():
    return make_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return spark.createDataFrame(bars_pdf).repartition(4).cache()
