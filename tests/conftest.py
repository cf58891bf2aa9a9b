import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tapegrain.session import build_session, clear
    s = build_session("tests", "local[4]", 4, str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear(s)
    s.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Three random-walk series with open, high, low, close, volume."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(11)
    out = []
    for k, sym in enumerate((1, 2, 3)):
        n = 300
        c = 100 * np.exp(np.cumsum(rng.normal(0.0003 * k, 0.015, n)))
        o = np.roll(c, 1) * (1 + rng.normal(0, 0.004, n))
        o[0] = c[0]
        hi, lo = np.maximum(o, c) * (1 + rng.uniform(0, 0.01, n)), np.minimum(o, c) * (1 - rng.uniform(0, 0.01, n))
        out.append(pd.DataFrame({"symbol": sym, "session": pd.bdate_range("2020-01-01", periods=n).date, "open": o, "high": hi, "low": lo, "close": c,
                                 "volume": rng.integers(1000, 9000, n).astype(float)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, walk):
    return spark.createDataFrame(walk, "symbol bigint, session date, open double, high double, low double, close double, volume double")
