"""Position rules held as rows against pandas loops; set-ups on hand-made bars."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapegrain.operators import setups as S


@pytest.fixture(scope="module")
def closes():
    rng = np.random.default_rng(12)
    days = [x.date() for x in pd.bdate_range("2020-01-01", periods=160)]
    return {s: pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.03, 160))), days) for s in ("a", "b")}


def plain(kind, c, p):
    if kind == "buy_and_hold":
        return [1] * len(c)
    if kind == "sma_cross":
        fast, slow = (c.rolling(int(p[k])).mean() for k in ("fast", "slow"))
        return (fast > slow).astype(int).tolist()
    if kind == "macd_cross":
        ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
        m = ema(c, 12) - ema(c, 26)
        return (m > ema(m, 9)).astype(int).tolist()
    n, d = int(p["period"]), c.diff()
    up, dn = (x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
    state, out = 0, []
    for r in 100 - 100 / (1 + up / dn):
        state = 0 if r > p["sell_above"] else 1 if r < p["buy_below"] else state
        out.append(state)
    return out


def test_rules_as_rows(spark, closes):
    rules = [(1, "buy_and_hold", None), (2, "sma_cross", {"fast": 5.0, "slow": 20.0}), (3, "sma_cross", {}), (4, "rsi", {"period": 5.0, "buy_below": 35.0, "sell_above": 60.0}), (5, "rsi", {"period": 5.0, "buy_below": 60.0, "sell_above": 40.0}), (6, "macd_cross", None)]
    bars = spark.createDataFrame([(s, d, float(v)) for s, c in closes.items() for d, v in c.items()], "symbol string, session date, close double")
    table = spark.createDataFrame(rules, "rule_id int, kind string, params map<string,double>")
    got = {(r["rule_id"], r["symbol"], r["session"]): r["position"] for r in S.rule_positions(bars, table).collect()}
    assert len(got) == 6 * 320
    for k, kind, p in rules:
        for s, c in closes.items():
            assert [got[k, s, d] for d in c.index] == plain(kind, c, S.POSITION_RULES[kind] | (p or {})), (k, s)
    for bad in (("x", "nothing", None), ("x", "rsi", {"buy": 1.0})):
        with pytest.raises(ValueError):
            S.rule_positions(bars, spark.createDataFrame([bad], "rule_id string, kind string, params map<string,double>"))
    assert S.rule_positions(bars, table.limit(0)).count() == 0


COLUMNS = {"symbol": "long", "session": "date", "ts": "timestamp", "slot": "int", "mod": "int", "open": "double", "high": "double", "low": "double", "close": "double", "vwap_s": "double", "open_d": "double", "prev_close": "double",
           "atr_prev": "double", "gap": "double", "dist": "double", "relvol": "double", "sess_low": "double"}
DAY = dt.date(2020, 3, 2)


def session(spark, bars, **daily):
    """Bars (minute, close, vwap, low so far, relvol) of one session and yesterday's features."""
    rows = [(1, DAY, dt.datetime(2020, 3, 2) + dt.timedelta(minutes=m), i, m, c, c + 0.5, c - 0.5, c, v, 10.0, 9.0, 2.0, 0.5, (c - v) / 2, r, lo) for i, (m, c, v, lo, r) in enumerate(bars)]
    x = spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))
    base = dict(close=9.0, high=9.5, low=8.5, rsi_2=50.0, rsi_3=50.0, sma50=8.0, sma200=20.0, sma50_slope=0.1, bw=1.0, bw_rank=0.9, high20=99.0, sum4=36.0) | daily
    d = spark.createDataFrame([(1, DAY, *base.values())], "symbol long, session date, " + ", ".join(f"{k}_y double" for k in base))
    reg = spark.createDataFrame([(1, DAY - dt.timedelta(days=3), "bull"), (1, DAY, "bear")], "symbol long, session date, regime string")
    return S.setups(S.context(x, d, reg), F.col("symbol") == 1)


def test_first_trigger_of_each_setup(spark):
    bars = [(585, 9.0, 9.5, 8.0, 1.0), (600, 9.4, 9.5, 8.0, 1.0), (615, 9.8, 9.6, 8.0, 2.0), (630, 10.2, 9.7, 8.0, 2.0), (720, 10.6, 9.8, 8.0, 2.0), (930, 9.9, 9.9, 8.0, 2.0), (945, 9.0, 9.9, 8.0, 2.0)]
    got = {(r["setup"], r["ts"].hour * 60 + r["ts"].minute): r for r in session(spark, bars, rsi_3=20.0).collect() if r["entry"]}
    # below the average price before 10:15, above then: the pullback fires once; a gap holds at 10:30; the low of the day before is taken out and regained
    assert set(got) == {("pullback", 615), ("gap_go", 630), ("liquidity_sweep", 600), ("last_half_hour", 930), ("orb30", 630)}
    assert got["gap_go", 630]["stop_dist"] == pytest.approx(2.2) and got["gap_go", 630]["target_dist"] == 4.0 and got["gap_go", 630]["max_sessions"] == 5
    assert got["liquidity_sweep", 600]["stop_dist"] == pytest.approx(1.6) and got["last_half_hour", 930]["score"] == pytest.approx(9.4 / 9 - 1)
    assert got["orb30", 630]["stop_dist"] == pytest.approx(1.7)  # from the low of the opening bars


def test_no_setup_without_its_day_before(spark):
    bars = [(600, 9.0, 9.5, 9.0, 1.0), (615, 9.8, 9.6, 9.0, 1.0), (630, 8.0, 9.7, 8.6, 1.0)]
    rows = session(spark, bars, rsi_2=5.0, sma200=8.0, sma50=10.0).collect()
    assert [(r["setup"], r["entry"], r["setup_entry"], r["exit_moc"]) for r in sorted(rows, key=lambda r: r["ts"])] == [("vwap_reversion", False, True, False), ("vwap_reversion", False, False, True), ("vwap_reversion", True, False, False)]
