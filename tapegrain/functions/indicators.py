"""Technical indicators as window columns over bars(symbol, session, open, high, low, close, volume).

Every function takes and returns a DataFrame; new columns only look back unless the name says
``lead`` or ``lagging``. All windows share one partitioning, so a chain costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import by_time, ewm, full, moving_order, ratio, roll_mean, roll_std, so_far, trailing

KEY, T = "symbol", "session"


def _w(key=KEY, t=T):
    return by_time(key, t)


def sma(x: str, n: int, key=KEY, t=T) -> Column:
    return roll_mean(x, _w(key, t), n)


def rolling_std(x: str, n: int, key=KEY, t=T, min_periods: int | None = None) -> Column:
    return roll_std(x, _w(key, t), n, min_periods)


def true_range(key=KEY, t=T) -> Column:
    pc = F.lag("close").over(_w(key, t))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def add_sma(df: DataFrame, n: int, x: str = "close", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"sma_{n}", sma(x, n))


def add_ema(df: DataFrame, n: int, x: str = "close", out: str | None = None) -> DataFrame:
    return ewm(df, KEY, T, {out or f"ema_{n}": (x, 2.0 / (n + 1), n)})


def add_rsi(df: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    out = out or f"rsi_{n}"
    d = F.col("close") - F.lag("close").over(_w())
    df = df.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
                         "_dn": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    df = ewm(df, KEY, T, {"_au": ("_up", 1.0 / n, n), "_ad": ("_dn", 1.0 / n, n)}, clock="_up")
    rs = ratio("_au", "_ad")
    return df.withColumn(out, 100 - 100 / (1 + rs)).drop("_up", "_dn", "_au", "_ad")


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(df, KEY, T, {"_fast": ("close", 2.0 / (fast + 1), fast), "_slow": ("close", 2.0 / (slow + 1), slow)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ewm(df, KEY, T, {"macd_signal": ("macd", 2.0 / (signal + 1), signal)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def add_bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = sma("close", n), rolling_std("close", n)
    df = df.withColumns({"bb_mid": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd})
    return df.withColumn("bb_pctb", ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))


def add_atr(df: DataFrame, n: int = 14, out: str | None = None, min_periods: int | None = None) -> DataFrame:
    df = df.withColumn("_tr", true_range())
    return ewm(df, KEY, T, {out or f"atr_{n}": ("_tr", 1.0 / n, n if min_periods is None else min_periods)}).drop("_tr")


def add_vwap(df: DataFrame, t: str = "ts", session: str = "session") -> DataFrame:
    """Volume-weighted price since the session's open."""
    w = so_far(Window.partitionBy(KEY, session).orderBy(t))
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap_session", ratio(F.sum(tp * F.col("volume")).over(w), F.sum("volume").over(w)))


def add_stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    w = trailing(_w(), k)
    lo, hi = full(F.min("low"), "low", w, k), full(F.max("high"), "high", w, k)
    df = df.withColumn("stoch_k", 100 * ratio(F.col("close") - lo, hi - lo))
    return df.withColumn("stoch_d", full(F.avg("stoch_k"), "stoch_k", trailing(_w(), d), d))


def add_ichimoku(df: DataFrame) -> DataFrame:
    """Charting lines; ``ichi_lagging`` holds a future close and must never feed a model."""
    def mid(n):
        w = trailing(_w(), n)
        return (full(F.max("high"), "high", w, n) + full(F.min("low"), "low", w, n)) / 2
    df = df.withColumns({"ichi_conv": mid(9), "ichi_base": mid(26), "_m52": mid(52)})
    return df.withColumns({
        "ichi_span_a": F.lag((F.col("ichi_conv") + F.col("ichi_base")) / 2, 26).over(_w()),
        "ichi_span_b": F.lag("_m52", 26).over(_w()),
        "ichi_lagging": F.lead("close", 26).over(_w())}).drop("_m52")


def add_adx(df: DataFrame, n: int = 14, out: str = "adx") -> DataFrame:
    w = _w()
    up = F.col("high") - F.lag("high").over(w)
    dn = F.lag("low").over(w) - F.col("low")
    df = df.withColumns({"_tr": true_range(),
                         "_pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0),
                         "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0)})
    a = 1.0 / n
    df = ewm(df, KEY, T, {"_atr": ("_tr", a, n), "_pdi": ("_pdm", a, n), "_mdi": ("_mdm", a, n)}, clock="_tr")
    pdi, mdi = 100 * ratio("_pdi", "_atr"), 100 * ratio("_mdi", "_atr")
    df = df.withColumn("_dx", 100 * ratio(F.abs(pdi - mdi), pdi + mdi))
    return ewm(df, KEY, T, {out: ("_dx", a, n)}).drop("_tr", "_pdm", "_mdm", "_atr", "_pdi", "_mdi", "_dx")


def trailing_rank(x: str, window: int, min_periods: int | None = None, key=KEY, t=T) -> Column:
    """Share of the earlier rows in the window whose value lies strictly below the current one.

    Rows without a value count in the share's base but not towards ``min_periods``.
    """
    w = trailing(_w(key, t), window)
    vals = F.array_agg(x).over(w)
    rows = F.count(F.lit(1)).over(w)
    below = F.size(F.filter(vals, lambda v: v < F.col(x)))
    return F.when(F.col(x).isNotNull() & (F.size(vals) >= (min_periods or window // 2)) & (rows > 1),
                  below / (rows - 1))


def add_trailing_rank(df: DataFrame, x: str, window: int, min_periods: int | None = None, out: str = "rank", key=KEY, t=T) -> DataFrame:
    """``trailing_rank`` as a moving order statistic: for long windows, no row carries its frame."""
    return moving_order(df, key, t, x, window, below=(out, min_periods or window // 2))


def slope_atr(ma: str, days: int, atr: str) -> Column:
    return ratio(F.col(ma) - F.lag(ma, days).over(_w()), days * F.col(atr))


# --- registry -----------------------------------------------------------------------------------

INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sma_20": lambda d: add_sma(d, 20),
    "sma_50": lambda d: add_sma(d, 50),
    "sma_200": lambda d: add_sma(d, 200),
    "ema_12": lambda d: add_ema(d, 12),
    "ema_26": lambda d: add_ema(d, 26),
    "rsi_14": lambda d: add_rsi(d, 14),
    "macd": add_macd,
    "bb_20": lambda d: add_bollinger(d, 20, 2.0),
    "atr_14": lambda d: add_atr(d, 14),
    "vwap": lambda d: add_vwap(d, t="session"),
    "stoch_14_3": lambda d: add_stochastic(d, 14, 3),
    "ichimoku": add_ichimoku,
}


def with_indicators(df: DataFrame, names: list[str]) -> DataFrame:
    """Add named indicators; an unknown name is an error."""
    for name in names:
        if name not in INDICATORS:
            raise KeyError(f"unknown indicator: {name}")
        df = INDICATORS[name](df)
    return df
