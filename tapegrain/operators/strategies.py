"""Set-up columns: yesterday's daily features, mean-reversion entries and exits, once-per-session rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.functions import indicators as I
from tapegrain.operators.kernels import asof_join, by_time, full, trailing

# Rule sets and their defaults (fixed values); a caller overrides by name.
RULES: dict[str, dict[str, float | str]] = {
    "rsi2_meanrev": {"rsi_period": 2, "rsi_entry": 10.0, "trend_sma": 200, "exit_sma": 5, "exit_mode": "sma", "exit_rsi": 65.0},
    "bollinger_meanrev": {"bb_period": 20, "bb_k": 2.0, "trend_sma": 200},
}


def rules(kind: str, **changes) -> dict[str, float | str]:
    """The defaults of a rule set with the caller's values over them; unknown names are refused."""
    if kind not in RULES:
        raise ValueError(f"unknown rule set {kind}")
    odd = set(changes) - set(RULES[kind])
    if odd:
        raise ValueError(f"{kind} has no {', '.join(sorted(odd))}")
    return RULES[kind] | changes


def lagged_features(bars: DataFrame) -> DataFrame:
    """Daily features as known at the previous close, one row per bar, suffix ``_y``."""
    w = by_time("symbol", "session")
    d = I.add_rsi(I.add_rsi(bars, 2), 3)
    sd = I.rolling_std("close", 20)
    d = d.withColumns({"sma50": I.sma("close", 50), "sma200": I.sma("close", 200), "bw": 4 * sd / I.sma("close", 20),
                       "high20": full(F.max("high"), "high", trailing(w, 20), 20), "sum4": full(F.sum("close"), "close", trailing(w, 4), 4)})
    d = d.withColumns({"sma50_slope": F.col("sma50") - F.lag("sma50", 10).over(w), "bw_rank": I.trailing_rank("bw", 126)})
    names = ["close", "high", "low", "rsi_2", "rsi_3", "sma50", "sma200", "sma50_slope", "bw", "bw_rank", "high20", "sum4"]
    return d.select("symbol", "session", *[F.lag(x).over(w).alias(f"{x}_y") for x in names])


def mean_reversion(bars: DataFrame, kind: str, market: DataFrame | None = None, market_sma: int = 200, **changes) -> DataFrame:
    """``bars`` with entry and exit flags of a rule set; a missing indicator is no signal.

    ``market`` (session, close): entries only while the last market close known is above its mean.
    """
    p = rules(kind, **changes)
    w = by_time("symbol", "session")
    trend = F.col("close") > I.sma("close", int(p["trend_sma"]))
    if kind == "rsi2_meanrev":
        n = int(p["rsi_period"])
        d = I.add_rsi(bars, n)
        entry = trend & (F.col(f"rsi_{n}") < p["rsi_entry"])
        leave = {"sma": F.col("close") > I.sma("close", int(p["exit_sma"])), "rsi": F.col(f"rsi_{n}") > p["exit_rsi"], "first_up": F.col("close") > F.lag("close").over(w)}[str(p["exit_mode"])]
    else:
        d = I.add_bollinger(bars, int(p["bb_period"]), float(p["bb_k"]))
        entry, leave = (F.col("close") < F.col("bb_lower")) & trend, F.col("close") > F.col("bb_mid")
    d = d.withColumns({"entry": F.coalesce(entry, F.lit(False)), "exit": F.coalesce(leave, F.lit(False))})
    if market is None:
        return d
    m = market.withColumn("_m", F.lit(1))
    up = m.select("_m", "session", F.coalesce(F.col("close") > full(F.avg("close"), "close", trailing(by_time("_m", "session"), market_sma), market_sma), F.lit(False)).alias("_up"))
    known = asof_join(d.select("session").distinct().withColumn("_m", F.lit(1)), up, "_m", "session", "session", {"_up": "_up"})  # calendar rows
    d = d.join(F.broadcast(known.select("session", "_up")), "session", "left")
    return d.withColumn("entry", F.col("entry") & F.coalesce("_up", F.lit(False))).drop("_up")


def first_true(rows: DataFrame, mask: Column, keys: Sequence[str], order: Sequence[str], out: str = "first") -> DataFrame:
    """Flag of the first row of each group (symbol and session) on which ``mask`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(mask, F.lit(False))
    return rows.withColumn(out, on & (F.sum(on.cast("int")).over(w) == 1))


def true_before(rows: DataFrame, mask: Column, keys: Sequence[str], order: Sequence[str], out: str = "before") -> DataFrame:
    """Whether ``mask`` held on an earlier row of the group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.max(F.coalesce(mask, F.lit(False))).over(w), F.lit(False)))


def latest_setups(rows: DataFrame, flag: str, score: str, key: str = "symbol", ts: str = "session") -> DataFrame:
    """The last completed row of each symbol that shows the set-up, best score first, missing scores last."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_z")).select(key, "_z.*")
    return last.where(F.col(flag)).orderBy(F.desc_nulls_last(score), key)
