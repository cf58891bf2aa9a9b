"""Feature blocks, cross-section factors, composites and rank portfolios over a long panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.functions import indicators as I
from tapegrain.operators.kernels import (MAX_GROUP_ROWS, by_time, full, rank_in_group, ratio, roll_mean, roll_moments, so_far, trailing)
from tapegrain.session import materialize

W = lambda: by_time("symbol", "session")

# Factor weights of the composite.
WEIGHTS = {"mom_12_1": 1 / 6, "resmom_12_1": 1 / 6, "sec_rel_mom": 1 / 6, "earn_surprise": 0.5}
MOMENTUM_WEIGHTS = {k: v for k, v in WEIGHTS.items() if k != "earn_surprise"}


def hourly_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars per (symbol, clock hour); at most 24 rows per symbol and day."""
    last = F.struct("ts", "event_id")
    return (ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("bar"), F.to_date("ts").alias("session"))
            .agg(F.min_by("price", last).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", last).alias("close"), F.sum("size").alias("volume"),
                 ratio(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"))
            .withColumnRenamed("bar", "ts"))


def with_slots(bars: DataFrame) -> DataFrame:
    """0-based slot inside the session and the running volume-weighted price."""
    w = Window.partitionBy("symbol", "session").orderBy("ts")
    px = F.coalesce("vwap", "close") * F.col("volume")
    return bars.withColumns({"slot": F.row_number().over(w) - 1,
                             "vwap_s": ratio(F.sum(px).over(so_far(w)), F.sum("volume").over(so_far(w)))})


def same_time_baseline(bars: DataFrame, value: str, lookback: int, slots: int | None = None,
                       out: str = "base") -> DataFrame:
    """Mean at the same slot over the previous ``lookback`` sessions, today excluded.

    Sessions with a missing slot count as rows, so the grid (session x slot) is filled first;
    it is bounded by the calendar per symbol.
    """
    slot_dim = F.sequence(F.lit(0), F.lit(slots - 1)) if slots else None
    days = bars.select("symbol", "session").distinct()
    grid = days.withColumn("slot", F.explode(slot_dim)) if slots else (
        days.join(bars.groupBy("symbol").agg(F.max("slot").alias("_m")), "symbol")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), "_m"))).drop("_m"))
    g = grid.join(bars, ["symbol", "session", "slot"], "left")
    w = Window.partitionBy("symbol", "slot").orderBy("session").rowsBetween(-lookback, -1)
    base = F.when(F.count(value).over(w) >= max(5, lookback // 2), F.avg(value).over(w))
    return g.withColumn(out, base).where(F.col(value).isNotNull())


def feature_block(bars: DataFrame) -> DataFrame:
    w = W()
    lr = lambda n: F.log(F.col("close") / F.lag("close", n).over(w))
    d = bars.withColumns({f"ret_{n}": lr(n) for n in (1, 5, 21, 63)})
    vol = lambda n: I.rolling_std("ret_1", n) * F.sqrt(F.lit(252.0))
    return d.withColumns({
        "vol_5": vol(5), "vol_21": vol(21), "vol_63": vol(63),
        **{f"sma_gap_{n}": F.col("close") / I.sma("close", n) - 1 for n in (10, 20, 50, 200)},
        "vol_z_20": ratio(F.col("volume") - I.sma("volume", 20), I.rolling_std("volume", 20)),
        "drawdown": F.col("close") / F.max("close").over(so_far(w)) - 1,
        "drawdown_252": F.col("close") / F.max("close").over(trailing(w, 252)) - 1})


def forward_targets(bars: DataFrame, horizons=(5, 21)) -> DataFrame:
    w = W()
    return bars.withColumns({f"target_{h}": F.log(F.lead("close", h).over(w) / F.col("close")) for h in horizons})


EVENT_FEATURES = ["ret_5", "ret_20", "ret_60", "vol_ratio", "dist_sma50_atr", "dist_high55_atr", "dist_low55_atr",
                  "off_high_252", "gap_atr", "volume_ratio"]


def event_features(bars: DataFrame) -> DataFrame:
    w = W()
    d = I.add_atr(bars, 14, out="atr").withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    back = lambda n: F.col("close") / F.lag("close", n).over(w) - 1
    prior = trailing(w, 55, -1)
    return d.withColumns({
        "ret_5": back(5), "ret_20": back(20), "ret_60": back(60),
        "vol_ratio": ratio(I.rolling_std("_r", 20), I.rolling_std("_r", 60)),
        "dist_sma50_atr": ratio(F.col("close") - I.sma("close", 50), "atr"),
        "dist_high55_atr": ratio(F.col("close") - full(F.max("high"), "high", prior, 55), "atr"),
        "dist_low55_atr": ratio(F.col("close") - full(F.min("low"), "low", prior, 55), "atr"),
        "off_high_252": F.col("close") / full(F.max("high"), "high", trailing(w, 252), 252) - 1,
        "gap_atr": ratio(F.col("open") - F.lag("close").over(w), "atr"),
        "volume_ratio": ratio("volume", I.sma("volume", 20))}).drop("_r")


def liquidity(bars: DataFrame, n: int = 60, back: int = 126) -> DataFrame:
    w = W()
    d = bars.withColumn("_dv", F.col("close") * F.col("volume"))
    return d.withColumns({
        f"median_dv_{n}": full(F.percentile("_dv", F.lit(0.5)), "_dv", trailing(w, n), n),
        f"prior_{back}": F.col("close") / F.lag("close", back).over(w) - 1}).drop("_dv")


def forward_daily(bars: DataFrame, h: int) -> DataFrame:
    w = W()
    d = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    ahead = w.rowsBetween(1, h)
    return d.withColumns({
        "fwd_ret": F.lead("close", h).over(w) / F.lead("open", 1).over(w) - 1,
        "fwd_vol": F.when(F.count("_r").over(ahead) == h, F.stddev_samp("_r").over(ahead) * F.sqrt(F.lit(252.0)))}).drop("_r")


def horizon_sigma(v21: str, v63: str, h: int) -> Column:
    blended = F.coalesce(0.5 * F.col(v21) + 0.5 * F.col(v63), F.lit(0.25))
    return F.greatest(blended, F.lit(0.05)) * F.sqrt(F.lit(h / 252.0))


def tradeable(min_dollar_volume: float, min_price: float = 5.0, min_bars: int = 260) -> Column:
    w = W()
    dv = roll_mean(F.col("close") * F.col("volume"), w, 21)
    return ((F.count("close").over(so_far(w)) >= min_bars) & (F.col("close") > min_price)
            & (F.coalesce(dv, F.lit(0.0)) > min_dollar_volume))


def panel_factors(bars: DataFrame, market: DataFrame, sectors: DataFrame, min_dollar_volume: float,
                  bound: int | None = None) -> DataFrame:
    """Momentum, market beta, residual momentum, sector-relative momentum and the tradeable mask."""
    w = W()
    m = market.select("session", (F.log("close") - F.lag(F.log("close")).over(Window.partitionBy("symbol").orderBy("session"))).alias("_mr"))
    d = bars.join(F.broadcast(m), "session")  # one row per session: bounded by the calendar
    d = d.withColumn("_lc", F.log("close"))
    d = d.withColumn("_r1", F.col("_lc") - F.lag("_lc").over(w))
    pair = F.col("_r1").isNotNull() & F.col("_mr").isNotNull()
    d = d.withColumns({"_x": F.when(pair, F.col("_r1")), "_y": F.when(pair, F.col("_mr"))})
    d = roll_moments(d, "symbol", "session", 252, {"_xy": ("_x", "_y"), "_yy": ("_y", "_y")})
    beta = F.when((F.col("_xy_n") >= 126) & (F.col("_xy_n") > 1), ratio("_xy_c", "_yy_c"))
    d = d.drop("_xy_x", "_yy_x", "_yy_n").withColumns({"beta": beta, "mom_12_1": F.lag("_lc", 21).over(w) - F.lag("_lc", 252).over(w),
                       "tradeable": tradeable(min_dollar_volume)})
    d = d.withColumn("_res", F.col("_r1") - F.col("beta") * F.col("_mr"))
    d = d.withColumn("_rz", F.lag("_res", 21).over(w))
    d = roll_moments(d, "symbol", "session", 231, {"_z": ("_rz", "_rz")})
    d = d.withColumn("resmom_12_1", F.when(F.col("_z_n") >= 231, F.col("_z_n") * F.col("_z_x") / (F.sqrt("_z_c") + 1e-9)))
    d = d.join(sectors.select("symbol", "sector"), "symbol")
    d = d.drop("_lc", "_r1", "_x", "_y", "_res", "_rz", "_mr", "_xy_n", "_xy_c", "_yy_c", "_z_n", "_z_x", "_z_c")
    if bound is not None and bound <= MAX_GROUP_ROWS:
        med = F.percentile("mom_12_1", F.lit(0.5)).over(Window.partitionBy("session", "sector"))
        return d.withColumn("sec_rel_mom", F.col("mom_12_1") - med)
    from tapegrain.operators.kernels import exact_quantiles
    med = exact_quantiles(d, ["session", "sector"], "mom_12_1", {"_med": 0.5})
    return (d.join(med, ["session", "sector"], "left")
            .withColumn("sec_rel_mom", F.col("mom_12_1") - F.col("_med")).drop("_med"))


def composite(panel: DataFrame, weights: dict[str, float], bound: int | None = None,
              mask: str = "tradeable") -> DataFrame:
    """Weighted sum of centred ranks among tradeable names; a missing factor is neutral."""
    d = panel
    for name in weights:
        d = d.withColumn(f"_in_{name}", F.when(F.col(mask), F.col(name)))
        d = rank_in_group(d, ["session"], f"_in_{name}", f"rank_{name}", bound)
    score = sum((F.coalesce(f"rank_{n}", F.lit(0.0)) * wt for n, wt in weights.items()), F.lit(0.0))
    return d.withColumn("score", F.when(F.col(mask), score)).drop(*[f"_in_{n}" for n in weights])


def last_covered(panel: DataFrame, mask: str = "tradeable", min_coverage: float = 0.8) -> DataFrame:
    """The rows of the last session on which at least 80 % of the best count of tradeable names trade.

    The date comes from counts alone, so a ranking that needs one date does not rank the others.
    """
    cov = panel.groupBy("session").agg(F.count(F.when(F.col(mask), 1)).alias("n"))  # one row per session
    best = cov.agg(F.max("n").alias("best"))
    asof = cov.join(F.broadcast(best)).where(F.col("n") >= min_coverage * F.col("best")).agg(F.max("session").alias("session"))
    return panel.join(F.broadcast(asof), "session")


def rank_universe(scored: DataFrame, top: int, bottom: int, min_coverage: float = 0.8) -> DataFrame:
    """Best and worst names on the last session that at least 80 % of the best coverage has.

    Top and bottom come from distributed top-k; the place of every other name is never needed.
    """
    scored = materialize(scored.select("symbol", "session", "score"), "scores")  # read four times below
    cov = scored.groupBy("session").agg(F.count("score").alias("n"))  # one row per session
    best = cov.agg(F.max("n").alias("best"))
    asof = (cov.join(F.broadcast(best)).where(F.col("n") >= min_coverage * F.col("best"))
            .orderBy(F.desc("session")).limit(1).select("session", "n"))
    s = (scored.where(F.col("score").isNotNull()).join(F.broadcast(asof), "session")
         .withColumn("_s", F.round("score", 8)))
    one = Window.partitionBy("session")
    hi = s.orderBy(F.desc("_s"), "symbol").limit(top)
    lo = s.orderBy("_s", F.desc("symbol")).limit(bottom)
    hi = hi.withColumn("place", F.row_number().over(one.orderBy(F.desc("_s"), "symbol"))).withColumn("rn", F.col("place"))
    lo = lo.withColumn("place", F.row_number().over(one.orderBy("_s", F.desc("symbol"))))
    lo = lo.withColumn("rn", F.col("n") - F.col("place") + 1).join(hi.select("symbol"), "symbol", "left_anti")
    both = hi.withColumn("side", F.lit("long")).unionByName(lo.withColumn("side", F.lit("short")))
    pct = F.round(100 * (1 - (F.col("rn") - 1) / F.greatest(F.col("n") - 1, F.lit(1))), 1)
    return both.withColumn("percentile", pct).select("symbol", "session", "score", "side", "place", "percentile")


def rank_portfolio(scored: DataFrame, hold: int = 21, top: float = 0.10, cost: float = 10 / 10_000, min_names: int = 30,
                   offsets: str = "first") -> DataFrame:
    """Every ``hold`` sessions: long the best and short the worst fraction, next open to next open.

    ``offsets="all"`` runs the study for each of the ``hold`` possible starting days at once: every
    session is then a rebalance of exactly one offset. One row per rebalance: gross and net log returns, the equal-weight universe, rank correlation,
    turnover against the set before. Cuts come from counts per date, so only the top and bottom
    names (group-limited) are ever ranked.
    """
    from tapegrain.operators.evaluation import rank_corr
    w = W()
    d = scored.withColumn("y", F.log(F.lead("open", 1 + hold).over(w) / F.lead("open", 1).over(w)))
    d = d.where(F.col("score").isNotNull()).select("symbol", "session", F.round("score", 9).alias("score"), "y")
    cal = d.select("session").distinct().withColumn("_rn", F.row_number().over(Window.partitionBy().orderBy("session")) - 1)
    if offsets == "first":
        cal = cal.where(F.col("_rn") % hold == 0)
    cal = cal.select("session", F.floor(F.col("_rn") / hold).alias("_k"), (F.col("_rn") % hold).alias("offset"))
    a = d.join(F.broadcast(cal), "session").where(F.col("y").isNotNull())
    a = materialize(a, "rebalance_rows")  # read by the counts, the cuts and the rank correlation
    tot = a.groupBy("session", "_k", "offset").agg(F.count(F.lit(1)).alias("names"), F.log(F.avg(F.exp("y"))).alias("equal_weight"))
    tot = tot.where(F.col("names") >= min_names).withColumn("n_long", F.greatest(
        F.when(F.col("names") >= 25, 5).otherwise(1).cast("bigint"), F.floor(F.col("names") * top + 1e-9)))
    b = a.drop("_k", "offset").join(F.broadcast(tot), "session")
    hi = b.withColumn("_p", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "symbol"))).where(F.col("_p") <= F.col("n_long"))
    lo = b.withColumn("_p", F.row_number().over(Window.partitionBy("session").orderBy("score", F.desc("symbol")))).where(F.col("_p") <= F.col("n_long"))
    held = hi.select("symbol", "_k", "offset")
    before = held.select("symbol", (F.col("_k") + 1).alias("_k"), "offset")
    kept = held.join(before, ["symbol", "_k", "offset"]).groupBy("_k", "offset").agg(F.count(F.lit(1)).alias("_kept"))
    prev_n = tot.select((F.col("_k") + 1).alias("_k"), "offset", F.col("n_long").alias("_pn"))
    g = tot.join(hi.groupBy("session").agg(F.log(F.avg(F.exp("y"))).alias("long_gross")), "session")
    g = g.join(lo.groupBy("session").agg(F.log(F.avg(F.exp("y"))).alias("short_gross")), "session")
    g = g.join(rank_corr(a, ["session"], "score", "y", "ic"), "session").join(kept, ["_k", "offset"], "left").join(prev_n, ["_k", "offset"], "left")
    turn = F.when(F.col("_pn").isNull(), 1.0).otherwise((F.col("n_long") + F.col("_pn") - 2 * F.coalesce("_kept", F.lit(0))) / (2 * F.col("n_long")))
    g = g.withColumn("turnover", turn)
    return g.withColumns({"long": F.col("long_gross") - 2 * cost * F.col("turnover"),
                          "long_short": F.col("long_gross") - F.col("short_gross") - 4 * cost * F.col("turnover")}).drop("_kept", "_pn", "_k")


def summarize_portfolio(p: DataFrame, hold: int = 21, value: str = "long", by: tuple[str, ...] = ()) -> DataFrame:
    """Growth, Sharpe, drawdown, excess over the equal-weight universe and rank-correlation statistics.

    One row per rebalance date goes in, so the drawdown window is bounded by the calendar.
    """
    per_year = 252.0 / hold
    w = Window.partitionBy(*by).orderBy("session")
    d = p.withColumn("_eq", F.exp(F.sum(value).over(so_far(w))))
    d = d.withColumns({"_dd": F.col("_eq") / F.max("_eq").over(so_far(w)) - 1, "_x": F.col(value) - F.col("equal_weight")})
    n, tiny = F.count(F.lit(1)), 1e-12
    t = lambda x: F.avg(x) / (F.stddev_samp(x) + tiny) * F.sqrt(n)
    return d.groupBy(*by).agg(n.alias("n_rebalances"), (F.exp(F.sum(value) / (n / per_year)) - 1).alias("cagr"),
                 (F.avg(value) / (F.stddev_samp(value) + tiny) * F.sqrt(F.lit(per_year))).alias("sharpe"), F.min("_dd").alias("max_drawdown"),
                 (F.avg("_x") * per_year).alias("excess_per_year"), t("_x").alias("excess_t"), F.avg("ic").alias("ic_mean"), t("ic").alias("ic_t"),
                 F.avg("turnover").alias("avg_turnover"))
