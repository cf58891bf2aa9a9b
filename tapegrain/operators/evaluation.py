"""Measures of curves, trades, forecasts and decisions; all by mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import CALENDAR_ROWS, by_time, exact_quantiles, rank_in_group, ratio, so_far
from tapegrain.session import materialize


def curve_metrics(curves: DataFrame, key: str = "symbol", ts: str = "session", value: str = "close", per_year: float = 252.0) -> DataFrame:
    """Return, growth, volatility, Sharpe, Sortino, deepest and longest drawdown per curve."""
    w = by_time(key, ts)
    d = curves.where(F.col(value).isNotNull()).select(key, ts, F.col(value).alias("_v"))
    d = d.withColumns({"_r": F.col("_v") / F.lag("_v").over(w) - 1, "_dd": F.col("_v") / F.max("_v").over(so_far(w)) - 1})
    d = d.withColumn("_isl", F.sum((F.col("_dd") >= 0).cast("int")).over(so_far(w)))
    g0 = d.groupBy(key, "_isl").agg(
        F.min_by("_v", ts).alias("_f"), F.max_by("_v", ts).alias("_l"), F.min(ts).alias("_t0"), F.max(ts).alias("_t1"),
        F.count("_r").alias("_n"), F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_q"),
        F.count(F.when(F.col("_r") < 0, 1)).alias("_nd"), F.sum(F.when(F.col("_r") < 0, F.col("_r"))).alias("_sd"),
        F.sum(F.when(F.col("_r") < 0, F.col("_r") * F.col("_r"))).alias("_qd"), F.min("_dd").alias("_mdd"),
        F.count(F.when(F.col("_dd") < 0, 1)).alias("_under"))
    g = g0.groupBy(key).agg(
        F.min_by("_f", "_t0").alias("_f"), F.max_by("_l", "_t1").alias("_l"),
        *[F.sum(x).alias(x) for x in ("_n", "_s", "_q", "_nd", "_sd", "_qd")], F.min("_mdd").alias("max_drawdown"),
        F.max("_under").alias("longest_drawdown"))
    var = lambda n, s, q: F.when(F.col(n) > 1, (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1))
    mean, sd, dsd = F.col("_s") / F.col("_n"), F.sqrt(var("_n", "_s", "_q")), F.sqrt(var("_nd", "_sd", "_qd"))
    ann = F.sqrt(F.lit(per_year))
    return g.where(F.col("_n") >= 1).select(
        key, (F.col("_l") / F.col("_f") - 1).alias("total_return"),
        (F.pow(F.col("_l") / F.col("_f"), per_year / F.col("_n")) - 1).alias("cagr"), (sd * ann).alias("vol"),
        F.when(sd > 0, mean / sd * ann).alias("sharpe"), F.when(dsd > 0, mean / dsd * ann).alias("sortino"), "max_drawdown", "longest_drawdown",
        F.when(sd > 0, mean / sd * F.sqrt("_n")).alias("t_stat"))


def _trade_aggs() -> list[Column]:
    win = F.col("pnl") > 0
    losses = F.sum(F.when(~win, F.col("pnl")))
    m, s, n = F.avg("r"), F.stddev_samp("r"), F.count("r")
    return [F.count(F.lit(1)).alias("n"), F.avg(win.cast("double")).alias("win_rate"),
            F.when(losses < 0, F.sum(F.when(win, F.col("pnl"))) / -losses).alias("profit_factor"), m.alias("mean_r"),
            F.when((n > 1) & (s > 0), m / (s / F.sqrt(n))).alias("t_mean_r"), F.avg("sessions").alias("mean_sessions"),
            F.sum("pnl").alias("net_pnl"), F.sum("costs").alias("costs"),
            F.when(F.sum(F.col("pnl") + F.col("costs")) > 0, 100 * F.sum("costs") / F.sum(F.col("pnl") + F.col("costs"))).alias("costs_pct_of_gross"),
            F.sum("r").alias("total_r")]


def trade_metrics(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trade-list measures with an exact median of R and the count of each exit reason as a map."""
    by = list(by)
    g = trades.groupBy(*by).agg(*_trade_aggs())
    med = exact_quantiles(trades, by, "r", {"median_r": 0.5})
    why = trades.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("_n"))
    why = why.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.array_agg(F.struct("reason", "_n")))).alias("exit_reasons"))
    if by:
        return g.join(med, by, "left").join(why, by, "left")
    return g.join(F.broadcast(med)).join(F.broadcast(why))  # one row each


def trades_by_group(trades: DataFrame, sets: Sequence[Sequence[str]], min_n: int = 1) -> DataFrame:
    """The measures for several key sets in one pass (null keys are groups of their own)."""
    cols = list(dict.fromkeys(x for s in sets for x in s))
    g = trades.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for x in cols]).agg(
        *_trade_aggs(), F.grouping_id(*cols).alias("gid"))
    return g.where(F.col("n") >= min_n)


def yearly_returns(curves: DataFrame, key: str = "symbol", ts: str = "session", value: str = "close") -> DataFrame:
    """Calendar-year returns; the first year starts from the first value."""
    y = curves.groupBy(key, F.year(ts).alias("year")).agg(F.max_by(value, ts).alias("_l"), F.min_by(value, ts).alias("_f"))
    w = by_time(key, "year")
    return y.withColumn("ret", F.col("_l") / F.coalesce(F.lag("_l").over(w), F.col("_f")) - 1).drop("_l", "_f")


def risk_block(returns: DataFrame, market: DataFrame, level: float = 0.95, per_year: float = 252.0) -> DataFrame:
    """Annual volatility, Sharpe, beta to the market and historical value at risk per symbol."""
    j = returns.join(F.broadcast(market.select("session", F.col("ret").alias("_m"))), "session")
    g = j.groupBy("symbol").agg(F.stddev_samp("ret").alias("_sd"), F.avg("ret").alias("_mu"),
                                (F.covar_samp("ret", "_m") / F.nullif(F.var_samp("_m"), F.lit(0.0))).alias("beta"), F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(j, ["symbol"], "ret", {"_q": 1 - level}, CALENDAR_ROWS)
    ann = F.sqrt(F.lit(per_year))
    return g.join(q, "symbol").select("symbol", "n", (F.col("_sd") * ann).alias("vol"), F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * ann).alias("sharpe"),
                                      "beta", (-F.col("_q")).alias("value_at_risk"))


def pinball(y: str, q: str, tau: float) -> Column:
    e = F.col(y) - F.col(q)
    return F.greatest(tau * e, (tau - 1) * e)


def score_forecasts(f: DataFrame) -> DataFrame:
    """Hit rate, error, band coverage and bias by horizon plus the overall row (horizon null).

    Needs horizon, last_price, p10, p50, p90, realised.
    """
    lr, fc = F.log(F.col("realised") / F.col("last_price")), F.log(F.col("p50") / F.col("last_price"))
    return f.where(F.col("realised").isNotNull()).rollup("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(((lr > 0) == (fc > 0)).cast("double")).alias("hit_rate"), F.avg(F.abs(lr - fc)).alias("mae_logret"),
        F.avg(F.col("realised").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"), F.avg(fc - lr).alias("bias"))


def probabilistic_scores(f: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pinball skill against a base forecast, band coverage, Brier skill and rank correlation.

    Needs y, q10, q50, q90, b10, b50, b90 (base), p_up, b_up.
    """
    by = list(by)
    loss = lambda p: sum((F.avg(pinball("y", f"{p}{t}", t / 100)) for t in (10, 50, 90)), F.lit(0.0))
    up = (F.col("y") > 0).cast("double")
    brier = lambda x: F.avg((F.col(x) - up) * (F.col(x) - up))
    g = f.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1 - loss("q") / loss("b")).alias("pinball_skill"),
                           F.avg(F.col("y").between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage"),
                           (1 - brier("p_up") / brier("b_up")).alias("brier_skill"), F.avg(F.abs(F.col("y") - F.col("q50"))).alias("mae"))
    return g.join(rank_corr(f, by, "p_up", "y"), by)


def rank_corr(f: DataFrame, by: Sequence[str], a: str, b: str, out: str = "rank_ic", bound: int | None = None, written: bool = False) -> DataFrame:
    """Spearman correlation: Pearson correlation of average ranks. ``written``: the rows are read from a table, not computed."""
    by = list(by)
    d = f.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    if bound is None and not written:
        d = materialize(d, "rank_pairs")  # both rankings read it several times
    pairs = d
    d = rank_in_group(d, by, "_a", "_ra", bound)
    if bound is None:
        d = d.drop("_a")
    d = rank_in_group(d, by, "_b", "_rb", bound, pairs)
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    return d.groupBy(*by).agg((F.covar_pop("_ra", "_rb") / F.nullif(spread, F.lit(0.0))).alias(out))


def auc(f: DataFrame, by: Sequence[str], score: str, hit: str) -> DataFrame:
    """Area under the ROC curve from average ranks."""
    by = list(by)
    d = rank_in_group(f.where(F.col(score).isNotNull()), by, score, "_r")
    n1, n0 = F.sum(F.col(hit)), F.sum(1 - F.col(hit))
    n = F.count(F.lit(1))
    rank_sum = F.sum(F.when(F.col(hit) == 1, (F.col("_r") + 0.5))) * n
    return d.groupBy(*by).agg(n.alias("n"), ((rank_sum - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))).alias("auc"))


def threshold_table(rows: DataFrame, score: str, realised: str) -> DataFrame:
    """Score cut points at 10/30/70/90 %, mean outcome per bucket and whether the means rise."""
    names = ("strong_sell", "sell", "hold", "buy", "strong_buy")
    q = exact_quantiles(rows, [], score, {"q10": .1, "q30": .3, "q70": .7, "q90": .9})
    d = rows.join(F.broadcast(q))  # one row of cut points
    s = F.col(score)
    b = F.when(s < F.col("q10"), 0).when(s < F.col("q30"), 1).when(s < F.col("q70"), 2).when(s < F.col("q90"), 3).otherwise(4)
    g = d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(realised).alias("mean_realised"), F.min(s).alias("low"))
    w = Window.partitionBy().orderBy("bucket")  # five rows
    g = g.withColumn("_step", F.lead("mean_realised").over(w) - F.col("mean_realised"))
    g = g.withColumn("monotonic", F.min("_step").over(Window.partitionBy()) >= -1e-6).drop("_step")
    return g.withColumn("label", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("bucket") + 1))


# How fast the record of a strategy moves its weight.
EVIDENCE_PRIOR_WEEKS = 12
SENSITIVITY_PER_PCT = 0.08
MULTIPLIER_BOUNDS = (0.5, 1.3)


def learned_multiplier(excess_pct: Column, weeks: Column) -> Column:
    """Multiplier from the mean excess in percent, weighted by the distinct weeks of evidence."""
    evidence = weeks / (weeks + EVIDENCE_PRIOR_WEEKS)
    lo, hi = MULTIPLIER_BOUNDS
    return F.greatest(F.lit(lo), F.least(F.lit(hi), 1 + SENSITIVITY_PER_PCT * evidence * F.coalesce(excess_pct, F.lit(0.0))))


def quality_report(bars: DataFrame, move: float = 0.4) -> DataFrame:
    """One pass of conditional counts per symbol."""
    w = by_time("symbol", "session")
    d = bars.withColumn("_r", F.abs(F.col("close") / F.lag("close").over(w) - 1))
    bad = ((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")))
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), n(bad).alias("ohlc_violations"), n(F.col("close") <= 0).alias("non_positive"),
                                   n(F.coalesce("volume", F.lit(0.0)) == 0).alias("zero_volume"), n(F.col("_r") > move).alias("big_moves"),
                                   F.max("_r").alias("biggest_move"))


def shrunk_covariance(returns: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Sample covariance of the pairs of aligned series, and the same shrunk to a scaled identity with the
    intensity of Ledoit and Wolf."""
    from tapegrain.operators.joins import session_pairs
    n_series = returns.select("symbol").distinct().count()
    full_days = returns.groupBy("session").agg(F.countDistinct("symbol").alias("_k")).where(F.col("_k") == n_series).select("session")
    r = returns.join(F.broadcast(full_days), "session")  # one row a session
    mean = r.groupBy("symbol").agg(F.avg("ret").alias("_mu"))
    r = r.join(mean, "symbol").withColumn("x", F.col("ret") - F.col("_mu"))
    prod = session_pairs(r, "x", n_series).withColumn("_p", F.col("xa") * F.col("xb"))
    half = prod.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("s"), F.avg(F.col("_p") * F.col("_p")).alias("_p2"))
    g = half.unionByName(half.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "s", "_p2"))
    t = g.agg(F.avg(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("_m"),
              F.sum((F.col("_p2") - F.col("s") * F.col("s")) / F.col("n")).alias("_beta"), F.sum(F.col("s") * F.col("s")).alias("_ss"))
    g = g.join(F.broadcast(t))
    delta = F.col("_ss") - n_series * F.col("_m") * F.col("_m")
    k = F.least(F.lit(1.0), F.col("_beta") / F.nullif(delta, F.lit(0.0)))
    target = F.when(F.col("a") == F.col("b"), F.col("_m")).otherwise(0.0)
    return g.select("a", "b", "n", (F.col("s") * F.col("n") / (F.col("n") - 1) * per_year).alias("sample_cov"),
                    (((1 - k) * F.col("s") + k * target) * per_year).alias("shrunk_cov"), k.alias("intensity"))


def equal_weight_returns(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean return of the held names from each anchor to the next."""
    p = prices.withColumn("_nx", F.lead("price").over(by_time("symbol", "anchor")))
    h = holdings.join(p, ["symbol", "anchor"]).where((F.col("price") > 0) & F.col("_nx").isNotNull())
    return h.groupBy("anchor").agg(F.avg(F.col("_nx") / F.col("price") - 1).alias("ret"), F.count(F.lit(1)).alias("n"))


def scenario_returns(universes: DataFrame, prices: DataFrame) -> DataFrame:
    """(rule, universe, anchor, until, ret, n): equal-weight return of each universe's names from each anchor to the next,
    under each rule for what a name is worth after its end.

    ``universes``: universe, anchor, symbol; ``prices``: rule, symbol, anchor, price. Scenarios are rows, so one plan serves all.
    """
    w = Window.partitionBy("rule", "symbol").orderBy("anchor")
    p = prices.withColumns({"_nx": F.lead("price").over(w), "until": F.lead("anchor").over(w)})
    h = universes.join(p, ["symbol", "anchor"]).where((F.col("price") > 0) & F.col("_nx").isNotNull())
    return h.groupBy("rule", "universe", "anchor", "until").agg(F.avg(F.col("_nx") / F.col("price") - 1).alias("ret"), F.count("*").alias("n"))


def yearly_table(returns: DataFrame, universes: list[str]) -> DataFrame:
    """(rule, year, one column for each universe): compounded returns of the periods that end in the year."""
    year = returns.withColumn("year", F.year("until"))
    return year.groupBy("rule", "year").pivot("universe", universes).agg(F.product(1 + F.col("ret")) - 1)


def survivorship_bias(returns: DataFrame, pairs: dict[str, tuple[str, str]], periods: int = 12) -> DataFrame:
    """(rule, annual return of each universe, bias of each pair): how much a universe that knew the future seems to gain a year."""
    names = sorted({u for pair in pairs.values() for u in pair})
    g = returns.groupBy("rule").pivot("universe", names).agg(F.pow(F.product(1 + F.col("ret")), periods / F.count("ret")) - 1)
    return g.select("rule", *names, *[(F.col(a) - F.col(b)).alias(k) for k, (a, b) in pairs.items()])
