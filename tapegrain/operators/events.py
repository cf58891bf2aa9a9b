"""Event work: reactions, clusters, event trades, placebos, first-touch exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import asof_join, by_time, clip, so_far, uniform
from tapegrain.session import materialize


def earnings_factors(bars: DataFrame, reactions: DataFrame, fresh: int = 63) -> DataFrame:
    """Latest surprise and reaction-day return, carried while they are at most ``fresh`` bars old."""
    w = by_time("symbol", "session")
    m = reactions.groupBy("symbol", F.col("reaction").alias("session")).agg(
        F.max_by(clip("surprise", -100.0, 100.0), "date").alias("_sp"))
    d = bars.join(m, ["symbol", "session"], "left").withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    mark = F.col("_sp").isNotNull() & F.col("_r").isNotNull()
    fr = w.rowsBetween(-fresh, 0)
    return d.withColumns({"earn_surprise": F.last(F.when(mark, F.col("_sp")), ignorenulls=True).over(fr),
                          "earn_ear": F.last(F.when(mark, F.col("_r")), ignorenulls=True).over(fr)}).drop("_sp", "_r")


def excess_after(events: DataFrame, bars: DataFrame, market: DataFrame, day: str, horizon: int) -> DataFrame:
    """Return from the first close at or after each event over ``horizon`` bars, and its excess over
    the market between the same two sessions."""
    w = by_time("symbol", "session")
    b = bars.select("symbol", "session", "close", F.lead("session", horizon).over(w).alias("_xs"), F.lead("close", horizon).over(w).alias("_xc"))
    e = asof_join(events, b.withColumn("_es", F.col("session")), "symbol", day, "session",
                  {"_es": "entry", "close": "_ec", "_xs": "exit", "_xc": "_xc"}, direction="forward")
    m1 = F.broadcast(market.select(F.col("session").alias("entry"), F.col("close").alias("_m1")))
    m2 = F.broadcast(market.select(F.col("session").alias("exit"), F.col("close").alias("_m2")))
    e = e.where(F.col("_xc").isNotNull()).join(m1, "entry").join(m2, "exit")
    e = e.withColumn("ret", F.col("_xc") / F.col("_ec") - 1)
    return e.withColumn("excess", F.col("ret") - (F.col("_m2") / F.col("_m1") - 1)).drop("_ec", "_xc", "_m1", "_m2")


def outcomes_at(records: DataFrame, bars: DataFrame, market: DataFrame, day: str, horizons=(5, 20)) -> DataFrame:
    """Outcome of each record after each horizon, in bars, with the market over the same two sessions."""
    w = by_time("symbol", "session")
    h = [F.struct(F.lit(n).alias("horizon"), F.lead("session", n).over(w).alias("xs"), F.lead("close", n).over(w).alias("xc")) for n in horizons]
    b = bars.select("symbol", "session", F.col("session").alias("_es"), F.col("close").alias("_ec"), *[x.alias(f"_h{i}") for i, x in enumerate(h)])
    e = asof_join(records, b, "symbol", day, "session", {"_es": "entry", "_ec": "_ec", **{f"_h{i}": f"_h{i}" for i in range(len(h))}}, direction="forward")
    e = e.withColumn("_z", F.explode(F.array(*[f"_h{i}" for i in range(len(h))])))
    e = e.select(*records.columns, "entry", "_ec", "_z.horizon", F.col("_z.xs").alias("exit"), F.col("_z.xc").alias("_xc")).where(F.col("_xc").isNotNull())
    m1 = F.broadcast(market.select(F.col("session").alias("entry"), F.col("close").alias("_m1")))
    m2 = F.broadcast(market.select(F.col("session").alias("exit"), F.col("close").alias("_m2")))
    e = e.join(m1, "entry").join(m2, "exit").withColumn("ret", F.col("_xc") / F.col("_ec") - 1)
    return e.withColumn("excess", F.col("ret") - (F.col("_m2") / F.col("_m1") - 1)).drop("_ec", "_xc", "_m1", "_m2")


def event_trades(bars: DataFrame, market: DataFrame, hold: int, cost: float, as_of: Column, liq: int = 60, prior: int = 126) -> DataFrame:
    """For every bar, the trade a signal on it would make: next open in, ``hold`` bars on out, and the
    excess over the market between the same sessions. A series that ended early exits at its last
    close when it ended ten days before ``as_of``; otherwise the trade has not matured (null)."""
    from tapegrain.operators.factors import liquidity
    w = by_time("symbol", "session")
    whole = Window.partitionBy("symbol")
    b = liquidity(bars, liq, prior)
    b = b.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(whole), "_end": F.max("session").over(whole),
                       "_lc": F.max_by("close", "session").over(whole),
                       "entry_date": F.lead("session", 1).over(w), "_eo": F.lead("open", 1).over(w),
                       "_xd": F.lead("session", 1 + hold).over(w), "_xo": F.lead("open", 1 + hold).over(w)})
    ended = F.col("_xd").isNull() & (F.datediff(as_of, "_end") >= 10) & F.col("entry_date").isNotNull()
    b = b.withColumns({"exit_date": F.when(ended, F.col("_end")).otherwise(F.col("_xd")), "_xp": F.when(ended, F.col("_lc")).otherwise(F.col("_xo")),
                       "exit_how": F.when(ended, "data_end").when(F.col("_xd").isNotNull(), "time")})
    m1 = F.broadcast(market.select(F.col("session").alias("entry_date"), F.col("open").alias("_m1")))
    m2 = F.broadcast(market.select(F.col("session").alias("exit_date"), F.col("open").alias("_m2")))
    b = b.join(m1, "entry_date", "left").join(m2, "exit_date", "left")
    ret = F.when((F.col("_eo") > 0) & (F.col("_xp") > 0), F.col("_xp") * (1 - cost) / (F.col("_eo") * (1 + cost)) - 1)
    b = b.withColumn("ret", ret).withColumn("ar", F.col("ret") - (F.col("_m2") / F.col("_m1") - 1))
    return b.drop("_end", "_lc", "_eo", "_xd", "_xo", "_xp", "_m1", "_m2")


def eligible(liq: int = 60, min_dollar_volume: float = 5e6, min_price: float = 5.0) -> Column:
    return (F.col("i") >= liq) & (F.col(f"median_dv_{liq}") >= min_dollar_volume) & (F.col("close") >= min_price)


def placebo_candidates(trades: DataFrame, purchases: DataFrame, hold: int, liq: int = 60) -> DataFrame:
    """Eligible bars farther than ``hold`` bars from any purchase, numbered per symbol by date and by
    prior return. Distances come from the last and the next marked bar, not from pairs."""
    p = purchases.select(F.col("issuer").alias("symbol"), F.col("filed").alias("_d")).distinct()
    at = asof_join(p, trades.select("symbol", "session", "i"), "symbol", "_d", "session", {"i": "i"}, direction="forward")
    mark = at.where(F.col("i").isNotNull()).select("symbol", "i").distinct().withColumn("_m", F.lit(True))
    # a purchase after the last bar still blocks the end of the series
    late = at.where(F.col("i").isNull()).select("symbol").distinct().withColumn("_late", F.lit(True))
    w = Window.partitionBy("symbol").orderBy("i")
    t = trades.join(mark, ["symbol", "i"], "left").join(late, "symbol", "left")
    t = t.withColumns({"_a": F.last(F.when(F.col("_m"), F.col("i")), ignorenulls=True).over(so_far(w)),
                       "_b": F.last(F.when(F.col("_m"), F.col("i")), ignorenulls=True).over(so_far(Window.partitionBy("symbol").orderBy(F.desc("i"))))})
    nxt = F.coalesce("_b", F.when(F.col("_late"), F.col("n")))
    far = (F.coalesce(F.col("i") - F.col("_a") > hold, F.lit(True))) & F.coalesce(nxt - F.col("i") > hold, F.lit(True))
    c = t.where(far & eligible(liq) & (F.col("i") < F.col("n") - hold - 2))
    c = c.withColumns({"c_rank": F.row_number().over(w), "m_rank": F.row_number().over(Window.partitionBy("symbol").orderBy(F.col(f"prior_126").asc_nulls_last(), "i")),
                       "c_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    return c.drop("_m", "_late", "_a", "_b")


def sample_placebos(events: DataFrame, candidates: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """At most ``k`` different placebo bars per event, without pairing events and candidates.

    The numbered candidates of a symbol are cut into k equal stretches and one number is drawn in
    each; the drawn numbers meet the candidates by equality.
    """
    n = candidates.groupBy("symbol").agg(F.max("c_n").alias("_n"))
    e = events.select("symbol", F.col("session").alias("event_session"), F.datediff("session", F.lit("1970-01-01").cast("date")).alias("_e")).join(n, "symbol")
    e = e.withColumn("_k", F.least(F.lit(k), F.col("_n"))).withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"))))
    u = uniform(seed, F.col("symbol"), F.col("_e"), F.col("_j"))
    e = e.withColumn("c_rank", (F.floor((F.col("_j") + u) * F.col("_n") / F.col("_k")) + 1).cast("int"))
    return e.select("symbol", "event_session", "c_rank").join(candidates, ["symbol", "c_rank"])


def sample_matched(events: DataFrame, candidates: DataFrame, band: float = 0.10, k: int = 5, seed: int = 11) -> DataFrame:
    """Placebos whose prior return lies within ``band`` of the event's: a rank interval from two
    ordered lookups, then one draw per stretch of it."""
    c = candidates.where(F.col("prior_126").isNotNull()).select("symbol", F.col("prior_126").alias("_v"), F.col("m_rank").alias("_r"))
    lo_c, hi_c = (c.groupBy("symbol", "_v").agg(f("_r").alias("_r")) for f in (F.min, F.max))
    e = events.where(F.col("prior_126").isNotNull()).select("symbol", F.col("session").alias("event_session"), (F.col("prior_126") - band).alias("_lo"),
                                                             (F.col("prior_126") + band).alias("_hi"), F.datediff("session", F.lit("1970-01-01").cast("date")).alias("_e"))
    e = asof_join(e, lo_c, "symbol", "_lo", "_v", {"_r": "_ra"}, direction="forward")
    e = asof_join(e, hi_c, "symbol", "_hi", "_v", {"_r": "_rb"})
    e = e.where(F.col("_rb") >= F.col("_ra")).withColumn("_n", F.col("_rb") - F.col("_ra") + 1)
    e = e.withColumn("_k", F.least(F.lit(k), F.col("_n"))).withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"))))
    u = uniform(seed, F.col("symbol"), F.col("_e"), F.col("_j"))
    e = e.withColumn("m_rank", (F.col("_ra") + F.floor((F.col("_j") + u) * F.col("_n") / F.col("_k"))).cast("int"))
    return e.select("symbol", "event_session", "m_rank").join(candidates, ["symbol", "m_rank"])


def event_study(clusters: DataFrame, purchases: DataFrame, trades: DataFrame, hold: int, liq: int = 60) -> DataFrame:
    """Per event: abnormal return and its difference to the mean of the stock's placebos and of the
    momentum-matched placebos."""
    bars = trades.withColumn("_s", F.col("session"))
    cols = ["_s", "i", "n", "close", f"median_dv_{liq}", "prior_126", "ret", "ar", "exit_how"]
    e = asof_join(clusters.select(F.col("issuer").alias("symbol"), "signal_date", "n_insiders", "total_value"), bars, "symbol", "signal_date", "session", {x: x for x in cols})
    e = e.where(F.col("_s").isNotNull()).where(eligible(liq) & F.col("ar").isNotNull()).withColumnRenamed("_s", "session")
    # read by both draws, each several times
    cand = materialize(placebo_candidates(trades, purchases, hold, liq).select("symbol", "c_rank", "m_rank", "c_n", "prior_126", "ar"), "candidates")
    p = sample_placebos(e, cand).groupBy("symbol").agg(F.avg("ar").alias("_p"))
    m = sample_matched(e, cand).groupBy("symbol").agg(F.avg("ar").alias("_m"))
    e = e.join(p, "symbol", "left").join(m, "symbol", "left")
    return e.withColumns({"ar_minus_placebo": F.col("ar") - F.col("_p"), "ar_minus_matched": F.col("ar") - F.col("_m")}).drop("_p", "_m")


def first_touch(bars: DataFrame, signal: str, stop_dist: str, reward: float = 2.0, max_hold: int = 20, cost: float = 0.0005) -> DataFrame:
    """Outcome label of each long signal: enter at the next open, leave at the stop, the target or after
    ``max_hold`` bars, whichever comes first (the stop when one bar touches both; a gap fills at the open).

    Each signal carries its next bars as one short array, so there is no join and no running account.
    """
    w = by_time("symbol", "session")
    ahead = F.array_agg(F.struct("session", "open", "high", "low", "close")).over(w.rowsBetween(1, max_hold))
    d = bars.withColumn("_bars", F.when(F.col(signal), ahead)).where(F.col(signal) & (F.size("_bars") > 0) & (F.col(stop_dist) > 0))
    entry = F.element_at("_bars", 1)["open"]
    d = d.withColumn("entry", entry).withColumns({"stop": F.col("entry") - F.col(stop_dist), "target": F.col("entry") + reward * F.col(stop_dist)})
    hits = F.transform("_bars", lambda z, i: F.struct(
        i.alias("i"), F.when(z["low"] <= F.col("stop"), "stop").when(z["high"] >= F.col("target"), "target").alias("why"),
        F.when(z["low"] <= F.col("stop"), F.when(i == 0, F.col("stop")).otherwise(F.least(z["open"], F.col("stop"))))
        .when(z["high"] >= F.col("target"), F.when(i == 0, F.col("target")).otherwise(F.greatest(z["open"], F.col("target")))).alias("px"), z["session"].alias("s")))
    d = d.withColumn("_hit", F.try_element_at(F.filter(hits, lambda z: z["why"].isNotNull()), F.lit(1)))
    end = F.element_at("_bars", -1)
    full_time = F.size("_bars") >= max_hold
    d = d.withColumns({"reason": F.coalesce(F.col("_hit.why"), F.when(full_time, "time")),
                       "exit_price": F.coalesce(F.col("_hit.px"), F.when(full_time, end["close"])), "exit_session": F.coalesce(F.col("_hit.s"), F.when(full_time, end["session"]))})
    d = d.where(F.col("reason").isNotNull())
    d = d.withColumn("ret", F.col("exit_price") * (1 - cost) / (F.col("entry") * (1 + cost)) - 1)
    return d.withColumn("r", F.col("ret") * F.col("entry") / F.col(stop_dist)).drop("_bars", "_hit")


def holding_study(bars: DataFrame, market: DataFrame, entries=(0, 21, 126), horizon: int = 126, cost: float = 0.001) -> DataFrame:
    """Returns of buying each series at fixed ordinals after its first bar, to ``horizon`` bars later or
    its last bar if that comes first, against the market between the same sessions."""
    w = by_time("symbol", "session")
    whole = Window.partitionBy("symbol")
    b = bars.select("symbol", "session", "open", "close", (F.row_number().over(w) - 1).alias("i"), F.max("session").over(whole).alias("_end"),
                    F.max_by("close", "session").over(whole).alias("_lc"), F.lead("session", horizon).over(w).alias("_xs"), F.lead("close", horizon).over(w).alias("_xc"))
    e = b.where(F.col("i").isin(*entries)).withColumns({"exit": F.coalesce("_xs", "_end"), "_px": F.coalesce("_xc", "_lc"), "early": F.col("_xs").isNull()})
    m1 = F.broadcast(market.select("session", F.col("close").alias("_m1")))
    m2 = F.broadcast(market.select(F.col("session").alias("exit"), F.col("close").alias("_m2")))
    e = e.join(m1, "session").join(m2, "exit").withColumn("ret", F.col("_px") * (1 - cost) / (F.col("close") * (1 + cost)) - 1)
    return e.select("symbol", F.col("i").alias("entry_bar"), "session", "exit", "early", "ret", (F.col("ret") - (F.col("_m2") / F.col("_m1") - 1)).alias("excess"))


def calendar_portfolio(events: DataFrame, returns: DataFrame, start: str, end: str) -> DataFrame:
    """Mean daily return of the events open on each day.

    Open counts come from +1/-1 steps per (symbol, day), so an event never meets every day it spans.
    """
    steps = events.select("symbol", F.explode(F.array(F.struct(F.col(start).alias("session"), F.lit(1).alias("d")), F.struct(F.date_add(end, 1).alias("session"), F.lit(-1).alias("d")))).alias("z"))
    s = steps.groupBy("symbol", F.col("z.session").alias("session")).agg(F.sum("z.d").alias("d"))
    u = returns.select("symbol", "session", "ret").withColumn("_k", F.lit(1)).unionByName(s.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("session", "_k").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("open", F.sum(F.coalesce("d", F.lit(0))).over(w)).where((F.col("_k") == 1) & (F.col("open") > 0))
    return u.groupBy("session").agg((F.sum(F.col("ret") * F.col("open")) / F.sum("open")).alias("ret"), F.sum("open").alias("open_events"))
