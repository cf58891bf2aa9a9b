"""Screen scores and decision rules as column expressions over one row per symbol or position.

Inputs are plain columns: ret_1m, ret_3m, rsi14, above_sma50, above_sma200, pos_in_range, pct_off_high,
vol_z_20, n_articles, sentiment, market_cap, pe, pa_score, pa_trend, catalyst_score, max_materiality,
lead_direction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapegrain.operators.kernels import clip

c = F.col
unit = lambda x: clip(x, -1.0, 1.0)

# Component weights of the screens.
SCREEN_WEIGHTS = {
    "rising_stars": {"momentum_3m": 0.18, "momentum_1m": 0.10, "rsi_zone": 0.08, "above_sma200": 0.08, "range_position": 0.14,
                     "volume_spike": 0.10, "news_velocity": 0.08, "news_sentiment": 0.16, "size_preference": 0.08},
    "smart_money": {"pa_confluence": 0.55, "trend_align": 0.20, "news_confirm": 0.15, "above_sma200": 0.10},
    "underpriced_movers": {"size": 0.25, "valuation": 0.30, "catalyst": 0.30, "momentum": 0.10, "trend": 0.05},
    "catalyst_plays": {"catalyst_strength": 0.50, "catalyst_polarity": 0.20, "headroom": 0.20, "rsi": 0.10},
}
# Weights of the recommendation by market regime.
REGIME_WEIGHTS = {
    "bull_low_vol": {"forecast": 0.30, "technical": 0.20, "fundamental": 0.15, "sentiment": 0.10, "price_action": 0.15},
    "bull_high_vol": {"forecast": 0.22, "technical": 0.15, "fundamental": 0.08, "sentiment": 0.20, "price_action": 0.25},
    "bear_low_vol": {"forecast": 0.28, "technical": 0.20, "fundamental": 0.12, "sentiment": 0.12, "price_action": 0.20},
    "bear_high_vol": {"forecast": 0.20, "technical": 0.12, "fundamental": 0.08, "sentiment": 0.20, "price_action": 0.25},
    "sideways": {"forecast": 0.20, "technical": 0.20, "fundamental": 0.15, "sentiment": 0.10, "price_action": 0.25},
}
OPINION_WEIGHTS = {"recommendation": 0.40, "forecast_move": 0.10, "analysts": 0.12, "insider": 0.08, "institutional": 0.06, "political": 0.05}


def _rising_stars() -> dict[str, Column]:
    rsi, pir, mc = c("rsi14"), c("pos_in_range"), F.coalesce(c("market_cap"), F.lit(0.0))
    return {
        "momentum_3m": unit(c("ret_3m") * 2.5), "momentum_1m": unit(c("ret_1m") * 5),
        "rsi_zone": F.when(rsi.between(50, 75), 1.0).when(rsi > 80, -0.6).when(rsi < 40, -0.3).otherwise(0.3),
        "above_sma200": F.when(c("above_sma200"), 0.8).otherwise(-0.5),
        "range_position": F.when(pir.between(0.7, 0.92), 1.0).when(pir > 0.97, -0.3).when(pir < 0.4, -0.2).otherwise(0.4),
        "volume_spike": unit(c("vol_z_20") * 0.5), "news_velocity": unit((c("n_articles") - 8) / 15), "news_sentiment": unit(c("sentiment") * 2),
        "size_preference": F.when(mc == 0, 0.0).when(mc < 50e9, 0.5).when(mc < 200e9, 0.1).otherwise(-0.3)}


def _breakout() -> dict[str, Column]:
    return {"above_sma50": F.when(c("above_sma50"), 0.5).otherwise(-0.5), "above_sma200": F.when(c("above_sma200"), 0.5).otherwise(-0.5),
            "near_high": F.when(c("pos_in_range") > 0.85, 1.0).when(c("pos_in_range") < 0.5, -0.3).otherwise(0.3),
            "volume_spike": unit(c("vol_z_20") * 0.6), "rsi": F.when((c("rsi14") > 55) & (c("rsi14") < 78), 0.6).otherwise(-0.3)}


def _value_with_catalyst() -> dict[str, Column]:
    return {"valuation": F.when((c("pe") > 0) & (c("pe") < 18), 0.8).when(c("pe") > 40, -0.4).otherwise(0.1),
            "news_sentiment": unit(c("sentiment") * 2), "momentum": unit(c("ret_1m") * 5), "above_sma50": F.when(c("above_sma50"), 0.5).otherwise(-0.3)}


def _smart_money() -> dict[str, Column]:
    pa, long = c("pa_score"), c("pa_score") > 0
    news = unit(c("sentiment") * 1.5)
    return {"pa_confluence": pa,
            "trend_align": F.when(((c("pa_trend") == "up") & long) | ((c("pa_trend") == "down") & (pa < 0)), 0.5).when(c("pa_trend") == "range", 0.1).otherwise(-0.4),
            "news_confirm": F.when(long, news).otherwise(-news),
            "above_sma200": F.when(long, F.when(c("above_sma200"), 0.4).otherwise(-0.5)).otherwise(F.when(c("above_sma200"), -0.4).otherwise(0.4))}


def _underpriced_movers() -> dict[str, Column]:
    mc, pe = F.coalesce(c("market_cap"), F.lit(0.0)), c("pe")
    return {"size": F.when(mc > 5e9, -1.0).when(mc < 2e9, 1.0).when(mc < 5e9, 0.6).otherwise(0.0),
            "valuation": F.when(pe.isNull(), -0.2).when((pe > 0) & (pe < 12), 1.0).when((pe >= 12) & (pe < 20), 0.5).when(pe >= 40, -0.6).otherwise(0.2),
            "catalyst": c("catalyst_score") * 1.2, "momentum": unit(c("ret_1m") * 4), "trend": F.when(c("above_sma200"), 0.4).otherwise(-0.4)}


def _catalyst_plays() -> dict[str, Column]:
    return {"catalyst_strength": c("max_materiality"), "catalyst_polarity": c("catalyst_score"),
            "headroom": F.when(c("ret_1m") > 0.30, -0.5).when(c("ret_1m") > 0.10, 0.2).otherwise(0.6), "rsi": F.when(c("rsi14") > 85, -0.6).otherwise(0.3)}


SCREENS: dict[str, Callable[[], dict[str, Column]]] = {
    "rising_stars": _rising_stars, "breakout": _breakout, "value_with_catalyst": _value_with_catalyst,
    "smart_money": _smart_money, "underpriced_movers": _underpriced_movers, "catalyst_plays": _catalyst_plays}


def components(screen: str) -> Column:
    """Component values as a map."""
    parts = SCREENS[screen]()
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))])


def score(screen: str) -> Column:
    """Score in [-1, 1]; the catalyst screen needs a material bullish lead and is 0 without one."""
    parts = SCREENS[screen]()
    w = SCREEN_WEIGHTS.get(screen)
    zero = F.lit(0.0)
    total = sum((F.coalesce(v, zero) * (w[k] if w else 1.0 / len(parts)) for k, v in parts.items()), zero)
    s = unit(total)
    if screen == "catalyst_plays":
        gate = (c("max_materiality") >= 0.6) & (c("lead_direction") == "bullish")
        s = F.when(gate, s).otherwise(0.0)
    return s


def entry_quality() -> Column:
    """Product of penalties for stretched prices and a bonus for pullbacks in an uptrend."""
    rsi, r1, r3, off, up = c("rsi14"), F.coalesce(c("ret_1m"), F.lit(0.0)), F.coalesce(c("ret_3m"), F.lit(0.0)), F.coalesce(c("pct_off_high"), F.lit(0.0)), c("above_sma200")
    q = F.when(rsi > 80, 0.45).when(rsi > 75, 0.65).when(rsi > 70, 0.82).otherwise(1.0)
    q = q * F.when(off < 0.02, 0.60).when(off < 0.05, 0.82).otherwise(1.0)
    q = q * F.when(r3 > 0.60, 0.40).when(r3 > 0.40, 0.60).when(r3 > 0.25, 0.80).otherwise(1.0)
    q = q * F.when(r1 > 0.25, 0.70).otherwise(1.0)
    q = q * F.when(up & rsi.between(40, 55), 1.15).when(up & r1.between(0.05, 0.15) & (rsi.isNull() | rsi.between(50, 65)), 1.05).otherwise(1.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.30), q))


def technical(rsi="rsi14", hist="macd_hist", close="close", sma50="sma_50", sma200="sma_200") -> tuple[Column, Column]:
    """Technical sub-score and its drivers."""
    z = F.lit(0.0)
    s = F.when(c(rsi) < 30, 0.3).when(c(rsi) > 70, -0.3).otherwise(z)
    s = s + F.when(c(hist).isNull(), z).when(c(hist) > 0, 0.15).otherwise(-0.15)
    for m in (sma50, sma200):
        s = s + F.when(c(m).isNull(), z).when(c(close) > c(m), 0.1).otherwise(-0.1)
    d = F.array_compact(F.array(
        F.when(c(rsi) < 30, "RSI oversold").when(c(rsi) > 70, "RSI overbought"),
        F.when(c(hist) > 0, "MACD histogram positive").when(c(hist) <= 0, "MACD histogram negative"),
        F.when(c(close) > c(sma50), "above 50-day average").when(c(close) <= c(sma50), "below 50-day average"),
        F.when(c(close) > c(sma200), "above 200-day average").when(c(close) <= c(sma200), "below 200-day average")))
    return s, d


def fundamental(pe="pe", eps="eps") -> Column:
    s = F.when((c(pe) > 0) & (c(pe) < 15), 0.25).when(c(pe) > 40, -0.15).otherwise(0.0)
    return s + F.when(c(eps) > 0, 0.05).when(c(eps) < 0, -0.1).otherwise(0.0)


def agreement(parts: list[Column]) -> Column:
    """Share of the larger sign among the parts that are not near zero; 0.5 when none is."""
    live = F.filter(F.array(*parts), lambda x: F.abs(x) > 0.05)
    pos = F.size(F.filter(live, lambda x: x > 0))
    return F.when(F.size(live) == 0, 0.5).otherwise(F.greatest(pos, F.size(live) - pos) / F.nullif(F.size(live), F.lit(0)))


def recommendation(regime: Column, forecast: Column, tech: Column, fund: Column, sent: Column, pa: Column) -> tuple[Column, Column]:
    """Regime-weighted blend of five scores and a confidence from their agreement."""
    parts = {"forecast": forecast, "technical": tech, "fundamental": fund, "sentiment": sent, "price_action": pa}
    out = None
    for name, w in REGIME_WEIGHTS.items():
        s = sum((parts[k] * v for k, v in w.items()), F.lit(0.0))
        out = F.when(regime == name, s) if out is None else out.when(regime == name, s)
    return out, clip(0.4 + 0.5 * agreement(list(parts.values())), 0.1, 0.95)


def opinion(regime: Column, rec: Column, rec_conf: Column, move: Column, pa: Column, analysts: Column, insider: Column,
            institutional: Column, political: Column) -> tuple[Column, Column, Column]:
    """Score, confidence and verdict from seven signals; weights are normalised per regime."""
    pa_w = None
    for name, w in REGIME_WEIGHTS.items():
        v = F.lit(w["price_action"] * 0.5)
        pa_w = F.when(regime == name, v) if pa_w is None else pa_w.when(regime == name, v)
    base = sum(OPINION_WEIGHTS.values())
    o = OPINION_WEIGHTS
    num = (o["recommendation"] * rec + o["forecast_move"] * unit(move * 6.0) + pa_w * pa + o["analysts"] * analysts + o["insider"] * insider
           + o["institutional"] * institutional + o["political"] * political)
    s = unit(num / (base + pa_w))
    conf = clip(0.35 + 0.55 * agreement([rec, move, pa, analysts, insider, institutional, political]), 0.1, 0.95) * F.greatest(F.lit(0.5), rec_conf)
    return s, conf, label_from_score(s)


def label_from_score(s: Column, cuts: tuple[float, float, float, float] = (-0.35, -0.12, 0.12, 0.35)) -> Column:
    a, b, d, e = cuts
    return F.when(s >= e, "STRONG_BUY").when(s >= d, "BUY").when(s <= a, "STRONG_SELL").when(s <= b, "SELL").otherwise("HOLD")


def vol_slope_regime(vol: Column, slope: Column, vol_cut: float = 0.25, slope_cut: float = 0.02) -> Column:
    hv = vol > vol_cut
    return (F.when(slope > slope_cut, F.when(hv, "bull_high_vol").otherwise("bull_low_vol"))
            .when(slope < -slope_cut, F.when(hv, "bear_high_vol").otherwise("bear_low_vol")).otherwise("sideways"))


def drift_after_report(surprise: Column, days: Column) -> Column:
    """Sign and square root of the surprise, fading over 60 days; 0 outside 90."""
    raw = F.signum(surprise) * F.sqrt(F.abs(surprise) / 10.0) * F.greatest(F.lit(0.0), 1 - days / 60.0)
    return F.when(days.between(0, 90), unit(raw)).otherwise(0.0)


def surprise_blend(surprises: Column) -> Column:
    """Weighted tanh of the last four surprises, newest first (array)."""
    w = F.slice(F.array(*[F.lit(x) for x in (0.4, 0.3, 0.2, 0.1)]), F.lit(1), F.least(F.size(surprises), F.lit(4)))
    num = F.aggregate(F.zip_with(F.slice(surprises, 1, 4), w, lambda s, x: F.tanh(s / 10.0) * x), F.lit(0.0), lambda a, x: a + x)
    return num / F.aggregate(w, F.lit(0.0), lambda a, x: a + x)


def health_multiplier(h: Column) -> Column:
    return F.when(h >= 0, 1.0 + 0.10 * h).otherwise(1.0 + 0.55 * h)


def invest_timing(drawdown: Column, regime_score: Column, max_dd: float = 0.35, tilt: float = 0.10) -> tuple[Column, Column, Column]:
    """Opportunity, level and equity tilt from drawdown and fear."""
    one = lambda x: clip(x, 0.0, 1.0)
    o = F.round(one(0.65 * one(drawdown / max_dd) + 0.35 * one(-regime_score / 100.0)), 3)
    return o, F.when(o >= 0.60, "STRONG_BUY").when(o >= 0.30, "ACCUMULATE").otherwise("NORMAL"), F.when(o >= 0.30, F.round(tilt * one((o - 0.30) / 0.70), 3)).otherwise(0.0)


def position_alerts(pnl_pct: Column, rec: Column, stop_dist_pct: Column, days_to_report: Column, trend: Column) -> Column:
    a = lambda cond, sev, kind: F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(kind).alias("kind")))
    return F.array_compact(F.array(
        F.when(pnl_pct < -15, F.struct(F.lit("critical").alias("severity"), F.lit("drawdown").alias("kind")))
        .when(pnl_pct < -8, F.struct(F.lit("warning").alias("severity"), F.lit("drawdown").alias("kind"))),
        a(stop_dist_pct < 3, "warning", "stop_approaching"), a((days_to_report > 0) & (days_to_report <= 14), "info", "earnings"),
        a((rec < -0.2) & (pnl_pct > 0), "warning", "thesis_change"), a(trend == "down", "warning", "trend_flip")))


def position_verdict(pnl_pct: Column, rec: Column, alerts: Column, trend: Column) -> Column:
    warnings = F.size(F.filter(alerts, lambda z: z["severity"] == "warning"))
    return (F.when(pnl_pct < -15, "STOP_OUT").when((rec < -0.30) & (pnl_pct > 5), "SELL").when((rec < -0.10) & (warnings >= 2), "TRIM")
            .when((rec > 0.30) & (pnl_pct < 5) & (trend == "up"), "ADD").otherwise("HOLD"))


def first_alert(alerts: Column) -> Column:
    """The critical alert if there is one, else the first warning."""
    pick = lambda sev: F.try_element_at(F.filter(alerts, lambda z: z["severity"] == sev), F.lit(1))
    return F.coalesce(pick("critical"), pick("warning"))


def thesis_status(last: Column, direction: Column, invalidation: Column, target1: Column, days_left: Column, horizon: Column) -> Column:
    long = direction == "long"
    return (F.when((long & (last < invalidation)) | (~long & (last > invalidation)), "invalidated")
            .when((long & (last >= target1)) | (~long & (last <= target1)), "target_hit")
            .when(days_left < 0, "expired").when(days_left <= F.greatest(F.lit(1), F.floor(horizon * 0.2).cast("int")), "expiring").otherwise("on_track"))


def fill(price: Column, side: Column, kind: Column, shares: Column, half_spread_cents: float = 0.5, half_spread_bps: float = 1.0,
         slip_bps: dict[str, float] | None = None, per_share: float = 0.0, sec_per_million: float = 27.8, taf: float = 0.000166, taf_max: float = 8.3) -> Column:
    """Fill price and fees of an order: half spread and slippage by kind, fees on sales."""
    slip = slip_bps or {"market": 2.0, "stop": 5.0, "moc": 1.0}
    half = F.when(kind == "moc", 0.0).otherwise(F.greatest(F.lit(half_spread_cents / 100.0), price * half_spread_bps / 1e4))
    s = F.lit(0.0)
    for k, bps in slip.items():
        s = F.when(kind == k, price * bps / 1e4).otherwise(s)
    px = F.when(kind == "limit", price).otherwise(price + side * (half + s))
    fees = per_share * shares + F.when(side < 0, px * shares * sec_per_million / 1e6 + F.least(taf * shares, F.lit(taf_max))).otherwise(0.0)
    return F.struct(px.alias("price"), fees.alias("fees"))


def trade_plan(entry: Column, stop_dist: Column, capital: Column, risk: float = 0.01, reward: float = 2.0, slots: int = 10) -> Column:
    """Stop, target and whole shares: by risk per share, never above an equal slot of the capital."""
    by_risk = F.floor(capital * risk / F.nullif(stop_dist, F.lit(0.0)))
    by_slot = F.floor(capital / slots / F.nullif(entry, F.lit(0.0)))
    return F.struct((entry - stop_dist).alias("stop"), (entry + reward * stop_dist).alias("target"), F.least(by_risk, by_slot).alias("shares"))


def retracement_levels(high: Column, low: Column, ratios=(0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(str(r)) for r in ratios]), F.array(*[high - r * (high - low) for r in ratios]))
