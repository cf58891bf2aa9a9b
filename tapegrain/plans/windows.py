"""Indicators and rolling features over daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.functions import indicators as I
from tapegrain.operators import factors as X
from tapegrain.operators.kernels import by_time, full, rank_in_group, trailing
from tapegrain.session import materialize
from tapegrain.plans.catalog import day, ds, query, rnd, rs

WS = "PARTITION BY symbol ORDER BY session"


def fr(n, end=0):
    return f"({WS} ROWS BETWEEN {n - 1 - end} PRECEDING AND {'CURRENT ROW' if end == 0 else f'{-end} PRECEDING'})"


def full_sql(agg, x, n, end=0, need=None):
    return f"CASE WHEN count({x}) OVER {fr(n, end)} >= {need or n} THEN {agg} OVER {fr(n, end)} END"


def ewm_sql(src, dst, specs, part="symbol", order="session"):
    """CTEs for decay averages in closed form (short series without inner gaps)."""
    ns = ", ".join(f"count({x}) OVER w AS n_{o}" for o, (x, a, m) in specs.items())
    run = "w"
    ys = ", ".join(
        f"CASE WHEN n_{o} >= {m} THEN power({1 - a!r}, n_{o}) * sum(CASE WHEN {x} IS NULL THEN 0 WHEN n_{o} = 1 THEN {x}"
        f" ELSE {a!r} * {x} END * power({1 - a!r}, -n_{o})) OVER {run} END AS {o}" for o, (x, a, m) in specs.items())
    win = f"WINDOW w AS (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"{dst}_n AS (SELECT *, {ns} FROM {src} {win}), {dst} AS (SELECT *, {ys} FROM {dst}_n {win})"


TR = """greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY session)),
 abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY session)))"""


@query("src01_daily_bars", f"""WITH {B.BARS} SELECT symbol, {ds()} AS session, {rs('open')} AS open, {rs('high')} AS high,
 {rs('low')} AS low, {rs('close')} AS close, volume, {rs('vwap')} AS vwap FROM bars""")
def daily_bars(spark, d):
    return B.daily_bars(spark, d).select("symbol", day().alias("session"), *[rnd(x).alias(x) for x in
                                         ("open", "high", "low", "close")], "volume", rnd("vwap").alias("vwap"))


@query("win01_sma", f"""WITH {B.BARS} SELECT symbol, {ds()} AS session, {rs(full_sql('avg(close)', 'close', 20))} AS sma_20,
 {rs(full_sql('avg(close)', 'close', 50))} AS sma_50, {rs(full_sql('avg(close)', 'close', 200))} AS sma_200 FROM bars""")
def sma(spark, d):
    b = I.with_indicators(B.daily_bars(spark, d), ["sma_20", "sma_50", "sma_200"])
    return b.select("symbol", day().alias("session"), *[rnd(f"sma_{n}").alias(f"sma_{n}") for n in (20, 50, 200)])


@query("win02_ema", f"""WITH {B.BARS}, {ewm_sql('bars', 'e', {'ema_12': ('close', 2 / 13, 12), 'ema_26': ('close', 2 / 27, 26)})}
 SELECT symbol, {ds()} AS session, {rs('ema_12')} AS ema_12, {rs('ema_26')} AS ema_26 FROM e""")
def ema(spark, d):
    b = I.with_indicators(B.daily_bars(spark, d), ["ema_12", "ema_26"])
    return b.select("symbol", day().alias("session"), rnd("ema_12").alias("ema_12"), rnd("ema_26").alias("ema_26"))


DELTA = f"""dl AS (SELECT *, close - lag(close) OVER ({WS}) AS dd FROM bars),
 ud AS (SELECT *, CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END AS up, CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0) END AS dn FROM dl)"""


@query("win03_rsi", f"""WITH {B.BARS}, {DELTA}, {ewm_sql('ud', 'e', {'au': ('up', 1 / 14, 14), 'ad': ('dn', 1 / 14, 14)})}
 SELECT symbol, {ds()} AS session, {rs('100 - 100 / (1 + au / nullif(ad, 0))')} AS rsi_14 FROM e""")
def rsi(spark, d):
    return I.add_rsi(B.daily_bars(spark, d)).select("symbol", day().alias("session"), rnd("rsi_14").alias("rsi_14"))


@query("win04_macd", f"""WITH {B.BARS}, {ewm_sql('bars', 'e', {'f': ('close', 2 / 13, 12), 's': ('close', 2 / 27, 26)})},
 m AS (SELECT symbol, session, f - s AS macd FROM e), {ewm_sql('m', 'g', {'sig': ('macd', 0.2, 9)})}
 SELECT symbol, {ds()} AS session, {rs('macd')} AS macd, {rs('sig')} AS macd_signal, {rs('macd - sig')} AS macd_hist FROM g""")
def macd(spark, d):
    b = I.add_macd(B.daily_bars(spark, d))
    return b.select("symbol", day().alias("session"), *[rnd(x).alias(x) for x in ("macd", "macd_signal", "macd_hist")])


@query("win05_bollinger", f"""WITH {B.BARS}, s AS (SELECT symbol, session, close, {full_sql('avg(close)', 'close', 20)} AS mid,
 {full_sql('stddev_samp(close)', 'close', 20)} AS sd FROM bars)
 SELECT symbol, {ds()} AS session, {rs('mid')} AS bb_mid, {rs('mid + 2 * sd')} AS bb_upper, {rs('mid - 2 * sd')} AS bb_lower,
 {rs('(close - (mid - 2 * sd)) / nullif(4 * sd, 0)')} AS bb_pctb FROM s""")
def bollinger(spark, d):
    b = I.add_bollinger(B.daily_bars(spark, d))
    return b.select("symbol", day().alias("session"), *[rnd(x).alias(x) for x in
                                                        ("bb_mid", "bb_upper", "bb_lower", "bb_pctb")])


@query("win06_atr", f"""WITH {B.BARS}, t AS (SELECT *, {TR} AS tr FROM bars),
 {ewm_sql('t', 'e', {'atr_14': ('tr', 1 / 14, 14)})} SELECT symbol, {ds()} AS session, {rs('atr_14')} AS atr_14 FROM e""")
def atr(spark, d):
    return I.add_atr(B.daily_bars(spark, d)).select("symbol", day().alias("session"), rnd("atr_14").alias("atr_14"))


@query("win07_session_vwap", f"""WITH {B.TICKS}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(ts AS DATE) AS session,
 max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(size) AS volume FROM ticks GROUP BY ALL)
 SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {rs('''sum((high + low + close) / 3 * volume) OVER w
  / nullif(sum(volume) OVER w, 0)''')} AS vwap_session FROM h WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)""")
def session_vwap(spark, d):
    h = X.hourly_bars(B.ticks(spark, d))
    return I.add_vwap(h).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                                rnd("vwap_session").alias("vwap_session"))


@query("win08_stochastic", f"""WITH {B.BARS}, k AS (SELECT symbol, session, 100 * (close - {full_sql('min(low)', 'low', 14)})
 / nullif({full_sql('max(high)', 'high', 14)} - {full_sql('min(low)', 'low', 14)}, 0) AS k FROM bars)
 SELECT symbol, {ds()} AS session, {rs('k')} AS stoch_k, {rs(full_sql('avg(k)', 'k', 3))} AS stoch_d FROM k""")
def stochastic(spark, d):
    b = I.add_stochastic(B.daily_bars(spark, d))
    return b.select("symbol", day().alias("session"), rnd("stoch_k").alias("stoch_k"), rnd("stoch_d").alias("stoch_d"))


def _mid(n):
    return f"({full_sql('max(high)', 'high', n)} + {full_sql('min(low)', 'low', n)}) / 2"


@query("win09_ichimoku", f"""WITH {B.BARS}, m AS (SELECT symbol, session, close, {_mid(9)} AS conv, {_mid(26)} AS base,
 {_mid(52)} AS m52 FROM bars) SELECT symbol, {ds()} AS session, {rs('conv')} AS ichi_conv, {rs('base')} AS ichi_base,
 {rs(f'lag((conv + base) / 2, 26) OVER ({WS})')} AS ichi_span_a, {rs(f'lag(m52, 26) OVER ({WS})')} AS ichi_span_b,
 {rs(f'lead(close, 26) OVER ({WS})')} AS ichi_lagging FROM m""")
def ichimoku(spark, d):
    b = I.add_ichimoku(B.daily_bars(spark, d))
    return b.select("symbol", day().alias("session"), *[rnd(x).alias(x) for x in (
        "ichi_conv", "ichi_base", "ichi_span_a", "ichi_span_b", "ichi_lagging")])


ADX_CTE = f"""mv AS (SELECT *, {TR} AS tr, high - lag(high) OVER ({WS}) AS u, lag(low) OVER ({WS}) - low AS dn FROM bars),
 dm AS (SELECT *, CASE WHEN u > dn AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0 END AS mdm FROM mv),
 {ewm_sql('dm', 'sm', {'a': ('tr', 1 / 14, 14), 'p': ('pdm', 1 / 14, 14), 'm': ('mdm', 1 / 14, 14)})},
 dxx AS (SELECT * EXCLUDE (n_a, n_p, n_m), 100 * abs(100 * p / nullif(a, 0) - 100 * m / nullif(a, 0)) / nullif(100 * p / nullif(a, 0)
  + 100 * m / nullif(a, 0), 0) AS dx FROM sm), {ewm_sql('dxx', 'ax', {'adx': ('dx', 1 / 14, 14)})}"""


@query("win10_adx", f"WITH {B.BARS}, {ADX_CTE} SELECT symbol, {ds()} AS session, {rs('adx')} AS adx FROM ax")
def adx(spark, d):
    return I.add_adx(B.daily_bars(spark, d)).select("symbol", day().alias("session"), rnd("adx").alias("adx"))


@query("win11_trailing_rank", f"""WITH {B.BARS}, v AS (SELECT symbol, session, close, list(close) OVER {fr(100)} AS vals FROM bars)
 SELECT symbol, {ds()} AS session, {rs('''CASE WHEN len(vals) >= 50 THEN
  CAST(len(list_filter(vals, lambda z: z < close)) AS DOUBLE) / (len(vals) - 1) END''', 6)} AS rank_100 FROM v""")
def trailing_rank(spark, d):
    return B.daily_bars(spark, d).select("symbol", day().alias("session"),
                                         rnd(I.trailing_rank("close", 100), 6).alias("rank_100"))


@query("win12_slope_atr", f"""WITH {B.BARS}, t AS (SELECT *, {TR} AS tr, {full_sql('avg(close)', 'close', 50)} AS ma FROM bars),
 {ewm_sql('t', 'e', {'atr': ('tr', 1 / 14, 14)})} SELECT symbol, {ds()} AS session,
 {rs(f'(ma - lag(ma, 10) OVER ({WS})) / nullif(10 * atr, 0)', 6)} AS slope FROM e""")
def slope(spark, d):
    b = I.add_atr(I.add_sma(B.daily_bars(spark, d), 50), 14)
    return b.select("symbol", day().alias("session"), rnd(I.slope_atr("sma_50", 10, "atr_14"), 6).alias("slope"))


@query("win13_slot_running_vwap", f"""WITH {B.TICKS}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(ts AS DATE) AS session,
 sum(price * size) / nullif(sum(size), 0) AS vwap, arg_max(price, (ts, event_id)) AS close, sum(size) AS volume FROM ticks GROUP BY ALL)
 SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, row_number() OVER w - 1 AS slot,
 {rs("sum(coalesce(vwap, close) * volume) OVER w / nullif(sum(volume) OVER w, 0)")} AS vwap_s
 FROM h WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)""")
def slot_vwap(spark, d):
    h = X.with_slots(X.hourly_bars(B.ticks(spark, d)))
    return h.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "slot", rnd("vwap_s").alias("vwap_s"))


@query("win14_same_time_baseline", f"""WITH {B.TICKS}, h AS (SELECT symbol, hour(ts) AS slot, CAST(ts AS DATE) AS session,
 sum(size) AS volume FROM ticks GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT symbol, session FROM h)
 CROSS JOIN (SELECT unnest(range(24)) AS slot)), j AS (SELECT g.symbol, g.session, g.slot, volume FROM g LEFT JOIN h USING (symbol, session, slot)),
 b AS (SELECT *, CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END AS base FROM j
  WINDOW w AS (PARTITION BY symbol, slot ORDER BY session ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
 SELECT symbol, {ds()} AS session, CAST(slot AS INTEGER) AS slot, {rs('volume')} AS volume, {rs('volume / nullif(base, 0)')} AS relvol
 FROM b WHERE volume IS NOT NULL""")
def same_time(spark, d):
    t = B.ticks(spark, d)
    h = (t.groupBy("symbol", F.hour("ts").alias("slot"), F.to_date("ts").alias("session"))
         .agg(F.sum("size").alias("volume")))
    b = X.same_time_baseline(h, "volume", 10, 24)
    return b.select("symbol", day().alias("session"), "slot", rnd("volume").alias("volume"),
                    rnd(F.col("volume") / F.nullif("base", F.lit(0.0))).alias("relvol"))


def _lr(n):
    return f"ln(close / lag(close, {n}) OVER ({WS}))"


@query("win15_feature_block", f"""WITH {B.BARS}, f AS (SELECT *, {_lr(1)} AS r1 FROM bars)
 SELECT symbol, {ds()} AS session, {rs('r1', 6)} AS ret_1, {rs(_lr(5), 6)} AS ret_5, {rs(_lr(21), 6)} AS ret_21, {rs(_lr(63), 6)} AS ret_63,
 {rs(full_sql('stddev_samp(r1)', 'r1', 21) + ' * sqrt(252)', 6)} AS vol_21,
 {rs(full_sql('stddev_samp(r1)', 'r1', 63) + ' * sqrt(252)', 6)} AS vol_63,
 {rs('close / ' + full_sql('avg(close)', 'close', 50) + ' - 1', 6)} AS sma_gap_50,
 {rs(f"(volume - {full_sql('avg(volume)', 'volume', 20)}) / nullif({full_sql('stddev_samp(volume)', 'volume', 20)}, 0)", 6)} AS vol_z_20,
 {rs(f'close / max(close) OVER ({WS} ROWS UNBOUNDED PRECEDING) - 1', 6)} AS drawdown,
 {rs(f'close / max(close) OVER {fr(252)} - 1', 6)} AS drawdown_252 FROM f""")
def feature_block(spark, d):
    f = X.feature_block(B.daily_bars(spark, d))
    return f.select("symbol", day().alias("session"), *[rnd(x, 6).alias(x) for x in (
        "ret_1", "ret_5", "ret_21", "ret_63", "vol_21", "vol_63", "sma_gap_50", "vol_z_20", "drawdown", "drawdown_252")])


@query("win16_forward_targets", f"""WITH {B.BARS} SELECT symbol, {ds()} AS session,
 {rs(f'ln(lead(close, 5) OVER ({WS}) / close)', 6)} AS target_5, {rs(f'ln(lead(close, 21) OVER ({WS}) / close)', 6)} AS target_21 FROM bars""")
def targets(spark, d):
    b = X.forward_targets(B.daily_bars(spark, d), (5, 21))
    return b.select("symbol", day().alias("session"), rnd("target_5", 6).alias("target_5"), rnd("target_21", 6).alias("target_21"))


@query("win18_event_features", f"""WITH {B.BARS}, f AS (SELECT *, {_lr(1)} AS r1, {TR} AS tr FROM bars),
 {ewm_sql('f', 'e', {'atr': ('tr', 1 / 14, 14)})}
 SELECT symbol, {ds()} AS session, {rs(f'close / lag(close, 5) OVER ({WS}) - 1', 6)} AS ret_5,
 {rs(f'close / lag(close, 20) OVER ({WS}) - 1', 6)} AS ret_20, {rs(f'close / lag(close, 60) OVER ({WS}) - 1', 6)} AS ret_60,
 {rs(f"{full_sql('stddev_samp(r1)', 'r1', 20)} / nullif({full_sql('stddev_samp(r1)', 'r1', 60)}, 0)", 6)} AS vol_ratio,
 {rs(f"(close - {full_sql('avg(close)', 'close', 50)}) / nullif(atr, 0)", 6)} AS dist_sma50_atr,
 {rs(f"(close - {full_sql('max(high)', 'high', 55, -1)}) / nullif(atr, 0)", 6)} AS dist_high55_atr,
 {rs(f"(close - {full_sql('min(low)', 'low', 55, -1)}) / nullif(atr, 0)", 6)} AS dist_low55_atr,
 {rs(f"close / {full_sql('max(high)', 'high', 252)} - 1", 6)} AS off_high_252,
 {rs(f"(open - lag(close) OVER ({WS})) / nullif(atr, 0)", 6)} AS gap_atr,
 {rs(f"volume / nullif({full_sql('avg(volume)', 'volume', 20)}, 0)", 6)} AS volume_ratio FROM e""")
def event_features(spark, d):
    f = X.event_features(B.symbol_bars(spark, d))
    return f.select("symbol", day().alias("session"), *[rnd(x, 6).alias(x) for x in X.EVENT_FEATURES])


def bound(spark, d):
    return B.symbol_bound(spark, d)


LR = f"""px AS (SELECT symbol, session, close, volume, open, vwap, high, low, ln(close) AS lc, ln(close) - lag(ln(close)) OVER ({WS}) AS r1 FROM bars),
 mk AS (SELECT session, ln(close) - lag(ln(close)) OVER (ORDER BY session) AS mr FROM mkt),
 pm AS (SELECT px.*, mr FROM px JOIN mk USING (session)),
 pr AS (SELECT *, CASE WHEN r1 IS NOT NULL AND mr IS NOT NULL THEN r1 END AS rr,
  CASE WHEN r1 IS NOT NULL AND mr IS NOT NULL THEN mr END AS rm FROM pm),
 bt AS (SELECT *, CASE WHEN count(rr) OVER w >= 126 THEN covar_samp(rr, rm) OVER w / nullif(var_samp(rm) OVER w, 0) END AS beta,
  lag(lc, 21) OVER ({WS}) - lag(lc, 252) OVER ({WS}) AS mom FROM pr
  WINDOW w AS ({WS} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
 rl AS (SELECT *, r1 - beta * mr AS resid FROM bt),
 rg AS (SELECT *, lag(resid, 21) OVER ({WS}) AS rz FROM rl),
 fa AS (SELECT rg.*, sector, CASE WHEN count(rz) OVER w2 = 231 THEN sum(rz) OVER w2 / (stddev_samp(rz) OVER w2 + 1e-9) END AS resmom
  FROM rg JOIN sectors USING (symbol) WINDOW w2 AS ({WS} ROWS BETWEEN 230 PRECEDING AND CURRENT ROW)),
 fx AS (SELECT *, mom - median(mom) OVER (PARTITION BY session, sector) AS secrel FROM fa),
 mask AS (SELECT *, (count(close) OVER ({WS} ROWS UNBOUNDED PRECEDING) >= 260 AND close > 5 AND
  coalesce({full_sql('avg(close * volume)', 'close', 21)}, 0) > 10000) AS ok FROM fx)"""
FACT = f"{B.BARS}, {B.MARKET}, {B.SECTORS}, {LR}"


@query("win28_factors", f"""WITH {FACT} SELECT symbol, {ds()} AS session, {rs('beta', 6)} AS beta, {rs('mom', 6)} AS mom_12_1,
 {rs('resmom', 4)} AS resmom_12_1, {rs('secrel', 6)} AS sec_rel_mom, ok AS tradeable FROM mask""")
def factors(spark, d):
    f = X.panel_factors(B.daily_bars(spark, d), B.market_bars(spark, d), B.sectors(spark, d), 10_000.0, bound(spark, d))
    return f.select("symbol", day().alias("session"), rnd("beta", 6).alias("beta"), rnd("mom_12_1", 6).alias("mom_12_1"),
                    rnd("resmom_12_1", 4).alias("resmom_12_1"), rnd("sec_rel_mom", 6).alias("sec_rel_mom"), "tradeable")


def pct_sql(x, by="session"):
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x})"
            f" - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) - 0.5 END")


@query("win30_cs_rank", f"""WITH {B.BARS}, m AS (SELECT symbol, session, round(close / lag(close, 21) OVER ({WS}) - 1, 3) AS r21 FROM bars)
 SELECT symbol, {ds()} AS session, {rs(pct_sql('r21'), 6)} AS pct FROM m""")
def cs_rank(spark, d):
    b = B.daily_bars(spark, d)
    m = b.select("symbol", "session", F.round(F.col("close") / F.lag("close", 21).over(by_time("symbol", "session")) - 1, 3).alias("r21"))
    return rank_in_group(m, ["session"], "r21", "pct", bound(spark, d)).select(
        "symbol", day().alias("session"), rnd("pct", 6).alias("pct"))


@query("win30_cs_rank_unbounded", f"""WITH {B.BARS}, m AS (SELECT symbol, session, round(close / lag(close, 21) OVER ({WS}) - 1, 3) AS r21 FROM bars)
 SELECT symbol, {ds()} AS session, {rs(pct_sql('r21'), 6)} AS pct FROM m""")
def cs_rank_unbounded(spark, d):
    """The same ranks without any bound on the names per date."""
    b = B.daily_bars(spark, d)
    m = b.select("symbol", "session", F.round(F.col("close") / F.lag("close", 21).over(by_time("symbol", "session")) - 1, 3).alias("r21"))
    return rank_in_group(m, ["session"], "r21", "pct").select("symbol", day().alias("session"), rnd("pct", 6).alias("pct"))


COMP = f"""{FACT}, mm AS (SELECT *, CASE WHEN ok THEN mom END AS m1, CASE WHEN ok THEN resmom END AS m2, CASE WHEN ok THEN secrel END AS m3 FROM mask),
 cp AS (SELECT symbol, session, close, open, ok, {pct_sql('m1')} AS k1, {pct_sql('m2')} AS k2, {pct_sql('m3')} AS k3 FROM mm),
 sc AS (SELECT *, CASE WHEN ok THEN (coalesce(k1, 0) + coalesce(k2, 0) + coalesce(k3, 0)) / 6 END AS score FROM cp)"""


def composite_panel(spark, d):
    f = X.panel_factors(B.daily_bars(spark, d), B.market_bars(spark, d), B.sectors(spark, d), 10_000.0, bound(spark, d))
    return X.composite(f, X.MOMENTUM_WEIGHTS, bound(spark, d))


@query("win31_composite", f"WITH {COMP} SELECT symbol, {ds()} AS session, {rs('score', 6)} AS score FROM sc WHERE score IS NOT NULL")
def composite(spark, d):
    return composite_panel(spark, d).where(F.col("score").isNotNull()).select(
        "symbol", day().alias("session"), rnd("score", 6).alias("score"))


@query("srt01_rank_universe", f"""WITH {COMP}, cov AS (SELECT session, count(score) AS n FROM sc GROUP BY 1),
 best AS (SELECT max(session) AS d FROM cov WHERE n >= 0.8 * (SELECT max(n) FROM cov)),
 r AS (SELECT symbol, session, round(score, 8) AS s8, score, row_number() OVER (ORDER BY round(score, 8) DESC, symbol) AS rn,
  row_number() OVER (ORDER BY round(score, 8), symbol DESC) AS rb, count(*) OVER () AS n FROM sc
  WHERE session = (SELECT d FROM best) AND score IS NOT NULL)
 SELECT symbol, {ds()} AS session, {rs('score', 6)} AS score, CASE WHEN rn <= 10 THEN 'long' ELSE 'short' END AS side,
 CAST(CASE WHEN rn <= 10 THEN rn ELSE rb END AS INTEGER) AS place, {rs('100.0 * (1 - (rn - 1.0) / greatest(n - 1, 1))', 1)} AS percentile
 FROM r WHERE rn <= 10 OR rb <= 5""")
def rank_universe(spark, d):
    f = X.panel_factors(B.daily_bars(spark, d), B.market_bars(spark, d), B.sectors(spark, d), 10_000.0, bound(spark, d))
    f = materialize(f.select("symbol", "session", "tradeable", *X.MOMENTUM_WEIGHTS), "panel")  # read by the counts and by the ranks
    r = X.rank_universe(X.composite(X.last_covered(f), X.MOMENTUM_WEIGHTS, bound(spark, d)), top=10, bottom=5)
    return r.select("symbol", day().alias("session"), rnd("score", 6).alias("score"), "side", "place",
                    rnd("percentile", 1).alias("percentile"))


@query("win32_trend_gate", f"""WITH {B.MARKET} SELECT {ds()} AS session, close > {full_sql('avg(close)', 'close', 210)} AS risk_on FROM mkt""")
def trend_gate(spark, d):
    m = B.market_bars(spark, d)
    return m.select(day().alias("session"), (F.col("close") > I.sma("close", 210)).alias("risk_on"))


@query("win37_liquidity", f"""WITH {B.BARS}, x AS (SELECT symbol, session, close, close * volume AS dv FROM bars)
 SELECT symbol, {ds()} AS session, {rs(full_sql('quantile_cont(dv, 0.5)', 'dv', 60))} AS median_dv_60,
 {rs(f'close / lag(close, 126) OVER ({WS}) - 1', 6)} AS prior_126 FROM x""")
def liquidity(spark, d):
    b = X.liquidity(B.daily_bars(spark, d))
    return b.select("symbol", day().alias("session"), rnd("median_dv_60").alias("median_dv_60"), rnd("prior_126", 6).alias("prior_126"))


@query("win39_forward_daily", f"""WITH {B.BARS}, r AS (SELECT *, close / lag(close) OVER ({WS}) - 1 AS ret FROM bars)
 SELECT symbol, {ds()} AS session, {rs(f'lead(close, 10) OVER ({WS}) / lead(open) OVER ({WS}) - 1', 6)} AS fwd_ret,
 {rs(f'CASE WHEN count(ret) OVER w = 10 THEN stddev_samp(ret) OVER w * sqrt(252) END', 6)} AS fwd_vol FROM r
 WINDOW w AS ({WS} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""")
def forward_daily(spark, d):
    b = X.forward_daily(B.daily_bars(spark, d), 10)
    return b.select("symbol", day().alias("session"), rnd("fwd_ret", 6).alias("fwd_ret"), rnd("fwd_vol", 6).alias("fwd_vol"))


@query("win51_horizon_sigma", f"""WITH {B.BARS}, f AS (SELECT *, {_lr(1)} AS r1 FROM bars), v AS (SELECT symbol, session,
 {full_sql('stddev_samp(r1)', 'r1', 21)} * sqrt(252) AS v21, {full_sql('stddev_samp(r1)', 'r1', 63)} * sqrt(252) AS v63 FROM f)
 SELECT symbol, {ds()} AS session, {rs('greatest(coalesce(0.5 * v21 + 0.5 * v63, 0.25), 0.05) * sqrt(5 / 252.0)', 6)} AS sigma_5 FROM v""")
def horizon_sigma(spark, d):
    f = X.feature_block(B.daily_bars(spark, d))
    return f.select("symbol", day().alias("session"), rnd(X.horizon_sigma("vol_21", "vol_63", 5), 6).alias("sigma_5"))


@query("win52_drawdown_from_high", f"""WITH {B.BARS} SELECT symbol, {ds()} AS session, {rs(f'1 - close / max(close) OVER {fr(252)}', 6)} AS drawdown FROM bars""")
def drawdown(spark, d):
    w = trailing(by_time("symbol", "session"), 252)
    return B.daily_bars(spark, d).select("symbol", day().alias("session"),
                                         rnd(1 - F.col("close") / F.max("close").over(w), 6).alias("drawdown"))
