"""Regimes, spells, drawdowns and price structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.operators import factors as X
from tapegrain.operators import regimes as R
from tapegrain.operators import structure as S
from tapegrain.operators.kernels import by_time, confirm, latch
from tapegrain.plans.catalog import day, ds, query, rnd, rs
from tapegrain.plans.windows import ADX_CTE, TR, WS, ewm_sql, full_sql
from tapegrain.session import materialize

MEMBERS = """members AS (SELECT l_suppkey AS symbol, min(CAST(l_shipdate AS DATE)) AS start, max(CAST(l_shipdate AS DATE)) AS "end"
  FROM lineitem GROUP BY 1, year(l_shipdate))"""


def members(spark, d):
    li = B.table(spark, d, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("_y"))
            .agg(F.min(F.to_date("l_shipdate")).alias("start"), F.max(F.to_date("l_shipdate")).alias("end")).drop("_y"))


def confirm_sql(src, dst, raw, out, days, immediate):
    w = "PARTITION BY symbol ORDER BY session"
    return f"""{dst}_l AS (SELECT *, {raw} IS NOT NULL AS live FROM {src}),
 {dst}_c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR {raw} IS DISTINCT FROM lag({raw}) OVER w THEN 1 ELSE 0 END AS chg,
   row_number() OVER w AS pos FROM {dst}_l WINDOW w AS (PARTITION BY symbol, live ORDER BY session)),
 {dst}_r AS (SELECT *, sum(chg) OVER (PARTITION BY symbol, live ORDER BY session ROWS UNBOUNDED PRECEDING) AS run FROM {dst}_c),
 {dst}_k AS (SELECT *, row_number() OVER (PARTITION BY symbol, live, run ORDER BY session) AS k FROM {dst}_r),
 {dst} AS (SELECT * EXCLUDE (live, chg, pos, run, k), last_value(CASE WHEN live AND (pos = 1 OR k >= {days} OR {raw} IN ({immediate})) THEN {raw} END IGNORE NULLS)
   OVER ({w} ROWS UNBOUNDED PRECEDING) AS {out} FROM {dst}_k)"""


REG = f"""{ADX_CTE}, fe AS (SELECT symbol, session, open, high, low, close, volume, a AS atr, adx, a / close AS atr_pct,
   {full_sql('avg(close)', 'close', 50)} AS sf, {full_sql('avg(close)', 'close', 200)} AS ss FROM ax),
 fg AS (SELECT *, (sf - lag(sf, 10) OVER ({WS})) / nullif(10 * atr, 0) AS slope,
   list(atr_pct) FILTER (atr_pct IS NOT NULL) OVER ({WS} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS vals,
   count(*) OVER ({WS} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS nrow FROM fe),
 fh AS (SELECT * EXCLUDE (vals, nrow), CASE WHEN atr_pct IS NOT NULL AND len(vals) >= 126 THEN
   CAST(len(list_filter(vals, lambda z: z < atr_pct)) AS DOUBLE) / (nrow - 1) END AS atr_rank FROM fg),
 fi AS (SELECT *, CASE WHEN ss IS NOT NULL AND adx IS NOT NULL AND slope IS NOT NULL THEN
   CASE WHEN close < ss AND slope < 0 THEN 'bear' WHEN close > ss AND slope > 0 AND adx >= 20 THEN 'bull' ELSE 'range' END END AS trend,
   coalesce(atr_rank >= 0.9 AND close < sf, false) AS hv FROM fh),
 fj AS (SELECT *, CASE WHEN trend IS NOT NULL AND atr_rank IS NOT NULL THEN CASE WHEN hv AND trend <> 'bull' THEN 'high_vol' ELSE trend END END AS raw FROM fi),
 {confirm_sql('fj', 'reg', 'raw', 'regime', 2, "'high_vol'")}"""


def stock_regimes(spark, d):
    return R.daily_regime(B.symbol_bars(spark, d))


@query("win19_trend_features", f"""WITH {B.BARS}, {REG} SELECT symbol, {ds()} AS session, {rs('atr_pct', 6)} AS atr_pct, {rs('slope', 6)} AS slope_fast,
 {rs('adx')} AS adx, {rs('atr_rank', 6)} AS atr_rank FROM reg""")
def trend_features(spark, d):
    f = R.trend_features(B.symbol_bars(spark, d))
    return f.select("symbol", day().alias("session"), rnd("atr_pct", 6).alias("atr_pct"), rnd("slope_fast", 6).alias("slope_fast"),
                    rnd("adx").alias("adx"), rnd("atr_rank", 6).alias("atr_rank"))


@query("win20_stock_regime", f"""WITH {B.BARS}, {REG} SELECT symbol, {ds()} AS session, trend, CASE WHEN hv THEN 'high' ELSE 'normal' END AS vol_state,
 raw, regime FROM reg""")
def stock_regime(spark, d):
    return stock_regimes(spark, d).select("symbol", day().alias("session"), "trend", "vol_state", "raw", "regime")


BREADTH = f"""br AS (SELECT session, avg(CAST(close > ma AS DOUBLE)) AS breadth, count(*) AS n_members FROM
 (SELECT symbol, session, close, {full_sql('avg(close)', 'close', 50)} AS ma FROM bars) b JOIN members m USING (symbol)
 WHERE ma IS NOT NULL AND session BETWEEN m.start AND m."end" GROUP BY 1)"""


@query("agg13_breadth", f"WITH {B.BARS}, {MEMBERS}, {BREADTH} SELECT {ds()} AS session, {rs('breadth', 6)} AS breadth, n_members FROM br")
def breadth(spark, d):
    b = R.breadth(members(spark, d), B.daily_bars(spark, d))
    return b.select(day().alias("session"), rnd("breadth", 6).alias("breadth"), "n_members")


# The synthetic market is far noisier than an index, so the volatility gate is set on its own scale.
MKT_PARAMS = R.DailyParams(vix_enter=600.0, vix_exit=500.0)
MREG = (REG.replace("FROM ax)", "FROM ax)", 1))


@query("win20_market_regime", f"""WITH {B.BARS}, {MEMBERS}, {BREADTH}, {B.MARKET.replace('mkt AS', 'mk0 AS')},
 mk1 AS (SELECT m.*, b.breadth, {full_sql('stddev_samp(r)', 'r', 20)} * sqrt(252) * 100 AS vix FROM
   (SELECT *, ln(close / lag(close) OVER (ORDER BY session)) AS r FROM mk0) m LEFT JOIN br b USING (session)),
 {ADX_CTE.replace('FROM bars)', 'FROM mk1)')}, fe AS (SELECT symbol, session, close, vix, breadth, a AS atr, adx, a / close AS atr_pct,
   {full_sql('avg(close)', 'close', 50)} AS sf, {full_sql('avg(close)', 'close', 200)} AS ss FROM ax),
 fg AS (SELECT *, (sf - lag(sf, 10) OVER ({WS})) / nullif(10 * atr, 0) AS slope,
   list(atr_pct) FILTER (atr_pct IS NOT NULL) OVER ({WS} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS vals,
   count(*) OVER ({WS} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS nrow FROM fe),
 fh AS (SELECT * EXCLUDE (vals, nrow), CASE WHEN atr_pct IS NOT NULL AND len(vals) >= 126 THEN
   CAST(len(list_filter(vals, lambda z: z < atr_pct)) AS DOUBLE) / (nrow - 1) END AS atr_rank FROM fg),
 fi AS (SELECT *, CASE WHEN ss IS NOT NULL AND adx IS NOT NULL AND slope IS NOT NULL THEN CASE WHEN close < ss AND slope < 0 THEN 'bear'
   WHEN close > ss AND slope > 0 AND adx >= 20 AND coalesce(breadth >= 0.5, false) THEN 'bull' ELSE 'range' END END AS trend,
   coalesce(atr_rank >= 0.9 AND close < sf, false) OR coalesce(last_value(CASE WHEN vix >= 600 THEN true WHEN vix < 500 THEN false END IGNORE NULLS)
     OVER ({WS} ROWS UNBOUNDED PRECEDING), false) AS hv FROM fh),
 fj AS (SELECT *, CASE WHEN trend IS NOT NULL AND atr_rank IS NOT NULL AND vix IS NOT NULL THEN
   CASE WHEN hv AND trend <> 'bull' THEN 'high_vol' ELSE trend END END AS raw FROM fi),
 {confirm_sql('fj', 'reg', 'raw', 'regime', 2, "'high_vol'")}
 SELECT {ds()} AS session, trend, CASE WHEN hv THEN 'high' ELSE 'normal' END AS vol_state, raw, regime FROM reg""")
def market_regime(spark, d):
    return market_regimes(spark, d).select(day().alias("session"), "trend", "vol_state", "raw", "regime")


def market_regimes(spark, d, p=MKT_PARAMS):
    from tapegrain.functions.indicators import rolling_std
    w = by_time("symbol", "session")
    m = B.market_bars(spark, d)
    m = m.withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    m = m.withColumn("vix", rolling_std("_r", 20) * F.sqrt(F.lit(252.0)) * 100).drop("_r")
    br = R.breadth(members(spark, d), B.daily_bars(spark, d)).select("session", "breadth")
    return R.daily_regime(m.join(F.broadcast(br), "session", "left"), p, "vix", "breadth")


@query("seq01_latch", f"""WITH {B.BARS}, r AS (SELECT symbol, session, close / lag(close) OVER ({WS}) - 1 AS ret FROM bars)
 SELECT symbol, {ds()} AS session, coalesce(last_value(CASE WHEN ret >= 0.5 THEN true WHEN ret < -0.3 THEN false END IGNORE NULLS)
  OVER ({WS} ROWS UNBOUNDED PRECEDING), false) AS state FROM r""")
def latch_q(spark, d):
    w = by_time("symbol", "session")
    b = B.daily_bars(spark, d).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    return b.select("symbol", day().alias("session"), latch(F.col("ret") >= 0.5, F.col("ret") < -0.3, w).alias("state"))


RAW3 = f"""r3 AS (SELECT symbol, session, CASE WHEN sma IS NULL THEN NULL WHEN close > 1.2 * sma THEN 'up' WHEN close < 0.8 * sma THEN 'down'
  ELSE 'flat' END AS raw FROM (SELECT *, {full_sql('avg(close)', 'close', 10)} AS sma FROM bars))"""


@query("seq02_confirm", f"""WITH {B.BARS}, {RAW3}, {confirm_sql('r3', 'c3', 'raw', 'label', 3, "'down'")} SELECT symbol, {ds()} AS session, raw, label FROM c3""")
def confirm_q(spark, d):
    from tapegrain.functions.indicators import sma
    b = B.daily_bars(spark, d).withColumn("_m", sma("close", 10))
    b = b.withColumn("raw", F.when(F.col("_m").isNull(), None).when(F.col("close") > 1.2 * F.col("_m"), "up")
                     .when(F.col("close") < 0.8 * F.col("_m"), "down").otherwise("flat"))
    return confirm(b, "symbol", "session", "raw", 3, ("down",), "label").select("symbol", day().alias("session"), "raw", "label")


SPELLS = f"""rr AS (SELECT * FROM reg WHERE regime IS NOT NULL), cg AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER ({WS}) THEN 1 ELSE 0 END AS chg FROM rr),
 gr AS (SELECT *, sum(chg) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS run FROM cg),
 sp AS (SELECT symbol, run, regime AS label, min(session) AS start, max(session) AS fin, count(*) AS sessions FROM gr GROUP BY 1, 2, 3)"""


@query("seq03_spells", f"WITH {B.BARS}, {REG}, {SPELLS} SELECT symbol, label, {ds('start')} AS start, {ds('fin')} AS \"end\", sessions FROM sp")
def spells(spark, d):
    s = R.spells(stock_regimes(spark, d))
    return s.select("symbol", "label", day("start").alias("start"), day("end").alias("end"), "sessions")


EPISODES = f"""tp AS (SELECT *, CASE WHEN close >= max(close) OVER ({WS} ROWS UNBOUNDED PRECEDING) THEN 1 ELSE 0 END AS top FROM bars),
 isl AS (SELECT *, sum(top) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS isl FROM tp),
 ep0 AS (SELECT symbol, isl, min(session) AS peak, arg_min(close, session) AS pk, min(close) AS low, arg_min(session, (close, session)) AS trough FROM isl GROUP BY 1, 2),
 ep1 AS (SELECT *, lead(peak) OVER (PARTITION BY symbol ORDER BY isl) AS recovered, low / pk - 1 AS depth FROM ep0),
 ep AS (SELECT * FROM ep1 WHERE depth <= -0.5)"""


@query("seq04_drawdowns", f"""WITH {B.BARS}, {EPISODES} SELECT symbol, {ds('peak')} AS peak, {ds('trough')} AS trough, {ds('recovered')} AS recovered,
 {rs('depth', 6)} AS depth FROM ep""")
def drawdowns(spark, d):
    e = R.drawdowns(B.daily_bars(spark, d), 0.5)
    return e.select("symbol", day("peak").alias("peak"), day("trough").alias("trough"), day("recovered").alias("recovered"), rnd("depth", 6).alias("depth"))


@query("seq05_detection", f"""WITH {B.BARS}, {REG}, {EPISODES}, rr AS (SELECT * FROM reg WHERE regime IS NOT NULL),
 dt AS (SELECT e.*, (SELECT min(session) FROM rr WHERE rr.symbol = e.symbol AND rr.session > e.peak AND regime IN ('bear', 'high_vol')) AS detected,
   (SELECT min(session) FROM rr WHERE rr.symbol = e.symbol AND rr.session > e.trough AND regime = 'bull') AS bull FROM ep e)
 SELECT symbol, {ds('peak')} AS peak, {ds('detected')} AS detected,
 CASE WHEN detected IS NOT NULL THEN (SELECT count(*) FROM rr WHERE rr.symbol = dt.symbol AND rr.session > dt.peak AND rr.session <= dt.detected) END AS lag_sessions,
 {rs('(SELECT close FROM bars b WHERE b.symbol = dt.symbol AND b.session = dt.detected) / pk - 1', 6)} AS drawdown_at_detection,
 {ds('bull')} AS back_to_bull,
 CASE WHEN bull IS NOT NULL THEN (SELECT count(*) FROM rr WHERE rr.symbol = dt.symbol AND rr.session > dt.trough AND rr.session <= dt.bull) END AS sessions_trough_to_bull FROM dt""")
def detection(spark, d):
    x = R.detection(R.drawdowns(B.symbol_bars(spark, d), 0.5), stock_regimes(spark, d), B.daily_bars(spark, d),
                    deal=lambda rows, *keys: B.spread(rows, spark, d, *keys))
    return x.select("symbol", day("peak").alias("peak"), day("detected").alias("detected"), "lag_sessions",
                    rnd("drawdown_at_detection", 6).alias("drawdown_at_detection"), day("back_to_bull").alias("back_to_bull"), "sessions_trough_to_bull")


@query("agg14_regime_shape", f"""WITH {B.BARS}, {REG}, {SPELLS}, t AS (SELECT symbol, count(*) AS n, sum(chg) - 1 AS sw FROM cg GROUP BY 1)
 SELECT symbol, label, count(*) AS spells, {rs('avg(sessions)', 6)} AS spell_mean, {rs('sum(sessions) / any_value(n)', 6)} AS share,
 {rs('any_value(sw) / (any_value(n) / 252.0)', 6)} AS switches_per_year FROM sp JOIN t USING (symbol) GROUP BY 1, 2""")
def regime_shape(spark, d):
    s = R.shape(stock_regimes(spark, d))
    return s.select("symbol", "label", "spells", rnd("spell_mean", 6).alias("spell_mean"), rnd("share", 6).alias("share"),
                    rnd("switches_per_year", 6).alias("switches_per_year"))


@query("agg14_transitions", f"""WITH {B.BARS}, {REG}, n AS (SELECT regime AS label, lead(regime) OVER ({WS}) AS next_label FROM reg WHERE regime IS NOT NULL)
 SELECT label, next_label, count(*) AS n, {rs('count(*) / sum(count(*)) OVER (PARTITION BY label)', 6)} AS share FROM n WHERE next_label IS NOT NULL GROUP BY 1, 2""")
def transitions(spark, d):
    return R.transitions(stock_regimes(spark, d)).select("label", "next_label", "n", rnd("share", 6).alias("share"))


FWD = f"""rt AS (SELECT *, close / lag(close) OVER ({WS}) - 1 AS ret FROM reg), fw AS (SELECT symbol, session, regime,
 lead(close, 10) OVER ({WS}) / lead(open) OVER ({WS}) - 1 AS fwd_ret, CASE WHEN count(ret) OVER w = 10 THEN stddev_samp(ret) OVER w * sqrt(252) END AS fwd_vol
 FROM rt WINDOW w AS ({WS} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
 fx AS (SELECT * FROM fw WHERE regime IS NOT NULL AND fwd_ret IS NOT NULL AND fwd_vol IS NOT NULL)"""


@query("agg15_forward_by_regime", f"""WITH {B.BARS}, {REG}, {FWD} SELECT regime, count(*) AS days, {rs('avg(fwd_ret)', 6)} AS mean_ret,
 {rs('median(fwd_ret)', 6)} AS median_ret, {rs('avg(CAST(fwd_ret > 0 AS DOUBLE))', 6)} AS up_share, {rs('avg(fwd_vol)', 6)} AS mean_vol FROM fx GROUP BY 1""")
def forward_by_regime(spark, d):
    t = R.forward_table(X.forward_daily(stock_regimes(spark, d), 10))
    return t.select("regime", "days", *[rnd(x, 6).alias(x) for x in ("mean_ret", "median_ret", "up_share", "mean_vol")])


@query("agg15_vol_separation", f"""WITH {B.BARS}, {REG}, {FWD} SELECT {rs("avg(fwd_vol) FILTER (regime IN ('bear', 'high_vol')) / avg(fwd_vol) FILTER (regime NOT IN ('bear', 'high_vol'))", 6)} AS vol_ratio FROM fx""")
def vol_separation(spark, d):
    return R.vol_separation(X.forward_daily(stock_regimes(spark, d), 10)).select(rnd("vol_ratio", 6).alias("vol_ratio"))


@query("agg18_agreement", f"""WITH {B.BARS}, {REG} SELECT {rs('avg(CAST(raw = regime AS DOUBLE))', 6)} AS agreement, count(*) AS sessions FROM reg
 WHERE raw IS NOT NULL AND regime IS NOT NULL""")
def agreement(spark, d):
    # both sides of the comparison read the labels, which are written once, without what led to them
    labels = materialize(stock_regimes(spark, d).select("symbol", "session", "raw", "regime"), "labels")
    a, b = (B.spread(labels.select("symbol", "session", x), spark, d, "symbol", "session") for x in ("raw", "regime"))
    return R.agreement(a, b, "raw", "regime").select(rnd("agreement", 6).alias("agreement"), "sessions")


# --- intraday -----------------------------------------------------------------------------------

IP = R.IntradayParams(relvol_lookback=10)
FEATURES = f"""t AS (SELECT *, {TR} AS tr FROM bars), {ewm_sql('t', 'e', {'atr': ('tr', 1 / 14, 14)})},
 dl AS (SELECT symbol, session, lag(close) OVER ({WS}) AS prev_close, lag(atr) OVER ({WS}) AS atr_prev FROM e),
 s0 AS (SELECT h.*, prev_close, nullif(atr_prev, 0) AS atr_prev, row_number() OVER w - 1 AS slot, sum(coalesce(vwap, close) * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap_s,
  first_value(open) OVER w AS open_d, max(high) OVER w AS sh, min(low) OVER w AS sl, sum(volume) OVER w AS cumvol FROM hb h LEFT JOIN dl USING (symbol, session)
  WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
 s1 AS (SELECT *, sign(close - vwap_s) AS side, sh - sl AS rng, max(slot) OVER (PARTITION BY symbol, session) AS ms, max(slot) OVER (PARTITION BY symbol) AS gs FROM s0),
 s2 AS (SELECT *, lag(side) OVER w AS ps FROM s1 WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
 grid AS (SELECT d.symbol, d.session, unnest(range(d.gs + 1)) AS slot FROM (SELECT DISTINCT symbol, session, gs FROM s1) d),
 bl AS (SELECT symbol, session, slot, CASE WHEN count(cumvol) OVER w >= 5 THEN avg(cumvol) OVER w END AS bv, CASE WHEN count(rng) OVER w >= 5 THEN avg(rng) OVER w END AS brg
  FROM grid LEFT JOIN s2 USING (symbol, session, slot) WINDOW w AS (PARTITION BY symbol, slot ORDER BY session ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
 fin AS (SELECT s2.*, (open_d - prev_close) / atr_prev AS gap, (close - vwap_s) / atr_prev AS dist,
  sum(CASE WHEN side > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w / (slot + 1) AS side_share, sum(CASE WHEN side <> ps AND side <> 0 THEN 1 ELSE 0 END) OVER w AS vwap_crosses,
  (sh - open_d) / atr_prev AS ext_up, (open_d - sl) / atr_prev AS ext_down, (close - open_d) / atr_prev AS move, cumvol / nullif(bv, 0) AS relvol,
  rng / nullif(brg, 0) AS range_ratio, slot % 4 = 3 OR slot = ms AS hour_close FROM s2 JOIN bl USING (symbol, session, slot)
  WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
 lb AS (SELECT *, (close - prev_close) / nullif(open_d - prev_close, 0) <= 0.5 AS back FROM fin),
 lab AS (SELECT *, CASE WHEN atr_prev IS NULL OR prev_close IS NULL OR vwap_s IS NULL THEN NULL
  WHEN gap >= 0.5 AND close > open_d AND close > vwap_s AND relvol >= 1.5 THEN 'gap_go_up'
  WHEN gap <= -0.5 AND close < open_d AND close < vwap_s AND relvol >= 1.5 THEN 'gap_go_down'
  WHEN (gap >= 0.5 AND close < vwap_s AND back) OR (ext_up >= 0.5 AND close < vwap_s AND close < open_d) THEN 'reversal_down'
  WHEN (gap <= -0.5 AND close > vwap_s AND back) OR (ext_down >= 0.5 AND close > vwap_s AND close > open_d) THEN 'reversal_up'
  WHEN side_share >= 0.75 AND dist >= 0.25 THEN 'trend_up' WHEN side_share <= 0.25 AND dist <= -0.25 THEN 'trend_down' ELSE 'range' END AS micro,
  CASE WHEN range_ratio >= 1.3 THEN 'expanding' WHEN range_ratio <= 0.7 THEN 'compressing' WHEN range_ratio IS NOT NULL THEN 'normal' END AS vol_state FROM lb)"""
INTRA = f"""{B.TICKS}, hb AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(ts AS DATE) AS session, first(price ORDER BY ts, event_id) AS open,
 max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(size) AS volume, sum(price * size) / nullif(sum(size), 0) AS vwap
 FROM ticks GROUP BY ALL),
 bars AS (SELECT symbol, CAST(ts AS DATE) AS session, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close FROM ticks GROUP BY ALL), {FEATURES}"""
FIN = f"""fi2 AS (SELECT *, (last_value(close) OVER (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - close) / atr_prev AS fwd_atr,
  CASE WHEN micro = 'range' THEN -sign(dist) WHEN micro LIKE '%up' THEN 1 ELSE -1 END AS dir FROM lab),
 fx AS (SELECT * FROM fi2 WHERE slot < ms AND micro IS NOT NULL AND fwd_atr IS NOT NULL),
 rel AS (SELECT *, fwd_atr - avg(fwd_atr) OVER (PARTITION BY session, slot) AS fwd_rel_atr FROM fx)"""


def intraday(spark, d):
    t = B.ticks(spark, d)
    daily = (t.groupBy("symbol", F.to_date("ts").alias("session")).agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close")))
    return R.intraday_label(R.intraday_features(X.hourly_bars(t), daily, IP), IP)


@query("win21_intraday_features", f"""WITH {INTRA} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, slot, {rs('gap')} AS gap, {rs('dist')} AS dist, {rs('side_share')} AS side_share,
 CAST(vwap_crosses AS BIGINT) AS vwap_crosses, {rs('ext_up')} AS ext_up, {rs('ext_down')} AS ext_down, {rs('move')} AS move, {rs('relvol')} AS relvol,
 {rs('range_ratio')} AS range_ratio, hour_close FROM lab""")
def intraday_features(spark, d):
    f = intraday(spark, d)
    return f.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "slot", *[rnd(x).alias(x) for x in (
        "gap", "dist", "side_share", "ext_up", "ext_down", "move", "relvol", "range_ratio")], "vwap_crosses", "hour_close")


@query("prj21_intraday_label", f"WITH {INTRA} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, micro, vol_state FROM lab")
def intraday_label(spark, d):
    return intraday(spark, d).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "micro", "vol_state")


@query("win41_book_context", f"""WITH {INTRA}, h AS (SELECT symbol, ts, volume, coalesce(last_value(CASE WHEN hour_close THEN micro END IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING), 'first_hour') AS known_micro FROM lab)
 SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, known_micro, CASE WHEN count(volume) OVER w >= 120 THEN {rs('median(volume) OVER w')} END AS median_volume FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 480 PRECEDING AND 1 PRECEDING)""")
def book_context(spark, d):
    f = R.book_context(intraday(spark, d), 480, 120)
    return f.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "known_micro", rnd("median_volume").alias("median_volume"))


@query("win40_forward_intraday", f"""WITH {INTRA}, {FIN} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, micro, {rs('fwd_atr')} AS fwd_atr, CAST(dir AS DOUBLE) AS dir,
 {rs('fwd_rel_atr')} AS fwd_rel_atr FROM rel""")
def forward_intraday(spark, d):
    f = R.add_relative(R.forward_intraday(intraday(spark, d)))
    return f.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "micro", rnd("fwd_atr").alias("fwd_atr"), "dir", rnd("fwd_rel_atr").alias("fwd_rel_atr"))


@query("agg16_clustered_t", f"""WITH {INTRA}, {FIN}, pd AS (SELECT micro, session, avg(fwd_rel_atr * dir) AS m, count(*) AS n, sum(fwd_rel_atr * dir) AS s FROM rel GROUP BY 1, 2)
 SELECT micro, CAST(sum(n) AS BIGINT) AS obs, count(*) AS sessions, {rs('avg(m)')} AS mean_per_day, {rs('sum(s) / sum(n)')} AS mean_pooled,
 {rs('CASE WHEN stddev_samp(m) > 0 THEN avg(m) / (stddev_samp(m) / sqrt(count(*))) END')} AS t_clustered FROM pd GROUP BY 1""")
def clustered_t(spark, d):
    f = R.clustered(R.add_relative(R.forward_intraday(intraday(spark, d))), "signed_rel_atr", "micro")
    return f.select("micro", "obs", "sessions", rnd("mean_per_day").alias("mean_per_day"), rnd("mean_pooled").alias("mean_pooled"), rnd("t_clustered").alias("t_clustered"))


# --- price structure ----------------------------------------------------------------------------

STR = f"""tr0 AS (SELECT *, {TR} AS tr FROM bars), {ewm_sql('tr0', 'ea', {'atr': ('tr', 1 / 14, 1)})},
 b AS (SELECT *, row_number() OVER ({WS}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ea),
 sw AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 AND high > max(high) OVER wb AND high > max(high) OVER wa THEN high END AS swing_high,
  CASE WHEN i >= 3 AND i < n - 3 AND low < min(low) OVER wb AND low < min(low) OVER wa THEN low END AS swing_low FROM b
  WINDOW wb AS ({WS} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), wa AS ({WS} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""


def base(spark, d):
    return S.with_structure_base(B.daily_bars(spark, d))


@query("win33_swings", f"""WITH {B.BARS}, {STR} SELECT symbol, {ds()} AS session, {rs('swing_high')} AS swing_high, {rs('swing_low')} AS swing_low FROM sw
 WHERE swing_high IS NOT NULL OR swing_low IS NOT NULL""")
def swings(spark, d):
    s = S.swings(base(spark, d)).where("swing_high is not null or swing_low is not null")
    return s.select("symbol", day().alias("session"), rnd("swing_high").alias("swing_high"), rnd("swing_low").alias("swing_low"))


@query("win34_fair_value_gaps", f"""WITH {B.BARS}, {STR}, nb AS (SELECT *, lag(high) OVER ({WS}) AS ph, lag(low) OVER ({WS}) AS pl, lead(high) OVER ({WS}) AS nh,
  lead(low) OVER ({WS}) AS nl FROM b), g AS (SELECT symbol, session, i, CASE WHEN ph < nl THEN 'bullish' WHEN pl > nh THEN 'bearish' END AS direction,
  CASE WHEN ph < nl THEN nl ELSE pl END AS upper, CASE WHEN ph < nl THEN ph ELSE nh END AS lower, abs(close - open) / greatest(atr, 1e-9) AS strength FROM nb)
 SELECT symbol, {ds()} AS session, direction, {rs('upper')} AS upper, {rs('lower')} AS lower, {rs('strength')} AS strength,
  strftime((SELECT min(b.session) FROM b WHERE b.symbol = g.symbol AND b.i >= g.i + 2 AND ((g.direction = 'bullish' AND b.low <= g.lower) OR
   (g.direction = 'bearish' AND b.high >= g.upper))), '%Y-%m-%d') AS fill_session FROM g WHERE direction IS NOT NULL AND strength >= 0.4""")
def fair_value_gaps(spark, d):
    g = S.gaps(base(spark, d))
    return g.select("symbol", day().alias("session"), "direction", rnd("upper").alias("upper"), rnd("lower").alias("lower"), rnd("strength").alias("strength"),
                    day("fill_session").alias("fill_session"))


@query("win35_order_blocks", f"""WITH {B.BARS}, {STR}, gf AS (SELECT *, CAST(lag(high) OVER ({WS}) < lead(low) OVER ({WS}) AS INT) AS gu,
  CAST(lag(low) OVER ({WS}) > lead(high) OVER ({WS}) AS INT) AS gd, (lead(close, 3) OVER ({WS}) - close) / greatest(atr, 1e-9) AS imp, lead(close) OVER ({WS}) AS nx FROM b),
 g2 AS (SELECT *, max(gu) OVER w AS du, max(gd) OVER w AS dd FROM gf WINDOW w AS ({WS} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
 o AS (SELECT *, CASE WHEN close < open AND imp >= 1.2 AND nx > close AND du = 1 THEN 'bullish' WHEN close > open AND -imp >= 1.2 AND nx < close AND dd = 1 THEN 'bearish' END AS direction
  FROM g2 WHERE i >= 1 AND i < n - 3)
 SELECT symbol, {ds()} AS session, direction, {rs('high')} AS upper, {rs('low')} AS lower, {rs('abs(imp)')} AS impulse,
  strftime((SELECT min(b.session) FROM b WHERE b.symbol = o.symbol AND b.i >= o.i + 4 AND ((o.direction = 'bullish' AND b.low <= o.high) OR
   (o.direction = 'bearish' AND b.high >= o.low))), '%Y-%m-%d') AS mitigated_session FROM o WHERE direction IS NOT NULL""")
def order_blocks(spark, d):
    o = S.order_blocks(base(spark, d))
    return o.select("symbol", day().alias("session"), "direction", rnd("upper").alias("upper"), rnd("lower").alias("lower"), rnd("impulse").alias("impulse"),
                    day("mitigated_session").alias("mitigated_session"))


@query("seq06_structure_events", f"""WITH {B.BARS}, {STR}, p0 AS (SELECT symbol, session, i, 0 AS k, swing_high AS price FROM sw WHERE swing_high IS NOT NULL
  UNION ALL SELECT symbol, session, i, 1, swing_low FROM sw WHERE swing_low IS NOT NULL), p1 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS cnt FROM p0),
 p2 AS (SELECT *, max(price) OVER w AS hh, min(price) OVER w AS ll FROM p1 WHERE cnt >= 4 WINDOW w AS (PARTITION BY symbol, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 p3 AS (SELECT *, CASE WHEN k = 0 AND price > hh THEN 'bullish' WHEN k = 1 AND price < ll THEN 'bearish' END AS direction FROM p2),
 p4 AS (SELECT *, lag(direction) OVER (PARTITION BY symbol ORDER BY i, k) AS prev FROM p3 WHERE direction IS NOT NULL)
 SELECT symbol, {ds()} AS session, direction, CASE WHEN prev <> direction THEN 'CHOCH' ELSE 'BOS' END AS kind, {rs("CASE WHEN k = 0 THEN hh ELSE ll END")} AS broken_level FROM p4""")
def structure_events(spark, d):
    e = S.structure_events(S.swings(base(spark, d)))
    return e.select("symbol", day().alias("session"), "direction", "kind", rnd("broken_level").alias("broken_level"))


@query("win36_liquidity_sweeps", f"""WITH {B.BARS}, {STR}, s AS (SELECT *, last_value(swing_low IGNORE NULLS) OVER wp AS sl, last_value(swing_high IGNORE NULLS) OVER wp AS sh,
  max(close) OVER wf AS mx, min(close) OVER wf AS mn FROM sw WINDOW wp AS ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING), wf AS ({WS} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 h AS (SELECT symbol, session, 'bullish' AS direction, sl AS lvl, mx AS rc FROM s WHERE i >= 1 AND i < n - 3 AND low < sl - 0.2 * greatest(atr, 1e-9) AND mx > sl
  UNION ALL SELECT symbol, session, 'bearish', sh, mn FROM s WHERE i >= 1 AND i < n - 3 AND high > sh + 0.2 * greatest(atr, 1e-9) AND mn < sh)
 SELECT symbol, {ds()} AS session, direction, {rs('lvl')} AS swept_level, {rs('rc')} AS reversal_close FROM h""")
def liquidity_sweeps(spark, d):
    e = S.sweeps(S.swings(base(spark, d)))
    return e.select("symbol", day().alias("session"), "direction", rnd("swept_level").alias("swept_level"), rnd("reversal_close").alias("reversal_close"))


@query("win38_dealing_range", f"""WITH {B.BARS}, {STR}, r AS (SELECT *, coalesce(max(swing_high) OVER w, max(high) OVER w) AS hi, coalesce(min(swing_low) OVER w, min(low) OVER w) AS lo
  FROM sw WINDOW w AS ({WS} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) SELECT symbol, {ds()} AS session, {rs('hi')} AS hi, {rs('lo')} AS lo,
  {rs('hi - 0.79::DOUBLE * (hi - lo)')} AS bull_lower, {rs('lo + 0.62::DOUBLE * (hi - lo)')} AS bear_lower, CASE WHEN abs(close - (lo + 0.5 * (hi - lo))) <= 0.05 * (hi - lo) THEN 'equilibrium'
  WHEN close > lo + 0.5 * (hi - lo) THEN 'premium' ELSE 'discount' END AS position, {rs('greatest(0, least(1, (close - lo) / (hi - lo)))')} AS pct_of_range
  FROM r WHERE i = n - 1 AND n >= 10 AND hi > lo""")
def dealing_range(spark, d):
    r = S.dealing_range(S.swings(base(spark, d)))
    return r.select("symbol", day().alias("session"), *[rnd(x).alias(x) for x in ("hi", "lo", "bull_lower", "bear_lower", "pct_of_range")], "position")


@query("seq08_zones")
def zones(spark, d):
    """A sequential merge; checked against a plain loop in the tests."""
    from tapegrain.session import materialize
    b = materialize(base(spark, d), "structure")
    s = S.swings(b)
    z = S.zones(b, s, S.order_blocks(b, written=True), S.gaps(b, written=True))
    return z.select("symbol", "direction", rnd("lower").alias("lower"), rnd("upper").alias("upper"), "strength", day("last_touch").alias("last_touch"), "role")


@query("sig17_confluence")
def confluence(spark, d):
    c = S.confluence(B.daily_bars(spark, d))
    return c.select("symbol", day().alias("session"), *[rnd(x).alias(x) for x in S.CONFLUENCE_WEIGHTS], rnd("score").alias("score"), "label")


@query("srt06_last_structures", f"""WITH {B.BARS}, {STR}, p0 AS (SELECT symbol, session, i, swing_high FROM sw WHERE swing_high IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 5) SELECT symbol, {ds()} AS session, {rs('swing_high')} AS swing_high FROM p0""")
def last_structures(spark, d):
    s = S.latest(S.swings(base(spark, d)).where(F.col("swing_high").isNotNull()), 5)
    return s.select("symbol", day().alias("session"), rnd("swing_high").alias("swing_high"))
