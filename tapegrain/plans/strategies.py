"""Set-ups, accounts, news features and the remaining small operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.functions import scoring as SC
from tapegrain.operators import fundamentals as FU
from tapegrain.operators import joins as J
from tapegrain.operators import learning as L
from tapegrain.operators import news as N
from tapegrain.operators import regimes as G
from tapegrain.operators import setups as SU
from tapegrain.operators import strategies as ST
from tapegrain.operators.kernels import by_time
from tapegrain.plans.catalog import day, ds, query, rnd, rs, stamp, ts_sql
from tapegrain.plans.regimes import FEATURES, IP, REG
from tapegrain.plans.windows import DELTA, WS, ewm_sql, fr, full_sql
from tapegrain.sources import documents as D
from tapegrain.sources import readers as R
from tapegrain.streaming import ticks as T

RSI = "100 - 100 / (1 + au{n} / nullif(ad{n}, 0))"
LAGGED = ["close", "high", "low", "rsi_2", "rsi_3", "sma50", "sma200", "sma50_slope", "bw", "bw_rank", "high20", "sum4"]


@query("win22_lagged_features", f"""WITH {B.BARS}, {DELTA}, {ewm_sql('ud', 'e', {'au2': ('up', 0.5, 2), 'ad2': ('dn', 0.5, 2), 'au3': ('up', 1 / 3, 3), 'ad3': ('dn', 1 / 3, 3)})},
 f AS (SELECT symbol, session, close, high, low, {RSI.format(n=2)} AS rsi_2, {RSI.format(n=3)} AS rsi_3, {full_sql('avg(close)', 'close', 50)} AS sma50, {full_sql('avg(close)', 'close', 200)} AS sma200,
  4 * {full_sql('stddev_samp(close)', 'close', 20)} / {full_sql('avg(close)', 'close', 20)} AS bw, {full_sql('max(high)', 'high', 20)} AS high20, {full_sql('sum(close)', 'close', 4)} AS sum4 FROM e),
 g AS (SELECT *, sma50 - lag(sma50, 10) OVER ({WS}) AS sma50_slope, list(bw) OVER {fr(126)} AS v FROM f),
 h AS (SELECT *, CASE WHEN bw IS NOT NULL AND len(list_filter(v, lambda z: z IS NOT NULL)) >= 63 THEN CAST(len(list_filter(v, lambda z: z < bw)) AS DOUBLE) / (len(v) - 1) END AS bw_rank FROM g)
 SELECT symbol, {ds()} AS session, {', '.join(f"{rs(f'lag({x}) OVER ({WS})')} AS {x}_y" for x in LAGGED)} FROM h""")
def lagged_features(spark, d):
    f = ST.lagged_features(B.daily_bars(spark, d))
    return f.select("symbol", day().alias("session"), *[rnd(f"{x}_y").alias(f"{x}_y") for x in LAGGED])


RSI2 = f"""{DELTA}, {ewm_sql('ud', 'e', {'au2': ('up', 0.5, 2), 'ad2': ('dn', 0.5, 2)})},
 f AS (SELECT *, {RSI.format(n=2)} AS rsi, {full_sql('avg(close)', 'close', 100)} AS trend, {full_sql('avg(close)', 'close', 5)} AS ma5, lag(close) OVER ({WS}) AS pc FROM e)"""


@query("win47_rsi_rules", f"""WITH {B.BARS}, {B.MARKET}, {RSI2}, m AS (SELECT session, coalesce(close > CASE WHEN count(close) OVER z >= 50 THEN avg(close) OVER z END, false) AS up FROM mkt WINDOW z AS (ORDER BY session ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
 SELECT f.symbol, {ds('f.session')} AS session, coalesce(close > trend AND rsi < 10, false) AND m.up AS entry, coalesce(close > ma5, false) AS exit_sma, coalesce(rsi > 65, false) AS exit_rsi, coalesce(close > pc, false) AS exit_up FROM f JOIN m USING (session)""")
def rsi_rules(spark, d):
    b = B.daily_bars(spark, d)
    a = ST.mean_reversion(b, "rsi2_meanrev", B.market_bars(spark, d), 50, trend_sma=100)
    other = lambda mode: ST.mean_reversion(b, "rsi2_meanrev", exit_mode=mode).select("symbol", "session", F.col("exit").alias(f"exit_{mode}"))
    j = a.withColumnRenamed("exit", "exit_sma").join(other("rsi"), ["symbol", "session"]).join(other("first_up").withColumnRenamed("exit_first_up", "exit_up"), ["symbol", "session"])
    return j.select("symbol", day().alias("session"), "entry", "exit_sma", "exit_rsi", "exit_up")


@query("win47_bollinger_rules", f"""WITH {B.BARS}, s AS (SELECT symbol, session, close, {full_sql('avg(close)', 'close', 20)} AS mid, {full_sql('stddev_samp(close)', 'close', 20)} AS sd, {full_sql('avg(close)', 'close', 60)} AS trend FROM bars)
 SELECT symbol, {ds()} AS session, coalesce(close < mid - 1.5 * sd AND close > trend, false) AS entry, coalesce(close > mid, false) AS exit FROM s""")
def bollinger_rules(spark, d):
    return ST.mean_reversion(B.daily_bars(spark, d), "bollinger_meanrev", bb_k=1.5, trend_sma=60).select("symbol", day().alias("session"), "entry", "exit")


@query("win46_rule_positions", f"""WITH {B.BARS}, {DELTA}, {ewm_sql('ud', 'e', {'au': ('up', 1 / 14, 14), 'ad': ('dn', 1 / 14, 14)})},
 mf AS (WITH {ewm_sql('bars', 'x', {'f': ('close', 2 / 13, 12), 's': ('close', 2 / 27, 26)})}, m AS (SELECT symbol, session, f - s AS macd FROM x), {ewm_sql('m', 'g', {'sig': ('macd', 0.2, 9)})} SELECT symbol, session, macd > sig AS up FROM g),
 i AS (SELECT e.symbol, e.session, {RSI.format(n='')} AS r, {full_sql('avg(close)', 'close', 10)} > {full_sql('avg(close)', 'close', 30)} AS c1, {full_sql('avg(close)', 'close', 12)} > {full_sql('avg(close)', 'close', 26)} AS c2, mf.up FROM e JOIN mf USING (symbol, session)),
 h AS (SELECT *, coalesce(last_value(CASE WHEN r > 60 THEN 0 WHEN r < 40 THEN 1 END IGNORE NULLS) OVER ({WS} ROWS UNBOUNDED PRECEDING), 0) AS p3, coalesce(last_value(CASE WHEN r > 70 THEN 0 WHEN r < 30 THEN 1 END IGNORE NULLS) OVER ({WS} ROWS UNBOUNDED PRECEDING), 0) AS p4 FROM i)
 SELECT rule_id, symbol, {ds()} AS session, CAST(position AS INTEGER) AS position FROM (SELECT symbol, session, unnest(['hold', 'cross-10-30', 'cross', 'rsi-40-60', 'rsi', 'macd']) AS rule_id,
  unnest([1, CAST(coalesce(c1, false) AS INTEGER), CAST(coalesce(c2, false) AS INTEGER), p3, p4, CAST(coalesce(up, false) AS INTEGER)]) AS position FROM h)""")
def rule_positions(spark, d):
    """Six rules held as rows: their windows and thresholds are data."""
    rules = spark.createDataFrame([("hold", "buy_and_hold", None), ("cross-10-30", "sma_cross", {"fast": 10.0, "slow": 30.0}), ("cross", "sma_cross", {}),
                                   ("rsi-40-60", "rsi", {"buy_below": 40.0, "sell_above": 60.0}), ("rsi", "rsi", None), ("macd", "macd_cross", None)], "rule_id string, kind string, params map<string,double>")
    r = SU.rule_positions(B.symbol_bars(spark, d), rules)
    return r.select("rule_id", "symbol", day().alias("session"), "position")


# Weeks stand in for sessions and their days for the bars of a session; a nation's lines are one symbol. Days close 55 minutes apart from 10:00.
WEEKS = f"""{B.LINES}, wl AS (SELECT lines.*, s_nationkey AS symbol, CAST(date_trunc('week', session) AS DATE) AS week FROM lines JOIN supplier ON s_suppkey = l_suppkey),
 hb AS (SELECT symbol, session AS ts, week AS session, first(p {B._T}) AS open, max(p) AS high, min(p) AS low, last(p {B._T}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap FROM wl GROUP BY symbol, wl.session, week),
 bars AS (SELECT symbol, week AS session, first(p ORDER BY wl.session, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY wl.session, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, sum(l_quantity) AS volume FROM wl GROUP BY symbol, week)"""


def weeks(spark, d):
    """(day bars of each week, week bars) of each nation."""
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("symbol"))
    li = B.lines(spark, d).join(s, "l_suppkey").withColumnRenamed("session", "ts").withColumn("session", F.date_trunc("week", "ts").cast("date"))
    tie = F.struct("ts", *B._TIE)
    ohlc = lambda *keys: li.groupBy(*keys).agg(F.min_by("p", tie).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", tie).alias("close"), F.sum("l_quantity").alias("volume"),
                                               (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"))
    return ohlc("symbol", "session", "ts"), ohlc("symbol", "session").drop("vwap")


_SETUP_ROW = "SELECT symbol, session, ts, '{0}' AS setup, {1} AS entry_on, {2} AS setup_entry, {3} AS exit_moc, {4} AS stop_dist, {5} AS target_dist, {6} AS trail_after, {7} AS trail_dist, {8} AS max_sessions, {9} AS score FROM x"
_CLIP = "least(greatest({0}, {1} * atr_prev), {2} * atr_prev)"
_SIG, _NIL = "mod BETWEEN 600 AND 930", "NULL::DOUBLE"
_PB, _VR = "regime_y = 'bull' AND rsi_3_y <= 30", "close_y > sma200_y AND rsi_2_y <= 10"
_CB, _GG = "bw_rank_y <= 0.2::DOUBLE AND close_y > sma50_y", "close_y > sma50_y AND sma50_slope_y > 0 AND gap >= 0.5"
SETUP_ROWS = " UNION ALL ".join([
    _SETUP_ROW.format("pullback", f"{_PB} AND close > vwap_s AND was_below AND {_SIG}", f"{_PB} AND mod = 600", "false", "1.5 * atr_prev", "3 * atr_prev", "1.5 * atr_prev", "1.5 * atr_prev", 10, "-rsi_3_y"),
    _SETUP_ROW.format("vwap_reversion", f"{_VR} AND dist <= -0.5 AND {_SIG}", f"{_VR} AND mod = 600", "slot = ms - 1 AND close > (sum4_y + close) / 5", "2.5 * atr_prev", _NIL, _NIL, _NIL, 5, "-rsi_2_y"),
    _SETUP_ROW.format("compression_breakout", f"{_CB} AND close > high20_y AND relvol >= 1.2::DOUBLE AND {_SIG}", f"{_CB} AND mod = 600", "false", "1.5 * atr_prev", "3 * atr_prev", "1.5 * atr_prev", "2 * atr_prev", 10, "relvol"),
    _SETUP_ROW.format("gap_go", f"{_GG} AND close > open_d AND close > vwap_s AND relvol >= 1.5 AND mod BETWEEN 600 AND 690", f"{_GG} AND mod = 600", "false", _CLIP.format("close - sl", 0.5, 1.5), "2 * atr_prev", "atr_prev", "atr_prev", 5, "gap"),
    _SETUP_ROW.format("gap_fade_down", "gap <= -0.5 AND close < open_d AND close < vwap_s AND relvol >= 1.5 AND mod BETWEEN 630 AND 870", "false", "false", "1.5 * atr_prev", _NIL, _NIL, _NIL, 0, "-gap"),
    _SETUP_ROW.format("liquidity_sweep", "sl < low_y AND close > low_y AND mod BETWEEN 600 AND 870", "false", "false", _CLIP.format("close - sl + 0.1::DOUBLE * atr_prev", 0.25, 1), _NIL, _NIL, _NIL, 0, "(low_y - sl) / atr_prev"),
    _SETUP_ROW.format("last_half_hour", "fc > prev_close AND mod = 930 AND symbol % 5 = 0", "false", "false", "0.5 * atr_prev", _NIL, _NIL, _NIL, 0, "fc / prev_close - 1"),
    _SETUP_ROW.format("orb30", "slot >= 2 AND close > oh AND relvol >= 1.2::DOUBLE AND mod BETWEEN 600 AND 720", "false", "false", _CLIP.format("close - ol", 0.25, 1), _NIL, _NIL, _NIL, 0, "relvol")])
LAGS = ", ".join(f"lag({x}) OVER ({WS}) AS {x}_y" for x in LAGGED)


@query("win49_setups", f"""WITH {WEEKS}, lab0 AS (WITH {FEATURES} SELECT * FROM lab),
 feat AS (WITH {DELTA}, {ewm_sql('ud', 'e', {'au2': ('up', 0.5, 2), 'ad2': ('dn', 0.5, 2), 'au3': ('up', 1 / 3, 3), 'ad3': ('dn', 1 / 3, 3)})},
  f AS (SELECT symbol, session, close, high, low, {RSI.format(n=2)} AS rsi_2, {RSI.format(n=3)} AS rsi_3, {full_sql('avg(close)', 'close', 50)} AS sma50, {full_sql('avg(close)', 'close', 200)} AS sma200,
   4 * {full_sql('stddev_samp(close)', 'close', 20)} / {full_sql('avg(close)', 'close', 20)} AS bw, {full_sql('max(high)', 'high', 20)} AS high20, {full_sql('sum(close)', 'close', 4)} AS sum4 FROM e),
  g AS (SELECT *, sma50 - lag(sma50, 10) OVER ({WS}) AS sma50_slope, list(bw) OVER {fr(126)} AS v FROM f),
  h AS (SELECT *, CASE WHEN bw IS NOT NULL AND len(list_filter(v, lambda z: z IS NOT NULL)) >= 63 THEN CAST(len(list_filter(v, lambda z: z < bw)) AS DOUBLE) / (len(v) - 1) END AS bw_rank FROM g) SELECT symbol, session, {LAGS} FROM h),
 rg AS (WITH {REG} SELECT symbol, session, lag(regime) OVER ({WS}) AS regime_y FROM reg),
 x0 AS (SELECT lab0.*, feat.* EXCLUDE (symbol, session), regime_y, 545 + 55 * isodow(ts) AS mod FROM lab0 JOIN feat USING (symbol, session) JOIN rg USING (symbol, session)),
 x AS (SELECT *, coalesce(bool_or(close < vwap_s) OVER (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was_below, max(close) FILTER (mod = 600) OVER s AS fc, max(high) FILTER (slot <= 1) OVER s AS oh, min(low) FILTER (slot <= 1) OVER s AS ol
  FROM x0 WINDOW s AS (PARTITION BY symbol, session)),
 rows AS ({SETUP_ROWS}),
 k AS (SELECT * REPLACE (coalesce(entry_on, false) AS entry_on, coalesce(setup_entry, false) AS setup_entry, coalesce(exit_moc, false) AS exit_moc), sum(CASE WHEN entry_on THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session, setup ORDER BY ts) AS nth FROM rows)
 SELECT symbol, {ds()} AS session, {ds('ts')} AS ts, setup, entry_on AND nth = 1 AS entry, setup_entry, exit_moc, {rs('stop_dist')} AS stop_dist, {rs('target_dist')} AS target_dist, {rs('trail_after')} AS trail_after, {rs('trail_dist')} AS trail_dist, max_sessions, {rs('score')} AS score
 FROM k WHERE (entry_on AND nth = 1) OR setup_entry OR exit_moc""")
def setups(spark, d):
    """Eight set-ups over the days of each week as one long table."""
    bars, daily = weeks(spark, d)
    x = SU.context(G.intraday_features(bars, daily, IP).withColumn("mod", 545 + 55 * (F.weekday("ts") + 1)), ST.lagged_features(daily), G.daily_regime(daily))
    s = SU.setups(x, F.col("symbol") % 5 == 0)
    return s.select("symbol", day().alias("session"), day("ts").alias("ts"), "setup", "entry", "setup_entry", "exit_moc", *[rnd(c).alias(c) for c in ("stop_dist", "target_dist", "trail_after", "trail_dist")], "max_sessions", rnd("score").alias("score"))


@query("srt05_setup_scan", f"""WITH {B.BARS}, {RSI2}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS rn FROM f) SELECT symbol, {ds()} AS session, {rs('rsi')} AS rsi_2 FROM l WHERE rn = 1 AND coalesce(close > ma5, false)""")
def setup_scan(spark, d):
    m = ST.mean_reversion(B.daily_bars(spark, d), "rsi2_meanrev").select("symbol", "session", "exit", "rsi_2")
    return ST.latest_setups(m, "exit", "rsi_2").select("symbol", day().alias("session"), rnd("rsi_2").alias("rsi_2"))


@query("seq11_first_per_session", f"""WITH {B.TICKS}, s AS (SELECT *, CAST(ts AS DATE) AS dy FROM ticks), f AS (SELECT event_id, symbol, dy, price > 60 AS up, price < 20 AS low, sum(CAST(coalesce(price > 60, false) AS INTEGER)) OVER (PARTITION BY symbol, dy ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k,
 max(CAST(coalesce(price < 20, false) AS INTEGER)) OVER (PARTITION BY symbol, dy ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s)
 SELECT event_id, symbol, coalesce(up, false) AND k = 1 AS first_above, coalesce(b, 0) = 1 AS was_below FROM f""")
def first_per_session(spark, d):
    t = B.ticks(spark, d).withColumn("dy", F.to_date("ts"))
    t = ST.first_true(t, F.col("price") > 60, ["symbol", "dy"], ["ts", "event_id"], "first_above")
    return ST.true_before(t, F.col("price") < 20, ["symbol", "dy"], ["ts", "event_id"], "was_below").select("event_id", "symbol", "first_above", "was_below")


FACTS = f"""{B.FUNDAMENTALS}, qf AS (SELECT symbol, date_trunc('quarter', period_end)::DATE AS period_start, period_end, available_at AS filed, revenue AS value FROM fun WHERE quarter(period_end) <> 4),
 yf AS (SELECT symbol, make_date(year(period_end), 1, 1) AS period_start, make_date(year(period_end), 12, 31) AS period_end, max(available_at) AS filed, sum(revenue) AS value FROM fun GROUP BY symbol, year(period_end)),
 facts AS (SELECT * FROM qf UNION ALL SELECT symbol, period_start, period_end, filed + 200, value * 1.01 FROM qf UNION ALL SELECT * FROM yf)"""


def reported_facts(spark, d):
    """Quarters one to three, each restated later, and whole years: the fourth quarter is never reported alone."""
    f = B.fundamentals(spark, d)
    cols = ["symbol", "period_start", "period_end", "filed", "value"]
    q = f.where(F.quarter("period_end") != 4).select("symbol", F.to_date(F.date_trunc("quarter", "period_end")).alias("period_start"), "period_end", F.col("available_at").alias("filed"), F.col("revenue").alias("value"))
    y = f.groupBy("symbol", F.year("period_end").alias("y")).agg(F.max("available_at").alias("filed"), F.sum("revenue").alias("value"))
    y = y.select("symbol", F.make_date("y", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"), "filed", "value")
    return q.unionByName(q.withColumns({"filed": F.date_add("filed", 200), "value": F.col("value") * 1.01})).unionByName(y).select(*cols)


@query("win43_first_reported", f"""WITH {FACTS}, k AS (SELECT *, CASE WHEN period_end - period_start BETWEEN 80 AND 100 THEN 'q' WHEN period_end - period_start BETWEEN 350 AND 380 THEN 'y' END AS kind FROM facts),
 o AS (SELECT * FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, kind, period_end ORDER BY filed, value) = 1), q AS (SELECT * FROM o WHERE kind = 'q'),
 g AS (SELECT y.symbol, y.period_end, y.filed, any_value(y.value) - sum(q.value) AS value, count(*) AS n, max(q.period_end) AS lst, bool_or(q.period_end = y.period_end) AS has FROM o y JOIN q ON q.symbol = y.symbol AND q.period_start >= y.period_start - 10 AND q.period_end <= y.period_end + 10 WHERE y.kind = 'y' GROUP BY y.symbol, y.period_end, y.filed)
 SELECT symbol, {ds('period_start')} AS period_start, {ds('period_end')} AS period_end, {ds('filed')} AS filed, {rs('value', 2)} AS value FROM q
 UNION ALL SELECT symbol, {ds('lst + 1')}, {ds('period_end')}, {ds('filed')}, {rs('value', 2)} FROM g WHERE n = 3 AND NOT has""")
def first_reported(spark, d):
    q = FU.first_reported_quarters(reported_facts(spark, d))
    return q.select("symbol", *[day(x).alias(x) for x in ("period_start", "period_end", "filed")], rnd("value", 2).alias("value"))


QUARTERS = f"""{B.FUNDAMENTALS}, qt AS (SELECT symbol, period_end, available_at, revenue, income AS net_income, income / units AS eps, revenue + income AS total_assets, CASE WHEN symbol % 3 <> 0 THEN units END AS long_debt, CASE WHEN symbol % 2 = 0 THEN revenue * 0.1::DOUBLE END AS short_debt FROM fun)"""


@query("win42_quarterly_derivations", f"""WITH {QUARTERS}, t AS (SELECT *, CASE WHEN long_debt IS NOT NULL OR short_debt IS NOT NULL THEN coalesce(long_debt, 0) + coalesce(short_debt, 0) END AS total_debt FROM qt)
 SELECT symbol, {ds('period_end')} AS period_end, {ds('available_at')} AS available_at, {rs('revenue / lag(revenue, 4) OVER w - 1', 6)} AS revenue_growth_yoy, {rs('eps / lag(eps, 4) OVER w - 1', 6)} AS eps_growth_yoy, {rs('net_income / nullif(revenue, 0)', 6)} AS net_margin,
 {rs('total_debt / nullif(total_assets, 0)', 6)} AS debt_to_assets, {rs('CASE WHEN count(eps) OVER z >= 4 THEN sum(eps) OVER z END')} AS eps_ttm FROM t WINDOW w AS (PARTITION BY symbol ORDER BY period_end), z AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def quarterly_derivations(spark, d):
    f, s = B.fundamentals(spark, d), F.col("symbol")
    q = f.select("symbol", "period_end", "available_at", "revenue", F.col("income").alias("net_income"), (F.col("income") / F.col("units")).alias("eps"), (F.col("revenue") + F.col("income")).alias("total_assets"),
                 F.when(s % 3 != 0, F.col("units")).alias("long_debt"), F.when(s % 2 == 0, F.col("revenue") * 0.1).alias("short_debt"))
    r = FU.quarterly_derivations(q)
    return r.select("symbol", day("period_end").alias("period_end"), day("available_at").alias("available_at"), *[rnd(x, 6).alias(x) for x in ("revenue_growth_yoy", "eps_growth_yoy", "net_margin", "debt_to_assets")], rnd("eps_ttm").alias("eps_ttm"))


ARTICLES = """art AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) + l_linenumber AS session, l_discount - 0.05::DOUBLE AS sentiment, l_tax AS relevance FROM lineitem)"""


def articles(spark, d):
    return B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("session"), (F.col("l_discount") - 0.05).alias("sentiment"), F.col("l_tax").alias("relevance"))


@query("agg03_daily_news", f"""WITH {B.BARS}, {ARTICLES}, a AS (SELECT symbol, session, avg(sentiment) AS m, coalesce(sum(sentiment * relevance) / nullif(sum(relevance), 0), avg(sentiment)) AS w, count(*) AS n FROM art GROUP BY 1, 2),
 j AS (SELECT b.symbol, b.session, coalesce(m, 0) AS m, coalesce(w, 0) AS w, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM bars b LEFT JOIN a USING (symbol, session))
 SELECT symbol, {ds()} AS session, {rs('m', 6)} AS news_mean, {rs('w', 6)} AS news_weighted, n AS news_count, {rs(f'CASE WHEN count(n) OVER {fr(30)} >= 5 THEN coalesce((n - avg(n) OVER {fr(30)}) / (stddev_samp(n) OVER {fr(30)} + 1e-9), 0) ELSE 0 END')} AS news_count_z FROM j""")
def daily_news(spark, d):
    n = N.daily_news(articles(spark, d), B.daily_bars(spark, d))
    return n.select("symbol", day().alias("session"), rnd("news_mean", 6).alias("news_mean"), rnd("news_weighted", 6).alias("news_weighted"), "news_count", rnd("news_count_z").alias("news_count_z"))


@query("win44_news_attention", f"""WITH {B.BARS}, {ARTICLES}, p AS (SELECT a.symbol, (SELECT min(b.session) FROM bars b WHERE b.symbol = a.symbol AND b.session >= a.session) AS session, a.sentiment FROM art a), g AS (SELECT symbol, session, count(*) AS n, sum(sentiment) AS s, count(sentiment) AS k FROM p WHERE session IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT b.symbol, b.session, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(k, 0) AS k FROM bars b LEFT JOIN g USING (symbol, session)), f AS (SELECT symbol, session, CAST(sum(n) OVER {fr(5)} AS DOUBLE) AS n5, coalesce(sum(s) OVER {fr(5)} / nullif(sum(k) OVER {fr(5)}, 0), 0) AS s5, coalesce(sum(s) OVER {fr(21)} / nullif(sum(k) OVER {fr(21)}, 0), 0) AS s21 FROM j)
 SELECT symbol, {ds()} AS session, {rs('ln(1 + n5)', 6)} AS news_n_5, {rs(f'least(10, greatest(-5, CASE WHEN count(n5) OVER {fr(252)} >= 60 THEN (n5 - avg(n5) OVER {fr(252)}) / (stddev_samp(n5) OVER {fr(252)} + 1e-9) ELSE 0 END))', 3)} AS news_att_z, {rs('s5', 6)} AS news_sent_5, {rs('s21', 6)} AS news_sent_21, {rs('s5 - s21', 6)} AS news_sent_chg FROM f""")
def news_attention(spark, d):
    n = N.news_attention(articles(spark, d), B.daily_bars(spark, d))
    return n.select("symbol", day().alias("session"), rnd("news_n_5", 6).alias("news_n_5"), rnd("news_att_z", 3).alias("news_att_z"), *[rnd(x, 6).alias(x) for x in ("news_sent_5", "news_sent_21", "news_sent_chg")])


# --- sessions inside a day: ticks as one-minute bars of a 09:30 to 16:00 session in UTC ----------------

SESSIONS = """ses AS (SELECT DISTINCT CAST(ts AS DATE) AS session, CAST(ts AS DATE) + INTERVAL '9 hours 30 minutes' AS open_ts, CAST(ts AS DATE) + INTERVAL '16 hours' AS close_ts FROM events),
 tb AS (SELECT event_id, event_type AS symbol, ts, CAST(ts AS DATE) AS session, value AS open, value AS high, value AS low, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, value AS vwap FROM events)"""


def session_table(spark, d):
    s = B.table(spark, d, "events").select(F.to_date("ts").alias("session")).distinct()
    at = lambda h, m: F.to_timestamp("session") + F.make_interval(hours=F.lit(h), mins=F.lit(m))
    return s.select("session", at(9, 30).alias("open_ts"), at(16, 0).alias("close_ts"))


def tick_bars(spark, d):
    t = B.ticks(spark, d)
    return t.select("event_id", "symbol", "ts", *[F.col("price").alias(x) for x in ("open", "high", "low", "close", "vwap")], F.col("size").alias("volume"))


@query("prj07_split_sessions", f"""WITH {SESSIONS} SELECT event_id, tb.symbol, {ds('tb.session')} AS session, {ts_sql("ts + INTERVAL '1 minute'")} AS t_close FROM tb JOIN ses USING (session) WHERE ts >= open_ts AND ts + INTERVAL '1 minute' <= close_ts""")
def split_sessions(spark, d):
    r, _ = R.split_sessions(tick_bars(spark, d), session_table(spark, d), 1, "UTC")
    return r.select("event_id", "symbol", day().alias("session"), stamp("t_close").alias("t_close"))


@query("agg02_premarket", f"""WITH {SESSIONS} SELECT tb.symbol, {ds('tb.session')} AS session, sum(volume) AS pre_volume, {rs('max(high)', 2)} AS pre_high, {rs('min(low)', 2)} AS pre_low, {rs('arg_max(close, ts)', 2)} AS pre_last FROM tb JOIN ses USING (session) WHERE ts + INTERVAL '1 minute' <= open_ts GROUP BY 1, tb.session""")
def premarket(spark, d):
    _, p = R.split_sessions(tick_bars(spark, d), session_table(spark, d), 1, "UTC")
    return p.select("symbol", day().alias("session"), "pre_volume", *[rnd(x, 2).alias(x) for x in ("pre_high", "pre_low", "pre_last")])


@query("agg01_hours_from_open", f"""WITH {SESSIONS}, r AS (SELECT tb.*, open_ts, close_ts, CAST(floor((epoch(ts) - epoch(open_ts)) / 3600) AS BIGINT) AS hour FROM tb JOIN ses USING (session) WHERE ts >= open_ts AND ts + INTERVAL '1 minute' <= close_ts)
 SELECT symbol, {ds()} AS session, hour, {rs('arg_min(open, ts)', 2)} AS open, {rs('max(high)', 2)} AS high, {rs('min(low)', 2)} AS low, {rs('arg_max(close, ts)', 2)} AS close, sum(volume) AS volume, {rs('sum(vwap * volume) / nullif(sum(volume), 0)', 2)} AS vwap, {ts_sql("least(max(open_ts) + to_hours(hour + 1), max(close_ts))")} AS t_close FROM r GROUP BY symbol, session, hour""")
def hours_from_open(spark, d):
    cal = session_table(spark, d)
    r, _ = R.split_sessions(tick_bars(spark, d), cal, 1, "UTC")
    h = R.hourly_from_open(r, cal)
    return h.select("symbol", day().alias("session"), "hour", *[rnd(x, 2).alias(x) for x in ("open", "high", "low", "close")], "volume", rnd("vwap", 2).alias("vwap"), stamp("t_close").alias("t_close"))


@query("prj05_completed_rows", f"""WITH {SESSIONS} SELECT event_id, symbol FROM tb WHERE ts + INTERVAL '15 minutes' <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM tb)""")
def completed_rows(spark, d):
    t = tick_bars(spark, d).withColumn("t_close", F.col("ts") + F.make_interval(mins=F.lit(15)))
    lo, hi = t.agg(F.min("ts"), F.max("ts")).first()
    return R.completed(t, F.lit(lo + (hi - lo) / 2)).select("event_id", "symbol")


@query("jon09_article_sessions", f"""SELECT event_id, {ds("CAST(ts + INTERVAL '8 hours' AS DATE)")} AS session_day FROM events""")
def article_sessions(spark, d):
    return D.articles_to_sessions(B.ticks(spark, d), "ts", zone="UTC").select("event_id", day("session_day").alias("session_day"))


# --- small column rules -------------------------------------------------------------------------------

@query("prj01_asset_class", """WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '=X' WHEN 1 THEN c_mktsegment || '-USD' WHEN 2 THEN c_mktsegment || '-USDT' ELSE c_mktsegment END AS symbol FROM customer)
 SELECT c_custkey, symbol, CASE WHEN ends_with(symbol, '=X') THEN 'fx' WHEN ends_with(symbol, '-USD') OR ends_with(symbol, '-USDT') THEN 'crypto' ELSE 'equity' END AS asset_class FROM s""")
def asset_class(spark, d):
    k, m = F.col("c_custkey") % 4, F.col("c_mktsegment")
    name = F.when(k == 0, F.concat(m, F.lit("=X"))).when(k == 1, F.concat(m, F.lit("-USD"))).when(k == 2, F.concat(m, F.lit("-USDT"))).otherwise(m)
    return B.table(spark, d, "customer").select("c_custkey", name.alias("symbol")).withColumn("asset_class", R.asset_class())


ROLES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Director' WHEN '2-HIGH' THEN 'Officer,Director' WHEN '3-MEDIUM' THEN 'Officer' ELSE 'TenPercentOwner' END"


@query("prj11_qualifying_purchases", f"""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND {ROLES} <> 'TenPercentOwner' AND l_linestatus = 'F' AND l_tax <> 0.08::DOUBLE AND l_extendedprice > 0 AND l_extendedprice / l_quantity > 0""")
def qualifying_purchases(spark, d):
    p = F.col("o_orderpriority")
    role = F.when(p == "1-URGENT", "Director").when(p == "2-HIGH", "Officer,Director").when(p == "3-MEDIUM", "Officer").otherwise("TenPercentOwner")
    li, o = B.table(spark, d, "lineitem"), B.table(spark, d, "orders").select("o_orderkey", role.alias("relationship"))
    tx = li.join(o, li.l_orderkey == o.o_orderkey).withColumns({
        "code": F.when(F.col("l_returnflag") == "R", "S").otherwise("P"), "acq_disp": F.when(F.col("l_linestatus") == "F", "A").otherwise("D"), "planned_10b5_1": F.col("l_tax") == 0.08,
        "value": F.col("l_extendedprice"), "price": F.col("l_extendedprice") / F.col("l_quantity")})
    return R.qualifying_purchases(tx).select("l_orderkey", "l_linenumber", "l_partkey")


@query("sig27_trade_plan", f"""WITH {B.BARS}, s AS (SELECT symbol, session, close, {full_sql('max(high)', 'high', 20)} - {full_sql('min(low)', 'low', 20)} AS width FROM bars), p AS (SELECT *, width / 10 AS dist FROM s)
 SELECT symbol, {ds()} AS session, {rs('close - dist', 2)} AS stop, {rs('close + 2 * dist', 2)} AS target, CAST(least(floor(1000000 * 0.01::DOUBLE / nullif(dist, 0)), floor(1000000 / 10.0::DOUBLE / nullif(close, 0))) AS BIGINT) AS shares,
 {rs('close + 0.618::DOUBLE * dist', 2)} AS level_618 FROM p WHERE dist IS NOT NULL""")
def trade_plan(spark, d):
    from tapegrain.operators.kernels import full, trailing
    w = trailing(by_time("symbol", "session"), 20)
    b = B.daily_bars(spark, d).withColumn("dist", (full(F.max("high"), "high", w, 20) - full(F.min("low"), "low", w, 20)) / 10).where(F.col("dist").isNotNull())
    b = b.withColumn("p", SC.trade_plan(F.col("close"), F.col("dist"), F.lit(1_000_000.0)))
    level = SC.retracement_levels(F.col("close") + F.col("dist"), F.col("close"), (0.0, 0.382, 1.0))["0.382"]
    return b.select("symbol", day().alias("session"), rnd("p.stop", 2).alias("stop"), rnd("p.target", 2).alias("target"), F.col("p.shares").cast("bigint").alias("shares"), rnd(level, 2).alias("level_618"))


@query("sig07_health_multiplier", f"""SELECT c_custkey, {rs('CASE WHEN h >= 0 THEN 1 + 0.1::DOUBLE * h ELSE 1 + 0.55::DOUBLE * h END', 6)} AS multiplier FROM (SELECT c_custkey, c_acctbal / 10000 AS h FROM customer)""")
def health_multiplier(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", rnd(SC.health_multiplier(F.col("c_acctbal") / 10000), 6).alias("multiplier"))


@query("stm08_surge_alerts", f"""WITH {B.TICKS}, l AS (SELECT event_id, symbol, account, (price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1) * 100 AS chg FROM ticks WHERE price > 0) SELECT event_id, symbol, {rs('chg', 2)} AS change_pct, CASE WHEN abs(chg) >= 100 THEN 'critical' ELSE 'warning' END AS severity FROM l WHERE abs(chg) >= 50 AND symbol IN ('click', 'purchase')""")
def surge_alerts(spark, d):
    w = by_time("symbol", ["ts", "event_id"])
    q = B.ticks(spark, d).where("price > 0").withColumn("change_pct", (F.col("price") / F.lag("price").over(w) - 1) * 100)
    watch = F.broadcast(spark.createDataFrame([("click",), ("purchase",)], "symbol string"))
    return T.surge_alerts(q, watch, 50.0).select("event_id", "symbol", rnd("change_pct", 2).alias("change_pct"), "severity")


# --- joins and model data ------------------------------------------------------------------------------

@query("jon03_asof_limited", f"""WITH {B.BARS}, v AS (SELECT symbol, session, vwap FROM bars WHERE volume >= 45), t AS (SELECT symbol, session, row_number() OVER ({WS}) AS i FROM bars), a AS (SELECT t.*, v.vwap, v.session AS rt FROM t ASOF LEFT JOIN v ON t.symbol = v.symbol AND t.session >= v.session),
 g AS (SELECT *, i - min(i) OVER (PARTITION BY symbol, rt) AS age FROM a) SELECT symbol, {ds()} AS session, {rs(f'lag(CASE WHEN age <= 5 THEN vwap END) OVER ({WS})', 2)} AS filled FROM g""")
def asof_limited(spark, d):
    b = B.daily_bars(spark, d)
    j = J.asof_limited(b.select("symbol", "session"), b.where("volume >= 45"), "symbol", "session", "vwap", "filled", 5, 1)
    return j.select("symbol", day().alias("session"), rnd("filled", 2).alias("filled"))


@query("mlp03_filter_map", f"""WITH {B.BARS}, s AS (SELECT symbol, session, volume, close FROM bars) SELECT symbol, {ds()} AS session, CASE WHEN volume >= 30 THEN close > 1500 ELSE true END AS take FROM s""")
def filter_map(spark, d):
    b = B.daily_bars(spark, d)
    scored = b.where("volume >= 30").select("symbol", "session", (F.col("close") > 1500).alias("kept"))
    return L.filter_map(b.select("symbol", "session"), scored).select("symbol", day().alias("session"), "take")


@query("mlp07_fold_loss", f"""WITH {B.BARS}, f AS (SELECT symbol, year(session) AS fold, ln(close / lag(close) OVER ({WS})) AS y FROM bars), g AS (SELECT * FROM f WHERE y IS NOT NULL), p AS (SELECT *, -0.3::DOUBLE AS a, 0.0::DOUBLE AS b, 0.3::DOUBLE AS c, 0.5::DOUBLE + 0.01::DOUBLE * (symbol % 9) AS q FROM g),
 l AS (SELECT symbol, fold, (greatest(0.1::DOUBLE * (y - a), -0.9::DOUBLE * (y - a)) + greatest(0.5::DOUBLE * (y - b), -0.5::DOUBLE * (y - b)) + greatest(0.9::DOUBLE * (y - c), -0.1::DOUBLE * (y - c))) / 3 AS pin, CASE WHEN y > 0 THEN -ln(q) ELSE -ln(1 - q) END AS ll, c - a AS wd FROM p)
 SELECT symbol, fold, {rs('avg(pin) + 0.3::DOUBLE * avg(ll) + 0.05::DOUBLE * avg(wd)', 6)} AS loss, count(*) AS n FROM l GROUP BY 1, 2""")
def fold_loss(spark, d):
    b = B.daily_bars(spark, d).select("symbol", F.year("session").alias("fold"), F.log(F.col("close") / F.lag("close").over(by_time("symbol", "session"))).alias("y")).where("y is not null")
    p = b.withColumns({"q10": F.lit(-0.3), "q50": F.lit(0.0), "q90": F.lit(0.3), "p_up": 0.5 + 0.01 * (F.col("symbol") % 9)})
    return L.fold_loss(p, ["symbol", "fold"]).select("symbol", "fold", rnd("loss", 6).alias("loss"), "n")


@query("prj15_suppressed_columns", f"""WITH {B.BARS}, v AS (SELECT var_pop(close) AS close, var_pop(volume * 0) AS flat, var_pop(volume) AS volume, var_pop(close * 1e-12) AS tiny FROM bars) SELECT feature, {rs('variance')} AS variance FROM (UNPIVOT v ON close, flat, volume, tiny INTO NAME feature VALUE variance) WHERE variance < 1e-9""")
def suppressed_columns(spark, d):
    b = B.daily_bars(spark, d).select("close", (F.col("volume") * 0).alias("flat"), "volume", (F.col("close") * 1e-12).alias("tiny"))
    return L.suppressed(b, ["close", "flat", "volume", "tiny"]).select("feature", rnd("variance").alias("variance"))
