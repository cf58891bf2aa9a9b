"""Curves, trades, forecasts, portfolios and decision records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.functions import indicators as I
from tapegrain.operators import corporate as C
from tapegrain.operators import evaluation as E
from tapegrain.operators import factors as X
from tapegrain.operators import joins as J
from tapegrain.operators import portfolio as P
from tapegrain.operators.kernels import asof_join, by_time, exact_quantiles, so_far
from tapegrain.plans.catalog import day, ds, query, rnd, rs
from tapegrain.plans.joins import ANCHORS
from tapegrain.plans.windows import COMP, WS, composite_panel, fr, full_sql


@query("agg05_curve_metrics", f"""WITH {B.BARS}, r AS (SELECT *, close / lag(close) OVER ({WS}) - 1 AS r, close / max(close) OVER ({WS} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars),
 i AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS isl FROM r),
 l AS (SELECT symbol, max(u) AS longest FROM (SELECT symbol, isl, count(*) FILTER (dd < 0) AS u FROM i GROUP BY 1, 2) GROUP BY 1),
 g AS (SELECT symbol, arg_max(close, session) / arg_min(close, session) AS tot, count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dsd, min(dd) AS mdd FROM r GROUP BY 1)
 SELECT symbol, {rs('tot - 1', 6)} AS total_return, {rs('power(tot, 252.0 / n) - 1', 6)} AS cagr, {rs('sd * sqrt(252)', 6)} AS vol, {rs('mu / sd * sqrt(252)', 6)} AS sharpe,
 {rs('mu / dsd * sqrt(252)', 6)} AS sortino, {rs('mdd', 6)} AS max_drawdown, longest AS longest_drawdown, {rs('mu / sd * sqrt(n)', 6)} AS t_stat FROM g JOIN l USING (symbol)""")
def curve_metrics(spark, d):
    m = E.curve_metrics(B.daily_bars(spark, d))
    return m.select("symbol", *[rnd(x, 6).alias(x) for x in ("total_return", "cagr", "vol", "sharpe", "sortino", "max_drawdown", "t_stat")], "longest_drawdown")


TRADES = """trades AS (SELECT l_returnflag AS market, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linestatus END AS micro, l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl,
 l_extendedprice * l_tax * 0.01::DOUBLE AS costs, l_extendedprice * (l_discount - 0.05::DOUBLE) / (l_quantity * 10) AS r, l_linenumber AS sessions, l_linestatus || l_returnflag AS reason FROM lineitem)"""


def trades(spark, d):
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    return B.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("market"), F.when(F.col("l_linenumber") <= 5, F.col("l_linestatus")).alias("micro"), pnl.alias("pnl"),
        (F.col("l_extendedprice") * F.col("l_tax") * 0.01).alias("costs"), (pnl / (F.col("l_quantity") * 10)).alias("r"), F.col("l_linenumber").alias("sessions"),
        F.concat("l_linestatus", "l_returnflag").alias("reason"))


TM = f"""count(*) AS n, {rs('avg(CAST(pnl > 0 AS DOUBLE))', 6)} AS win_rate, {rs('CASE WHEN sum(pnl) FILTER (pnl <= 0) < 0 THEN sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0) END', 6)} AS profit_factor,
 {rs('avg(r)')} AS mean_r, {rs('avg(r) / (stddev_samp(r) / sqrt(count(r)))', 3)} AS t_mean_r, {rs('avg(sessions)', 6)} AS mean_sessions"""


@query("agg06_trade_metrics", f"""WITH {TRADES} SELECT market, {TM}, {rs('median(r)')} AS median_r, {rs('CASE WHEN sum(pnl + costs) > 0 THEN 100 * sum(costs) / sum(pnl + costs) END', 3)} AS costs_pct_of_gross,
 count(*) FILTER (reason LIKE 'O%') AS exits_open, count(*) FILTER (reason LIKE 'F%') AS exits_filled FROM trades GROUP BY market""")
def trade_metrics(spark, d):
    t = E.trade_metrics(trades(spark, d), ["market"])
    count = lambda x: F.aggregate(F.map_entries("exit_reasons"), F.lit(0).cast("bigint"), lambda a, e: a + F.when(e["key"].startswith(x), e["value"]).otherwise(0))
    return t.select("market", "n", *[rnd(x, 6).alias(x) for x in ("win_rate", "profit_factor", "mean_sessions")], rnd("mean_r").alias("mean_r"),
                    rnd("t_mean_r", 3).alias("t_mean_r"), rnd("median_r").alias("median_r"), rnd("costs_pct_of_gross", 3).alias("costs_pct_of_gross"),
                    count("O").alias("exits_open"), count("F").alias("exits_filled"))


@query("agg07_trades_by_group", f"""WITH {TRADES} SELECT market, micro, grouping(market, micro) AS gid, {TM} FROM trades
 GROUP BY GROUPING SETS ((market), (micro), (market, micro)) HAVING count(*) >= 50""")
def trades_by_group(spark, d):
    t = E.trades_by_group(trades(spark, d), [["market"], ["micro"], ["market", "micro"]], 50)
    return t.select("market", "micro", F.col("gid").cast("bigint").alias("gid"), "n", *[rnd(x, 6).alias(x) for x in ("win_rate", "profit_factor", "mean_sessions")],
                    rnd("mean_r").alias("mean_r"), rnd("t_mean_r", 3).alias("t_mean_r"))


@query("agg08_yearly_returns", f"""WITH {B.BARS}, y AS (SELECT symbol, year(session) AS year, arg_max(close, session) AS l, arg_min(close, session) AS f FROM bars GROUP BY 1, 2)
 SELECT symbol, CAST(year AS INTEGER) AS year, {rs('l / coalesce(lag(l) OVER (PARTITION BY symbol ORDER BY year), f) - 1', 6)} AS ret FROM y""")
def yearly(spark, d):
    return E.yearly_returns(B.daily_bars(spark, d)).select("symbol", "year", rnd("ret", 6).alias("ret"))


RET = f"""rt AS (SELECT symbol, session, close / lag(close) OVER ({WS}) - 1 AS ret FROM bars), rq AS (SELECT * FROM rt WHERE ret IS NOT NULL),
 mr AS (SELECT session, close / lag(close) OVER (ORDER BY session) - 1 AS m FROM mkt)"""


def returns(spark, d):
    b = B.daily_bars(spark, d)
    return b.select("symbol", "session", (F.col("close") / F.lag("close").over(by_time("symbol", "session")) - 1).alias("ret")).where(F.col("ret").isNotNull())


@query("agg09_risk_block", f"""WITH {B.BARS}, {B.MARKET}, {RET}, j AS (SELECT symbol, ret, m FROM rq JOIN mr USING (session)),
 k AS (SELECT symbol, ret, CASE WHEN m IS NULL THEN NULL ELSE ret END AS rr, m FROM j)
 SELECT symbol, count(*) AS n, {rs('stddev_samp(ret) * sqrt(252)', 6)} AS vol, {rs('avg(ret) / stddev_samp(ret) * sqrt(252)', 6)} AS sharpe,
 {rs('covar_samp(rr, m) / var_samp(m)', 6)} AS beta, {rs('-quantile_cont(ret, 0.05)', 6)} AS value_at_risk FROM k GROUP BY 1""")
def risk_block(spark, d):
    m = B.market_bars(spark, d).select("session", (F.col("close") / F.lag("close").over(by_time("symbol", "session")) - 1).alias("ret"))
    return E.risk_block(returns(spark, d), m).select("symbol", "n", *[rnd(x, 6).alias(x) for x in ("vol", "sharpe", "beta", "value_at_risk")])


# --- portfolios ---------------------------------------------------------------------------------

# an independent step-by-step form: one recursion step per trade number, all keys at once
AVGCOST = f"""{B.TRANSACTIONS}, t0 AS (SELECT *, row_number() OVER (PARTITION BY portfolio, symbol ORDER BY session, l_orderkey, l_linenumber, l_partkey) AS k FROM tx),
 pos AS (SELECT portfolio, symbol, k, session, CASE WHEN side = 'buy' THEN qty ELSE 0::DOUBLE END AS held, CASE WHEN side = 'buy' THEN qty * price + fee ELSE 0::DOUBLE END AS cost FROM t0 WHERE k = 1
  UNION ALL SELECT t.portfolio, t.symbol, t.k, t.session, CASE WHEN t.side = 'buy' THEN p.held + t.qty ELSE greatest(p.held - t.qty, 0) END,
   CASE WHEN t.side = 'buy' THEN p.cost + t.qty * t.price + t.fee WHEN p.held <= 0 THEN 0 ELSE p.cost * (1 - least(t.qty, p.held) / p.held) END
  FROM pos p JOIN t0 t ON t.portfolio = p.portfolio AND t.symbol = p.symbol AND t.k = p.k + 1),
 fin AS (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY portfolio, symbol ORDER BY k DESC) = 1)"""


@query("seq10_average_cost", f"WITH RECURSIVE {AVGCOST} SELECT portfolio, symbol, {rs('held', 2)} AS held, {rs('cost', 2)} AS cost FROM fin")
def average_cost(spark, d):
    p = P.positions(B.transactions(spark, d))
    return p.select("portfolio", "symbol", rnd("held", 2).alias("held"), rnd("cost", 2).alias("cost"))


DIVS = """t AS (SELECT portfolio, symbol, session, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS q FROM tx GROUP BY 1, 2, 3),
 hh AS (SELECT p.portfolio, v.symbol, v.amount, (SELECT sum(q) FROM t WHERE t.portfolio = p.portfolio AND t.symbol = v.symbol AND t.session <= v.ex_date) AS shares
  FROM (SELECT DISTINCT portfolio, symbol FROM t) p JOIN dvd v ON p.symbol = v.symbol), dr AS (SELECT portfolio, symbol, sum(amount * shares) AS received FROM hh WHERE shares > 0 GROUP BY 1, 2)"""
LASTPX = "px AS (SELECT symbol, arg_max(close, session) AS price FROM bars GROUP BY 1)"


def last_prices(spark, d):
    return B.daily_bars(spark, d).groupBy("symbol").agg(F.max_by("close", "session").alias("price"))


@query("agg11_valuation", f"""WITH RECURSIVE {AVGCOST}, {B.DIVIDENDS}, {DIVS}, {B.BARS}, {LASTPX}, {B.SECTORS},
 v AS (SELECT f.portfolio, s.sector, sum(held * price) AS mv, sum(cost) AS c, sum(coalesce(received, 0)) AS dv, count(*) AS n FROM fin f JOIN px USING (symbol) JOIN sectors s USING (symbol)
  LEFT JOIN dr ON dr.portfolio = f.portfolio AND dr.symbol = f.symbol WHERE held > 0 GROUP BY 1, 2)
 SELECT portfolio, CAST(sum(n) AS BIGINT) AS positions, {rs('sum(mv)', 2)} AS market_value, {rs('sum(c)', 2)} AS cost, {rs('sum(mv) - sum(c)', 2)} AS open_profit, {rs('sum(dv)', 2)} AS dividends,
 {rs('max(mv) / sum(mv)', 6)} AS top_sector_share FROM v GROUP BY 1""")
def valuation(spark, d):
    tx = B.transactions(spark, d)
    v = P.valuation(P.positions(tx), last_prices(spark, d), P.dividends_received(tx, B.dividends(spark, d)), B.sectors(spark, d))
    return v.select("portfolio", "positions", *[rnd(x, 2).alias(x) for x in ("market_value", "cost", "open_profit", "dividends")], rnd("top_sector_share", 6).alias("top_sector_share"))


@query("agg10_concentration", f"""WITH RECURSIVE {AVGCOST}, {B.BARS}, {LASTPX}, m AS (SELECT portfolio, held * price AS mv FROM fin JOIN px USING (symbol) WHERE held > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY mv DESC) AS rn FROM m)
 SELECT portfolio, {rs('sum(mv * mv) / (sum(mv) * sum(mv))', 6)} AS hhi, {rs('sum(mv) * sum(mv) / sum(mv * mv)', 6)} AS effective_bets, {rs('max(mv) / sum(mv)', 6)} AS top1,
 {rs('sum(mv) FILTER (rn <= 3) / sum(mv)', 6)} AS top3 FROM r GROUP BY 1""")
def concentration(spark, d):
    m = P.positions(B.transactions(spark, d)).where(F.col("held") > 0).join(last_prices(spark, d), "symbol").select("portfolio", (F.col("held") * F.col("price")).alias("mv"))
    return P.concentration(m, "portfolio", "mv").select("portfolio", *[rnd(x, 6).alias(x) for x in ("hhi", "effective_bets", "top1", "top3")])


@query("agg12_holdings", f"""WITH h AS (SELECT l_suppkey AS filing, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS security, sum(l_extendedprice) AS v, sum(l_quantity) AS shares, max(max(l_extendedprice)) OVER (PARTITION BY l_suppkey) AS mx
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
 SELECT filing, security, {rs('v * CASE WHEN mx <= 1e8 THEN 1000 ELSE 1 END', 0)} AS value, {rs('shares', 2)} AS shares, {rs('v / sum(v) OVER (PARTITION BY filing)', 6)} AS weight FROM h""")
def holdings(spark, d):
    li = B.table(spark, d, "lineitem").join(B.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    rows = li.select(F.col("l_suppkey").alias("filing"), F.coalesce("p_name", F.col("l_partkey").cast("string")).alias("security"), "l_extendedprice", "l_quantity")
    h = P.holdings_by_security(rows, "filing", "security", "l_extendedprice", "l_quantity")
    return h.select("filing", "security", rnd("value", 0).alias("value"), rnd("shares", 2).alias("shares"), rnd("weight", 6).alias("weight"))


@query("agg19_equal_weight_returns", f"""WITH {B.BARS}, {ANCHORS}, g AS (SELECT symbol, anchor FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN anchors),
 p AS (SELECT g.symbol, g.anchor, b.close AS price FROM g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.anchor >= b.session),
 n AS (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY anchor) AS nx FROM p)
 SELECT {ds('anchor')} AS anchor, {rs('avg(nx / price - 1)', 6)} AS ret, count(*) AS n FROM n WHERE price > 0 AND nx IS NOT NULL GROUP BY 1""")
def equal_weight(spark, d):
    a = C.month_starts(B.calendar(spark, d)).select(F.col("session").alias("anchor"))
    p = J.anchor_prices(B.daily_bars(spark, d), a)
    return E.equal_weight_returns(p.select("symbol", "anchor"), p).select(day("anchor").alias("anchor"), rnd("ret", 6).alias("ret"), "n")


@query("agg21_quality_report", f"""WITH {B.BARS}, r AS (SELECT *, abs(close / lag(close) OVER ({WS}) - 1) AS r FROM bars)
 SELECT symbol, count(*) AS bars, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS ohlc_violations, count(*) FILTER (close <= 0) AS non_positive,
 count(*) FILTER (coalesce(volume, 0) = 0) AS zero_volume, count(*) FILTER (r > 0.4) AS big_moves, {rs('max(r)', 6)} AS biggest_move FROM r GROUP BY 1""")
def quality_report(spark, d):
    q = E.quality_report(B.daily_bars(spark, d))
    return q.select("symbol", "bars", "ohlc_violations", "non_positive", "zero_volume", "big_moves", rnd("biggest_move", 6).alias("biggest_move"))


@query("agg22_quantiles", f"""WITH {B.BARS}, {B.SECTORS}, r AS (SELECT sector, close / lag(close) OVER ({WS}) - 1 AS r FROM bars JOIN sectors USING (symbol))
 SELECT sector, {rs('quantile_cont(r, 0.5)', 6)} AS q50, {rs('quantile_cont(r, 0.9)', 6)} AS q90, {rs('quantile_cont(r, 0.99)', 6)} AS q99 FROM r GROUP BY 1""")
def quantiles(spark, d):
    r = returns(spark, d).join(B.sectors(spark, d).select("symbol", "sector"), "symbol")
    return exact_quantiles(r, ["sector"], "ret", {"q50": .5, "q90": .9, "q99": .99}).select("sector", *[rnd(x, 6).alias(x) for x in ("q50", "q90", "q99")])


@query("agg24_archive_status", f"""SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS entities, {ds('min(o_orderdate)')} AS first_day, {ds('max(o_orderdate)')} AS last_day FROM orders GROUP BY 1""")
def archive_status(spark, d):
    o = B.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("entities"),
                                                                  day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"))


@query("agg25_copy_scorecards", f"""WITH {B.BARS}, {B.MARKET}, {B.FILINGS}, nb AS (SELECT symbol, session, open, lead(session, 63) OVER ({WS}) AS xs, lead(open, 63) OVER ({WS}) AS xo FROM bars),
 e AS (SELECT f.owner, f.issuer, f.filed - f.trade_date AS lag, nb.session AS es, nb.open AS eo, xs, xo FROM fil f ASOF LEFT JOIN nb ON f.issuer = nb.symbol AND f.filed < nb.session WHERE code = 'P'),
 x AS (SELECT e.*, ln(xo / eo) - ln(m2.open / m1.open) AS ex FROM e LEFT JOIN mkt m1 ON m1.session = es LEFT JOIN mkt m2 ON m2.session = xs)
 SELECT owner, count(*) AS buys, count(ex) AS n, {rs('avg(ex)', 6)} AS mean_excess, {rs('median(ex)', 6)} AS median_excess, {rs('avg(CAST(ex > 0 AS DOUBLE))', 6)} AS hit_rate,
 {rs('CASE WHEN count(ex) > 2 AND stddev_samp(ex) > 0 THEN avg(ex) / (stddev_samp(ex) / sqrt(count(ex))) END', 4)} AS t_stat, {rs('avg(lag)', 4)} AS mean_lag FROM x GROUP BY 1 HAVING count(*) >= 5""")
def copy_scorecards(spark, d):
    from tapegrain.operators.disclosures import scorecards
    f = B.filings(spark, d).where(F.col("code") == "P")
    s = scorecards(f, B.daily_bars(spark, d), B.market_bars(spark, d), 63, 5)
    return s.select("owner", "buys", "n", *[rnd(x, 6).alias(x) for x in ("mean_excess", "median_excess", "hit_rate")], rnd("t_stat", 4).alias("t_stat"), rnd("mean_lag", 4).alias("mean_lag"))


@query("agg42_trending", f"""SELECT source, count(*) AS n, {rs('avg(n_chars)', 2)} AS mean_chars FROM documents GROUP BY 1 HAVING count(*) >= 5 ORDER BY abs(avg(n_chars)) DESC, source LIMIT 8""")
def trending(spark, d):
    g = B.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m")).where(F.col("n") >= 5)
    return g.orderBy(F.desc(F.abs("m")), "source").limit(8).select("source", "n", rnd("m", 2).alias("mean_chars"))


@query("agg43_distinct_values", "SELECT DISTINCT 'industry' AS kind, n_name AS value FROM nation UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM customer")
def distinct_values(spark, d):
    n = B.table(spark, d, "nation").select(F.lit("industry").alias("kind"), F.col("n_name").alias("value")).distinct()
    return n.unionByName(B.table(spark, d, "customer").select(F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("value")).distinct())


@query("agg45_shrunk_covariance", f"""WITH {B.BARS}, {B.SECTORS}, {B.SECTOR_BARS}, s AS (SELECT sector AS symbol, session, close FROM sector_bars),
 r AS (SELECT symbol, session, close / lag(close) OVER ({WS}) - 1 AS ret FROM s), q AS (SELECT * FROM r WHERE ret IS NOT NULL),
 k AS (SELECT session FROM q GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM q)), f AS (SELECT * FROM q WHERE session IN (SELECT session FROM k)),
 z AS (SELECT symbol, session, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM f),
 c AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, avg(a.x * b.x) AS s, avg(a.x * b.x * a.x * b.x) AS p2 FROM z a JOIN z b USING (session) GROUP BY 1, 2),
 t AS (SELECT avg(s) FILTER (a = b) AS m, sum((p2 - s * s) / n) AS beta, sum(s * s) AS ss, count(DISTINCT a) AS p FROM c),
 w AS (SELECT least(1, beta / (ss - p * m * m)) AS k, m FROM t)
 SELECT a, b, n, {rs('s * n / (n - 1) * 252', 6)} AS sample_cov, {rs('((1 - k) * s + CASE WHEN a = b THEN k * m ELSE 0 END) * 252', 6)} AS shrunk_cov, {rs('k', 6)} AS intensity FROM c, w""")
def shrunk_covariance(spark, d):
    s = B.sector_bars(spark, d).withColumnRenamed("sector", "symbol")
    s = s.withColumn("ret", F.col("close") / F.lag("close").over(by_time("symbol", "session")) - 1).where(F.col("ret").isNotNull())
    c = E.shrunk_covariance(s)
    return c.select("a", "b", "n", *[rnd(x, 6).alias(x) for x in ("sample_cov", "shrunk_cov", "intensity")])


# --- forecasts ----------------------------------------------------------------------------------

FC = f"""fr0 AS (SELECT *, ln(close / lag(close) OVER ({WS})) AS r1 FROM bars), fr1 AS (SELECT symbol, session, close, {full_sql('avg(r1)', 'r1', 60)} AS mu, {full_sql('stddev_samp(r1)', 'r1', 60)} AS sd,
 last_value(session) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM fr0),
 fc AS (SELECT symbol, session, horizon, close AS last_price, close * exp(mu * horizon) AS p50, close * exp(mu * horizon - 1.2816::DOUBLE * sd * sqrt(horizon)) AS p10,
  close * exp(mu * horizon + 1.2816::DOUBLE * sd * sqrt(horizon)) AS p90, session + CAST(horizon * 7 // 5 AS INTEGER) AS target, fin FROM fr1, (VALUES (5), (20)) h(horizon) WHERE sd IS NOT NULL),
 rz AS (SELECT fc.*, b.close AS realised FROM fc ASOF JOIN bars b ON fc.symbol = b.symbol AND fc.target >= b.session WHERE fc.target <= fc.fin)"""


def forecasts(spark, d):
    """Climatology forecasts per (symbol, session, horizon) and the close at or before the target date."""
    w = by_time("symbol", "session")
    b = B.symbol_bars(spark, d).where(F.col("symbol").isNotNull()).select("symbol", "session", "close")
    b = b.withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    b = b.withColumns({"mu": I.sma("_r", 60), "sd": I.rolling_std("_r", 60), "_fin": F.max("session").over(Window.partitionBy("symbol"))})
    band = lambda h, z: F.col("close") * F.exp(F.col("mu") * h + z * F.col("sd") * F.sqrt(F.lit(h)))
    made = [F.struct("session", F.lit(h).alias("horizon"), F.col("close").alias("last_price"), band(h, 0.0).alias("p50"), band(h, -1.2816).alias("p10"), band(h, 1.2816).alias("p90"),
                     F.date_add("session", h * 7 // 5).alias("target")) for h in (5, 20)]
    # each bar carries the forecasts made on it, so that all of this is one task's work on a symbol, dealt once
    b = b.withColumn("_f", F.when(F.col("sd").isNotNull(), F.filter(F.array(*made), lambda z: z["target"] <= F.col("_fin"))))
    return asof_join(None, b, "symbol", "target", "session", {"close": "realised"}, carried="_f")


@query("agg33_forecast_scores", f"""WITH {B.BARS}, {FC} SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n, {rs('avg(CAST((ln(realised / last_price) > 0) = (ln(p50 / last_price) > 0) AS DOUBLE))', 6)} AS hit_rate,
 {rs('avg(abs(ln(realised / last_price) - ln(p50 / last_price)))', 6)} AS mae_logret, {rs('avg(CAST(realised BETWEEN p10 AND p90 AS DOUBLE))', 6)} AS coverage,
 {rs('avg(ln(p50 / last_price) - ln(realised / last_price))', 6)} AS bias FROM rz GROUP BY ROLLUP (horizon)""")
def forecast_scores(spark, d):
    s = E.score_forecasts(forecasts(spark, d))
    return s.select("horizon", "n", *[rnd(x, 6).alias(x) for x in ("hit_rate", "mae_logret", "coverage", "bias")])


SC = f"""sf AS (SELECT symbol, session, round(score, 9) AS score, lead(close, 21) OVER ({WS}) / lead(open) OVER ({WS}) - 1 AS y FROM sc), sr AS (SELECT * FROM sf WHERE score IS NOT NULL AND y IS NOT NULL)"""


def scored_forward(spark, d):
    w = by_time("symbol", "session")
    p = composite_panel(spark, d).withColumn("y", F.lead("close", 21).over(w) / F.lead("open", 1).over(w) - 1)
    return p.where(F.col("score").isNotNull() & F.col("y").isNotNull()).select(
        "symbol", "session", F.round("score", 9).alias("score"), "y")


@query("agg34_threshold_calibration", f"""WITH {COMP}, {SC}, q AS (SELECT quantile_cont(score, 0.1) AS a, quantile_cont(score, 0.3) AS b, quantile_cont(score, 0.7) AS c, quantile_cont(score, 0.9) AS e FROM sr),
 g AS (SELECT CASE WHEN score < a THEN 0 WHEN score < b THEN 1 WHEN score < c THEN 2 WHEN score < e THEN 3 ELSE 4 END AS bucket, count(*) AS n, avg(y) AS m FROM sr, q GROUP BY 1),
 h AS (SELECT *, lead(m) OVER (ORDER BY bucket) - m AS step FROM g)
 SELECT bucket, n, {rs('m', 5)} AS mean_realised, min(step) OVER () >= -1e-6 AS monotonic, ['strong_sell', 'sell', 'hold', 'buy', 'strong_buy'][bucket + 1] AS label FROM h""")
def threshold_calibration(spark, d):
    from tapegrain.session import materialize
    t = E.threshold_table(materialize(scored_forward(spark, d), "scores"), "score", "y")  # read twice
    return t.select("bucket", "n", rnd("mean_realised", 5).alias("mean_realised"), "monotonic", "label")


RECS = f"""rec AS (SELECT l_suppkey AS symbol, CASE l_linenumber % 3 WHEN 0 THEN 'momentum' WHEN 1 THEN 'value' ELSE 'catalyst' END AS strategy, CAST(o_orderdate AS DATE) AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
 n1 AS (SELECT symbol, session, close, lead(session, 5) OVER ({WS}) AS s5, lead(close, 5) OVER ({WS}) AS c5, lead(session, 20) OVER ({WS}) AS s20, lead(close, 20) OVER ({WS}) AS c20 FROM bars),
 ro AS (SELECT r.*, n.session AS es, n.close AS ec, s5, c5, s20, c20 FROM rec r ASOF JOIN n1 n ON r.symbol = n.symbol AND r.day <= n.session),
 ru AS (SELECT strategy, day, 5 AS horizon, es, ec, s5 AS xs, c5 AS xc FROM ro UNION ALL SELECT strategy, day, 20, es, ec, s20, c20 FROM ro),
 rv AS (SELECT strategy, day, horizon, xc / ec - 1 AS ret, (xc / ec - 1) - (m2.close / m1.close - 1) AS excess FROM ru JOIN mkt m1 ON m1.session = es JOIN mkt m2 ON m2.session = xs WHERE xc IS NOT NULL)"""


def records(spark, d):
    """Surfaced names per strategy and day with their outcome after 5 and 20 bars."""
    from tapegrain.operators.events import outcomes_at
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    o = B.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    m = F.col("l_linenumber") % 3
    rec = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("symbol"), F.when(m == 0, "momentum").when(m == 1, "value").otherwise("catalyst").alias("strategy"),
                                                            F.to_date("o_orderdate").alias("day")).distinct()
    return outcomes_at(rec, B.daily_bars(spark, d), B.market_bars(spark, d), "day", (5, 20))


@query("agg35_track_record", f"""WITH {B.BARS}, {B.MARKET}, {RECS} SELECT strategy, horizon, count(*) AS n, {rs('avg(ret)', 6)} AS mean_ret, {rs('avg(CAST(ret > 0 AS DOUBLE))', 6)} AS win_rate, {rs('avg(excess)', 6)} AS mean_excess,
 count(DISTINCT yearweek(day)) AS weeks, {rs('greatest(0.5, least(1.3, 1 + 0.08 * (count(DISTINCT yearweek(day)) / (count(DISTINCT yearweek(day)) + 12.0)) * avg(excess) * 100))', 6)} AS multiplier FROM rv GROUP BY 1, 2""")
def track_record(spark, d):
    r = records(spark, d)
    wk = F.extract(F.lit("YEAROFWEEK"), "day") * 100 + F.weekofyear("day")
    g = r.groupBy("strategy", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
                                             F.avg("excess").alias("mean_excess"), F.countDistinct(wk).alias("weeks"))
    return g.select("strategy", "horizon", "n", "weeks", *[rnd(x, 6).alias(x) for x in ("mean_ret", "win_rate", "mean_excess")],
                    rnd(E.learned_multiplier(100 * F.col("mean_excess"), F.col("weeks")), 6).alias("multiplier"))


@query("agg38_probabilistic_scores", f"""WITH {B.BARS}, {FC}, e AS (SELECT horizon, ln(realised / last_price) AS y, ln(p10 / last_price) AS q10, ln(p50 / last_price) AS q50, ln(p90 / last_price) AS q90,
  round(1 / (1 + exp(-ln(p50 / last_price) * 5)), 6) AS p_up FROM rz), l AS (SELECT horizon, avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))) + avg(greatest(0.5 * (y - q50), -0.5 * (y - q50))) + avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))) AS lq,
  avg(greatest(0.1 * (y + 1), -0.9 * (y + 1))) + avg(abs(y)) * 0.5 + avg(greatest(0.9 * (y - 1), -0.1 * (y - 1))) AS lb, avg(CAST(y BETWEEN q10 AND q90 AS DOUBLE)) AS cov, count(*) AS n,
  avg(power(p_up - CAST(y > 0 AS INT), 2)) AS bq, avg(power(0.5 - CAST(y > 0 AS INT), 2)) AS bb, avg(abs(y - q50)) AS mae FROM e GROUP BY 1)
 SELECT CAST(horizon AS INTEGER) AS horizon, n, {rs('1 - lq / lb', 5)} AS pinball_skill, {rs('cov', 6)} AS coverage, {rs('1 - bq / bb', 5)} AS brier_skill, {rs('mae', 5)} AS mae FROM l""")
def probabilistic_scores(spark, d):
    f = forecasts(spark, d)
    lg = lambda x: F.log(F.col(x) / F.col("last_price"))
    e = f.select("horizon", lg("realised").alias("y"), lg("p10").alias("q10"), lg("p50").alias("q50"), lg("p90").alias("q90"), F.lit(-1.0).alias("b10"), F.lit(0.0).alias("b50"), F.lit(1.0).alias("b90"),
                 F.round(1 / (1 + F.exp(-lg("p50") * 5)), 6).alias("p_up"), F.lit(0.5).alias("b_up"))
    s = E.probabilistic_scores(e, ["horizon"])
    return s.select("horizon", "n", rnd("pinball_skill", 5).alias("pinball_skill"), rnd("coverage", 6).alias("coverage"), rnd("brier_skill", 5).alias("brier_skill"), rnd("mae", 5).alias("mae"))


@query("seq14_rank_portfolio", f"""WITH {COMP}, cal2 AS (SELECT session, row_number() OVER (ORDER BY session) AS rn FROM (SELECT DISTINCT session FROM sc WHERE score IS NOT NULL)),
 fw AS (SELECT symbol, session, round(score, 9) AS score, ln(lead(open, 22) OVER ({WS}) / lead(open) OVER ({WS})) AS y FROM sc), a AS (SELECT f.* FROM fw f JOIN cal2 USING (session) WHERE (rn - 1) % 21 = 0 AND score IS NOT NULL AND y IS NOT NULL),
 k AS (SELECT *, count(*) OVER (PARTITION BY session) AS m, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY session ORDER BY score, symbol DESC) AS lo FROM a),
 n AS (SELECT *, greatest(CASE WHEN m >= 25 THEN 5 ELSE 1 END, CAST(floor(m * 0.1 + 1e-9) AS BIGINT)) AS nl FROM k WHERE m >= 10)
 SELECT {ds()} AS session, {rs('ln(avg(exp(y)) FILTER (hi <= nl))', 6)} AS long_ret, {rs('ln(avg(exp(y)) FILTER (lo <= nl))', 6)} AS short_ret, {rs('ln(avg(exp(y)))', 6)} AS equal_weight, any_value(nl) AS n_long, count(*) AS names FROM n GROUP BY 1""")
def rank_portfolio(spark, d):
    p = X.rank_portfolio(composite_panel(spark, d), hold=21, min_names=10)
    return p.select(day().alias("session"), rnd("long_gross", 6).alias("long_ret"), rnd("short_gross", 6).alias("short_ret"), rnd("equal_weight", 6).alias("equal_weight"), "n_long", "names")


@query("agg39_portfolio_summary")
def portfolio_summary(spark, d):
    """Growth, Sharpe, drawdown, excess and rank-correlation statistics of the rank portfolio, net of costs."""
    p = X.rank_portfolio(composite_panel(spark, d), hold=21, min_names=10)
    s = X.summarize_portfolio(p, hold=21)
    return s.select("n_rebalances", *[rnd(x, 5).alias(x) for x in ("cagr", "sharpe", "max_drawdown", "excess_per_year", "excess_t", "ic_mean", "ic_t", "avg_turnover")])


@query("seq17_contribution_growth", f"""WITH {B.BARS}, {B.SECTORS}, {B.SECTOR_BARS}, b AS (SELECT sector, session, close, row_number() OVER (PARTITION BY sector, date_trunc('month', session) ORDER BY session) AS rn FROM sector_bars),
 s AS (SELECT *, CASE WHEN rn = 1 THEN 100.0 / close ELSE 0 END AS sh FROM b), o AS (SELECT *, sum(sh) OVER (PARTITION BY sector ORDER BY session ROWS UNBOUNDED PRECEDING) AS own FROM s),
 g AS (SELECT session, sum(own * close) AS value, sum((own - sh) * close) AS pre, sum(sh * close) AS inn FROM o GROUP BY 1),
 h AS (SELECT *, coalesce(ln(pre / nullif(lag(value) OVER (ORDER BY session), 0)), 0) AS lg FROM g WHERE true)
 SELECT {ds()} AS session, {rs('value', 2)} AS value, {rs('sum(inn) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING)', 2)} AS invested FROM h""")
def contribution_growth(spark, d):
    p = B.sector_bars(spark, d).withColumnRenamed("sector", "symbol")
    w = p.select("symbol").distinct().withColumn("weight", F.lit(0.2))
    g = P.contribution_growth(p, w, 500.0)
    return g.select(day().alias("session"), rnd("value", 2).alias("value"), rnd("invested", 2).alias("invested"))


ALLOC = f"""al AS (SELECT c_custkey AS portfolio, c_mktsegment AS seg, c_acctbal AS cash FROM customer), mv AS (SELECT o_custkey AS portfolio, o_orderpriority AS sleeve, sum(o_totalprice) AS market_value FROM orders GROUP BY 1, 2),
 sl AS (SELECT portfolio, sleeve, market_value, 0.2::DOUBLE AS weight FROM mv)"""


@query("seq20_rebalance_plan", f"""WITH {ALLOC}, t AS (SELECT portfolio, sum(market_value) AS tot FROM sl GROUP BY 1), j AS (SELECT sl.portfolio, sleeve, greatest(cash, 0) AS cash, greatest(0, weight * (tot + greatest(cash, 0)) - market_value) AS gap FROM sl JOIN t USING (portfolio) JOIN al USING (portfolio)),
 g AS (SELECT *, sum(gap) OVER (PARTITION BY portfolio) AS gaps FROM j) SELECT portfolio, sleeve, {rs('CASE WHEN gaps > 0 THEN least(cash * gap / gaps, gap) ELSE 0 END', 2)} AS buy FROM g""")
def rebalance_plan(spark, d):
    sl = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("portfolio"), F.col("o_orderpriority").alias("sleeve")).agg(F.sum("o_totalprice").alias("market_value")).withColumn("weight", F.lit(0.2))
    cash = B.table(spark, d, "customer").select(F.col("c_custkey").alias("portfolio"), F.greatest("c_acctbal", F.lit(0.0)).alias("cash"))
    return P.rebalance_plan(sl, cash).select("portfolio", "sleeve", rnd("buy", 2).alias("buy"))


@query("seq19_order_plan", f"""WITH t AS (SELECT l_suppkey AS portfolio, l_returnflag AS symbol, CASE l_returnflag WHEN 'A' THEN 0.5::DOUBLE WHEN 'N' THEN 0.5::DOUBLE ELSE 0 END AS weight, sum(l_extendedprice) AS mv FROM lineitem GROUP BY 1, 2, 3),
 v AS (SELECT portfolio, sum(mv) AS value FROM t GROUP BY 1), j AS (SELECT t.*, value, weight * value AS tg, weight * value - mv AS gap FROM t JOIN v USING (portfolio)),
 w AS (SELECT *, CASE WHEN tg <= 0 AND mv > 0 THEN 'exit' WHEN mv <= 0 AND tg > 0 THEN 'new' WHEN gap < -0.25 * tg THEN 'trim' WHEN gap > 0.25 * tg THEN 'top_up' END AS reason FROM j),
 f AS (SELECT *, sum(greatest(gap, 0)) OVER (PARTITION BY portfolio) AS buys, sum(greatest(-gap, 0)) OVER (PARTITION BY portfolio) AS sells FROM w WHERE reason IS NOT NULL AND abs(gap) >= 100)
 SELECT portfolio, symbol, reason, {rs('CASE WHEN gap > 0 THEN gap * CASE WHEN buys > 0 THEN least(1, (1000 + sells) / buys) ELSE 1 END ELSE gap END', 2)} AS amount FROM f""")
def order_plan(spark, d):
    p = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("portfolio"), F.col("l_returnflag").alias("symbol")).agg(F.sum("l_extendedprice").alias("market_value"))
    t = p.select("portfolio", "symbol", F.when(F.col("symbol").isin("A", "N"), 0.5).otherwise(0.0).alias("weight"))
    v = p.groupBy("portfolio").agg(F.sum("market_value").alias("value")).withColumn("cash", F.lit(1000.0))
    return P.plan_orders(t, p, v).select("portfolio", "symbol", "reason", rnd("amount", 2).alias("amount"))


@query("sta13_internal_rate")
def internal_rate(spark, d):
    """Monthly buys of each customer and the value at the end; a bisection, checked in the tests."""
    o = B.table(spark, d, "orders")
    m = o.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg((-F.sum("o_totalprice")).alias("f"))
    g = m.groupBy("o_custkey").agg(F.sort_array(F.array_agg(F.struct("m", "f"))).alias("a"), F.sum("f").alias("s"))  # at most one row a month
    g = g.withColumn("flows", F.concat(F.transform("a", lambda z: z["f"]), F.array(F.col("s") * -1.08)))
    return g.select(F.col("o_custkey").alias("portfolio"), rnd(P.internal_rate(F.col("flows")), 5).alias("rate"))


@query("agg44_book_risk", f"""WITH RECURSIVE {B.BARS}, {B.SECTORS}, nat AS (SELECT s_suppkey AS symbol, s_nationkey AS book FROM supplier),
 mo AS (SELECT symbol, date_trunc('month', session)::DATE AS session, arg_max(close, session) AS close FROM bars GROUP BY 1, 2),
 rt AS (SELECT * FROM (SELECT symbol, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS ret FROM mo) WHERE ret IS NOT NULL),
 mk AS (SELECT session, avg(ret) AS m FROM rt GROUP BY 1),
 bt AS (SELECT symbol, covar_samp(ret, m) / nullif(var_samp(m), 0) AS beta FROM rt JOIN mk USING (session) GROUP BY 1),
 l14 AS (SELECT symbol, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 st AS (SELECT symbol, 2 * avg(high - low) / max(close) FILTER (rn = 1) AS stop_pct FROM l14 WHERE rn <= 14 AND n > 30 GROUP BY 1),
 hold AS (SELECT book, symbol, sum(volume) * arg_max(close, session) AS mv FROM bars JOIN nat USING (symbol) GROUP BY 1, 2),
 h AS (SELECT hold.*, mv / sum(mv) OVER (PARTITION BY book) AS w, sector, beta, least(stop_pct, 0.5) AS stop FROM hold LEFT JOIN sectors USING (symbol) LEFT JOIN bt USING (symbol) LEFT JOIN st USING (symbol)),
 hr AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY w DESC, symbol) AS r, row_number() OVER (PARTITION BY book ORDER BY symbol) AS place FROM h),
 cm AS (SELECT book, rt.session FROM nat JOIN rt USING (symbol) GROUP BY book, rt.session HAVING count(*) = (SELECT count(DISTINCT n2.symbol) FROM nat n2 JOIN rt r2 ON r2.symbol = n2.symbol WHERE n2.book = nat.book)),
 ok AS (SELECT book FROM cm GROUP BY 1 HAVING count(*) > 30),
 rr AS (SELECT cm.book, symbol, cm.session, ret FROM cm JOIN ok USING (book) JOIN nat USING (book) JOIN rt USING (symbol, session)),
 lk AS (SELECT a.book, a.symbol AS x, b.symbol AS y FROM rr a JOIN rr b ON a.book = b.book AND a.session = b.session AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING abs(corr(a.ret, b.ret)) >= 0.2),
 go AS (SELECT book, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS lead FROM (SELECT DISTINCT book FROM hr) UNION ALL SELECT go.book, hr.place,
  CASE WHEN EXISTS (SELECT 1 FROM lk WHERE lk.book = go.book AND lk.y = hr.symbol AND list_contains(go.lead, lk.x)) THEN go.lead ELSE list_append(go.lead, hr.symbol) END FROM go JOIN hr ON hr.book = go.book AND hr.place = go.place + 1),
 ld AS (SELECT book, unnest(lead) AS x FROM (SELECT book, arg_max(lead, place) AS lead FROM go GROUP BY 1)),
 cl AS (SELECT book, count(*) AS led, count(DISTINCT x) AS n_clusters FROM ld JOIN lk USING (book, x) GROUP BY 1),
 sc AS (SELECT book, arg_min(sector, (-sw, sector)) AS top_sector, max(sw) AS top_sector_weight FROM (SELECT book, sector, sum(w) AS sw FROM h WHERE sector IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 sm AS (SELECT book, count(*) AS n, sum(mv) AS mv, max(symbol) FILTER (r = 1) AS largest, max(w) AS lw, sum(w) FILTER (r <= 3) AS t3, sum(w * beta) / nullif(sum(w) FILTER (beta IS NOT NULL), 0) AS beta, sum(w * stop) * 100 AS risk FROM hr GROUP BY 1),
 z AS (SELECT sm.*, top_sector, top_sector_weight, coalesce(led, 0) AS led, coalesce(n_clusters, 0) AS n_clusters FROM sm LEFT JOIN sc USING (book) LEFT JOIN cl USING (book))
 SELECT book, n AS n_holdings, greatest(1, n - led) AS n_effective_bets, {rs('mv', 1)} AS market_value, largest, {rs('lw', 6)} AS largest_weight, {rs('t3', 6)} AS top3_weight, top_sector, {rs('top_sector_weight', 6)} AS top_sector_weight, {rs('beta', 6)} AS beta, {rs('risk')} AS at_risk_pct, n_clusters,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN lw > 0.35 THEN 'critical:concentration' WHEN lw > 0.2 THEN 'warning:concentration' END, CASE WHEN t3 > 0.6 AND n > 3 THEN 'warning:top3' END, CASE WHEN top_sector_weight > 0.5 THEN 'warning:sector' END,
  CASE WHEN beta > 1.5 THEN 'warning:beta' END, CASE WHEN risk > 12 THEN 'warning:stop_risk' END, CASE WHEN n_clusters > 0 THEN 'warning:correlation' END], lambda s: s IS NOT NULL), ','), ''), 'info:ok') AS warnings FROM z""")
def book_risk(spark, d):
    """Books by nation that hold their suppliers; clusters of monthly returns inside each book."""
    from pyspark.sql import Window
    from tapegrain.session import materialize
    bars = materialize(B.daily_bars(spark, d).select("symbol", "session", "high", "low", "close", "volume"), "bars")
    books = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("book"))
    monthly = bars.groupBy("symbol", F.date_trunc("month", "session").cast("date").alias("m")).agg(F.max_by("close", "session").alias("close")).withColumnRenamed("m", "session")
    ret = F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("session")) - 1
    returns = materialize(monthly.select("symbol", "session", ret.alias("ret")).where("ret is not null"), "returns")
    market = returns.groupBy("session").agg(F.avg("ret").alias("m"))  # a row a month
    beta = returns.join(market, "session").groupBy("symbol").agg((F.covar_samp("ret", "m") / F.nullif(F.var_samp("m"), F.lit(0.0))).alias("beta"))
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    stop = bars.select("symbol", "high", "low", "close", rn.alias("rn"), F.count("*").over(Window.partitionBy("symbol")).alias("n")).where("rn <= 14 and n > 30").groupBy("symbol").agg(
        (2 * F.avg(F.col("high") - F.col("low")) / F.max(F.when(F.col("rn") == 1, F.col("close")))).alias("stop_pct"))
    facts = B.sectors(spark, d).select("symbol", "sector").join(beta, "symbol", "left").join(stop, "symbol", "left")
    held = bars.join(books, "symbol").groupBy("book", "symbol").agg((F.sum("volume") * F.max_by("close", "session")).alias("market_value"))
    placed = held.select("book", "symbol", F.col("symbol").alias("place"))
    r = P.risk_review(held, facts, P.clusters(placed, returns, 0.2))
    return r.select("book", "n_holdings", "n_effective_bets", rnd("market_value", 1).alias("market_value"), "largest", *[rnd(x, 6).alias(x) for x in ("largest_weight", "top3_weight", "top_sector_weight", "beta")], "top_sector",
                    rnd("at_risk_pct").alias("at_risk_pct"), "n_clusters", "warnings")
