"""Point-in-time joins, corporate actions and universes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.operators import corporate as C
from tapegrain.operators import evaluation as E
from tapegrain.operators import joins as J
from tapegrain.operators.kernels import asof_join, by_time, so_far
from tapegrain.plans.catalog import day, ds, query, rnd, rs
from tapegrain.plans.regimes import MEMBERS, members
from tapegrain.plans.windows import WS, full_sql
from tapegrain.session import fresh_path, materialize
from tapegrain.sources import readers as SR


@query("jon01_asof_filings", f"""WITH {B.BARS}, {B.FUNDAMENTALS} SELECT b.symbol, {ds()} AS session, {ds('f.period_end')} AS period_end, {rs('coalesce(f.revenue, 0)', 2)} AS revenue
 FROM bars b ASOF LEFT JOIN fun f ON b.symbol = f.symbol AND b.session >= f.available_at""")
def asof_filings(spark, d):
    f = B.fundamentals(spark, d)
    # two quarters may become known on one day: the later period counts
    f = f.groupBy("symbol", "available_at").agg(F.max_by(F.struct("period_end", "revenue"), "period_end").alias("z")).select("symbol", "available_at", "z.*")
    j = asof_join(B.daily_bars(spark, d).select("symbol", "session"), f, "symbol", "session", "available_at", {"period_end": "period_end", "revenue": "revenue"})
    return j.select("symbol", day().alias("session"), day("period_end").alias("period_end"), rnd(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue"))


@query("jon02_macro_align", f"""WITH {B.BARS}, {B.SECTORS}, {B.SECTOR_BARS}, m AS (SELECT sector, session, close, close / lag(close, 5) OVER w - 1 AS chg5,
  CASE WHEN count(close) OVER z = 60 THEN (close - avg(close) OVER z) / nullif(stddev_samp(close) OVER z, 0) END AS z60 FROM sector_bars
  WINDOW w AS (PARTITION BY sector ORDER BY session), z AS (PARTITION BY sector ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 b AS (SELECT symbol, sector, session FROM bars JOIN sectors USING (symbol))
 SELECT b.symbol, {ds('b.session')} AS session, {rs('coalesce(m.close, 0)')} AS level, {rs('coalesce(chg5, 0)', 6)} AS chg5, {rs('coalesce(z60, 0)', 6)} AS z60
 FROM b ASOF LEFT JOIN m ON b.sector = m.sector AND b.session >= m.session""")
def macro_align(spark, d):
    w = by_time("sector", "session")
    z = w.rowsBetween(-59, 0)
    m = B.sector_bars(spark, d)
    m = m.withColumns({"chg5": F.col("close") / F.lag("close", 5).over(w) - 1,
                       "z60": F.when(F.count("close").over(z) == 60, (F.col("close") - F.avg("close").over(z)) / F.nullif(F.stddev_samp("close").over(z), F.lit(0.0)))})
    # the series ends before the bars do on some sessions, so it is aligned on the calendar per sector first
    cal = B.calendar(spark, d).select("session").join(F.broadcast(m.select("sector").distinct()))
    a = asof_join(cal, m, "sector", "session", "session", {"close": "level", "chg5": "chg5", "z60": "z60"})
    b = B.daily_bars(spark, d).select("symbol", "session").join(B.sectors(spark, d).select("symbol", "sector"), "symbol")
    j = b.join(F.broadcast(a), ["sector", "session"], "left")  # five series over the calendar
    return j.select("symbol", day().alias("session"), rnd(F.coalesce("level", F.lit(0.0))).alias("level"),
                    rnd(F.coalesce("chg5", F.lit(0.0)), 6).alias("chg5"), rnd(F.coalesce("z60", F.lit(0.0)), 6).alias("z60"))


@query("jon04_point_lookups", f"""WITH {B.BARS}, {B.REPORTS}, p AS (SELECT r.*, b.close AS close_before FROM rep r ASOF LEFT JOIN bars b ON r.symbol = b.symbol AND r.date >= b.session)
 SELECT p.symbol, {ds('p.date')} AS date, {rs('p.close_before')} AS close_before, {rs('b.close')} AS close_after
 FROM p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.date <= b.session""")
def point_lookups(spark, d):
    b = B.daily_bars(spark, d).select("symbol", "session", "close")
    r = asof_join(B.reports(spark, d), b, "symbol", "date", "session", {"close": "close_before"})
    r = asof_join(r, b, "symbol", "date", "session", {"close": "close_after"}, direction="forward")
    return r.select("symbol", day("date").alias("date"), rnd("close_before").alias("close_before"), rnd("close_after").alias("close_after"))


ANCHORS = f"""{B.CALENDAR}, anchors AS (SELECT min(session) AS anchor FROM cal GROUP BY date_trunc('month', session))"""


@query("jon05_anchor_prices", f"""WITH {B.BARS}, {ANCHORS}, e AS (SELECT symbol, max(session) AS fin FROM bars GROUP BY 1),
 g AS (SELECT symbol, anchor, fin FROM e CROSS JOIN anchors) SELECT g.symbol, {ds('g.anchor')} AS anchor,
 {rs('CASE WHEN g.anchor > g.fin AND g.symbol % 2 = 0 THEN 0 ELSE b.close END')} AS price FROM g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.anchor >= b.session""")
def anchor_prices(spark, d):
    a = C.month_starts(B.calendar(spark, d)).select(F.col("session").alias("anchor"))
    p = J.anchor_prices(B.daily_bars(spark, d), a, F.col("symbol") % 2 == 0)
    return p.select("symbol", day("anchor").alias("anchor"), rnd("price").alias("price"))


@query("jon06_members_on_date", f"""WITH {B.BARS}, {MEMBERS} SELECT b.symbol, {ds()} AS session, {ds('m.start')} AS start FROM bars b JOIN members m
 ON b.symbol = m.symbol AND b.session >= m.start AND b.session <= m."end" """)
def members_on(spark, d):
    m = members(spark, d).withColumn("since", F.col("start"))
    j = J.members_between(B.daily_bars(spark, d).select("symbol", "session"), m, "symbol", "session", ["since"])
    return j.select("symbol", day().alias("session"), day("since").alias("start"))


REACT = f"""{B.CALENDAR}, {B.REPORTS}, r1 AS (SELECT r.*, c.session AS same FROM rep r ASOF LEFT JOIN cal c ON r.date <= c.session),
 r2 AS (SELECT r1.*, c.session AS nxt FROM r1 ASOF LEFT JOIN cal c ON r1.date < c.session),
 react AS (SELECT DISTINCT symbol, date, timing, surprise, unnest(CASE WHEN timing = 'bmo' THEN [same] WHEN timing = 'amc' THEN [nxt] ELSE [same, nxt] END) AS reaction FROM r2)"""


@query("jon08_reaction_sessions", f"WITH {REACT} SELECT symbol, {ds('date')} AS date, timing, {ds('reaction')} AS reaction FROM react WHERE reaction IS NOT NULL")
def reaction_sessions(spark, d):
    r = J.reaction_sessions(B.reports(spark, d), B.calendar(spark, d), "date", "timing")
    return r.select("symbol", day("date").alias("date"), "timing", day("reaction").alias("reaction"))


@query("win29_earnings_factors", f"""WITH {B.BARS}, {REACT}, mk AS (SELECT symbol, reaction AS session, arg_max(greatest(-100, least(100, surprise)), date) AS sp FROM react WHERE reaction IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT b.symbol, b.session, ln(b.close / lag(b.close) OVER ({WS})) AS ear, sp FROM bars b LEFT JOIN mk USING (symbol, session))
 SELECT symbol, {ds()} AS session, {rs(f"last_value(CASE WHEN sp IS NOT NULL AND ear IS NOT NULL THEN sp END IGNORE NULLS) OVER ({WS} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)", 6)} AS earn_surprise,
 {rs(f"last_value(CASE WHEN sp IS NOT NULL AND ear IS NOT NULL THEN ear END IGNORE NULLS) OVER ({WS} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)", 6)} AS earn_ear FROM j""")
def earnings_factors(spark, d):
    from tapegrain.operators.events import earnings_factors as ef
    r = J.reaction_sessions(B.reports(spark, d), B.calendar(spark, d), "date", "timing")
    f = ef(B.daily_bars(spark, d), r)
    return f.select("symbol", day().alias("session"), rnd("earn_surprise", 6).alias("earn_surprise"), rnd("earn_ear", 6).alias("earn_ear"))


@query("jon10_trailing_density", f"""WITH {B.BARS}, {B.FILINGS}, f AS (SELECT issuer AS symbol, filed, sum(CASE WHEN code = 'P' THEN 1 ELSE -1 END) AS c,
  sum(CASE WHEN code = 'P' THEN value ELSE -value END) AS v FROM fil GROUP BY 1, 2),
 u AS (SELECT symbol, session AS dd, true AS bar, NULL AS c, NULL AS v FROM bars UNION ALL SELECT symbol, filed, false, c, v FROM f),
 q AS (SELECT *, coalesce(sum(c) OVER w, 0) AS net, coalesce(sum(v) OVER w, 0) AS netv FROM u WINDOW w AS (PARTITION BY symbol ORDER BY dd RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW))
 SELECT symbol, {ds('dd')} AS session, CAST(net AS BIGINT) AS net_count, {rs('tanh(netv / 1000000.0)', 6)} AS net_value FROM q WHERE bar""")
def trailing_density(spark, d):
    s = F.when(F.col("code") == "P", 1).otherwise(-1)
    f = B.filings(spark, d).withColumnRenamed("issuer", "symbol")
    j = J.trailing_density(B.daily_bars(spark, d).select("symbol", "session"), f, "symbol", "session", "filed", 90,
                           {"net_count": s, "net_value": s * F.col("value")})
    return j.select("symbol", day().alias("session"), "net_count", rnd(F.tanh(F.col("net_value") / 1e6), 6).alias("net_value"))


@query("jon11_report_coverage", f"""WITH {B.BARS}, {B.REPORTS}, m AS (SELECT symbol, min(session) AS session FROM bars GROUP BY symbol, date_trunc('month', session))
 SELECT symbol, {ds()} AS session FROM m WHERE EXISTS (SELECT 1 FROM rep r WHERE r.symbol = m.symbol AND r.date BETWEEN m.session - 20 AND m.session + 20)""")
def report_coverage(spark, d):
    m = B.daily_bars(spark, d).groupBy("symbol", F.date_trunc("month", "session").alias("_m")).agg(F.min("session").alias("session")).drop("_m")
    x = J.distance_to_events(m, B.reports(spark, d), "symbol", "session", "date")
    return x.where((F.col("days_since") <= 20) | (F.col("days_until") <= 20)).select("symbol", day().alias("session"))


@query("jon13_metric_merge", f"""WITH {B.FUNDAMENTALS}, l AS (SELECT symbol, period_end, available_at, 'revenue' AS metric, revenue AS value FROM fun
  UNION ALL SELECT symbol, period_end, available_at + 5, 'units', units FROM fun UNION ALL SELECT symbol, period_end, available_at + 2, 'income', income FROM fun WHERE income > 100000)
 SELECT symbol, {ds('period_end')} AS period_end, {rs("max(value) FILTER (metric = 'revenue')", 2)} AS revenue, {rs("max(value) FILTER (metric = 'income')", 2)} AS income,
 {rs("max(value) FILTER (metric = 'units')", 2)} AS units, {ds('max(available_at)')} AS available_at FROM l GROUP BY symbol, period_end""")
def metric_merge(spark, d):
    f = B.fundamentals(spark, d)
    row = lambda m, lag, cond: F.when(cond, F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.date_add("available_at", lag).alias("filed")))
    long = f.select("symbol", "period_end", F.explode(F.array_compact(F.array(
        row("revenue", 0, F.lit(True)), row("units", 5, F.lit(True)), row("income", 2, F.col("income") > 100000)))).alias("z")).select("symbol", "period_end", "z.*")
    g = long.groupBy("symbol", "period_end").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("revenue", "income", "units")],
                                                 F.max("filed").alias("available_at"))
    return g.select("symbol", day("period_end").alias("period_end"), *[rnd(m, 2).alias(m) for m in ("revenue", "income", "units")], day("available_at").alias("available_at"))


@query("jon16_reconciliation", f"""WITH {B.BARS}, x AS (SELECT event_type, CAST(ts AS DATE) AS session, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2),
 t AS (SELECT CAST(ts AS DATE) AS session, sum(value) AS total FROM events GROUP BY 1)
 SELECT event_type, {ds('x.session')} AS session, n, {rs('v', 2)} AS value_sum, {rs('v / total', 6)} AS share FROM x JOIN t USING (session)""")
def reconciliation(spark, d):
    e = B.table(spark, d, "events").withColumn("session", F.to_date("ts"))
    x = e.groupBy("event_type", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    t = x.groupBy("session").agg(F.sum("v").alias("total"))
    return x.join(t, "session").select("event_type", day().alias("session"), "n", rnd("v", 2).alias("value_sum"), rnd(F.col("v") / F.col("total"), 6).alias("share"))


@query("jon18_sector_relative", f"""WITH {B.BARS}, {B.SECTORS}, {B.SECTOR_BARS}, s AS (SELECT symbol, sector, session, close / lag(close, 21) OVER w - 1 AS r21, close / lag(close, 63) OVER w - 1 AS r63
  FROM bars JOIN sectors USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY session)),
 p AS (SELECT sector, session, close / lag(close, 21) OVER w - 1 AS p21, close / lag(close, 63) OVER w - 1 AS p63 FROM sector_bars WINDOW w AS (PARTITION BY sector ORDER BY session)),
 j AS (SELECT symbol, session, r21 - p21 AS a, r63 - p63 AS b FROM s JOIN p USING (sector, session))
 SELECT symbol, {ds()} AS session, {rs('a', 6)} AS rel_21, {rs('b', 6)} AS rel_63,
 {rs('''tanh(6.7::DOUBLE * (coalesce(0.4::DOUBLE * a, 0) + coalesce(0.6::DOUBLE * b, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 0.4::DOUBLE END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.6::DOUBLE END), 0))''', 6)} AS score FROM j""")
def sector_relative(spark, d):
    from tapegrain.operators.signals import sector_relative as sr
    j = sr(B.daily_bars(spark, d), B.sectors(spark, d), B.sector_bars(spark, d))
    return j.select("symbol", day().alias("session"), rnd("rel_21", 6).alias("rel_21"), rnd("rel_63", 6).alias("rel_63"), rnd("score", 6).alias("score"))


@query("jon19_pair_correlation", f"""WITH {B.BARS},
 r AS (SELECT symbol, session, close / lag(close) OVER ({WS}) - 1 AS ret FROM bars), q AS (SELECT * FROM r WHERE ret IS NOT NULL)
 SELECT a.symbol AS a, b.symbol AS b, {rs('corr(a.ret, b.ret)', 6)} AS corr, count(*) AS n FROM q a JOIN q b ON a.session = b.session AND a.symbol < b.symbol
 GROUP BY 1, 2 HAVING count(*) >= 20""")
def pair_correlation(spark, d):
    b = B.symbol_bars(spark, d, 6 * B.TASK_LINES)  # one window, and tasks that fill a tile of series
    r = b.select("symbol", "session", (F.col("close") / F.lag("close").over(by_time("symbol", "session")) - 1).alias("ret")).where(F.col("ret").isNotNull())
    c = J.pairwise_corr(r)
    return c.select("a", "b", rnd("corr", 6).alias("corr"), "n")


def industry_returns(spark, d):
    """Daily returns of the 25 industry series: a fixed small set of series for pair work."""
    b = B.daily_bars(spark, d).join(B.sectors(spark, d).select("symbol", "industry"), "symbol")
    s = b.groupBy(F.col("industry").alias("symbol"), "session").agg((F.sum(F.col("vwap") * F.col("volume")) / F.sum("volume")).alias("close"))
    r = s.withColumn("ret", F.col("close") / F.lag("close").over(by_time("symbol", "session")) - 1)
    return r.where(F.col("ret").isNotNull())


@query("jon23_quiet_sessions", f"""WITH {B.BARS}, {B.REPORTS} SELECT symbol, {ds()} AS session FROM bars b
 WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.symbol = b.symbol AND abs(r.date - b.session) <= 15)""")
def quiet_sessions(spark, d):
    x = J.distance_to_events(B.daily_bars(spark, d).select("symbol", "session"), B.reports(spark, d), "symbol", "session", "date")
    far = (F.coalesce("days_since", F.lit(9999)) > 15) & (F.coalesce("days_until", F.lit(9999)) > 15)
    return x.where(far).select("symbol", day().alias("session"))


@query("jon26_dividends_received", f"""WITH {B.TRANSACTIONS}, {B.DIVIDENDS}, t AS (SELECT portfolio, symbol, session, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS q FROM tx GROUP BY 1, 2, 3),
 h AS (SELECT p.portfolio, v.symbol, v.ex_date, v.amount, (SELECT sum(q) FROM t WHERE t.portfolio = p.portfolio AND t.symbol = v.symbol AND t.session <= v.ex_date) AS shares
  FROM (SELECT DISTINCT portfolio, symbol FROM t) p JOIN dvd v ON p.symbol = v.symbol)
 SELECT portfolio, symbol, {rs('sum(amount * shares)')} AS received, count(*) AS payments FROM h WHERE shares > 0 GROUP BY 1, 2""")
def dividends_received(spark, d):
    from tapegrain.operators.portfolio import dividends_received as dr
    return dr(B.transactions(spark, d), B.dividends(spark, d)).select("portfolio", "symbol", rnd("received").alias("received"), "payments")


@query("jon30_window_excess", f"""WITH {B.BARS}, {B.MARKET}, {B.REPORTS}, n AS (SELECT symbol, session, close, lead(session, 10) OVER ({WS}) AS exit_s, lead(close, 10) OVER ({WS}) AS exit_c FROM bars),
 e AS (SELECT r.symbol, r.date, n.session AS es, n.close AS ec, exit_s, exit_c FROM rep r ASOF JOIN n ON r.symbol = n.symbol AND r.date <= n.session)
 SELECT e.symbol, {ds('e.date')} AS date, {rs('exit_c / ec - 1', 6)} AS ret, {rs('(exit_c / ec - 1) - (m2.close / m1.close - 1)', 6)} AS excess
 FROM e JOIN mkt m1 ON m1.session = es JOIN mkt m2 ON m2.session = exit_s WHERE exit_c IS NOT NULL""")
def window_excess(spark, d):
    from tapegrain.operators.events import excess_after
    x = excess_after(B.reports(spark, d), B.daily_bars(spark, d), B.market_bars(spark, d), "date", 10)
    return x.select("symbol", day("date").alias("date"), rnd("ret", 6).alias("ret"), rnd("excess", 6).alias("excess"))


@query("jon32_nearest_tolerance", f"""WITH {B.BARS}, {B.REPORTS}, b AS (SELECT symbol, session FROM bars),
 x AS (SELECT b.symbol, b.session, r.date AS bd, r.surprise AS bv FROM b ASOF LEFT JOIN rep r ON b.symbol = r.symbol AND b.session >= r.date),
 y AS (SELECT x.*, r.date AS fd, r.surprise AS fv FROM x ASOF LEFT JOIN rep r ON x.symbol = r.symbol AND x.session <= r.date)
 SELECT symbol, {ds()} AS session, {rs('''CASE WHEN bd IS NOT NULL AND (fd IS NULL OR session - bd <= fd - session) THEN CASE WHEN session - bd <= 1 THEN bv ELSE 0 END
  WHEN fd - session <= 1 THEN fv ELSE 0 END''', 6)} AS surprise FROM y""")
def nearest(spark, d):
    x = J.nearest(B.daily_bars(spark, d).select("symbol", "session"), B.reports(spark, d), "symbol", "session", "date", "surprise", 1, "near")
    return x.select("symbol", day().alias("session"), rnd("near", 6).alias("surprise"))


@query("stm04_quiet_feed_batch", f"""WITH {B.TICKS}, p AS (SELECT * FROM ticks WHERE symbol <> 'view'), v AS (SELECT * FROM ticks WHERE symbol = 'view'),
 j AS (SELECT v.account, v.event_id, v.ts, v.price, p.ts AS pts FROM v ASOF LEFT JOIN p ON v.account = p.account AND v.ts >= p.ts)
 SELECT account, event_id, {rs('price', 2)} AS price FROM j WHERE pts IS NULL OR epoch(ts) - epoch(pts) >= 86400""")
def quiet_feed_batch(spark, d):
    """As-of join of raw ticks, cut into day blocks so that one busy account spreads over many tasks."""
    t = B.ticks(spark, d)
    second, first = t.where(F.col("symbol") == "view"), t.where(F.col("symbol") != "view")
    j = asof_join(second, first.select("account", F.col("ts").alias("pts")), "account", "ts", "pts", {"pts": "pts"}, block="to_date(_t)")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("pts").cast("timestamp"))
    return j.where(F.col("pts").isNull() | (gap >= 86_400_000_000)).select("account", "event_id", rnd("price", 2).alias("price"))


# --- corporate actions --------------------------------------------------------------------------

RAW = f"""{B.SPLITS}, src AS (SELECT b.symbol, b.session, b.open, b.high, b.low, b.close, b.volume, coalesce((SELECT exp(sum(ln(ratio))) FROM splits s WHERE s.symbol = b.symbol AND s.ex_date > b.session), 1) AS f FROM bars b)"""


@query("win23_factor_after", f"WITH {B.BARS}, {RAW} SELECT symbol, {ds()} AS session, {rs('f', 2)} AS split_factor FROM src")
def factor_after(spark, d):
    f = C.factor_after(B.daily_bars(spark, d), B.splits(spark, d))
    return f.select("symbol", day().alias("session"), rnd("split_factor", 2).alias("split_factor"))


def raw_bars(spark, d):
    b = B.daily_bars(spark, d).select("symbol", "session", "open", "high", "low", "close", "volume")
    return C.factor_after(b, B.splits(spark, d), "f").withColumn("close_raw", F.col("close") * F.col("f")).drop("f")


STEPS = f"""fz AS (SELECT symbol, session, close, f, ln(close * f / close) AS lf FROM src), fy AS (SELECT *, abs(lf - lag(lf) OVER ({WS})) AS dd,
 quantile_cont(lf, 0.5) OVER ({WS} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS bf, quantile_cont(lf, 0.5) OVER ({WS} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS af FROM fz),
 fw AS (SELECT symbol, session AS ex_date, exp(bf - af) AS ratio FROM fy WHERE dd > 0.01 AND abs(bf - af) > 0.02),
 fv AS (SELECT *, CASE WHEN ex_date - lag(ex_date) OVER (PARTITION BY symbol ORDER BY ex_date) > 7 THEN 1 WHEN lag(ex_date) OVER (PARTITION BY symbol ORDER BY ex_date) IS NULL THEN 1 ELSE 0 END AS nw FROM fw),
 fu AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ex_date ROWS UNBOUNDED PRECEDING) AS c FROM fv),
 steps AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY symbol, c ORDER BY round(abs(ln(ratio)), 9) DESC, ex_date) = 1)"""


@query("win24_applied_splits", f"WITH {B.BARS}, {RAW}, {STEPS} SELECT symbol, {ds('ex_date')} AS ex_date, {rs('ratio', 3)} AS ratio FROM steps")
def applied_splits(spark, d):
    s = C.applied_splits(raw_bars(spark, d))
    return s.select("symbol", day("ex_date").alias("ex_date"), rnd("ratio", 3).alias("ratio"))


@query("win25_validate_splits", f"""WITH {B.BARS}, {RAW}, {STEPS}, ob AS (SELECT symbol, session, lag(close * f) OVER ({WS}) / (close * f) AS obs FROM src),
 v AS (SELECT s.symbol, s.ex_date, s.ratio, o.obs FROM steps s ASOF LEFT JOIN ob o ON s.symbol = o.symbol AND s.ex_date <= o.session)
 SELECT symbol, {ds('ex_date')} AS ex_date, {rs('obs')} AS observed_ratio, CASE WHEN obs IS NULL THEN 'unchecked' WHEN abs(ln(ratio)) >= 0.1 AND abs(ln(obs) - ln(ratio)) < abs(ln(obs)) THEN 'split' ELSE 'not_split' END AS state FROM v""")
def validate_splits(spark, d):
    raw = raw_bars(spark, d)
    s = C.validate_splits(C.applied_splits(raw), raw)
    return s.select("symbol", day("ex_date").alias("ex_date"), rnd("observed_ratio").alias("observed_ratio"), "state")


@query("win26_adjust_daily", f"""WITH {B.BARS}, {B.SPLITS}, {B.DIVIDENDS}, f1 AS (SELECT b.*, coalesce((SELECT exp(sum(ln(ratio))) FROM splits s WHERE s.symbol = b.symbol AND s.ex_date > b.session), 1) AS sf,
  row_number() OVER ({WS}) AS rn, lag(close) OVER ({WS}) AS prev FROM bars b),
 am AS (SELECT v.symbol, b.session, sum(v.amount) AS amt FROM dvd v ASOF JOIN bars b ON v.symbol = b.symbol AND v.ex_date <= b.session GROUP BY 1, 2),
 f2 AS (SELECT f1.*, CASE WHEN rn > 1 THEN coalesce(amt, 0) / sf ELSE 0 END AS adj FROM f1 LEFT JOIN am USING (symbol, session)),
 f3 AS (SELECT *, exp(sum(coalesce(ln((close + adj) / prev), 0)) OVER ({WS} ROWS UNBOUNDED PRECEDING)) * first_value(close) OVER ({WS}) AS tr FROM f2)
 SELECT symbol, {ds()} AS session, {rs('coalesce(adj / prev, 0)', 6)} AS div_ret, {rs('tr', 2)} AS tr_close, {rs('tr / close', 6)} AS tr_factor FROM f3""")
def adjust_daily(spark, d):
    a = C.adjust_daily(B.daily_bars(spark, d).select("symbol", "session", "open", "high", "low", "close", "volume"),
                       B.splits(spark, d).withColumn("state", F.lit("split")), B.dividends(spark, d))
    return a.select("symbol", day().alias("session"), rnd("div_ret", 6).alias("div_ret"), rnd("tr_close", 2).alias("tr_close"), rnd("tr_factor", 6).alias("tr_factor"))


# Every (supplier, ship date) is an action: its kind by the least line number, its name the supplier's on that day. A quarter of the
# suppliers was renamed from O.. to S.. in 1995; in 1997 another company took O.., whose actions some rows report.
RENAMED, REUSED, TODAY = "1995-06-01", "1997-01-01", "1998-08-01"
_NAMED = f"CASE WHEN k % 4 = 0 AND ex_date < DATE '{RENAMED}' THEN concat('O', k) WHEN k % 4 = 1 AND ex_date >= DATE '{REUSED}' AND m % 2 = 0 THEN concat('O', k - 1) ELSE concat('S', k) END"
_KIND = "CASE m WHEN 1 THEN 'cash_dividends' WHEN 2 THEN 'cash_dividends' WHEN 3 THEN 'spin_offs' WHEN 4 THEN 'cash_mergers' ELSE 'forward_splits' END"
ACTIONS = f"""act AS (SELECT *, {_KIND} AS kind, concat(k, ':', strftime(ex_date, '%Y-%m-%d')) AS id, {_NAMED} AS name, q / 100.0::DOUBLE AS ratio FROM
 (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS ex_date, min(l_linenumber) AS m, sum(l_extendedprice) * 0.0001::DOUBLE AS rate, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)),
 per AS (SELECT concat('S', s_suppkey) AS root, concat('S', s_suppkey) AS name, CASE WHEN s_suppkey % 4 = 0 THEN DATE '{RENAMED}' ELSE DATE '1900-01-01' END AS lo, DATE '9999-12-31' AS hi FROM supplier
  UNION ALL SELECT concat('S', s_suppkey), concat('O', s_suppkey), DATE '1900-01-01', DATE '{RENAMED}' - 1 FROM supplier WHERE s_suppkey % 4 = 0)"""


def landed_actions(spark, d):
    """The actions written in the vendor's layout, in two batches; the first has half the rate for some, which the second corrects."""
    g = (B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("ex_date"))
         .agg(F.min("l_linenumber").alias("m"), (F.sum("l_extendedprice") * 0.0001).alias("rate"), F.sum("l_quantity").alias("q")))
    g = g.withColumns({"kind": F.expr(_KIND), "name": F.expr(_NAMED), "id": F.concat_ws(":", "k", day("ex_date"))})
    of = {"cash_dividends": {"symbol": "name", "special": "m = 2"}, "spin_offs": {"source_symbol": "name", "new_symbol": "concat('S', k + 1)", "new_rate": "double(q)", "source_rate": "100D"},
          "cash_mergers": {"acquiree_symbol": "name", "effective_date": "ex_date"}, "forward_splits": {"symbol": "name", "new_rate": "double(q)", "old_rate": "100D"}}
    path = fresh_path(spark, "actions")
    for batch, part in (("1", g.where("m % 3 = 1").withColumn("rate", F.col("rate") / 2)), ("2", g)):
        lists = [F.array_agg(F.when(F.col("kind") == kind, F.struct("id", "ex_date", "rate", *[F.expr(x).alias(n) for n, x in more.items()]))).alias(kind) for kind, more in of.items()]
        docs = part.groupBy("k").agg(*lists).drop("k")
        docs.select(*[F.filter(kind, lambda r: r.isNotNull()).alias(kind) for kind in of]).write.json(f"{path}/batch-{batch}")
    s = B.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("O"), "s_suppkey").alias("o"), F.concat(F.lit("S"), "s_suppkey").alias("s"), F.concat(F.lit("X"), "s_suppkey").alias("x"))
    change = lambda on, old, new: F.struct(F.concat_ws(":", F.lit(on), old).alias("id"), F.lit(on).alias("process_date"), F.col(old).alias("old_symbol"), F.col(new).alias("new_symbol"))
    s.select(F.array(change(RENAMED, "o", "s"), change(REUSED, "x", "o")).alias("name_changes")).write.json(f"{path}/batch-3")
    return materialize(SR.corporate_actions(spark, f"{path}/*"), "actions")


@query("src08_corporate_actions", f"""WITH {ACTIONS} SELECT kind, id, name AS symbol, {ds('ex_date')} AS day, {rs('rate')} AS rate FROM act
 UNION ALL SELECT 'name_changes', concat('{RENAMED}:O', s_suppkey), concat('S', s_suppkey), '{RENAMED}', NULL FROM supplier WHERE s_suppkey % 4 = 0
 UNION ALL SELECT 'name_changes', concat('{REUSED}:X', s_suppkey), concat('O', s_suppkey), '{REUSED}', NULL FROM supplier WHERE s_suppkey % 4 = 0""")
def corporate_actions(spark, d):
    a = landed_actions(spark, d)
    name = F.when(F.col("kind") == "name_changes", F.col("new_symbol")).otherwise(F.coalesce("symbol", "source_symbol", "acquiree_symbol"))
    return a.select("kind", "id", name.alias("symbol"), day(F.coalesce("ex_date", "process_date")).alias("day"), rnd("rate").alias("rate"))


def entity_inputs(spark, d):
    """(actions, name periods, bars of each entity, prices by name)."""
    actions = landed_actions(spark, d)
    roots = B.table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    periods = materialize(C.symbol_periods(roots, actions.where("kind = 'name_changes'"), TODAY), "periods")
    bars = raw_bars(spark, d).withColumn("root", F.concat(F.lit("S"), "symbol"))
    return actions, periods, bars, bars.select(F.col("root").alias("symbol"), "session", "close_raw")


@query("jon07_named_actions", f"WITH {ACTIONS} SELECT root, kind, {ds('ex_date')} AS day, count(*) AS n FROM act JOIN per ON act.name = per.name AND ex_date BETWEEN lo AND hi GROUP BY ALL")
def named_actions(spark, d):
    """Actions by the entity that carried their name on the day, through renames and reused names."""
    actions, periods, _, _ = entity_inputs(spark, d)
    a = actions.where("kind <> 'name_changes'").withColumn("of", F.coalesce("symbol", "source_symbol", "acquiree_symbol"))
    return C.in_periods(a, periods, "of", "ex_date").groupBy("root", "kind", day("ex_date").alias("day")).agg(F.count("*").alias("n"))


@query("win27_distributions", f"""WITH {B.BARS}, {RAW}, {STEPS}, {ACTIONS}, ob AS (SELECT symbol, session, lag(close * f) OVER ({WS}) / (close * f) AS obs, lag(close * f) OVER ({WS}) - open * f AS gap FROM src),
 ends AS (SELECT symbol AS k, min(session) AS lo, max(session) AS hi FROM bars GROUP BY 1),
 own AS (SELECT CAST(substr(root, 2) AS BIGINT) AS symbol, act.* FROM act JOIN per ON act.name = per.name AND ex_date BETWEEN per.lo AND per.hi),
 paid AS (SELECT own.symbol, own.ex_date, rate AS amount, CASE WHEN m = 2 THEN 'special' ELSE 'dividend' END AS kind, NULL AS new_symbol FROM own WHERE kind = 'cash_dividends' AND rate <> 0
  UNION ALL SELECT own.symbol, own.ex_date, coalesce(ratio * n.close * n.f, 0), CASE WHEN coalesce(ratio * n.close * n.f, 0) = 0 THEN 'spin_off_gap_estimate' ELSE 'spin_off' END, concat('S', own.k + 1)
   FROM own LEFT JOIN src n ON n.symbol = own.k + 1 AND n.session = own.ex_date WHERE kind = 'spin_offs'),
 inside AS (SELECT paid.* FROM paid JOIN ends ON ends.k = paid.symbol WHERE ex_date > lo AND ex_date <= hi),
 v AS (SELECT s.symbol, s.ex_date, s.ratio, o.obs FROM steps s ASOF LEFT JOIN ob o ON s.symbol = o.symbol AND s.ex_date <= o.session),
 odd AS (SELECT symbol, ex_date FROM v WHERE obs > 1.02 AND NOT (abs(ln(ratio)) >= 0.1 AND abs(ln(obs) - ln(ratio)) < abs(ln(obs))) AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.symbol = v.symbol AND i.kind <> 'dividend' AND abs(i.ex_date - v.ex_date) <= 3)),
 rows AS (SELECT * FROM inside UNION ALL SELECT symbol, ex_date, 0, 'misrecorded_split_gap_estimate', NULL FROM odd)
 SELECT concat('S', r.symbol) AS root, {ds('ex_date')} AS ex_date, kind, new_symbol, {rs("CASE WHEN kind LIKE '%gap_estimate' THEN greatest(coalesce(gap, 0), 0) ELSE amount END", 3)} AS amount_raw
 FROM rows r ASOF LEFT JOIN ob ON r.symbol = ob.symbol AND r.ex_date <= ob.session""")
def distributions(spark, d):
    actions, periods, bars, prices = entity_inputs(spark, d)
    splits = C.validate_splits(C.applied_splits(bars), bars).withColumn("root", F.concat(F.lit("S"), "symbol"))
    x = C.distributions(actions, periods, bars, prices, splits)
    return x.select("root", day("ex_date").alias("ex_date"), "kind", "new_symbol", rnd("amount_raw", 3).alias("amount_raw"))


@query("win27_take_out_prices", f"""WITH {B.BARS}, {ACTIONS}, ends AS (SELECT symbol AS k, max(session) AS last_day FROM bars GROUP BY 1)
 SELECT root, {ds('last_day')} AS last_day, {rs('arg_min(rate, (ex_date, id))')} AS price FROM act JOIN per ON act.name = per.name JOIN ends ON root = concat('S', ends.k) AND last_day BETWEEN per.lo AND per.hi
 WHERE kind = 'cash_mergers' AND rate <> 0 AND abs(ex_date - last_day) <= 10 GROUP BY 1, last_day""")
def take_out_prices(spark, d):
    actions, periods, bars, _ = entity_inputs(spark, d)
    return C.take_out_prices(actions, periods, bars).select("root", day("last_day").alias("last_day"), rnd("price").alias("price"))


# --- universe -----------------------------------------------------------------------------------

@query("srt08_month_starts", f"""WITH {B.CALENDAR} SELECT {ds('min(session)')} AS session, min(ord) AS ord FROM cal GROUP BY date_trunc('month', session)""")
def month_starts(spark, d):
    return C.month_starts(B.calendar(spark, d)).select(day().alias("session"), F.col("ord").cast("bigint").alias("ord"))


LIQ = f"""{B.CALENDAR}, ms AS (SELECT min(session) AS rebalance, min(ord) AS o FROM cal GROUP BY date_trunc('month', session)),
 lq AS (SELECT rebalance, symbol, median(close * volume) AS mdv, arg_max(close, b.session) AS last_close, count(*) / 250.0 AS cov FROM bars b JOIN cal USING (session) JOIN ms ON ord < o AND ord >= o - 250 GROUP BY 1, 2)"""


def liquidity_ranks(spark, d, bars=None):
    cal = B.calendar(spark, d)
    # dealt by symbol before each bar is widened to the rebalances it serves, so the wide rows are not shuffled
    bars = B.symbol_bars(spark, d) if bars is None else B.spread(bars, spark, d, "symbol")
    return C.rank_liquidity(bars.select("symbol", "session", "close", "volume"), C.month_starts(cal), cal, 250, 500.0, 20000.0, 0.15)


@query("agg23_liquidity_rank", f"""WITH {B.BARS}, {LIQ} SELECT {ds('rebalance')} AS rebalance, symbol, {rs('mdv', 2)} AS median_dv, {rs('last_close')} AS last_close, {rs('cov', 6)} AS coverage
 FROM lq WHERE cov >= 0.15 AND last_close >= 500 AND mdv >= 20000""")
def liquidity_rank(spark, d):
    r = liquidity_ranks(spark, d)
    return r.select(day("rebalance").alias("rebalance"), "symbol", rnd("median_dv", 2).alias("median_dv"), rnd("last_close").alias("last_close"), rnd("coverage", 6).alias("coverage"))


@query("seq13_monthly_universe", f"""WITH {B.BARS}, {LIQ}, {B.SECTORS}, f AS (SELECT lq.*, industry FROM lq JOIN sectors USING (symbol) WHERE cov >= 0.15 AND last_close >= 500 AND mdv >= 20000),
 g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rebalance, industry ORDER BY mdv DESC, symbol) = 1)
 SELECT {ds('rebalance')} AS rebalance, symbol, CAST(row_number() OVER (PARTITION BY rebalance ORDER BY mdv DESC, symbol) AS INTEGER) AS rank FROM g
 QUALIFY row_number() OVER (PARTITION BY rebalance ORDER BY mdv DESC, symbol) <= 10""")
def monthly_universe(spark, d):
    r = liquidity_ranks(spark, d).join(B.sectors(spark, d).select("symbol", "industry"), "symbol")
    u = C.top_n(C.one_per_company(r, "industry", "median_dv"), 10, "median_dv")
    return u.select(day("rebalance").alias("rebalance"), "symbol", "rank")


SHARE_CLASS = "CASE WHEN symbol % 3 = 0 THEN symbol % 40 END"


@query("seq12_uncorrelated_universe", f"""WITH RECURSIVE {B.BARS}, {LIQ},
 f AS (SELECT rebalance, symbol, {SHARE_CLASS} AS co, row_number() OVER (PARTITION BY rebalance ORDER BY mdv DESC, symbol) AS place FROM lq WHERE cov >= 0.15 AND last_close >= 500 AND mdv >= 20000),
 wr AS (SELECT rebalance, symbol, b.session, close / lag(close) OVER (PARTITION BY rebalance, symbol ORDER BY b.session) - 1 AS ret FROM bars b JOIN cal USING (session) JOIN ms ON ord < o AND ord >= o - 250),
 cr AS (SELECT x.rebalance, x.symbol AS a, y.symbol AS b FROM wr x JOIN wr y ON x.rebalance = y.rebalance AND x.session = y.session AND x.symbol <> y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL
  GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND stddev_pop(x.ret) > 0 AND stddev_pop(y.ret) > 0 AND corr(x.ret, y.ret) > 0.6),
 bad AS (SELECT g.rebalance, g.place, list(h.place) FILTER (h.place IS NOT NULL) AS worse_than FROM f g LEFT JOIN f h ON h.rebalance = g.rebalance AND h.place < g.place
  AND (h.co = g.co OR EXISTS (SELECT 1 FROM cr WHERE cr.rebalance = g.rebalance AND cr.a = h.symbol AND cr.b = g.symbol)) GROUP BY 1, 2),
 go AS (SELECT rebalance, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT rebalance FROM f)
  UNION ALL SELECT go.rebalance, bad.place, CASE WHEN list_has_any(go.kept, coalesce(worse_than, [])) THEN go.kept ELSE list_append(go.kept, bad.place) END FROM go JOIN bad ON bad.rebalance = go.rebalance AND bad.place = go.place + 1),
 done AS (SELECT rebalance, unnest(kept) AS place FROM (SELECT rebalance, arg_max(kept, place) AS kept FROM go GROUP BY 1))
 SELECT {ds('rebalance')} AS rebalance, symbol, place, CAST(row_number() OVER (PARTITION BY rebalance ORDER BY place) AS INTEGER) AS pick FROM done JOIN f USING (rebalance, place)
 QUALIFY row_number() OVER (PARTITION BY rebalance ORDER BY place) <= 12""")
def uncorrelated_universe(spark, d):
    from pyspark.sql import Window
    cal, bars = materialize(B.calendar(spark, d), "calendar"), materialize(B.daily_bars(spark, d).select("symbol", "session", "close", "volume"), "bars")
    place = F.row_number().over(Window.partitionBy("rebalance").orderBy(F.desc("median_dv"), "symbol"))
    ranked = liquidity_ranks(spark, d, bars).withColumn("place", place.cast("bigint")).withColumn("company", F.expr(SHARE_CLASS))
    u = C.uncorrelated(ranked, lambda names: C.window_returns(bars, C.month_starts(cal), cal, 250, names), 12, 0.6, "company")
    return u.select(day("rebalance").alias("rebalance"), "symbol", "place", "pick")


CHANGES = """chg AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, list(DISTINCT l_suppkey) AS tickers FROM lineitem GROUP BY 1)"""


def membership_changes(spark, d):
    li = B.table(spark, d, "lineitem")
    return (li.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), F.col("l_suppkey").alias("t")).distinct()
            .select("date", F.array("t").alias("tickers")))


@query("seq09_membership_intervals", f"""WITH {CHANGES}, dt AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM chg), m AS (SELECT o, date, unnest(tickers) AS ticker FROM chg JOIN dt USING (date)),
 g AS (SELECT *, o - row_number() OVER (PARTITION BY ticker ORDER BY o) AS grp FROM m), iv AS (SELECT ticker, grp, min(date) AS start, max(o) AS lst FROM g GROUP BY 1, 2)
 SELECT ticker, {ds('start')} AS start, {ds('dt.date - 1')} AS "end" FROM iv LEFT JOIN dt ON dt.o = lst + 1""")
def membership_intervals(spark, d):
    iv = C.membership_intervals(membership_changes(spark, d))
    return iv.select("ticker", day("start").alias("start"), day("end").alias("end"))


@query("seq15_classify_survivors", f"""WITH {B.BARS}, k AS (SELECT symbol, count(*) AS nb, max(session) AS lb FROM bars GROUP BY 1), mx AS (SELECT max(session) AS m FROM bars),
 t AS (SELECT symbol, close, session, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS rn FROM bars),
 f AS (SELECT symbol, max(close) FILTER (rn = 1) / max(close) - 1 AS fall FROM t WHERE rn <= 20 GROUP BY 1)
 SELECT symbol, CASE WHEN symbol % 5 = 0 THEN 'current' WHEN lb >= m - 10 THEN 'left_index_trading' WHEN fall < -0.5 THEN 'delisted_distressed' ELSE 'delisted' END AS label
 FROM k JOIN f USING (symbol), mx""")
def classify_survivors(spark, d):
    b = B.daily_bars(spark, d)
    m = b.groupBy("symbol").agg(F.min("session").alias("start"), F.max("session").alias("_e")).withColumn(
        "end", F.when(F.col("symbol") % 5 != 0, F.col("_e"))).drop("_e")
    mx = F.broadcast(b.agg(F.date_sub(F.max("session"), 10).alias("_cut")))
    return C.classify_survivors(m.join(mx), b, F.col("_cut")).select("symbol", "label")


# --- survivorship -------------------------------------------------------------------------------

SURVIVORS = f"""{LIQ}, {B.SECTORS}, {CHANGES}, mx AS (SELECT max(session) AS m, max(ord) AS mo FROM cal),
 k15 AS (SELECT symbol, max(session) AS lb FROM bars GROUP BY 1), t15 AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS rn FROM bars),
 f15 AS (SELECT symbol, max(close) FILTER (rn = 1) / max(close) - 1 AS fall FROM t15 WHERE rn <= 20 GROUP BY 1),
 cls AS (SELECT symbol, lb, CASE WHEN symbol % 5 = 0 THEN 'current' WHEN lb >= m - 10 THEN 'left_index_trading' WHEN fall < -0.1 THEN 'delisted_distressed' ELSE 'delisted' END AS label FROM k15 JOIN f15 USING (symbol), mx),
 dt AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM chg), me AS (SELECT o, date, unnest(tickers) AS symbol FROM chg JOIN dt USING (date)),
 iv AS (SELECT symbol, min(date) AS start, max(o) AS lst FROM (SELECT *, o - row_number() OVER (PARTITION BY symbol ORDER BY o) AS grp FROM me) GROUP BY symbol, grp),
 mem AS (SELECT symbol, start, dt.date - 1 AS fin FROM iv LEFT JOIN dt ON dt.o = lst + 1),
 fl AS (SELECT rebalance, symbol, mdv, industry, label = 'current' AS lives FROM lq JOIN sectors USING (symbol) JOIN cls USING (symbol) WHERE cov >= 0.15 AND last_close >= 500 AND mdv >= 20000),
 ht AS (SELECT symbol, mdv, industry FROM (SELECT symbol, median(close * volume) AS mdv, arg_max(close, b.session) AS lc, count(*) / 250.0 AS cov FROM bars b JOIN cal USING (session), mx WHERE ord > mo - 250 GROUP BY 1) JOIN sectors USING (symbol) JOIN cls USING (symbol)
  WHERE cov >= 0.15 AND lc >= 500 AND mdv >= 20000 AND label = 'current'),
 an AS (SELECT ms.rebalance, cal.session AS anchor FROM ms JOIN cal ON cal.ord = ms.o - 1 UNION ALL SELECT NULL, m FROM mx),
 t1 AS (SELECT * FROM (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY rebalance, industry ORDER BY mdv DESC, symbol) = 1) QUALIFY row_number() OVER (PARTITION BY rebalance ORDER BY mdv DESC, symbol) <= 10),
 t2 AS (SELECT * FROM (SELECT * FROM fl WHERE lives QUALIFY row_number() OVER (PARTITION BY rebalance, industry ORDER BY mdv DESC, symbol) = 1) QUALIFY row_number() OVER (PARTITION BY rebalance ORDER BY mdv DESC, symbol) <= 10),
 t3 AS (SELECT * FROM (SELECT * FROM ht QUALIFY row_number() OVER (PARTITION BY industry ORDER BY mdv DESC, symbol) = 1) QUALIFY row_number() OVER (ORDER BY mdv DESC, symbol) <= 10),
 al AS (SELECT rebalance, mem.symbol, label = 'current' AS lives FROM an JOIN mem ON rebalance BETWEEN start AND coalesce(fin, DATE '9999-12-31') JOIN cls ON cls.symbol = mem.symbol),
 un AS (SELECT 'pit_top' AS universe, anchor, symbol FROM t1 JOIN an USING (rebalance) UNION ALL SELECT 'survivors_top', anchor, symbol FROM t2 JOIN an USING (rebalance) UNION ALL SELECT 'hindsight_top', anchor, symbol FROM t3, an
  UNION ALL SELECT 'pit_all', anchor, symbol FROM al JOIN an USING (rebalance) UNION ALL SELECT 'survivors_all', anchor, symbol FROM al JOIN an USING (rebalance) WHERE lives),
 pg AS (SELECT c.symbol, c.lb, c.label, a.anchor FROM cls c CROSS JOIN (SELECT DISTINCT anchor FROM an) a), pb AS (SELECT pg.*, b.close AS price FROM pg ASOF LEFT JOIN bars b ON pg.symbol = b.symbol AND pg.anchor >= b.session),
 pr AS (SELECT 'last_price' AS rule, symbol, anchor, price FROM pb UNION ALL SELECT 'distressed_zero', symbol, anchor, CASE WHEN label = 'delisted_distressed' AND anchor > lb THEN 0 ELSE price END FROM pb),
 pn AS (SELECT *, lead(price) OVER (PARTITION BY rule, symbol ORDER BY anchor) AS nx, lead(anchor) OVER (PARTITION BY rule, symbol ORDER BY anchor) AS until FROM pr),
 sr AS (SELECT rule, universe, anchor, until, avg(nx / price - 1) AS ret FROM un JOIN pn USING (symbol, anchor) WHERE price > 0 AND nx IS NOT NULL GROUP BY ALL)"""
UNIVERSES = ["pit_top", "survivors_top", "hindsight_top", "pit_all", "survivors_all"]


def scenario_inputs(spark, d):
    """Five universes at the session before each month and prices under two rules for names that ended."""
    bars, cal = materialize(B.daily_bars(spark, d).select("symbol", "session", "close", "volume"), "bars"), materialize(B.calendar(spark, d), "calendar")
    starts, end = C.month_starts(cal), cal.agg(F.max("session").alias("m"), F.max("ord").alias("o")).first()
    anchors = starts.join(cal.select(F.col("session").alias("anchor"), (F.col("ord") + 1).alias("ord")), "ord").select(F.col("session").alias("rebalance"), "anchor")
    anchors = anchors.unionByName(spark.createDataFrame([(None, end["m"])], "rebalance date, anchor date"))
    rank = lambda on: C.rank_liquidity(bars, on, cal, 250, 500.0, 20000.0, 0.15).join(B.sectors(spark, d).select("symbol", "industry"), "symbol")
    m = bars.groupBy("symbol").agg(F.min("session").alias("start"), F.max("session").alias("_e")).withColumn("end", F.when(F.col("symbol") % 5 != 0, F.col("_e"))).drop("_e")
    last = C.classify_survivors(m, bars, F.date_sub(F.lit(end["m"]), 10)).select("symbol", "label")
    recent = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    low = bars.withColumn("_rn", recent).where("_rn <= 20").groupBy("symbol").agg((F.max(F.when(F.col("_rn") == 1, F.col("close"))) / F.max("close") - 1).alias("fall"))
    # the supplied prices hardly halve in twenty bars: here a fall by a tenth counts as distress
    ended = F.when(F.col("fall") < -0.1, "delisted_distressed").otherwise("delisted")
    last = materialize(last.join(low, "symbol").select("symbol", F.when(F.col("label").startswith("delisted"), ended).otherwise(F.col("label")).alias("label")), "labels")
    lives = last.where("label in ('current', 'renamed_member')").select("symbol")
    ranked = materialize(rank(starts), "ranked")
    today = rank(spark.createDataFrame([(end["m"], end["o"] + 1)], "session date, ord int")).join(lives, "symbol", "left_semi")
    top = lambda r: C.top_n(C.one_per_company(r, "industry", "median_dv"), 10, "median_dv").select("rebalance", "symbol")
    iv = C.membership_intervals(membership_changes(spark, d)).select(F.col("ticker").alias("symbol"), "start", F.coalesce("end", F.lit("9999-12-31").cast("date")).alias("end"))
    at = anchors.where("rebalance is not null")  # a row a month
    held = iv.join(F.broadcast(at), F.col("rebalance").between(F.col("start"), F.col("end"))).select("rebalance", "symbol")
    on = lambda u, name: u.join(F.broadcast(at), "rebalance").select(F.lit(name).alias("universe"), "anchor", "symbol")
    always = F.explode(F.array(*[F.lit(r["anchor"]) for r in anchors.select("anchor").collect()])).alias("anchor")
    universes = (on(top(ranked), "pit_top").unionByName(on(top(ranked.join(lives, "symbol", "left_semi")), "survivors_top"))
                 .unionByName(top(today).select("symbol", always).select(F.lit("hindsight_top").alias("universe"), "anchor", "symbol"))
                 .unionByName(on(held, "pit_all")).unionByName(on(held.join(lives, "symbol", "left_semi"), "survivors_all")))
    gone = last.where("label = 'delisted_distressed'").select("symbol", F.lit(True).alias("gone"))
    px = J.anchor_prices(bars, anchors).join(bars.groupBy("symbol").agg(F.max("session").alias("lb")), "symbol").join(gone, "symbol", "left")
    zero = F.when(F.col("gone") & (F.col("anchor") > F.col("lb")), 0.0).otherwise(F.col("price"))
    rules = F.array(F.struct(F.lit("last_price").alias("rule"), F.col("price")), F.struct(F.lit("distressed_zero").alias("rule"), zero.alias("price")))
    return universes, px.select("symbol", "anchor", F.explode(rules).alias("z")).select("z.rule", "symbol", "anchor", "z.price")


_BY_UNIVERSE = ", ".join("max({0}) FILTER (universe = '" + u + "') AS " + u for u in UNIVERSES)
_ROUNDED = ", ".join(f"{rs(u, 6)} AS {u}" for u in UNIVERSES)


@query("agg20_survivorship_yearly", f"""WITH {B.BARS}, {SURVIVORS}, yr AS (SELECT rule, year(until) AS year, universe, product(1 + ret) - 1 AS r FROM sr GROUP BY 1, 2, 3),
 pv AS (SELECT rule, CAST(year AS INTEGER) AS year, {_BY_UNIVERSE.format('r')} FROM yr GROUP BY 1, 2) SELECT rule, year, {_ROUNDED} FROM pv""")
def survivorship_yearly(spark, d):
    y = E.yearly_table(E.scenario_returns(*scenario_inputs(spark, d)), UNIVERSES)
    return y.select("rule", "year", *[rnd(u, 6).alias(u) for u in UNIVERSES])


BIAS = {"bias_top": ("survivors_top", "pit_top"), "bias_hindsight": ("hindsight_top", "pit_top"), "bias_all": ("survivors_all", "pit_all")}
_BIAS = ", ".join(f"{rs(f'{a} - {b}', 6)} AS {k}" for k, (a, b) in BIAS.items())


@query("agg20_survivorship_bias", f"""WITH {B.BARS}, {SURVIVORS}, cg AS (SELECT rule, universe, power(product(1 + ret), 12.0::DOUBLE / count(*)) - 1 AS c FROM sr GROUP BY 1, 2),
 pv AS (SELECT rule, {_BY_UNIVERSE.format('c')} FROM cg GROUP BY 1) SELECT rule, {_BIAS} FROM pv""")
def survivorship_bias(spark, d):
    b = E.survivorship_bias(E.scenario_returns(*scenario_inputs(spark, d)), BIAS)
    return b.select("rule", *[rnd(k, 6).alias(k) for k in BIAS])
