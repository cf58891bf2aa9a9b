"""Event studies, resampling, labels and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.functions import indicators as I
from tapegrain.operators import disclosures as D
from tapegrain.operators import evaluation as E
from tapegrain.operators import events as V
from tapegrain.operators import factors as X
from tapegrain.operators import regimes as R
from tapegrain.operators import stats as S
from tapegrain.operators.kernels import CALENDAR_ROWS, by_time, exact_quantiles, poisson_one_sql, uniform_sql
from tapegrain.plans.catalog import day, ds, query, rnd, rs
from tapegrain.plans.evaluation import FC, SC, TRADES, forecasts, scored_forward, trades
from tapegrain.plans.regimes import REG
from tapegrain.plans.windows import COMP, TR, WS, composite_panel, ewm_sql, full_sql
from tapegrain.session import materialize


@query("sta01_bootstrap_mean", f"""WITH r AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders), d AS (SELECT id, v, unnest(range(1, 51)) AS rep FROM r),
 u AS (SELECT rep, v, {uniform_sql(1, 'rep', 'id')} AS u FROM d), w AS (SELECT rep, v, {poisson_one_sql('u')} AS w FROM u), g AS (SELECT rep, sum(w * v) / sum(w) AS m FROM w GROUP BY 1)
 SELECT {rs('quantile_cont(m, 0.05)', 2)} AS lo, {rs('quantile_cont(m, 0.95)', 2)} AS hi, count(*) AS reps FROM g""")
def bootstrap_mean(spark, d):
    b = S.bootstrap_mean(B.table(spark, d, "orders"), ["o_orderkey"], "o_totalprice", 50)
    return b.select(rnd("lo", 2).alias("lo"), rnd("hi", 2).alias("hi"), "reps")


@query("sta02_cluster_bootstrap", f"""WITH m AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, s, n FROM (SELECT date_trunc('month', o_orderdate) AS c, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)),
 k AS (SELECT count(*) AS k, sum(s) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n_rows FROM m), d0 AS (SELECT k, unnest(range(1, 501)) AS rep FROM k), d1 AS (SELECT k, rep, unnest(range(1, k + 1)) AS j FROM d0),
 d2 AS (SELECT rep, CAST(floor({uniform_sql(1, 'rep', 'j')} * k) AS BIGINT) AS i FROM d1), g AS (SELECT rep, sum(s) / sum(n) AS b FROM d2 JOIN m USING (i) GROUP BY 1)
 SELECT {rs('any_value(mean)', 2)} AS mean, any_value(n_rows) AS n_rows, {rs('quantile_cont(b, 0.05)', 2)} AS lo, {rs('quantile_cont(b, 0.95)', 2)} AS hi FROM g, k""")
def cluster_bootstrap(spark, d):
    o = B.table(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    b = S.cluster_bootstrap(o, "month", "o_totalprice", 500)
    return b.select(rnd("mean", 2).alias("mean"), "n_rows", rnd("lo", 2).alias("lo"), rnd("hi", 2).alias("hi"))


@query("sta03_sharpe_difference", f"""WITH {B.MARKET}, s0 AS (SELECT session, close / lag(close) OVER (ORDER BY session) - 1 AS a, open / lag(open) OVER (ORDER BY session) - 1 AS b FROM mkt),
 s AS (SELECT a, b, row_number() OVER (ORDER BY session) - 1 AS i FROM s0 WHERE a IS NOT NULL), n AS (SELECT count(*) AS n FROM s), d0 AS (SELECT n, unnest(range(1, 101)) AS rep FROM n),
 d1 AS (SELECT n, rep, unnest(range(0, (n - 1) // 21 + 1)) AS j FROM d0), d2 AS (SELECT n, rep, j, CAST(floor({uniform_sql(3, 'rep', 'j')} * n) AS BIGINT) AS st FROM d1),
 d3 AS (SELECT n, rep, j, st, unnest(range(0, 21)) AS o FROM d2), g AS (SELECT rep, (avg(a) / stddev_pop(a) - avg(b) / stddev_pop(b)) * sqrt(252) AS diff FROM d3 JOIN s ON s.i = (st + o) % n WHERE j * 21 + o < n GROUP BY 1)
 SELECT (SELECT {rs('(avg(a) / stddev_pop(a) - avg(b) / stddev_pop(b)) * sqrt(252)', 5)} FROM s) AS diff, {rs('quantile_cont(diff, 0.05)', 5)} AS lo, {rs('quantile_cont(diff, 0.95)', 5)} AS hi FROM g""")
def sharpe_difference(spark, d):
    w = by_time("symbol", "session")
    m = B.market_bars(spark, d)
    r = m.select("session", *[(F.col(x) / F.lag(x).over(w) - 1).alias(y) for x, y in (("close", "a"), ("open", "b"))]).where(F.col("a").isNotNull())
    b = S.block_bootstrap_sharpe(r, "a", "b", "session", 100)
    return b.select(*[rnd(x, 5).alias(x) for x in ("diff", "lo", "hi")])


@query("sta04_trade_monte_carlo", f"""WITH t0 AS (SELECT CAST(l_shipdate AS DATE) AS session, avg(l_discount - l_tax) AS r FROM lineitem GROUP BY 1), t AS (SELECT r, row_number() OVER (ORDER BY session) - 1 AS i FROM t0),
 n AS (SELECT count(*) AS n FROM t), d0 AS (SELECT n, unnest(range(1, 41)) AS sim FROM n), d1 AS (SELECT n, sim, unnest(range(1, n + 1)) AS j FROM d0),
 d2 AS (SELECT sim, j, r FROM (SELECT sim, j, CAST(floor({uniform_sql(5, 'sim', 'j')} * n) AS BIGINT) AS i FROM d1) JOIN t USING (i)),
 c AS (SELECT sim, j, sum(r) OVER (PARTITION BY sim ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM d2), dd AS (SELECT sim, j, c, c - greatest(max(c) OVER (PARTITION BY sim ORDER BY j ROWS UNBOUNDED PRECEDING), 0) AS dd FROM c),
 g AS (SELECT sim, arg_max(c, j) AS total, min(dd) AS dd FROM dd GROUP BY 1) SELECT {rs('quantile_cont(total, 0.05)', 5)} AS total_p5, {rs('quantile_cont(total, 0.5)', 5)} AS total_p50, {rs('quantile_cont(total, 0.95)', 5)} AS total_p95,
 {rs('quantile_cont(dd, 0.05)', 5)} AS drawdown_p5, {rs('quantile_cont(dd, 0.5)', 5)} AS drawdown_p50, {rs('avg(CAST(total <= 0 AS DOUBLE))', 5)} AS p_loss FROM g""")
def trade_monte_carlo(spark, d):
    t = B.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("session")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("r"))
    m = S.trade_monte_carlo(t, "r", "session", 40)
    return m.select(*[rnd(x, 5).alias(x) for x in m.columns])


HOLD = 40
LAST = "2003-12-31"


def study_trades(spark, d):
    return V.event_trades(B.symbol_bars(spark, d).select("symbol", "session", "open", "high", "low", "close", "volume"), B.market_bars(spark, d), HOLD, 0.001, F.lit(LAST).cast("date"))


@query("sta05_event_trades", f"""WITH {B.BARS}, {B.MARKET}, b AS (SELECT symbol, session, lead(session) OVER ({WS}) AS es, lead(open) OVER ({WS}) AS eo, lead(session, {HOLD + 1}) OVER ({WS}) AS xs, lead(open, {HOLD + 1}) OVER ({WS}) AS xo,
  last_value(session) OVER z AS fin, last_value(close) OVER z AS lc FROM bars WINDOW z AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 c AS (SELECT *, xs IS NULL AND es IS NOT NULL AND DATE '{LAST}' - fin >= 10 AS ended FROM b), e AS (SELECT *, CASE WHEN ended THEN fin ELSE xs END AS xd, CASE WHEN ended THEN lc ELSE xo END AS xp FROM c)
 SELECT symbol, {ds('e.session')} AS session, CASE WHEN ended THEN 'data_end' WHEN xs IS NOT NULL THEN 'time' END AS exit_how, {rs('xp * 0.999::DOUBLE / (eo * 1.001::DOUBLE) - 1', 6)} AS ret,
 {rs('xp * 0.999::DOUBLE / (eo * 1.001::DOUBLE) - 1 - (m2.open / m1.open - 1)', 6)} AS ar FROM e LEFT JOIN mkt m1 ON m1.session = es LEFT JOIN mkt m2 ON m2.session = xd""".replace("SELECT symbol, strftime", "SELECT e.symbol, strftime"))
def event_trades(spark, d):
    return study_trades(spark, d).select("symbol", day().alias("session"), "exit_how", rnd("ret", 6).alias("ret"), rnd("ar", 6).alias("ar"))


def study(spark, d):
    f = B.filings(spark, d).where(F.col("code") == "P")
    t = materialize(study_trades(spark, d), "study_trades")  # read by the events and by both placebo draws
    t = t.withColumn("median_dv_60", F.col("median_dv_60") * 1000)  # the tables' prices are small money
    return V.event_study(D.detect_clusters(f, min_insiders=4), f, t, hold=HOLD)


@query("sta06_event_study")
def event_study(spark, d):
    """Draws decide the placebos; checked on planted effects in the tests."""
    e = study(spark, d)
    return e.select("symbol", day("signal_date").alias("signal_date"), "n_insiders", rnd("ar", 6).alias("ar"), rnd("ar_minus_placebo", 6).alias("ar_minus_placebo"),
                    rnd("ar_minus_matched", 6).alias("ar_minus_matched"))


@query("sta06_study_verdict")
def study_verdict(spark, d):
    e = study(spark, d).withColumn("month", F.date_trunc("month", "signal_date"))
    b = S.cluster_bootstrap(e, "month", "ar_minus_placebo", 500)
    word = F.when(F.col("lo") > 0, "edge").when(F.col("hi") < 0, "no_edge").otherwise("not_distinguishable")
    return b.select("n_rows", rnd("mean", 6).alias("mean"), rnd("lo", 6).alias("lo"), rnd("hi", 6).alias("hi"), word.alias("verdict"))


@query("sta07_auc_rank_ic", f"""WITH {B.BARS}, {FC}, e AS (SELECT horizon, round(1 / (1 + exp(-ln(p50 / last_price) * 5)), 6) AS p, CAST(realised > last_price AS INT) AS hit, ln(realised / last_price) AS y FROM rz),
 r AS (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY p) + (count(*) OVER (PARTITION BY horizon, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY horizon ORDER BY y) + (count(*) OVER (PARTITION BY horizon, y) - 1) / 2.0 AS ry FROM e)
 SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n, {rs('(sum(CASE WHEN hit = 1 THEN rp ELSE 0 END) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * CAST(sum(1 - hit) AS DOUBLE))', 6)} AS auc, {rs('corr(rp, ry)', 5)} AS rank_ic FROM r GROUP BY 1""")
def auc_rank_ic(spark, d):
    f = forecasts(spark, d).select("horizon", F.round(1 / (1 + F.exp(-F.log(F.col("p50") / F.col("last_price")) * 5)), 6).alias("p"),
                                   (F.col("realised") > F.col("last_price")).cast("int").alias("hit"), F.log(F.col("realised") / F.col("last_price")).alias("y"))
    f = materialize(f, "outcomes")  # both measures read it several times
    a = E.auc(f, ["horizon"], "p", "hit").join(E.rank_corr(f, ["horizon"], "p", "y", written=True), "horizon")
    return a.select("horizon", "n", rnd("auc", 6).alias("auc"), rnd("rank_ic", 5).alias("rank_ic"))


@query("sta08_predictive_core", f"""WITH {B.BARS}, f0 AS (SELECT *, ln(close / lag(close) OVER ({WS})) AS r1, ln(lead(close, 5) OVER ({WS}) / close) AS y FROM bars), f1 AS (SELECT symbol, y, {full_sql('stddev_samp(r1)', 'r1', 21)} * sqrt(5) AS sg FROM f0),
 f2 AS (SELECT * FROM f1 WHERE y IS NOT NULL AND sg IS NOT NULL), a AS (SELECT symbol, median(y) AS anchor, avg(CAST(y > 0 AS DOUBLE)) AS base, count(*) AS n FROM f2 GROUP BY 1)
 SELECT f2.symbol, any_value(n) AS n, {rs('any_value(anchor)', 6)} AS anchor, {rs('any_value(base)', 6)} AS base_rate, {rs('quantile_cont((y - anchor) / sg, 0.1)', 5)} AS z10, {rs('quantile_cont((y - anchor) / sg, 0.9)', 5)} AS z90 FROM f2 JOIN a USING (symbol) GROUP BY 1""")
def predictive_core(spark, d):
    return core(spark, d).select("symbol", "n", rnd("anchor", 6).alias("anchor"), rnd("base_rate", 6).alias("base_rate"), rnd("z10", 5).alias("z10"), rnd("z90", 5).alias("z90"))


def labelled(spark, d, h=5):
    w = by_time("symbol", "session")
    b = B.daily_bars(spark, d).select("symbol", "session", "close")
    f = b.withColumns({"_r": F.log(F.col("close") / F.lag("close").over(w)), "y": F.log(F.lead("close", h).over(w) / F.col("close")), "i": F.row_number().over(w)})
    return f.withColumn("sigma", I.rolling_std("_r", 21) * F.sqrt(F.lit(float(h))))


def core(spark, d):
    return S.predictive_core(labelled(spark, d).where(F.col("y").isNotNull() & F.col("sigma").isNotNull()), ["symbol"], "y", "sigma", {"z10": .1, "z50": .5, "z90": .9}, CALENDAR_ROWS)


@query("mlp04_forecast_table", f"""WITH {B.BARS}, f0 AS (SELECT *, ln(close / lag(close) OVER ({WS})) AS r1, ln(lead(close, 5) OVER ({WS}) / close) AS y FROM bars), f1 AS (SELECT symbol, session, close, y, {full_sql('stddev_samp(r1)', 'r1', 21)} * sqrt(5) AS sg FROM f0),
 f2 AS (SELECT * FROM f1 WHERE y IS NOT NULL AND sg IS NOT NULL), a AS (SELECT symbol, median(y) AS anchor, avg(CAST(y > 0 AS DOUBLE)) AS base FROM f2 GROUP BY 1), z AS (SELECT symbol, quantile_cont((y - anchor) / sg, 0.1) AS z10, quantile_cont((y - anchor) / sg, 0.9) AS z90 FROM f2 JOIN a USING (symbol) GROUP BY 1),
 l AS (SELECT symbol, arg_max(close, session) AS close, arg_max(sg, session) AS sg FROM f1 WHERE sg IS NOT NULL GROUP BY 1)
 SELECT symbol, {rs('close * exp(anchor + z10 * sg)')} AS q10, {rs('close * exp(anchor)')} AS anchor_price, {rs('close * exp(anchor + z90 * sg)')} AS q90, {rs('base', 6)} AS prob_up FROM l JOIN a USING (symbol) JOIN z USING (symbol)""")
def forecast_table(spark, d):
    last = labelled(spark, d).where(F.col("sigma").isNotNull()).groupBy("symbol").agg(F.max_by(F.struct("close", "sigma"), "session").alias("z")).select("symbol", "z.*")
    j = last.join(core(spark, d), "symbol")
    q = lambda z: F.col("close") * F.exp(F.col("anchor") + z * F.col("sigma"))
    return j.select("symbol", rnd(q(F.col("z10"))).alias("q10"), rnd(q(F.lit(0.0))).alias("anchor_price"), rnd(q(F.col("z90"))).alias("q90"), rnd("base_rate", 6).alias("prob_up"))


@query("sta09_overlay_weight", f"""WITH {B.BARS}, f0 AS (SELECT symbol, session, ln(lead(close, 5) OVER ({WS}) / close) AS y, ln(close / lag(close, 5) OVER ({WS})) AS x FROM bars), f AS (SELECT * FROM f0 WHERE y IS NOT NULL AND x IS NOT NULL),
 b AS (SELECT symbol, (row_number() OVER ({WS}) - 1) // 5 AS blk, y, 0.5::DOUBLE AS p0, 1 / (1 + exp(x)) AS p1, unnest(range(11)) / 10.0 AS w FROM f),
 l AS (SELECT symbol, w, blk, avg(-CASE WHEN y > 0 THEN ln(p0) ELSE ln(1 - p0) END + CASE WHEN y > 0 THEN ln(greatest(1e-6, least(1 - 1e-6, (1 - w) * p0 + w * p1))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, (1 - w) * p0 + w * p1))) END) AS g FROM b GROUP BY 1, 2, 3),
 t AS (SELECT symbol, w, avg(g) AS gain, count(*) AS blocks, avg(g) / nullif(stddev_samp(g) / sqrt(count(*)), 0) AS t FROM l GROUP BY 1, 2)
 SELECT symbol, {rs('coalesce(arg_max(w, gain) FILTER (t >= 2 AND w > 0), 0)', 2)} AS weight, max(blocks) AS blocks FROM t GROUP BY 1""")
def overlay_weight(spark, d):
    w = by_time("symbol", "session")
    b = B.daily_bars(spark, d)
    f = b.select("symbol", "session", F.log(F.lead("close", 5).over(w) / F.col("close")).alias("y"), F.log(F.col("close") / F.lag("close", 5).over(w)).alias("x"))
    f = f.where(F.col("y").isNotNull() & F.col("x").isNotNull()).withColumns({"p0": F.lit(0.5), "p1": 1 / (1 + F.exp("x"))})
    return S.overlay_weight(f, "p0", "p1", "y", "session", 5, "symbol").select("symbol", rnd("weight", 2).alias("weight"), "blocks")


@query("sta10_verdict", f"""WITH {TRADES}, m AS (SELECT market, count(*) AS n, avg(r) AS mr, avg(r) / (stddev_samp(r) / sqrt(count(r))) AS t, avg(CAST(pnl > 0 AS DOUBLE)) AS wr FROM trades GROUP BY 1),
 c AS (SELECT market, CAST(n >= 100 AS INT) + CAST(mr > 0 AS INT) + CAST(t >= 2 AS INT) + CAST(wr >= 0.4 AS INT) AS k FROM m) SELECT market, k AS n_passed, CASE WHEN k >= 4 THEN 'pass' WHEN k = 0 THEN 'fail' ELSE 'mixed' END AS verdict FROM c""")
def verdict(spark, d):
    t = E.trade_metrics(trades(spark, d), ["market"])
    v = S.verdict({"enough": F.col("n") >= 100, "positive": F.col("mean_r") > 0, "significant": F.col("t_mean_r") >= 2, "wins": F.col("win_rate") >= 0.4})
    return t.select("market", v.alias("v")).select("market", F.col("v.n_passed").alias("n_passed"), F.col("v.verdict").alias("verdict"))


@query("sta11_jitter", f"""WITH {B.BARS}, j0 AS (SELECT symbol, session, close, unnest(range(1, 6)) AS run FROM bars), j1 AS (SELECT *, {uniform_sql(17, 'run', 'symbol', "(session - DATE '1970-01-01')")} AS u1,
 {uniform_sql(17 + 7919, 'run', 'symbol', "(session - DATE '1970-01-01')")} AS u2 FROM j0), j2 AS (SELECT run, symbol, session, close * (1 + 0.0005::DOUBLE * sqrt(-2 * ln(greatest(u1, 1e-12))) * cos(2 * 3.141592653589793::DOUBLE * u2)) AS c FROM j1),
 r AS (SELECT run, symbol, c / lag(c) OVER (PARTITION BY run, symbol ORDER BY session) - 1 AS r FROM j2), s AS (SELECT run, symbol, avg(r) / stddev_samp(r) AS sh FROM r GROUP BY 1, 2)
 SELECT symbol, {rs('median(sh)', 5)} AS median_sharpe, {rs('min(sh)', 5)} AS low, {rs('max(sh)', 5)} AS high FROM s GROUP BY 1""")
def jitter(spark, d):
    b = B.daily_bars(spark, d).select("symbol", "session", "open", "high", "low", "close")
    j = S.jittered(b, 5, 0.0005, 17, [F.col("symbol"), F.datediff("session", F.lit("1970-01-01").cast("date"))])
    r = j.withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("run", "symbol").orderBy("session")) - 1)
    s = r.groupBy("run", "symbol").agg((F.avg("r") / F.stddev_samp("r")).alias("sh"))
    return s.groupBy("symbol").agg(rnd(F.percentile("sh", F.lit(0.5)), 5).alias("median_sharpe"), rnd(F.min("sh"), 5).alias("low"), rnd(F.max("sh"), 5).alias("high"))


@query("sta12_sensitivity", f"""WITH {B.BARS}, {REG}, v AS (SELECT * FROM (VALUES ('base', 20, 0.9), ('adx15', 15, 0.9), ('adx25', 25, 0.9), ('rank80', 20, 0.8)) t(variant, a, k)),
 l AS (SELECT variant, symbol, session, CASE WHEN trend IS NOT NULL AND atr_rank IS NOT NULL THEN CASE WHEN atr_rank >= k AND close < sf AND NOT (NOT (close < ss AND slope < 0) AND close > ss AND slope > 0 AND adx >= a) THEN 'high_vol'
   WHEN close < ss AND slope < 0 THEN 'bear' WHEN close > ss AND slope > 0 AND adx >= a THEN 'bull' ELSE 'range' END END AS lab FROM reg, v),
 b AS (SELECT symbol, session, lab AS base FROM l WHERE variant = 'base') SELECT variant, count(*) AS n, {rs('avg(CAST(lab = base AS DOUBLE))', 6)} AS agreement, {rs("avg(CAST(lab = 'bull' AS DOUBLE))", 6)} AS bull_share FROM l JOIN b USING (symbol, session) WHERE lab IS NOT NULL GROUP BY 1""")
def sensitivity(spark, d):
    """Thresholds are columns of a short variant list, so the features are computed once."""
    f = R.trend_features(B.symbol_bars(spark, d))
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(a).alias("a"), F.lit(k).alias("k")) for n, a, k in (("base", 20.0, .9), ("adx15", 15.0, .9), ("adx25", 25.0, .9), ("rank80", 20.0, .8))])
    f = f.where(F.col("sma_slow").isNotNull() & F.col("adx").isNotNull() & F.col("slope_fast").isNotNull() & F.col("atr_rank").isNotNull())
    bear = (F.col("close") < F.col("sma_slow")) & (F.col("slope_fast") < 0)

    def label(a, k):
        bull = (F.col("close") > F.col("sma_slow")) & (F.col("slope_fast") > 0) & (F.col("adx") >= a) & ~bear
        hv = (F.col("atr_rank") >= k) & (F.col("close") < F.col("sma_fast")) & ~bull
        return F.when(hv, "high_vol").when(bear, "bear").when(bull, "bull").otherwise("range")

    x = f.withColumn("base", label(F.lit(20.0), F.lit(0.9))).withColumn("z", F.explode(v)).select("*", "z.*")
    x = x.withColumn("lab", label(F.col("a"), F.col("k")))
    return x.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("lab") == F.col("base")).cast("double")), 6).alias("agreement"),
                                    rnd(F.avg((F.col("lab") == "bull").cast("double")), 6).alias("bull_share"))


@query("sta15_holding_study", f"""WITH {B.BARS}, {B.MARKET}, b AS (SELECT symbol, session, close, row_number() OVER ({WS}) - 1 AS i, last_value(session) OVER z AS fin, last_value(close) OVER z AS lc, lead(session, 126) OVER ({WS}) AS xs, lead(close, 126) OVER ({WS}) AS xc FROM bars
  WINDOW z AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
 SELECT b.symbol, CAST(i AS INTEGER) AS entry_bar, xs IS NULL AS early, {rs('coalesce(xc, lc) * 0.999::DOUBLE / (b.close * 1.001::DOUBLE) - 1', 6)} AS ret, {rs('coalesce(xc, lc) * 0.999::DOUBLE / (b.close * 1.001::DOUBLE) - 1 - (m2.close / m1.close - 1)', 6)} AS excess
 FROM b JOIN mkt m1 ON m1.session = b.session JOIN mkt m2 ON m2.session = coalesce(xs, fin) WHERE i IN (0, 21, 126)""")
def holding_study(spark, d):
    h = V.holding_study(B.daily_bars(spark, d), B.market_bars(spark, d))
    return h.select("symbol", "entry_bar", "early", rnd("ret", 6).alias("ret"), rnd("excess", 6).alias("excess"))


@query("sta16_climatology_folds", f"""WITH {B.BARS}, l AS (SELECT symbol, row_number() OVER ({WS}) AS i, ln(lead(close, 5) OVER ({WS}) / close) AS y FROM bars), m AS (SELECT symbol, max(i) AS mx FROM l GROUP BY 1), f AS (SELECT symbol, unnest(range(250, mx + 1, 100)) AS fold FROM m WHERE mx >= 250)
 SELECT l.symbol, CAST(fold AS INTEGER) AS fold, count(*) AS n_train, {rs('avg(CAST(y > 0 AS DOUBLE))', 6)} AS base_rate, {rs('quantile_cont(y, 0.1)', 6)} AS q10, {rs('quantile_cont(y, 0.9)', 6)} AS q90 FROM l JOIN f ON l.symbol = f.symbol AND i + 5 <= fold WHERE y IS NOT NULL GROUP BY 1, 2""")
def climatology(spark, d):
    l = labelled(spark, d).select("symbol", "i", "y")
    c = S.climatology_folds(l, "symbol", "i", "y", 5, 100, 250, {"q10": .1, "q90": .9})
    return c.select("symbol", "fold", "n_train", rnd("base_rate", 6).alias("base_rate"), rnd("q10", 6).alias("q10"), rnd("q90", 6).alias("q90"))


@query("sta17_offset_spread")
def offset_spread(spark, d):
    """Median and range over all rebalance offsets of the portfolio summary."""
    p = X.rank_portfolio(composite_panel(spark, d), hold=21, min_names=10, offsets="all")
    s = X.summarize_portfolio(p, 21, by=("offset",))
    return s.agg(F.count(F.lit(1)).alias("offsets"), *[rnd(f(x), 5).alias(f"{n}_{x}") for x in ("cagr", "sharpe") for n, f in
                                                       (("min", F.min), ("median", lambda c: F.percentile(c, F.lit(0.5))), ("max", F.max))])


@query("agg40_calendar_portfolio", f"""WITH {B.BARS}, {B.REPORTS}, e AS (SELECT symbol, date AS st, date + 30 AS fin FROM rep), r AS (SELECT symbol, session, close / lag(close) OVER ({WS}) - 1 AS ret FROM bars)
 SELECT {ds('r.session')} AS session, {rs('avg(ret)', 6)} AS ret, count(*) AS open_events FROM r JOIN e ON r.symbol = e.symbol AND r.session BETWEEN e.st AND e.fin WHERE ret IS NOT NULL GROUP BY 1""")
def calendar_portfolio(spark, d):
    w = by_time("symbol", "session")
    r = B.daily_bars(spark, d).select("symbol", "session", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where(F.col("ret").isNotNull())
    e = B.reports(spark, d).select("symbol", F.col("date").alias("st"), F.date_add("date", 30).alias("fin"))
    return V.calendar_portfolio(e, r, "st", "fin").select(day().alias("session"), rnd("ret", 6).alias("ret"), "open_events")


SIGNALS = f"""sg0 AS (SELECT *, {TR} AS tr, {full_sql('max(high)', 'high', 20, -1)} AS hh FROM bars), {ewm_sql('sg0', 'sg', {'atr': ('tr', 1 / 14, 14)})},
 n AS (SELECT *, row_number() OVER ({WS}) AS rn, count(*) OVER (PARTITION BY symbol) AS nb FROM sg), en AS (SELECT *, lead(open) OVER ({WS}) AS entry FROM n),
 s AS (SELECT symbol, session, rn, nb, entry, 2 * atr AS sd, entry - 2 * atr AS stp, entry + 4 * atr AS tgt FROM en WHERE close > hh AND atr IS NOT NULL AND entry IS NOT NULL),
 h AS (SELECT s.symbol, s.session, min(b.rn) AS hrn FROM s JOIN n b ON b.symbol = s.symbol AND b.rn > s.rn AND b.rn <= s.rn + 20 AND (b.low <= s.stp OR b.high >= s.tgt) GROUP BY 1, 2),
 o AS (SELECT s.*, h.hrn, b.open AS bo, b.low AS bl FROM s LEFT JOIN h USING (symbol, session) LEFT JOIN n b ON b.symbol = s.symbol AND b.rn = h.hrn),
 p AS (SELECT o.*, CASE WHEN hrn IS NULL THEN 'time' WHEN bl <= stp THEN 'stop' ELSE 'target' END AS reason, CASE WHEN hrn IS NULL THEN (SELECT close FROM n WHERE n.symbol = o.symbol AND n.rn = o.rn + 20)
   WHEN bl <= stp THEN CASE WHEN hrn = rn + 1 THEN stp ELSE least(bo, stp) END ELSE CASE WHEN hrn = rn + 1 THEN tgt ELSE greatest(bo, tgt) END END AS xp FROM o WHERE hrn IS NOT NULL OR rn + 20 <= nb)"""


def touch(spark, d):
    b = I.add_atr(B.symbol_bars(spark, d), 14, out="atr")
    from tapegrain.operators.kernels import full, trailing
    hh = full(F.max("high"), "high", trailing(by_time("symbol", "session"), 20, -1), 20)
    b = b.withColumns({"_sig": F.coalesce(F.col("close") > hh, F.lit(False)) & F.col("atr").isNotNull(), "_sd": 2 * F.col("atr")})
    return V.first_touch(b, "_sig", "_sd")


@query("seq21_first_touch", f"""WITH {B.BARS}, {SIGNALS} SELECT symbol, {ds()} AS session, reason, {rs('xp')} AS exit_price, {rs('xp * 0.9995::DOUBLE / (entry * 1.0005::DOUBLE) - 1', 6)} AS ret,
 {rs('(xp * 0.9995::DOUBLE / (entry * 1.0005::DOUBLE) - 1) * entry / sd', 5)} AS r FROM p""")
def first_touch(spark, d):
    return touch(spark, d).select("symbol", day().alias("session"), "reason", rnd("exit_price").alias("exit_price"), rnd("ret", 6).alias("ret"), rnd("r", 5).alias("r"))


@query("seq16_walk_forward_folds", f"""WITH {B.BARS}, {SIGNALS}, e AS (SELECT symbol, session, (SELECT session FROM n WHERE n.symbol = p.symbol AND n.rn = coalesce(p.hrn, p.rn + 20)) AS xs FROM p),
 f AS (SELECT fold, make_date(fold, 1, 1) - 10 AS cutoff FROM (SELECT DISTINCT year(session) AS fold FROM e) WHERE fold >= 1998)
 SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (xs < cutoff) AS n_train, count(*) FILTER (xs >= cutoff AND year(session) = fold) AS n_test FROM e, f GROUP BY 1""")
def walk_forward_folds(spark, d):
    t = touch(spark, d)
    folds = S.fold_dim(t.select(F.year("session").alias("year")).distinct(), 1998, 10)
    g = S.walk_forward(t, folds, "session", "exit_session").groupBy("fold").agg(F.count(F.when(F.col("role") == "train", 1)).alias("n_train"), F.count(F.when(F.col("role") == "test", 1)).alias("n_test"))
    return g


@query("agg36_gate_outcomes", """WITH g AS (SELECT l_orderkey, l_suppkey AS symbol, l_partkey % 50 AS bar, CASE l_returnflag WHEN 'R' THEN 'veto' WHEN 'A' THEN 'approve' ELSE 'downsize' END AS decision, l_discount * 10 - 0.5::DOUBLE AS r, l_linenumber, l_partkey FROM lineitem),
 k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY symbol, bar ORDER BY l_orderkey, l_linenumber, l_partkey) = 1)
 SELECT decision, count(*) AS n, """ + rs("avg(r)", 6) + """ AS mean_r, """ + rs("sum(CASE decision WHEN 'veto' THEN -r WHEN 'downsize' THEN -0.5 * r ELSE 0 END)") + """ AS r_avoided FROM k GROUP BY 1""")
def gate_outcomes(spark, d):
    from tapegrain.operators.joins import keep_first
    li = B.table(spark, d, "lineitem")
    g = li.select("l_orderkey", F.col("l_suppkey").alias("symbol"), (F.col("l_partkey") % 50).alias("bar"), F.when(F.col("l_returnflag") == "R", "veto").when(F.col("l_returnflag") == "A", "approve").otherwise("downsize").alias("decision"),
                  (F.col("l_discount") * 10 - 0.5).alias("r"), "l_linenumber", "l_partkey")
    k = keep_first(g, ["symbol", "bar"], ["l_orderkey", "l_linenumber", "l_partkey"])
    avoided = F.when(F.col("decision") == "veto", -F.col("r")).when(F.col("decision") == "downsize", -0.5 * F.col("r")).otherwise(0.0)
    return k.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("r"), 6).alias("mean_r"), rnd(F.sum(avoided)).alias("r_avoided"))


@query("agg37_kept_vs_skipped", f"""WITH {COMP}, {SC}, k AS (SELECT score >= 0.1 AS kept, y FROM sr) SELECT kept, count(*) AS n, {rs('avg(y)', 5)} AS mean_y, {rs('avg(CAST(y > 0 AS DOUBLE))', 6)} AS win_rate FROM k GROUP BY 1""")
def kept_vs_skipped(spark, d):
    k = scored_forward(spark, d).withColumn("kept", F.col("score") >= 0.1)
    return k.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("y"), 5).alias("mean_y"), rnd(F.avg((F.col("y") > 0).cast("double")), 6).alias("win_rate"))
