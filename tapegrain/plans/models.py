"""Event rows, fold-wise classifiers, blends and windows for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.operators import factors as X
from tapegrain.operators import learning as L
from tapegrain.operators import stats as S
from tapegrain.operators.kernels import by_time
from tapegrain.plans.catalog import day, ds, query, rnd, rs
from tapegrain.plans.evaluation import FC, forecasts
from tapegrain.plans.studies import SIGNALS, touch
from tapegrain.plans.windows import WS, full_sql
from tapegrain.session import materialize

FEATS = ["ret_5", "ret_20", "vol_ratio", "gap_atr", "volume_ratio", "crowd"]


def win_rows(spark, d):
    t = touch(spark, d).select("symbol", "session", F.lit(1).alias("side"), "exit_session", (F.col("r") > 0).cast("int").alias("win"), "r")
    f = X.event_features(B.symbol_bars(spark, d)).select("symbol", "session", *X.EVENT_FEATURES)
    return L.event_rows(t, f, ["ret_5", "ret_20", "gap_atr"])


@query("mlp01_event_rows", f"""WITH {B.BARS}, {SIGNALS}, e AS (SELECT p.symbol, p.session, (xp * 0.9995::DOUBLE / (entry * 1.0005::DOUBLE) - 1) > 0 AS win FROM p), c AS (SELECT session, count(*) AS crowd FROM e GROUP BY 1),
 f AS (SELECT symbol, session, close / lag(close, 5) OVER ({WS}) - 1 AS ret_5 FROM bars) SELECT e.symbol, {ds('e.session')} AS session, CAST(win AS INTEGER) AS win, crowd, {rs('ret_5', 6)} AS ret_5 FROM e JOIN c USING (session) JOIN f ON f.symbol = e.symbol AND f.session = e.session""")
def event_rows(spark, d):
    return win_rows(spark, d).select("symbol", day().alias("session"), "win", "crowd", rnd("ret_5", 6).alias("ret_5"))


def fold_rows(spark, d):
    e = materialize(win_rows(spark, d), "win_rows")  # every fold reads it
    return S.walk_forward(e, S.fold_dim(e.select(F.year("session").alias("year")).distinct(), 0, 10), "session", "exit_session")


@query("mlp02_fold_scores")
def fold_scores(spark, d):
    """A logistic win classifier per test year; fitted models are no SQL."""
    rows = fold_rows(spark, d)
    s = L.fit_folds(rows, FEATS, sorted(r["fold"] for r in rows.select("fold").distinct().collect()))  # one a year
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("p"), 4).alias("mean_p"), rnd(F.avg(F.when(F.col("kept"), F.col("r"))), 4).alias("kept_r"),
                                 rnd(F.avg(F.when(~F.col("kept"), F.col("r"))), 4).alias("skipped_r"))


@query("mlp11_importances")
def importances(spark, d):
    rows = materialize(win_rows(spark, d), "win_rows")
    m = L.classifier(FEATS, "trees").fit(rows)
    return L.importances(spark, m, FEATS, 5)


@query("mlp05_blend", f"""WITH {B.BARS}, {FC}, l AS (SELECT symbol, session, horizon, 'clim' AS model, p10, p50, p90 FROM fc WHERE target <= fin UNION ALL SELECT symbol, session, horizon, 'flat', p10, last_price, p90 FROM fc WHERE target <= fin),
 w AS (SELECT *, CASE WHEN model = 'clim' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w FROM l )
 SELECT symbol, {ds()} AS session, horizon, {rs('exp(sum(w * ln(p50)) / sum(w))', 3)} AS p50, {rs('exp(sum(w * ln(p50)) / sum(w)) * exp(sum(w * ln(p10 / p50)) / sum(w))', 3)} AS p10 FROM w GROUP BY 1, w.session, horizon""")
def blend(spark, d):
    f = forecasts(spark, d).withColumn("regime", F.lit("any"))
    two = F.explode(F.array(F.struct(F.lit("clim").alias("model"), F.col("p50").alias("mid")), F.struct(F.lit("flat").alias("model"), F.col("last_price").alias("mid"))))
    l = f.select("symbol", "session", "horizon", "regime", "p10", "p90", two.alias("z")).select("symbol", "session", "horizon", "regime", "p10", "p90", "z.model", F.col("z.mid").alias("p50"))
    b = L.blend_forecasts(l, {"any": {"clim": 0.6, "flat": 0.4}}, ["symbol", "session", "horizon"])
    return b.select("symbol", day().alias("session"), "horizon", rnd("p50", 3).alias("p50"), rnd("p10", 3).alias("p10"))


@query("mlp06_holdout", f"""WITH {B.BARS}, f AS (SELECT symbol, session, ln(lead(close, 5) OVER ({WS}) / close) AS y, ln(close / lag(close, 5) OVER ({WS})) AS p FROM bars), g AS (SELECT * FROM f WHERE y IS NOT NULL AND p IS NOT NULL),
 r AS (SELECT *, percent_rank() OVER (PARTITION BY symbol ORDER BY session) AS r FROM g) SELECT symbol, count(*) AS n, {rs('avg(CAST((y > 0) = (p > 0) AS DOUBLE))', 6)} AS hit_rate, {rs('avg(abs(y - p))', 5)} AS mae, {rs('avg(CAST(y > 0 AS DOUBLE))', 6)} AS up_rate FROM r WHERE r >= 0.8 GROUP BY 1""")
def holdout(spark, d):
    w = by_time("symbol", "session")
    b = B.daily_bars(spark, d)
    f = b.select("symbol", "session", F.log(F.lead("close", 5).over(w) / F.col("close")).alias("y"), F.log(F.col("close") / F.lag("close", 5).over(w)).alias("p")).dropna()
    return L.holdout_metrics(f, "symbol", "session", "y", "p").select("symbol", "n", rnd("hit_rate", 6).alias("hit_rate"), rnd("mae", 5).alias("mae"), rnd("up_rate", 6).alias("up_rate"))


@query("mlp08_simplex_weights", f"""WITH {B.BARS}, f AS (SELECT symbol, ln(lead(close, 5) OVER ({WS}) / close) AS y, ln(close / lag(close, 5) OVER ({WS})) AS a, ln(close / lag(close, 20) OVER ({WS})) AS b, 0.0::DOUBLE AS z FROM bars), g AS (SELECT * FROM f WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
 w AS (SELECT i / 5.0::DOUBLE AS wa, j / 5.0::DOUBLE AS wb FROM range(6) t(i), range(6) u(j) WHERE i + j <= 5), m AS (SELECT symbol, wa, wb, avg(power(y - wa * a - wb * b, 2)) AS mse FROM g, w GROUP BY 1, 2, 3)
 SELECT symbol, {rs('arg_min(wa, mse)', 2)} AS w_a, {rs('arg_min(wb, mse)', 2)} AS w_b, {rs('min(mse)', 5)} AS mse FROM m GROUP BY 1""")
def simplex(spark, d):
    w = by_time("symbol", "session")
    b = B.daily_bars(spark, d)
    lag = lambda n: F.log(F.col("close") / F.lag("close", n).over(w))
    f = b.select("symbol", F.log(F.lead("close", 5).over(w) / F.col("close")).alias("y"), lag(5).alias("a"), lag(20).alias("b"), F.lit(0.0).alias("z"))
    s = L.simplex_weights(f, ["a", "b", "z"], "y", "symbol")
    return s.select("symbol", rnd("w_a", 2).alias("w_a"), rnd("w_b", 2).alias("w_b"), rnd("mse", 5).alias("mse"))


@query("mlp09_sequence_windows", f"""WITH {B.BARS}, f AS (SELECT symbol, session, ln(close / lag(close) OVER ({WS})) AS r FROM bars), t AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM f WHERE session < DATE '1999-01-01'), g AS (SELECT symbol, session, coalesce((r - m) / s, 0) AS z FROM f, t),
 w AS (SELECT symbol, session, count(*) OVER q AS n, sum(z) OVER q AS sz, first_value(z) OVER q AS z0 FROM g WINDOW q AS ({WS} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT symbol, {ds()} AS session, {rs('sz')} AS total, {rs('z0')} AS oldest FROM w WHERE n = 10""")
def sequence_windows(spark, d):
    f = B.daily_bars(spark, d).withColumn("r", F.log(F.col("close") / F.lag("close").over(by_time("symbol", "session")))).select("symbol", "session", "r")
    s = L.sequence_windows(f, ["r"], 10, F.col("session") < "1999-01-01")
    return s.select("symbol", day().alias("session"), rnd(F.aggregate("window", F.lit(0.0), lambda a, v: a + v[0])).alias("total"), rnd(F.element_at("window", 1)[0]).alias("oldest"))
