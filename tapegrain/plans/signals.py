"""Screens, blended scores and decision rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapegrain import bindings as B
from tapegrain.functions import indicators as I
from tapegrain.functions import scoring as S
from tapegrain.functions import text as T
from tapegrain.operators.kernels import by_time, roll_std, trailing
from tapegrain.plans.catalog import day, ds, query, rnd, rs
from tapegrain.plans.evaluation import AVGCOST
from tapegrain.plans.text import CLS, headlines
from tapegrain.plans.windows import DELTA, TR, WS, ewm_sql, fr, full_sql

PACK = f"""{B.BARS}, {DELTA}, t1 AS (SELECT *, {TR} AS tr FROM ud), {ewm_sql('t1', 'e1', {'au': ('up', 1 / 14, 14), 'ad': ('dn', 1 / 14, 14), 'atr': ('tr', 1 / 14, 14)})},
 f1 AS (SELECT symbol, session, close, close / lag(close, 21) OVER ({WS}) - 1 AS ret_1m, close / lag(close, 63) OVER ({WS}) - 1 AS ret_3m, 100 - 100 / (1 + au / nullif(ad, 0)) AS rsi14, atr / close AS atr_pct,
  {full_sql('avg(close)', 'close', 50)} AS sma50, {full_sql('avg(close)', 'close', 200)} AS sma200, (volume - {full_sql('avg(volume)', 'volume', 20)}) / nullif({full_sql('stddev_samp(volume)', 'volume', 20)}, 0) AS vol_z_20,
  max(close) OVER {fr(252)} AS hi, min(close) OVER {fr(252)} AS lo, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS rn FROM e1),
 {B.FUNDAMENTALS}, fl AS (SELECT symbol, arg_max(income, period_end) AS income, arg_max(units, period_end) AS units FROM fun GROUP BY 1), {CLS},
 ca AS (SELECT symbol, count(*) AS n_articles, sum(con) / nullif(sum(materiality), 0) AS catalyst_score, max(materiality) AS max_materiality, arg_max(direction, (abs(con), published, title)) AS lead_direction FROM
  (SELECT *, materiality * CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS con FROM cls) GROUP BY 1),
 pk AS (SELECT symbol, session, close, ret_1m, ret_3m, rsi14, atr_pct, vol_z_20, coalesce(close > sma50, false) AS a50, coalesce(close > sma200, false) AS a200, (hi - close) / hi AS off, greatest(0, least(1, (close - lo) / (hi - lo + 1e-9))) AS pir,
  20 * close * units / nullif(income, 0) AS pe, close * units * 10000 AS mc, n_articles, catalyst_score, max_materiality, lead_direction, catalyst_score * 0.5 AS sent, tanh(ret_1m) AS pa,
  CASE WHEN close > sma50 THEN 'up' WHEN close < sma200 THEN 'down' ELSE 'range' END AS trend FROM f1 LEFT JOIN fl USING (symbol) LEFT JOIN ca USING (symbol) WHERE rn = 1)"""


def feature_pack(spark, d):
    """One row per symbol: the last bar's features joined with fundamentals and news."""
    b = I.add_atr(I.add_rsi(B.symbol_bars(spark, d)), 14)
    # only RSI and range need the history; the rest reads the last 252 bars of each symbol as one aggregate
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    b = b.select("symbol", "session", "close", "volume", "rsi_14", "atr_14", rn.alias("rn")).where(F.col("rn") <= 252)
    at = lambda x, k: F.max(F.when(F.col("rn") == k, F.col(x)))
    near = lambda x, k: F.when(F.col("rn") <= k, F.col(x))
    mean = lambda x, k: F.when(F.count(near(x, k)) >= k, F.avg(near(x, k)))
    spread = F.when(F.count(near("volume", 20)) >= 20, F.stddev_samp(near("volume", 20)))
    close = at("close", 1)
    last = b.groupBy("symbol").agg(F.max("session").alias("session"), close.alias("close"), (close / at("close", 22) - 1).alias("ret_1m"), (close / at("close", 64) - 1).alias("ret_3m"), at("rsi_14", 1).alias("rsi_14"),
                                   (at("atr_14", 1) / close).alias("atr_pct"), mean("close", 50).alias("sma50"), mean("close", 200).alias("sma200"), F.max("close").alias("hi"), F.min("close").alias("lo"),
                                   ((at("volume", 1) - mean("volume", 20)) / F.nullif(spread, F.lit(0.0))).alias("vol_z_20"))
    fu = B.fundamentals(spark, d).groupBy("symbol").agg(F.max_by(F.struct("income", "units"), "period_end").alias("z")).select("symbol", "z.*")
    cl = T.classify(headlines(spark, d), "title")
    sign = F.when(F.col("direction") == "bullish", 1.0).when(F.col("direction") == "bearish", -1.0).otherwise(0.0)
    con = F.col("materiality") * sign
    ca = cl.withColumn("con", con).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_articles"), (F.sum("con") / F.nullif(F.sum("materiality"), F.lit(0.0))).alias("catalyst_score"),
                                                         F.max("materiality").alias("max_materiality"), F.max_by("direction", F.struct(F.abs("con"), "published", "title")).alias("lead_direction"))
    p = last.join(fu, "symbol", "left").join(ca, "symbol", "left")
    return p.select("symbol", "session", "close", "ret_1m", "ret_3m", F.col("rsi_14").alias("rsi14"), "atr_pct", "vol_z_20", F.coalesce(F.col("close") > F.col("sma50"), F.lit(False)).alias("above_sma50"),
                    F.coalesce(F.col("close") > F.col("sma200"), F.lit(False)).alias("above_sma200"), ((F.col("hi") - F.col("close")) / F.col("hi")).alias("pct_off_high"),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9))).alias("pos_in_range"),
                    (20 * F.col("close") * F.col("units") / F.nullif("income", F.lit(0.0))).alias("pe"), (F.col("close") * F.col("units") * 10000).alias("market_cap"), "n_articles", "catalyst_score",
                    "max_materiality", "lead_direction", (F.col("catalyst_score") * 0.5).alias("sentiment"), F.tanh("ret_1m").alias("pa_score"),
                    F.when(F.col("close") > F.col("sma50"), "up").when(F.col("close") < F.col("sma200"), "down").otherwise("range").alias("pa_trend"), F.col("sma50").alias("sma_50"), F.col("sma200").alias("sma_200"))


@query("sig01_feature_pack", f"""WITH {PACK} SELECT symbol, {ds()} AS session, {rs('ret_1m', 6)} AS ret_1m, {rs('ret_3m', 6)} AS ret_3m, {rs('rsi14')} AS rsi14, {rs('vol_z_20')} AS vol_z_20, a50 AS above_sma50, a200 AS above_sma200,
 {rs('off', 6)} AS pct_off_high, {rs('pir', 6)} AS pos_in_range, {rs('pe', 3)} AS pe, n_articles, {rs('catalyst_score', 6)} AS catalyst_score, lead_direction FROM pk""")
def pack(spark, d):
    p = feature_pack(spark, d)
    return p.select("symbol", day().alias("session"), *[rnd(x, 6).alias(x) for x in ("ret_1m", "ret_3m", "pct_off_high", "pos_in_range", "catalyst_score")], rnd("rsi14").alias("rsi14"), rnd("vol_z_20").alias("vol_z_20"),
                    "above_sma50", "above_sma200", rnd("pe", 3).alias("pe"), "n_articles", "lead_direction")


def _u(x):
    return f"greatest(-1, least(1, {x}))"


SCREENS = f"""scr AS (SELECT *, {_u(f'''0.18 * coalesce({_u("ret_3m * 2.5")}, 0) + 0.10 * coalesce({_u("ret_1m * 5")}, 0) + 0.08 * CASE WHEN rsi14 BETWEEN 50 AND 75 THEN 1 WHEN rsi14 > 80 THEN -0.6 WHEN rsi14 < 40 THEN -0.3 ELSE 0.3 END + 0.08 * CASE WHEN a200 THEN 0.8 ELSE -0.5 END
   + 0.14 * CASE WHEN pir BETWEEN 0.7 AND 0.92 THEN 1 WHEN pir > 0.97 THEN -0.3 WHEN pir < 0.4 THEN -0.2 ELSE 0.4 END + 0.10 * coalesce({_u("vol_z_20 * 0.5")}, 0) + 0.08 * {_u("(n_articles - 8) / 15.0")} + 0.16 * {_u("sent * 2")}
   + 0.08 * CASE WHEN coalesce(mc, 0) = 0 THEN 0 WHEN mc < 50e9 THEN 0.5 WHEN mc < 200e9 THEN 0.1 ELSE -0.3 END''')} AS rising_stars,
  {_u(f'''(CASE WHEN a50 THEN 0.5 ELSE -0.5 END + CASE WHEN a200 THEN 0.5 ELSE -0.5 END + CASE WHEN pir > 0.85 THEN 1 WHEN pir < 0.5 THEN -0.3 ELSE 0.3 END + coalesce({_u("vol_z_20 * 0.6")}, 0) + CASE WHEN rsi14 > 55 AND rsi14 < 78 THEN 0.6 ELSE -0.3 END) / 5''')} AS breakout,
  {_u(f'''(CASE WHEN pe > 0 AND pe < 18 THEN 0.8 WHEN pe > 40 THEN -0.4 ELSE 0.1 END + {_u("sent * 2")} + coalesce({_u("ret_1m * 5")}, 0) + CASE WHEN a50 THEN 0.5 ELSE -0.3 END) / 4''')} AS value_with_catalyst,
  {_u(f'''0.55 * coalesce(pa, 0) + 0.20 * CASE WHEN (trend = 'up' AND pa > 0) OR (trend = 'down' AND pa < 0) THEN 0.5 WHEN trend = 'range' THEN 0.1 ELSE -0.4 END + 0.15 * CASE WHEN pa > 0 THEN {_u("sent * 1.5")} ELSE -({_u("sent * 1.5")}) END
   + 0.10 * CASE WHEN pa > 0 THEN CASE WHEN a200 THEN 0.4 ELSE -0.5 END ELSE CASE WHEN a200 THEN -0.4 ELSE 0.4 END END''')} AS smart_money,
  {_u(f'''0.25 * CASE WHEN coalesce(mc, 0) > 5e9 THEN -1 WHEN coalesce(mc, 0) < 2e9 THEN 1 WHEN mc < 5e9 THEN 0.6 ELSE 0 END + 0.30 * CASE WHEN pe IS NULL THEN -0.2 WHEN pe > 0 AND pe < 12 THEN 1 WHEN pe >= 12 AND pe < 20 THEN 0.5 WHEN pe >= 40 THEN -0.6 ELSE 0.2 END
   + 0.30 * catalyst_score * 1.2 + 0.10 * coalesce({_u("ret_1m * 4")}, 0) + 0.05 * CASE WHEN a200 THEN 0.4 ELSE -0.4 END''')} AS underpriced_movers,
  CASE WHEN max_materiality >= 0.6 AND lead_direction = 'bullish' THEN {_u('''0.5 * max_materiality + 0.2 * catalyst_score + 0.2 * CASE WHEN ret_1m > 0.3 THEN -0.5 WHEN ret_1m > 0.1 THEN 0.2 ELSE 0.6 END + 0.1 * CASE WHEN rsi14 > 85 THEN -0.6 ELSE 0.3 END''')} ELSE 0 END AS catalyst_plays,
  greatest(0.05, least(1.3, CASE WHEN rsi14 > 80 THEN 0.45 WHEN rsi14 > 75 THEN 0.65 WHEN rsi14 > 70 THEN 0.82 ELSE 1 END * CASE WHEN off < 0.02 THEN 0.6 WHEN off < 0.05 THEN 0.82 ELSE 1 END * CASE WHEN ret_3m > 0.6 THEN 0.4 WHEN ret_3m > 0.4 THEN 0.6 WHEN ret_3m > 0.25 THEN 0.8 ELSE 1 END
   * CASE WHEN ret_1m > 0.25 THEN 0.7 ELSE 1 END * CASE WHEN a200 AND rsi14 BETWEEN 40 AND 55 THEN 1.15 WHEN a200 AND coalesce(ret_1m, 0) BETWEEN 0.05 AND 0.15 AND (rsi14 IS NULL OR rsi14 BETWEEN 50 AND 65) THEN 1.05 ELSE 1 END)) AS entry_quality FROM pk)"""


@query("sig02_screen_scores", f"WITH {PACK}, {SCREENS} SELECT symbol, {', '.join(f'{rs(s, 6)} AS {s}' for s in S.SCREENS)} FROM scr")
def screen_scores(spark, d):
    p = feature_pack(spark, d)
    return p.select("symbol", *[rnd(S.score(s), 6).alias(s) for s in S.SCREENS])


@query("sig08_entry_quality", f"WITH {PACK}, {SCREENS} SELECT symbol, {rs('entry_quality', 6)} AS entry_quality FROM scr")
def entry_quality(spark, d):
    return feature_pack(spark, d).select("symbol", rnd(S.entry_quality(), 6).alias("entry_quality"))


UNPIVOT = " UNION ALL ".join(f"SELECT symbol, '{s}' AS strategy, {s} AS score, entry_quality, close FROM scr" for s in S.SCREENS)


@query("set07_opportunities", f"""WITH {PACK}, {SCREENS}, u AS ({UNPIVOT}), h AS (SELECT * FROM u WHERE score > 0.1),
 g AS (SELECT symbol, count(*) AS n_strategies, max(round(score, 9)) AS best, arg_max(strategy, (round(score, 9), strategy)) AS best_strategy, any_value(entry_quality) AS q FROM h GROUP BY 1),
 r AS (SELECT *, least(1, best + 0.05 * (n_strategies - 1)) AS raw FROM g) SELECT symbol, n_strategies, best_strategy, {rs('raw', 6)} AS raw_score, {rs('raw * q', 6)} AS score FROM r ORDER BY round(raw * q, 9) DESC, n_strategies DESC, symbol LIMIT 50""")
def opportunities(spark, d):
    """Union of the screens per symbol with a confluence bonus, times entry quality; best first."""
    p = feature_pack(spark, d)
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.round(S.score(s), 9).alias("score")) for s in S.SCREENS])
    u = p.select("symbol", S.entry_quality().alias("q"), F.explode(each).alias("z")).select("symbol", "q", "z.*").where(F.col("score") > 0.1)
    g = u.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_strategies"), F.max("score").alias("best"), F.max_by("strategy", F.struct("score", "strategy")).alias("best_strategy"), F.first("q").alias("q"))
    g = g.withColumn("raw", F.least(F.lit(1.0), F.col("best") + 0.05 * (F.col("n_strategies") - 1))).withColumn("s", F.col("raw") * F.col("q"))
    return g.orderBy(F.desc(F.round("s", 9)), F.desc("n_strategies"), "symbol").limit(50).select("symbol", "n_strategies", "best_strategy", rnd("raw", 6).alias("raw_score"), rnd("s", 6).alias("score"))


@query("srt02_screen_top", f"WITH {PACK}, {SCREENS} SELECT symbol, {rs('rising_stars', 6)} AS score FROM scr WHERE coalesce(mc, 0) BETWEEN 1e9 AND 1e12 ORDER BY round(rising_stars, 9) DESC, symbol LIMIT 10")
def screen_top(spark, d):
    p = feature_pack(spark, d).where(F.coalesce("market_cap", F.lit(0.0)).between(1e9, 1e12)).withColumn("s", S.score("rising_stars"))
    return p.orderBy(F.desc(F.round("s", 9)), "symbol").limit(10).select("symbol", rnd("s", 6).alias("score"))


@query("sig11_sector_zscore", f"""WITH {PACK}, {SCREENS}, {B.SECTORS}, j AS (SELECT symbol, sector, rising_stars AS s FROM scr JOIN sectors USING (symbol)), g AS (SELECT sector, avg(s) AS m, stddev_pop(s) AS sd, count(*) AS n FROM j GROUP BY 1)
 SELECT symbol, sector, {rs('CASE WHEN n < 2 OR sd < 1e-12 THEN 0 ELSE (s - m) / sd END', 5)} AS z FROM j JOIN g USING (sector)""")
def sector_zscore(spark, d):
    from tapegrain.operators.signals import group_zscore
    j = feature_pack(spark, d).withColumn("s", S.score("rising_stars")).join(B.sectors(spark, d).select("symbol", "sector"), "symbol")
    return group_zscore(j, "sector", "s", "z").select("symbol", "sector", rnd("z", 5).alias("z"))


QF = ("ret_3m", "catalyst_score", "pe")


@query("sig12_quality_picks", f"""WITH {PACK}, m AS (SELECT {', '.join(f'median({x}) AS m_{x}' for x in QF)} FROM pk), f AS (SELECT symbol, {', '.join(f'coalesce({x}, m_{x}) AS {x}' for x in QF)} FROM pk, m),
 z AS (SELECT symbol, {' + '.join(f'({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0)' for x in QF)} AS z FROM f) SELECT symbol, {rs('z', 5)} AS z, {rs('1.0 / 20', 4)} AS weight FROM z ORDER BY round(z, 8) DESC, symbol LIMIT 20""")
def quality_picks(spark, d):
    from tapegrain.operators.signals import quality_picks as qp
    return qp(feature_pack(spark, d), QF, 20).select("symbol", rnd("z", 5).alias("z"), rnd("weight", 4).alias("weight"))


def rec_frame(spark, d):
    p = feature_pack(spark, d)
    w = by_time("symbol", "session")
    b = I.add_macd(B.symbol_bars(spark, d))
    b = b.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    b = b.withColumns({"_v": roll_std("_r", w, 59) * F.sqrt(F.lit(252.0)), "_s": F.col("close") / F.lag("close", 59).over(w) - 1})
    last = b.groupBy("symbol").agg(F.max_by(F.struct("macd_hist", "_v", "_s"), "session").alias("z")).select("symbol", "z.*")
    p = p.join(last, "symbol").withColumn("regime", F.when(F.col("_v").isNull(), "sideways").otherwise(S.vol_slope_regime(F.col("_v"), F.col("_s"))))
    tech, drivers = S.technical()
    p = p.withColumns({"technical": tech, "drivers": drivers, "eps": F.lit(1.0), "forecast": F.tanh(F.coalesce("ret_3m", F.lit(0.0)))})
    p = p.withColumn("fundamental", S.fundamental())
    score, conf = S.recommendation(F.col("regime"), F.col("forecast"), F.col("technical"), F.col("fundamental"), F.coalesce("sentiment", F.lit(0.0)), F.coalesce("pa_score", F.lit(0.0)))
    return p.withColumns({"rec_score": score, "rec_conf": conf})


_MACD = f"""{ewm_sql('bars', 'em', {'f12': ('close', 2 / 13, 12), 's26': ('close', 2 / 27, 26)})}, mm1 AS (SELECT symbol, session, close, f12 - s26 AS macd FROM em), {ewm_sql('mm1', 'mg', {'sig': ('macd', 0.2, 9)})},
 mr1 AS (SELECT *, close / lag(close) OVER ({WS}) - 1 AS r FROM mg), mv1 AS (SELECT symbol, session, macd - sig AS hist, {full_sql('stddev_samp(r)', 'r', 59)} * sqrt(252) AS v, close / lag(close, 59) OVER ({WS}) - 1 AS sl FROM mr1),
 ml1 AS (SELECT symbol, arg_max(hist, session) AS hist, arg_max(v, session) AS v, arg_max(sl, session) AS sl FROM mv1 GROUP BY 1),
 rp AS (SELECT pk.*, hist, CASE WHEN v IS NULL THEN 'sideways' WHEN sl > 0.02 THEN CASE WHEN v > 0.25 THEN 'bull_high_vol' ELSE 'bull_low_vol' END WHEN sl < -0.02 THEN CASE WHEN v > 0.25 THEN 'bear_high_vol' ELSE 'bear_low_vol' END ELSE 'sideways' END AS regime,
  CASE WHEN rsi14 < 30 THEN 0.3::DOUBLE WHEN rsi14 > 70 THEN -0.3::DOUBLE ELSE 0 END + CASE WHEN hist IS NULL THEN 0 WHEN hist > 0 THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END + CASE WHEN a50 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END + CASE WHEN a200 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END AS tech,
  CASE WHEN pe > 0 AND pe < 15 THEN 0.25::DOUBLE WHEN pe > 40 THEN -0.15::DOUBLE ELSE 0 END + 0.05::DOUBLE AS fund, tanh(coalesce(ret_3m, 0)) AS fcs FROM pk JOIN ml1 USING (symbol)),
 rw AS (SELECT *, CASE regime {' '.join(f"WHEN '{k}' THEN {w['forecast']} * fcs + {w['technical']} * tech + {w['fundamental']} * fund + {w['sentiment']} * coalesce(sent, 0) + {w['price_action']} * coalesce(pa, 0)" for k, w in S.REGIME_WEIGHTS.items())} END AS rec,
  list_filter([fcs, tech, fund, coalesce(sent, 0), coalesce(pa, 0)], lambda z: abs(z) > 0.05) AS lv FROM rp),
 rx AS (SELECT *, greatest(0.1, least(0.95, 0.4 + 0.5 * CASE WHEN len(lv) = 0 THEN 0.5 ELSE greatest(len(list_filter(lv, lambda z: z > 0)), len(list_filter(lv, lambda z: z < 0))) / CAST(len(lv) AS DOUBLE) END)) AS conf FROM rw)"""


@query("sig14_recommendation", f"WITH {PACK}, {_MACD} SELECT symbol, regime, {rs('tech', 5)} AS technical, {rs('fund', 5)} AS fundamental, {rs('rec', 5)} AS score, {rs('conf', 5)} AS confidence FROM rx")
def recommendation(spark, d):
    p = rec_frame(spark, d)
    return p.select("symbol", "regime", rnd("technical", 5).alias("technical"), rnd("fundamental", 5).alias("fundamental"), rnd("rec_score", 5).alias("score"), rnd("rec_conf", 5).alias("confidence"))


@query("sig15_opinion")
def opinion(spark, d):
    """Seven signals per symbol joined and blended into one verdict."""
    from tapegrain.operators.disclosures import insider_signal, political_signal
    as_of = F.lit("1998-06-30").cast("date")
    f = B.filings(spark, d)
    ins = insider_signal(f, as_of).select(F.col("issuer").alias("symbol"), F.col("score").alias("insider"))
    pol = political_signal(f, as_of, {}).select(F.col("issuer").alias("symbol"), F.col("score").alias("political"))
    p = rec_frame(spark, d).join(ins, "symbol", "left").join(pol, "symbol", "left").fillna(0.0, ["insider", "political"])
    s, conf, verdict = S.opinion(F.col("regime"), F.col("rec_score"), F.col("rec_conf"), F.coalesce("ret_1m", F.lit(0.0)) * 0.1, F.coalesce("pa_score", F.lit(0.0)), F.lit(0.0), F.col("insider"), F.lit(0.0), F.col("political"))
    return p.select("symbol", rnd(s, 5).alias("score"), rnd(conf, 5).alias("confidence"), verdict.alias("verdict"))


@query("sig16_report_signals", f"""WITH {B.REPORTS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM rep WHERE date <= DATE '1998-06-30'),
 a AS (SELECT symbol, max(surprise) FILTER (rn = 1) AS s1, DATE '1998-06-30' - max(date) AS days, sum(tanh(surprise / 10.0) * CASE rn WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0.1 END) / sum(CASE rn WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0.1 END) AS blend FROM r WHERE rn <= 4 GROUP BY 1)
 SELECT symbol, {rs('CASE WHEN days BETWEEN 0 AND 90 THEN greatest(-1, least(1, sign(s1) * sqrt(abs(s1) / 10.0) * greatest(0, 1 - days / 60.0))) ELSE 0 END', 6)} AS drift, {rs('blend', 6)} AS blend FROM a""")
def report_signals(spark, d):
    r = B.reports(spark, d).where(F.col("date") <= "1998-06-30")
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    k = r.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 4)
    a = k.groupBy("symbol").agg(F.transform(F.array_sort(F.array_agg(F.struct("rn", "surprise"))), lambda z: z["surprise"]).alias("ss"), F.datediff(F.lit("1998-06-30").cast("date"), F.max("date")).alias("days"))
    return a.select("symbol", rnd(S.drift_after_report(F.element_at("ss", 1), F.col("days")), 6).alias("drift"), rnd(S.surprise_blend(F.col("ss")), 6).alias("blend"))


@query("sig20_market_composite", f"""WITH {B.BARS}, {B.MARKET}, {B.SECTORS}, {B.SECTOR_BARS}, m AS (SELECT session, close, {full_sql('avg(close)', 'close', 50)} AS s50, {full_sql('avg(close)', 'close', 200)} AS s200, (close / lag(close, 20) OVER ({WS}) - 1) * 100 AS r20 FROM mkt),
 s AS (SELECT session, max(r) FILTER (sector = 'ASIA') AS asia, max(r) FILTER (sector = 'EUROPE') AS eu FROM (SELECT sector, session, (close / lag(close, 20) OVER (PARTITION BY sector ORDER BY session) - 1) * 100 AS r FROM sector_bars) GROUP BY 1),
 p AS (SELECT session, CASE WHEN s50 IS NULL THEN NULL ELSE greatest(-1, least(1, CASE WHEN close > s50 THEN 0.5 ELSE -0.5 END + CASE WHEN s200 IS NULL THEN CASE WHEN close > s50 THEN 0.5 ELSE -0.5 END WHEN close > s200 THEN 0.5 ELSE -0.5 END)) END AS trend,
  CASE WHEN r20 IS NOT NULL THEN greatest(-1, least(1, r20 / 5)) END AS momentum, CASE WHEN asia - r20 IS NOT NULL THEN greatest(-1, least(1, (asia - r20) / 3)) END AS breadth, CASE WHEN eu - asia IS NOT NULL THEN greatest(-1, least(1, (eu - asia) / 3)) END AS credit FROM m LEFT JOIN s USING (session)),
 c AS (SELECT *, (coalesce(0.3 * trend, 0) + coalesce(0.2 * momentum, 0) + coalesce(0.2 * breadth, 0) + coalesce(0.3 * credit, 0)) / nullif((CASE WHEN trend IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN momentum IS NULL THEN 0 ELSE 0.2 END) + (CASE WHEN breadth IS NULL THEN 0 ELSE 0.2 END) + (CASE WHEN credit IS NULL THEN 0 ELSE 0.3 END), 0) AS comp FROM p)
 SELECT {ds()} AS session, {rs('comp', 5)} AS composite, CASE WHEN comp >= 0.245 THEN 'risk_on' WHEN comp <= -0.245 THEN 'risk_off' ELSE 'neutral' END AS regime FROM c WHERE comp IS NOT NULL""")
def market_composite(spark, d):
    from tapegrain.operators.signals import market_composite as mc
    c = mc(B.market_bars(spark, d), B.sector_bars(spark, d), "ASIA", "EUROPE")
    return c.select(day().alias("session"), rnd("composite", 5).alias("composite"), "regime")


@query("sig24_sentiment_momentum", f"""WITH {CLS}, a AS (SELECT symbol, DATE '1998-06-30' - published AS age, CASE direction WHEN 'bullish' THEN materiality WHEN 'bearish' THEN -materiality ELSE 0 END AS s, materiality AS c FROM cls),
 g AS (SELECT symbol, coalesce(sum(s * c) FILTER (age <= 7) / nullif(sum(c) FILTER (age <= 7), 0), 0) AS s7, sum(s * c) / nullif(sum(c), 0) AS s30, count(*) AS n FROM a WHERE age BETWEEN 0 AND 30 GROUP BY 1) SELECT symbol, n, {rs('tanh((s7 - s30) * 1.5)', 6)} AS score FROM g""")
def sentiment_momentum(spark, d):
    from tapegrain.operators.signals import sentiment_momentum as sm
    h = T.classify(headlines(spark, d), "title")
    s = F.when(F.col("direction") == "bullish", F.col("materiality")).when(F.col("direction") == "bearish", -F.col("materiality")).otherwise(0.0)
    return sm(h.withColumn("s", s), "symbol", "published", "s", "materiality", F.lit("1998-06-30").cast("date")).select("symbol", "n", rnd("score", 6).alias("score"))


@query("sig25_position_review", f"""WITH RECURSIVE {AVGCOST}, {PACK}, v AS (SELECT portfolio, f.symbol, (close - cost / held) / (cost / held) * 100 AS pnl, trend, coalesce(sent, 0) + coalesce(pa, 0) * 0.5 AS rec, atr_pct * 200 AS sd FROM fin f JOIN pk ON pk.symbol = f.symbol WHERE held > 0 AND cost > 0),
 a AS (SELECT *, CASE WHEN pnl >= -15 AND pnl < -8 THEN 1 ELSE 0 END + CASE WHEN sd < 3 THEN 1 ELSE 0 END + CASE WHEN rec < -0.2 AND pnl > 0 THEN 1 ELSE 0 END + CASE WHEN trend = 'down' THEN 1 ELSE 0 END AS warns FROM v)
 SELECT portfolio, symbol, {rs('pnl', 4)} AS pnl_pct, CASE WHEN pnl < -15 THEN 'STOP_OUT' WHEN rec < -0.3 AND pnl > 5 THEN 'SELL' WHEN rec < -0.1 AND warns >= 2 THEN 'TRIM' WHEN rec > 0.3 AND pnl < 5 AND trend = 'up' THEN 'ADD' ELSE 'HOLD' END AS verdict,
 CASE WHEN pnl < -15 THEN 'drawdown' WHEN pnl < -8 THEN 'drawdown' WHEN sd < 3 THEN 'stop_approaching' WHEN rec < -0.2 AND pnl > 0 THEN 'thesis_change' WHEN trend = 'down' THEN 'trend_flip' END AS first_alert FROM a""")
def position_review(spark, d):
    from tapegrain.operators.portfolio import positions
    p = positions(B.transactions(spark, d)).where((F.col("held") > 0) & (F.col("cost") > 0))
    j = p.join(feature_pack(spark, d), "symbol")
    basis = F.col("cost") / F.col("held")
    j = j.withColumns({"pnl": (F.col("close") - basis) / basis * 100, "rec": F.coalesce("sentiment", F.lit(0.0)) + F.coalesce("pa_score", F.lit(0.0)) * 0.5})
    j = j.withColumn("alerts", S.position_alerts(F.col("pnl"), F.col("rec"), F.col("atr_pct") * 200, F.lit(None).cast("int"), F.col("pa_trend")))
    return j.select("portfolio", "symbol", rnd("pnl", 4).alias("pnl_pct"), S.position_verdict(F.col("pnl"), F.col("rec"), F.col("alerts"), F.col("pa_trend")).alias("verdict"),
                    S.first_alert(F.col("alerts"))["kind"].alias("first_alert"))


@query("sig26_thesis_status", f"""WITH {B.BARS}, px AS (SELECT symbol, arg_max(close, session) AS last FROM bars GROUP BY 1), t AS (SELECT o_orderkey AS id, l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS dir, l_extendedprice / l_quantity AS entry, DATE '1998-06-30' - CAST(o_orderdate AS DATE) AS el, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT id, t.symbol, l_linenumber, l_partkey, {rs("(last - entry) / entry * 100 * CASE WHEN dir = 'long' THEN 1 ELSE -1 END", 4)} AS pnl_pct, CASE WHEN (dir = 'long' AND last < entry * 0.8) OR (dir = 'short' AND last > entry * 1.2) THEN 'invalidated' WHEN (dir = 'long' AND last >= entry * 1.3) OR (dir = 'short' AND last <= entry * 0.7) THEN 'target_hit'
  WHEN 365 - el < 0 THEN 'expired' WHEN 365 - el <= 73 THEN 'expiring' ELSE 'on_track' END AS status FROM t JOIN px USING (symbol)""")
def thesis_status(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    li = B.lines(spark, d)
    t = li.join(o, li.l_orderkey == o.o_orderkey).withColumns({"dir": F.when(F.col("l_returnflag") == "R", "short").otherwise("long"), "left": 365 - F.datediff(F.lit("1998-06-30").cast("date"), F.to_date("o_orderdate"))})
    px = B.daily_bars(spark, d).groupBy(F.col("symbol").alias("l_suppkey")).agg(F.max_by("close", "session").alias("last"))
    j = t.join(px, "l_suppkey")
    k = lambda up, dn: F.when(F.col("dir") == "long", F.col("p") * up).otherwise(F.col("p") * dn)
    pnl = (F.col("last") - F.col("p")) / F.col("p") * 100 * F.when(F.col("dir") == "long", 1).otherwise(-1)
    st = S.thesis_status(F.col("last"), F.col("dir"), k(0.8, 1.2), k(1.3, 0.7), F.col("left"), F.lit(365))
    return j.select(F.col("o_orderkey").alias("id"), F.col("l_suppkey").alias("symbol"), "l_linenumber", "l_partkey", rnd(pnl, 4).alias("pnl_pct"), st.alias("status"))


@query("sca11_fills", f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS p, l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, CASE l_linenumber % 4 WHEN 0 THEN 'market' WHEN 1 THEN 'stop' WHEN 2 THEN 'moc' ELSE 'limit' END AS kind FROM lineitem),
 g AS (SELECT *, CASE WHEN kind = 'limit' THEN p ELSE p + side * (CASE WHEN kind = 'moc' THEN 0 ELSE greatest(0.005, p * 1.0 / 10000) END + p * CASE kind WHEN 'market' THEN 2 WHEN 'stop' THEN 5 WHEN 'moc' THEN 1 END / 10000.0) END AS px FROM f)
 SELECT l_orderkey, l_linenumber, l_partkey, {rs('px')} AS price, {rs('CASE WHEN side < 0 THEN px * q * 27.8 / 1000000 + least(0.000166 * q, 8.3) ELSE 0 END')} AS fees FROM g""")
def fills(spark, d):
    li = B.lines(spark, d)
    m = F.col("l_linenumber") % 4
    kind = F.when(m == 0, "market").when(m == 1, "stop").when(m == 2, "moc").otherwise("limit")
    f = S.fill(F.col("p"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1), kind, F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", rnd(f["price"]).alias("price"), rnd(f["fees"]).alias("fees"))


@query("sig21_invest_timing", f"""WITH {B.MARKET}, m AS (SELECT session, greatest(0, 1 - close / max(close) OVER {fr(252)}) AS dd FROM mkt), o AS (SELECT session, round(greatest(0, least(1, 0.65 * greatest(0, least(1, dd / 0.35)) + 0.35 * 0.4)), 3) AS o FROM m)
 SELECT {ds()} AS session, {rs('o', 2)} AS opportunity, CASE WHEN o >= 0.6 THEN 'STRONG_BUY' WHEN o >= 0.3 THEN 'ACCUMULATE' ELSE 'NORMAL' END AS level FROM o""")
def invest_timing(spark, d):
    w = trailing(by_time("symbol", "session"), 252)
    m = B.market_bars(spark, d).withColumn("dd", F.greatest(F.lit(0.0), 1 - F.col("close") / F.max("close").over(w)))
    o, level, _ = S.invest_timing(F.col("dd"), F.lit(-40.0))
    return m.select(day().alias("session"), rnd(o, 2).alias("opportunity"), level.alias("level"))


@query("prj13_instrument_search", """WITH q AS (SELECT DISTINCT lower(r_name) AS query, r_name AS u FROM region), i AS (SELECT c_mktsegment || '-' || c_custkey AS symbol, c_name || ' ' || r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 s AS (SELECT query, symbol, CASE WHEN upper(symbol) = u THEN 100 WHEN starts_with(upper(symbol), u) THEN 80 WHEN contains(upper(symbol), u) THEN 60 WHEN starts_with(upper(name), u) THEN 50 WHEN contains(upper(name), u) THEN 30 ELSE 0 END AS score FROM i, q)
 SELECT query, symbol, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, symbol) AS INTEGER) AS place FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, symbol) <= 20""")
def instrument_search(spark, d):
    from tapegrain.sources.queries import search_instruments
    r = B.table(spark, d, "region")
    n = F.broadcast(B.table(spark, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")))
    i = B.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string")).alias("symbol"), F.concat_ws(" ", "c_name", "r_name").alias("name"))
    return search_instruments(r.select(F.lower("r_name").alias("query")).distinct(), i, 20).select("query", "symbol", "score", "place")
