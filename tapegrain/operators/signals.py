"""Scores and blended signals as column expressions over one row per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import by_time, clip
from tapegrain.session import materialize


def blend(parts: dict[str, float]) -> Column:
    """Weighted mean over the parts that are present; null when none is."""
    num = sum((F.coalesce(F.col(k) * v, F.lit(0.0)) for k, v in parts.items()), F.lit(0.0))
    den = sum((F.when(F.col(k).isNotNull(), v).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    return num / F.nullif(den, F.lit(0.0))


def sector_relative(bars: DataFrame, sectors: DataFrame, proxies: DataFrame) -> DataFrame:
    """Return over 21 and 63 bars minus that of the sector proxy, and a squashed blend."""
    w, wp = by_time("symbol", "session"), by_time("sector", "session")
    back = lambda n, ww: F.col("close") / F.lag("close", n).over(ww) - 1
    s = bars.select("symbol", "session", back(21, w).alias("_r21"), back(63, w).alias("_r63")).join(sectors.select("symbol", "sector"), "symbol")
    p = proxies.select("sector", "session", back(21, wp).alias("_p21"), back(63, wp).alias("_p63"))
    j = s.join(F.broadcast(p), ["sector", "session"])  # a fixed number of sectors over the calendar
    j = j.withColumns({"rel_21": F.col("_r21") - F.col("_p21"), "rel_63": F.col("_r63") - F.col("_p63")})
    return j.withColumn("score", F.tanh(6.7 * blend({"rel_21": 0.4, "rel_63": 0.6})))


def social_signal(posts: DataFrame) -> DataFrame:
    """Mean of self-labels or confident text scores, engagement-weighted forum mean, blend and hype.

    Needs symbol, forum, label, polarity, confidence, engagement.
    """
    forum = F.col("forum")
    s1 = F.when(~forum, F.when(F.col("label").isNotNull(), F.col("label")).when(F.col("confidence") > 0.1, F.col("polarity")))
    w = F.when(forum, F.greatest(F.lit(1.0), F.log1p("engagement")))
    g = posts.groupBy("symbol").agg(F.count(F.when(~forum, 1)).alias("_n1"), F.coalesce(F.avg(s1), F.lit(0.0)).alias("_s1"), F.count(F.when(forum, 1)).alias("_n2"),
                                    F.coalesce(F.sum(F.col("polarity") * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)).alias("_s2"))
    mix = (F.when((F.col("_n1") > 0) & (F.col("_n2") > 0), 0.6 * F.col("_s1") + 0.4 * F.col("_s2")).when(F.col("_n1") > 0, F.col("_s1")).otherwise(F.col("_s2")))
    n = F.col("_n1") + F.col("_n2")
    return g.select("symbol", n.alias("n"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mix)).alias("score"), F.tanh(n / 25.0).alias("hype"))


def group_zscore(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Population z-score inside each group; 0 for single rows and flat groups.

    Group moments are aggregated and joined back, so a group of any size needs no single task.
    """
    g = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"), F.count(value).alias("_n"))
    z = F.when((F.col("_n") < 2) | (F.col("_sd") < 1e-12), 0.0).otherwise((F.col(value) - F.col("_m")) / F.nullif("_sd", F.lit(0.0)))
    return df.join(g, group).withColumn(out, z).drop("_m", "_sd", "_n")


def quality_picks(df: DataFrame, factors, n: int) -> DataFrame:
    """Sum of median-imputed population z-scores; best ``n`` at equal weight."""
    from tapegrain.operators.kernels import exact_quantiles
    base = materialize(df, "factors")  # one row per symbol, read by every median below
    d = base
    for x in factors:
        m = exact_quantiles(base, [], x, {f"_md_{x}": 0.5})
        d = d.join(F.broadcast(m)).withColumn(f"_f_{x}", F.coalesce(F.col(x), F.col(f"_md_{x}")))
    t = d.agg(*[F.avg(f"_f_{x}").alias(f"_a_{x}") for x in factors], *[F.stddev_pop(f"_f_{x}").alias(f"_s_{x}") for x in factors])
    d = d.join(F.broadcast(t))
    z = sum(((F.col(f"_f_{x}") - F.col(f"_a_{x}")) / F.nullif(f"_s_{x}", F.lit(0.0)) for x in factors), F.lit(0.0))
    return d.withColumn("z", z).orderBy(F.desc(F.round("z", 8)), "symbol").limit(n).withColumn("weight", F.lit(1.0 / n))


# Weights of the market composite used here.
COMPOSITE_WEIGHTS = {"trend": 0.3, "momentum": 0.2, "breadth": 0.2, "credit": 0.3}


def market_composite(market: DataFrame, proxies: DataFrame, breadth_proxy: str, credit_proxy: str) -> DataFrame:
    """Risk-on score per session from trend, momentum, breadth and credit parts that are present."""
    from tapegrain.functions.indicators import sma
    w, wp = by_time("symbol", "session"), by_time("sector", "session")
    unit = lambda x: clip(x, -1.0, 1.0)
    m = market.withColumns({"_s50": sma("close", 50), "_s200": sma("close", 200), "_r20": (F.col("close") / F.lag("close", 20).over(w) - 1) * 100})
    p = proxies.withColumn("_r", (F.col("close") / F.lag("close", 20).over(wp) - 1) * 100)
    p = p.groupBy("session").agg(F.max(F.when(F.col("sector") == breadth_proxy, F.col("_r"))).alias("_b"), F.max(F.when(F.col("sector") == credit_proxy, F.col("_r"))).alias("_c"))
    j = m.join(F.broadcast(p), "session", "left")
    half = lambda c: F.when(F.col("close") > F.col(c), 0.5).otherwise(-0.5)
    j = j.withColumns({"trend": F.when(F.col("_s50").isNotNull(), unit(half("_s50") + F.when(F.col("_s200").isNull(), half("_s50")).otherwise(half("_s200")))),
                       "momentum": unit(F.col("_r20") / 5), "breadth": unit((F.col("_b") - F.col("_r20")) / 3), "credit": unit((F.col("_c") - F.col("_b")) / 3)})
    j = j.withColumn("composite", blend(COMPOSITE_WEIGHTS)).where(F.col("composite").isNotNull())
    reg = F.when(F.col("composite") >= 0.245, "risk_on").when(F.col("composite") <= -0.245, "risk_off").otherwise("neutral")
    return j.select("session", "trend", "momentum", "breadth", "credit", "composite", reg.alias("regime"))


def sentiment_momentum(df: DataFrame, key: str, published: str, score: str, weight: str, as_of: Column) -> DataFrame:
    """Seven-day minus thirty-day weighted mean, squashed."""
    age = F.datediff(as_of, published)
    d = df.where((age >= 0) & (age <= 30))
    wk = age <= 7
    w = lambda cond: F.sum(F.when(cond, F.col(score) * F.col(weight))) / F.nullif(F.sum(F.when(cond, F.col(weight))), F.lit(0.0))
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(w(wk), F.lit(0.0)).alias("_7"), w(F.lit(True)).alias("_30"))
    return g.withColumn("score", F.tanh((F.col("_7") - F.col("_30")) * 1.5)).drop("_7", "_30")
