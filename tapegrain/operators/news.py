"""News features on the bars of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.operators.kernels import asof_join, by_time, clip, trailing


def daily_news(articles: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean and relevance-weighted sentiment, count and its 30-row z of the articles of each bar's own day.

    ``articles``: symbol, session, sentiment, relevance. Weights that sum to zero give the plain mean; days
    without articles are zero.
    """
    weight = F.nullif(F.sum("relevance"), F.lit(0.0))
    a = articles.groupBy("symbol", "session").agg(F.avg("sentiment").alias("_m"), F.coalesce(F.sum(F.col("sentiment") * F.col("relevance")) / weight, F.avg("sentiment")).alias("_w"), F.count("sentiment").alias("_n"))
    d = bars.select("symbol", "session").join(a, ["symbol", "session"], "left")
    d = d.select("symbol", "session", F.coalesce("_m", F.lit(0.0)).alias("news_mean"), F.coalesce("_w", F.lit(0.0)).alias("news_weighted"), F.coalesce("_n", F.lit(0)).cast("double").alias("news_count"))
    f = trailing(by_time("symbol", "session"), 30)
    z = (F.col("news_count") - F.avg("news_count").over(f)) / (F.stddev_samp("news_count").over(f) + 1e-9)
    return d.withColumn("news_count_z", F.when(F.count("news_count").over(f) >= 5, F.coalesce(z, F.lit(0.0))).otherwise(0.0))


def news_attention(articles: DataFrame, bars: DataFrame) -> DataFrame:
    """Five-bar article count (log), its z over a year, and mean sentiment over 5 and 21 bars.

    An article belongs to the first bar on or after its session; articles after the last bar are left out.
    """
    days = articles.groupBy("symbol", "session").agg(F.count("*").alias("_n"), F.sum("sentiment").alias("_s"), F.count("sentiment").alias("_k"))
    at = asof_join(days, bars.select("symbol", "session", F.col("session").alias("_at")), "symbol", "session", "session", {"_at": "bar"}, direction="forward")
    per = at.where("bar is not null").groupBy("symbol", F.col("bar").alias("session")).agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_k")])
    d = bars.select("symbol", "session").join(per, ["symbol", "session"], "left").fillna(0, ["_n", "_s", "_k"])
    w = by_time("symbol", "session")
    d = d.withColumn("_n5", F.sum("_n").over(trailing(w, 5)).cast("double"))
    mean = lambda n: F.coalesce(F.sum("_s").over(trailing(w, n)) / F.nullif(F.sum("_k").over(trailing(w, n)), F.lit(0)), F.lit(0.0))
    year = trailing(w, 252)
    z = F.when(F.count("_n5").over(year) >= 60, (F.col("_n5") - F.avg("_n5").over(year)) / (F.stddev_samp("_n5").over(year) + 1e-9))
    d = d.select("symbol", "session", F.log1p("_n5").alias("news_n_5"), clip(F.coalesce(z, F.lit(0.0)), -5.0, 10.0).alias("news_att_z"), mean(5).alias("news_sent_5"), mean(21).alias("news_sent_21"))
    return d.withColumn("news_sent_chg", F.col("news_sent_5") - F.col("news_sent_21"))
