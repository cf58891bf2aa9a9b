"""Quarterly accounts as first reported, with the day each figure became known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.operators.kernels import by_time, full, ratio, trailing

# Day counts of a quarter and of a year (fixed values).
QUARTER, YEAR, SLACK = (80, 100), (350, 380), 10


def first_reported_quarters(facts: DataFrame) -> DataFrame:
    """(symbol, period_start, period_end, filed, value): one row per quarter, first filing only.

    ``facts``: symbol, period_start, period_end, filed, value. A quarter without a figure of its own is the
    year less its three quarters, known when the year was filed. The quarters of one company that meet one
    of its years are bounded by the calendar.
    """
    f = facts.where("period_start is not null and period_end is not null and filed is not null and value is not null")
    days = F.datediff("period_end", "period_start")
    f = f.withColumn("kind", F.when(days.between(*QUARTER), "q").when(days.between(*YEAR), "y")).where("kind is not null")
    first = f.groupBy("symbol", "kind", "period_end").agg(F.min_by(F.struct("period_start", "filed", "value"), F.struct("filed", "value")).alias("z")).select("symbol", "kind", "period_end", "z.*")
    q = first.where("kind = 'q'").drop("kind")
    y = first.where("kind = 'y'").select("symbol", F.col("period_start").alias("ys"), F.col("period_end").alias("ye"), F.col("filed").alias("yf"), F.col("value").alias("yv"))
    inside = (F.col("period_start") >= F.date_sub("ys", SLACK)) & (F.col("period_end") <= F.date_add("ye", SLACK))
    g = y.join(q, "symbol").where(inside).groupBy("symbol", "ys", "ye", "yf", "yv").agg(
        F.count("*").alias("n"), F.sum("value").alias("s"), F.max("period_end").alias("last"), F.max((F.col("period_end") == F.col("ye")).cast("int")).alias("has"))
    rest = g.where("n = 3 and has = 0").select("symbol", F.date_add("last", 1).alias("period_start"), F.col("ye").alias("period_end"), F.col("yf").alias("filed"), (F.col("yv") - F.col("s")).alias("value"))
    return q.select(*rest.columns).unionByName(rest)


def quarterly_derivations(quarters: DataFrame) -> DataFrame:
    """Growth over four quarters, trailing-year earnings, margin and leverage of quarterly rows.

    ``quarters``: symbol, period_end, available_at, revenue, net_income, eps, total_assets, long_debt,
    short_debt. Debt is missing only where both parts are. Values of a row use rows up to it only.
    """
    w = by_time("symbol", "period_end")
    growth = lambda x: F.col(x) / F.nullif(F.lag(x, 4).over(w), F.lit(0.0)) - 1
    debt = F.when(F.col("long_debt").isNotNull() | F.col("short_debt").isNotNull(), F.coalesce("long_debt", F.lit(0.0)) + F.coalesce("short_debt", F.lit(0.0)))
    d = quarters.withColumn("total_debt", debt)
    return d.select("symbol", "period_end", "available_at", "revenue", "net_income", "eps", "total_assets", "total_debt",
                    growth("revenue").alias("revenue_growth_yoy"), growth("eps").alias("eps_growth_yoy"), ratio("net_income", "revenue").alias("net_margin"),
                    ratio("total_debt", "total_assets").alias("debt_to_assets"), full(F.sum("eps"), "eps", trailing(w, 4), 4).alias("eps_ttm"))
