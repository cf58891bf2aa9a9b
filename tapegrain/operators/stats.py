"""Resampling, predictive distributions, folds and verdicts with hashed, repeatable draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import CALENDAR_ROWS, by_time, exact_quantiles, poisson_one, so_far, uniform


def replicates(rows: DataFrame, name: str, n: int) -> DataFrame:
    """Replicate numbers 1..n over all tasks, so that no single task makes all draws."""
    spark = rows.sparkSession
    return spark.range(1, n + 1, 1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))).select(F.col("id").cast("int").alias(name))


def bootstrap_mean(rows: DataFrame, ids: Sequence[str], value: str, reps: int, seed: int = 1, probs=(0.05, 0.95)) -> DataFrame:
    """Interval of a mean by Poisson weights per (row, replicate).

    Rows are widened by replicate inside the task and summed before the shuffle, so only ``reps``
    partial sums leave each partition.
    """
    d = rows.where(F.col(value).isNotNull()).select(*ids, F.col(value).alias("_v")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    w = poisson_one(uniform(seed, F.col("rep"), *[F.col(x) for x in ids]))
    g = d.withColumn("_w", w).groupBy("rep").agg((F.sum(F.col("_w") * F.col("_v")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("m"))
    return g.agg(F.percentile("m", F.lit(probs[0])).alias("lo"), F.percentile("m", F.lit(probs[1])).alias("hi"), F.count("m").alias("reps"))


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, reps: int = 2000, seed: int = 1, probs=(0.05, 0.95)) -> DataFrame:
    """Mean with a 90 % interval that resamples whole clusters (calendar months).

    Clusters are reduced to (sum, n) first; a replicate draws as many clusters as there are.
    """
    m = rows.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    m = m.withColumn("i", F.row_number().over(Window.partitionBy().orderBy(cluster)) - 1)  # one row per month
    k = m.agg(F.count(F.lit(1)).alias("k"), (F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n_rows"))
    draws = replicates(rows, "rep", reps).join(F.broadcast(k.select("k"))).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    draws = draws.select("rep", F.floor(uniform(seed, F.col("rep"), F.col("j")) * F.col("k")).alias("i"))
    g = draws.join(F.broadcast(m), "i").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("b"))
    q = g.agg(F.percentile("b", F.lit(probs[0])).alias("lo"), F.percentile("b", F.lit(probs[1])).alias("hi"))
    return k.select("mean", "n_rows").join(F.broadcast(q))


def block_bootstrap_sharpe(series: DataFrame, a: str, b: str, order: str, reps: int = 500, block: int = 21, seed: int = 3, per_year: float = 252.0) -> DataFrame:
    """Interval of Sharpe(a) - Sharpe(b) from paired circular blocks; population deviations.

    The series has one row per session and is broadcast; draws are spread over the replicates.
    """
    s = series.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.row_number().over(Window.partitionBy().orderBy(order)) - 1).alias("i"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    d = replicates(series, "rep", reps).join(F.broadcast(n))
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))
    d = d.withColumn("start", F.floor(uniform(seed, F.col("rep"), F.col("j")) * F.col("n")))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("j") * block + F.col("o") < F.col("n"))
    d = d.select("rep", F.pmod(F.col("start") + F.col("o"), F.col("n")).alias("i"))
    sharpe = lambda x: F.avg(x) / F.nullif(F.stddev_pop(x), F.lit(0.0)) * F.sqrt(F.lit(per_year))
    g = d.join(F.broadcast(s), "i").groupBy("rep").agg((sharpe("a") - sharpe("b")).alias("diff"))
    q = g.agg(F.percentile("diff", F.lit(0.05)).alias("lo"), F.percentile("diff", F.lit(0.95)).alias("hi"))
    return s.agg((sharpe("a") - sharpe("b")).alias("diff")).join(F.broadcast(q))


def trade_monte_carlo(trades: DataFrame, r: str, order: str, sims: int, seed: int = 5) -> DataFrame:
    """Totals and deepest falls of resampled trade sequences. Trades are numbered in one window, so the list
    is one a session at most; the draws are spread over the tasks and joined, not broadcast."""
    t = trades.select(F.col(r).alias("r"), (F.row_number().over(Window.partitionBy().orderBy(order)) - 1).alias("i"))
    n = t.agg(F.count(F.lit(1)).alias("n"))
    d = replicates(trades, "sim", sims).join(F.broadcast(n)).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    d = d.select("sim", "j", F.floor(uniform(seed, F.col("sim"), F.col("j")) * F.col("n")).alias("i")).join(t, "i")
    w = Window.partitionBy("sim").orderBy("j")
    d = d.withColumn("_c", F.sum("r").over(so_far(w)))
    d = d.withColumn("_dd", F.col("_c") - F.greatest(F.max("_c").over(so_far(w)), F.lit(0.0)))
    g = d.groupBy("sim").agg(F.max_by("_c", "j").alias("total"), F.min("_dd").alias("dd"))
    return g.agg(*[F.percentile("total", F.lit(p)).alias(f"total_p{int(p * 100)}") for p in (0.05, 0.5, 0.95)],
                 *[F.percentile("dd", F.lit(p)).alias(f"drawdown_p{int(p * 100)}") for p in (0.05, 0.5)],
                 F.avg((F.col("total") <= 0).cast("double")).alias("p_loss"))


def normal_draw(seed: int, *ids: Column) -> Column:
    """A repeatable standard normal draw from two uniform draws."""
    u1, u2 = uniform(seed, *ids), uniform(seed + 7919, *ids)
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * u2)


def jittered(bars: DataFrame, runs: int, eps: float, seed: int, ids: Sequence[Column]) -> DataFrame:
    """Bars repeated under ``runs`` run ids with tiny repeatable noise on the price level of each row."""
    d = bars.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    k = 1 + eps * normal_draw(seed, F.col("run"), *ids)
    return d.withColumn("_k", k).withColumns({x: F.col(x) * F.col("_k") for x in ("open", "high", "low", "close")}).drop("_k")


def predictive_core(rows: DataFrame, by: Sequence[str], y: str, sigma: str, probs: dict[str, float], bound: int | None = None) -> DataFrame:
    """Median anchor, base rate and standardised residual quantiles per group."""
    by = list(by)
    a = exact_quantiles(rows, by, y, {"anchor": 0.5}, bound)
    n = rows.groupBy(*by).agg(F.count(y).alias("n"), F.avg((F.col(y) > 0).cast("double")).alias("base_rate"))
    z = rows.join(a, by).withColumn("_z", (F.col(y) - F.col("anchor")) / F.col(sigma))
    return n.join(a, by).join(exact_quantiles(z, by, "_z", probs, bound), by)


def overlay_weight(rows: DataFrame, base: str, alt: str, y: str, order: str, horizon: int, key: str, min_t: float = 2.0) -> DataFrame:
    """Largest mixing weight out of 0, 0.1 .. 1 whose block-averaged log-loss gain has t >= ``min_t``; else 0."""
    d = rows.withColumn("_blk", F.floor((F.row_number().over(by_time(key, order)) - 1) / horizon))
    d = d.withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / F.lit(10.0))))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (1 - F.col("w")) * F.col(base) + F.col("w") * F.col(alt)))
    b = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(base)))
    loss = lambda q: -F.when(F.col(y) > 0, F.log(q)).otherwise(F.log(1 - q))
    g = d.withColumn("_g", loss(b) - loss(p)).groupBy(key, "w", "_blk").agg(F.avg("_g").alias("_g"))
    g = g.groupBy(key, "w").agg(F.avg("_g").alias("gain"), F.stddev_samp("_g").alias("_sd"), F.count(F.lit(1)).alias("blocks"))
    g = g.withColumn("t", F.when(F.col("_sd") > 0, F.col("gain") / (F.col("_sd") / F.sqrt("blocks"))))
    ok = (F.col("t") >= min_t) & (F.col("w") > 0)
    return g.groupBy(key).agg(F.coalesce(F.max_by(F.when(ok, F.col("w")), F.when(ok, F.col("gain"))), F.lit(0.0)).alias("weight"), F.max("blocks").alias("blocks"))


def fold_dim(years: DataFrame, first_test_year: int, embargo_days: int) -> DataFrame:
    """One fold per test year with its training cutoff."""
    return (years.where(F.col("year") >= first_test_year)
            .select(F.col("year").alias("fold"), F.date_sub(F.make_date("year", F.lit(1), F.lit(1)), embargo_days).alias("cutoff")))


def walk_forward(events: DataFrame, folds: DataFrame, day: str, exit_day: str) -> DataFrame:
    """Events with their role per fold: train when the label ended before the cutoff, test in the fold's year.

    Folds are a handful of years; they become one literal array, and an event is widened by those it serves.
    """
    names = folds.columns
    lit = F.array(*[F.struct(*[F.lit(r[c]).cast(folds.schema[c].dataType).alias(c) for c in names]) for r in folds.collect()])
    serves = F.filter(lit, lambda f: (F.col(exit_day) < f["cutoff"]) | (F.year(day) == f["fold"]))
    wide = events.withColumn("_f", F.explode(serves)).select(*events.columns, *[F.col("_f")[c].alias(c) for c in names])
    return wide.withColumn("role", F.when(F.col(exit_day) < F.col("cutoff"), "train").when(F.year(day) == F.col("fold"), "test"))


def expanding_splits(n: int, n_splits: int, val_size: int) -> list[tuple[int, int, int]]:
    """(train end, validation start, validation end) of fixed-size expanding splits, oldest first."""
    first = n - n_splits * val_size
    return [(first + i * val_size, first + i * val_size, first + (i + 1) * val_size) for i in range(n_splits) if first + i * val_size > 0]


def climatology_folds(labels: DataFrame, key: str, ordinal: str, y: str, horizon: int, step: int, warmup: int, probs: dict[str, float]) -> DataFrame:
    """Quantiles and base rate per (key, fold) from the labels that had matured before the fold start."""
    mx = labels.groupBy(key).agg(F.max(ordinal).alias("_mx"))
    folds = mx.where(F.col("_mx") >= warmup).select(key, F.explode(F.sequence(F.lit(warmup), F.col("_mx").cast("int"), F.lit(step))).alias("fold"))
    j = labels.where(F.col(y).isNotNull()).join(folds, key).where(F.col(ordinal) + horizon <= F.col("fold"))
    q = exact_quantiles(j, [key, "fold"], y, probs, CALENDAR_ROWS)  # one row per session
    return q.join(j.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n_train"), F.avg((F.col(y) > 0).cast("double")).alias("base_rate")), [key, "fold"])


def verdict(checks: dict[str, Column], need: int | None = None) -> Column:
    """Named checks as an array of structs plus the overall word."""
    arr = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    passed = F.size(F.filter(arr, lambda z: z["passed"]))
    word = F.when(passed >= (need or len(checks)), "pass").when(passed == 0, "fail").otherwise("mixed")
    return F.struct(arr.alias("checks"), passed.alias("n_passed"), word.alias("verdict"))
