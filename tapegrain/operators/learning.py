"""Data side of the models: event rows, fold-wise classifiers, filters, blends, sequence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.operators.kernels import exact_quantiles
from tapegrain.session import materialize


def event_rows(signals: DataFrame, features: DataFrame, directional: Sequence[str], backdrop: DataFrame | None = None) -> DataFrame:
    """Features on the signal date, turned to the side of the trade, with the day's crowding.

    ``signals``: symbol, session, side (+1 / -1). Crowding is aggregated per session and joined back.
    """
    crowd = signals.groupBy("session").agg(F.count(F.lit(1)).alias("crowd"))
    d = signals.join(features, ["symbol", "session"]).join(crowd, "session")
    d = d.withColumns({x: F.col(x) * F.col("side") for x in directional})
    return d.join(F.broadcast(backdrop), "session", "left") if backdrop is not None else d


def classifier(features: Sequence[str], kind: str = "logistic", label: str = "win", seed: int = 7) -> Pipeline:
    """Imputed and scaled logistic regression, or shallow boosted trees."""
    names = [f"_i_{x}" for x in features]
    stages = [Imputer(inputCols=list(features), outputCols=names, strategy="median"), VectorAssembler(inputCols=names, outputCol="_raw")]
    if kind == "trees":
        stages.append(GBTClassifier(featuresCol="_raw", labelCol=label, maxDepth=3, maxIter=20, stepSize=0.1, subsamplingRate=0.8, seed=seed))
    else:
        stages += [StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.1)]
    return Pipeline(stages=stages)


def fit_folds(rows: DataFrame, features: Sequence[str], folds: Sequence[int], kind: str = "logistic", min_train: int = 50, quantile: float = 0.5) -> DataFrame:
    """Score each fold's test rows with a model fitted on its training rows.

    The fold list is a handful of years; every fit is one distributed job. The threshold is a
    quantile of the training scores.
    """
    out = None
    for fold in folds:
        f = rows.where(F.col("fold") == fold)
        train = f.where(F.col("role") == "train")
        if train.limit(min_train).count() < min_train:  # too few to learn from: the rows stay, unscored and kept
            part = f.where(F.col("role") == "test").select(*rows.columns, F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("threshold"))
            out = part if out is None else out.unionByName(part)
            continue
        m = classifier(features, kind).fit(train)
        score = lambda d: m.transform(d).withColumn("p", vector_to_array("probability")[1])  # noqa: E731,B023
        t = exact_quantiles(score(train), [], "p", {"threshold": quantile})
        part = score(f.where(F.col("role") == "test")).join(F.broadcast(t)).select(*rows.columns, "p", "threshold")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("kept", F.coalesce(F.col("p") >= F.col("threshold"), F.lit(True))) if out is not None else rows.limit(0)


def filter_map(signals: DataFrame, scored: DataFrame) -> DataFrame:
    """Signals with the filter's word; a signal the filter never saw is taken."""
    k = scored.select("symbol", "session", "kept").dropDuplicates(["symbol", "session"])
    return signals.join(k, ["symbol", "session"], "left").withColumn("take", F.coalesce("kept", F.lit(True))).drop("kept")


def importances(spark, model: PipelineModel, features: Sequence[str], top: int = 10) -> DataFrame:
    v = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(features, v)), "feature string, importance double")  # one row per feature
    return rows.orderBy(F.desc("importance"), "feature").limit(top)


def blend_forecasts(long: DataFrame, mix: dict[str, dict[str, float]], key: Sequence[str]) -> DataFrame:
    """Blend p10 / p50 / p90 of several models in log space with regime weights over the models present.

    ``long``: key columns, regime, model, p10, p50, p90.
    """
    w = F.lit(0.0)
    for regime, parts in mix.items():
        for model, x in parts.items():
            w = F.when((F.col("regime") == regime) & (F.col("model") == model), x).otherwise(w)
    d = long.where(F.col("p50") > 0).withColumn("_w", w).where(F.col("_w") > 0)
    g = d.groupBy(*key).agg(F.sum("_w").alias("_t"), F.sum(F.col("_w") * F.log("p50")).alias("_m"), F.sum(F.col("_w") * F.log(F.col("p10") / F.col("p50"))).alias("_lo"),
                            F.sum(F.col("_w") * F.log(F.col("p90") / F.col("p50"))).alias("_hi"), F.count(F.lit(1)).alias("models"))
    m = F.exp(F.col("_m") / F.col("_t"))
    return g.select(*key, "models", m.alias("p50"), (m * F.exp(F.col("_lo") / F.col("_t"))).alias("p10"), (m * F.exp(F.col("_hi") / F.col("_t"))).alias("p90"))


def holdout_metrics(pred: DataFrame, key: str, order: str, y: str, p: str, tail: float = 0.2) -> DataFrame:
    """Direction hits, error and up-rate on the last share of each series."""
    w = Window.partitionBy(key).orderBy(order)
    d = pred.withColumn("_r", F.percent_rank().over(w)).where(F.col("_r") >= 1 - tail)
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col(y) > 0) == (F.col(p) > 0)).cast("double")).alias("hit_rate"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"),
                              F.avg((F.col(y) > 0).cast("double")).alias("up_rate"))


def fold_loss(pred: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean pinball of three quantiles + 0.3 log loss + 0.05 width."""
    from tapegrain.operators.evaluation import pinball
    pin = (pinball("y", "q10", 0.1) + pinball("y", "q50", 0.5) + pinball("y", "q90", 0.9)) / 3
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p_up")))
    ll = -F.when(F.col("y") > 0, F.log(p)).otherwise(F.log(1 - p))
    return pred.groupBy(*key).agg((F.avg(pin) + 0.3 * F.avg(ll) + 0.05 * F.avg(F.col("q90") - F.col("q10"))).alias("loss"), F.count(F.lit(1)).alias("n"))


def simplex_weights(rows: DataFrame, models: Sequence[str], y: str, by: str, steps: int = 5) -> DataFrame:
    """Best mixing weights per regime from a grid on the simplex, scored by squared error.

    Only the cross products of the model columns are aggregated (one pass); the grid is then scored
    on those few sums.
    """
    cols = [*models, y]
    aggs = [F.avg(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(cols) for b in cols[i:]]
    s = rows.dropna(subset=cols).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    axis = F.sequence(F.lit(0), F.lit(steps))
    for m in models[:-1]:
        s = s.withColumn(f"w_{m}", F.explode(axis)).withColumn(f"w_{m}", F.col(f"w_{m}") / steps)
    used = sum((F.col(f"w_{m}") for m in models[:-1]), F.lit(0.0))
    s = s.withColumn(f"w_{models[-1]}", F.round(1 - used, 9)).where(F.col(f"w_{models[-1]}") >= 0)
    pair = lambda a, b: F.col(f"`{a}|{b}`") if cols.index(a) <= cols.index(b) else F.col(f"`{b}|{a}`")
    mse = pair(y, y) - 2 * sum((F.col(f"w_{m}") * pair(m, y) for m in models), F.lit(0.0)) + sum((F.col(f"w_{a}") * F.col(f"w_{b}") * pair(a, b) for a in models for b in models), F.lit(0.0))
    s = s.withColumn("mse", mse)
    g = s.groupBy(by).agg(F.min_by(F.struct("n", "mse", *[f"w_{m}" for m in models]), F.struct(F.round("mse", 12), *[F.col(f"w_{m}") for m in models])).alias("z"))
    return g.select(by, "z.*")


def sequence_windows(rows: DataFrame, features: Sequence[str], length: int, train_until: Column, key: str = "symbol", order: str = "session") -> DataFrame:
    """The ``length`` earlier feature rows of each row, normalised with train-only mean and deviation."""
    st = rows.where(train_until).agg(*[F.avg(x).alias(f"_m_{x}") for x in features], *[F.stddev_samp(x).alias(f"_s_{x}") for x in features])
    d = rows.join(F.broadcast(st))
    vec = F.array(*[F.coalesce((F.col(x) - F.col(f"_m_{x}")) / F.nullif(f"_s_{x}", F.lit(0.0)), F.lit(0.0)) for x in features])
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-length, -1)
    d = d.withColumn("_v", vec).withColumn("window", F.array_agg("_v").over(w))
    return d.where(F.size("window") == length).drop("_v", *[f"_{p}_{x}" for x in features for p in "ms"])


def suppressed(rows: DataFrame, features: Sequence[str], floor: float = 1e-9) -> DataFrame:
    """Columns whose training variance is negligible, as rows."""
    v = rows.agg(*[F.var_pop(x).alias(x) for x in features])
    return v.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("variance")) for x in features])).alias("z")).select("z.*").where(F.col("variance") < floor)
