"""Outcomes of stored records, filled in as prices arrive.

A run takes whatever records and prices have landed since the last one and appends the outcomes that have become known,
each once. It keeps no state but its own output: what is open is what no earlier epoch has written. An epoch owns a
folder and overwrites it, so a retried epoch, also one that meets more prices than the first attempt, leaves each outcome
in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrain.operators.kernels import asof_join
from tapegrain.session import materialize

RECORDS = "record_id bigint, symbol bigint, surfaced date, entry double"
PRICES = "symbol bigint, session date, close double"
OUTCOMES = "record_id bigint, horizon int, matured_on date, ret double, epoch bigint"
#: Days after which a record is scored (fixed values).
HORIZONS = (7, 28, 84)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes written so far; empty before the first epoch."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(OUTCOMES).parquet(path)


def due(records: DataFrame, horizons=HORIZONS) -> DataFrame:
    """A row for each record with a price and each horizon: the day from which the outcome can be read."""
    rows = records.where("entry > 0").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return rows.withColumn("due", F.date_add("surfaced", F.col("horizon")))


def matured(open_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Open rows whose symbol has a close on or after the due day: per cent from entry to the first such close."""
    first = open_rows.agg(F.min("due")).first()[0]
    if first is None:
        return open_rows.select("record_id", "horizon", F.col("due").alias("matured_on"), F.col("entry").alias("ret"))
    p = prices.where(F.col("session") >= F.lit(first)).select("symbol", "session", "close", F.col("session").alias("_at"))
    j = asof_join(open_rows, p, "symbol", "due", "session", {"_at": "matured_on", "close": "_close"}, direction="forward")
    return j.where("_close > 0").select("record_id", "horizon", "matured_on", ((F.col("_close") / F.col("entry") - 1) * 100).alias("ret"))


def score_epoch(spark: SparkSession, records_path: str, prices_path: str, out: str, epoch: int, horizons=HORIZONS) -> None:
    """Write the outcomes known now that no earlier epoch holds."""
    done = outcomes(spark, out).where(F.col("epoch") < epoch).select("record_id", "horizon")
    records = spark.read.schema(RECORDS).parquet(records_path).dropDuplicates(["record_id"])
    open_rows = materialize(due(records, horizons).join(done, ["record_id", "horizon"], "left_anti"), "open")
    matured(open_rows, spark.read.schema(PRICES).parquet(prices_path)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def run(spark: SparkSession, records_path: str, prices_path: str, out: str, checkpoint: str, horizons=HORIZONS) -> None:
    """One available-now run; new files of either input start an epoch."""
    news = [spark.readStream.schema(s).parquet(p).select(F.lit(1).alias("n")) for s, p in ((RECORDS, records_path), (PRICES, prices_path))]
    query = (news[0].unionByName(news[1]).writeStream.foreachBatch(lambda _, epoch: score_epoch(spark, records_path, prices_path, out, epoch, horizons))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
