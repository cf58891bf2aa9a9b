"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapegrain", master: str | None = None,
                  shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
        if master.startswith("local"):  # small test data: keep window work on all threads
            b = (b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
                 .config("spark.driver.memory", "12g"))
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(b.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on; called wherever tables enter.

    Spark 4.1 lets a union inherit the partitioning of its inputs. Together with adaptive coalescing
    the inputs can be paired wrongly and groups come out twice, so that shortcut is switched off.
    """
    key = "spark.sql.unionOutputPartitioning"
    try:
        if spark.conf.get(key) != "false":
            spark.conf.set(key, "false")
    except Exception:  # noqa: BLE001 - Spark versions without the setting do not need it
        pass
    return spark


_FALLBACK: dict[str, str] = {}  # application id -> folder, only where the session names none


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in the one every executor can reach, named by ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder is taken; a cluster must name one.
    """
    found, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="tapegrain-")
        found = _FALLBACK[app]
    return os.path.join(found, f"tapegrain-{app}")


def clear(spark: SparkSession) -> None:
    """Delete what this application wrote to its shared folder; call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, stem: str) -> str:
    return os.path.join(shared_dir(spark), f"{stem}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, stem: str = "stage") -> DataFrame:
    """Cut the lineage by writing the rows to the shared folder and reading them back.

    The written table survives the loss of any executor, unlike cached blocks.
    """
    path = fresh_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
