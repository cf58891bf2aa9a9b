"""Session settings, tables and components shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tapegrain
from tapegrain import session

#: Rows handed to Python at once; texts are cut further by bytes there.
BATCH_ROWS = 1000


_SHIPPED: set[str] = set()  # applications whose executors have this package


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(tapegrain.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tapegrain-"), "tapegrain_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tapegrain", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return session.prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose records one bucket gathers, about, where a bucket is one group of a Python task.
BUCKET_BYTES = 24 << 20


def buckets_for(docs: DataFrame, least: int) -> int:
    """How many buckets keep a group at about BUCKET_BYTES of text, whatever the number of shuffle partitions; at least ``least``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-int(total) // BUCKET_BYTES))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def materialize(df: DataFrame, stem: str) -> DataFrame:
    """Rows written to the shared folder of the session and read back: no lineage, no executor to lose."""
    return session.materialize(df, f"llm-{stem}")


#: Ids are broadcast only where a count finds no more of them; else they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi", column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``column`` is one of the ids (column doc_id), or with ``left_anti`` those without; null equals null."""
    ids = materialize(ids.select(F.col("doc_id").alias("_id")).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs[column].eqNullSafe(F.col("_id")), how)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of each id that has a link: (id, component_id), from ``edges`` (a, b).

    Large-star and small-star steps (Kiveris et al. 2014) by grouping and joining until every id hangs
    on a root: O(log^2) rounds, each linear in the edges and written to the shared folder.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    for _ in range(max_rounds):
        # done when no id has two parents and no parent has one: a count over both ends of the edges
        ends = e.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("lo").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(down, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(down.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct())
        e = materialize(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = e.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
    return label.unionByName(label.select(F.col("component_id").alias("id"), "component_id").distinct())
