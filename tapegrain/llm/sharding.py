"""Shards of equal row counts by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document starts in a shard given by a hash; then, round by
round, the documents of a group look at the shards of their neighbours and move to the one that holds most
of them, as far as its quota, widened by SLACK times the linked share so that groups can trade places, has room. Documents of a group that sit in one shard are alike, so the rounds
work on counts of (group, start shard, shard): a few narrow rows, and none for documents without links.
A group larger than a quota fills one shard after the other.

Afterwards each shard keeps its quota, linked documents first, and what is over goes to the shards with
room, whole groups after one another, so counts differ by at most one. Ranks in a shard come from counts
of blocks (shard, linked, group salt, row salt): no shard and no group is ranked in one task, and only one
number for each shard reaches the driver.

Null texts hold no bytes and link with nothing; empty texts are equal to each other. Rows that share an
id, null included, are separate documents. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.llm.common import materialize, partitions

SHARDS, OVERHEAD, ROUNDS = 40, 16, 12
SLACK, ROW_SALTS = 0.5, 8
_BEFORE = (Window.unboundedPreceding, -1)


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _lookup(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def described(docs: DataFrame, shards: int, salts: int) -> DataFrame:
    """A row for each document: size, checksum, group (null without text), start shard, salt."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = F.monotonically_increasing_id()
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("bytes"), F.crc32(raw).alias("text_crc32"),
                      F.when(F.col("text").isNotNull(), F.unhex(F.sha2(F.col("text"), 256))).alias("grp"), row.alias("row"))
    out = out.select("doc_id", (F.col("bytes") + OVERHEAD).alias("size"), "text_crc32", "grp", "row",
                     F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("home"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(salts)).cast("int").alias("salt"))
    return materialize(out, "shard-rows")


def propagate(rows: DataFrame, quota: list[int], rounds: int, salts: int) -> DataFrame:
    """(grp, home, shard): where the documents of each group of two or more go."""
    cells = rows.where("grp is not null").groupBy("grp", "home").agg(F.count("*").alias("n"))
    many = cells.groupBy("grp").agg(F.sum("n").alias("total")).where("total > 1").select("grp")
    state = materialize(cells.join(many, "grp").select("grp", "home", F.col("home").alias("shard"), "n"), "labels")
    for _ in range(rounds):
        have = state.groupBy("grp", "shard").agg(F.sum("n").alias("n"))
        load = {r["shard"]: r["n"] for r in have.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        slack = 1 + SLACK * sum(load.values()) / max(1, sum(quota))
        room = [max(0, int(q * slack) - load.get(s, 0)) for s, q in enumerate(quota)]
        # a shard takes part while it has room for the group's smallest cell
        least = have.groupBy("grp").agg(F.min("n").alias("least"))
        target = have.join(least, "grp").where(_lookup(room, F.col("shard")) >= F.col("least")).groupBy("grp").agg(F.max_by(F.struct("shard", "n"), F.struct("n", -F.col("shard"))).alias("t"))
        moves = have.join(target, "grp").where("shard <> t.shard and (n < t.n or (n = t.n and shard > t.shard))")
        moves = moves.select("grp", "shard", "n", F.col("t.shard").alias("to"), F.pmod(F.xxhash64("grp"), F.lit(salts)).alias("block"))
        moves = materialize(moves, "moves")
        # room is given out block by block: blocks of moves are added up first, then the moves in each
        blocks = moves.groupBy("to", "block").agg(F.sum("n").alias("n"))
        before = blocks.select("to", "block", F.coalesce(F.sum("n").over(Window.partitionBy("to").orderBy("block").rowsBetween(*_BEFORE)), F.lit(0)).alias("before"))
        own = F.sum("n").over(Window.partitionBy("to", "block").orderBy("n", "grp", "shard").rowsBetween(Window.unboundedPreceding, 0))
        taken = moves.withColumn("own", own).join(before, ["to", "block"]).where(F.col("before") + F.col("own") <= _lookup(room, F.col("to")))
        taken = materialize(taken.select("grp", "shard", "to"), "taken")
        if taken.isEmpty():
            break
        state = materialize(state.join(taken, ["grp", "shard"], "left").select("grp", "home", F.coalesce("to", "shard").alias("shard"), "n"), "labels")
    return state.select("grp", "home", "shard")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    salts = partitions(docs.sparkSession)
    rows = described(docs, shards, salts)
    quota = quotas(rows.count(), shards)
    moved = propagate(rows, quota, rounds, salts).withColumnRenamed("shard", "label")
    placed = rows.join(moved, ["grp", "home"], "left").select("doc_id", "size", "text_crc32", "row", "salt", F.coalesce("label", "home").alias("label"), F.col("label").isNull().cast("int").alias("alone"), F.xxhash64("grp").alias("mark"))
    # linked documents are ordered by group, then by row; the others by row
    block = ["label", "alone", "group_salt", "salt"]
    placed = placed.withColumn("group_salt", F.when(F.col("alone") == 0, F.pmod("mark", F.lit(salts))).otherwise(0)).withColumn("salt", F.when(F.col("alone") == 0, F.col("salt") % ROW_SALTS).otherwise(F.col("salt")))
    placed = materialize(placed.drop("mark"), "placed")
    counts = materialize(placed.groupBy(*block).agg(F.count("*").alias("n")), "counts")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy(*block[1:]).rowsBetween(*_BEFORE)), F.lit(0))
    ahead = counts.select(*block, ahead.alias("ahead"))
    have = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    number = [have.get(s, 0) for s in range(shards)]
    over = [max(0, n - q) for n, q in zip(number, quota)]
    pool_at = [sum(over[:s]) for s in range(shards)]
    lack = [max(0, q - n) for n, q in zip(number, quota)]
    lack_at = [sum(lack[:s]) for s in range(shards)]
    ranked = placed.withColumn("own", F.row_number().over(Window.partitionBy(*block).orderBy("row")) - 1)
    ranked = ranked.join(ahead, block).withColumn("rank", F.col("own") + F.col("ahead"))
    stays = F.col("rank") < _lookup(quota, F.col("label"))
    pool = F.col("rank") - _lookup(quota, F.col("label")) + _lookup(pool_at, F.col("label"))
    ranked = ranked.withColumn("pool", F.when(~stays, pool))
    # the shard with room whose share of the pool holds this place: the last that begins at or before it
    taker = F.greatest(*[F.when((F.col("pool") >= lack_at[s]) & F.lit(lack[s] > 0), F.lit(s)) for s in range(shards)], F.lit(-1))
    ranked = ranked.withColumn("shard", F.when(stays, F.col("label")).otherwise(taker).cast("int"))
    slot = F.when(stays, F.col("rank")).otherwise(F.col("pool") - _lookup(lack_at, F.col("shard")) + _lookup(number, F.col("shard")))
    return ranked.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
