"""Conversations as ordered chunks of rows, shared by structure repair and chat formatting.

Rows are sorted through a range shuffle by conversation, turn (nulls first), role and text (its first 256
characters, then a hash of all of it); a salt comes last, so that a conversation, a turn or one repeated row that holds a third
of all rows is dealt to many tasks. Each task cuts its rows into chunks: at most ``CHUNK_ROWS`` rows or ``CHUNK_BYTES``
of one conversation, or one longer text. Chunks are numbered through all tasks, so the neighbours of a chunk
are found by its number, and no step gathers a conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm.common import materialize, partitions

CHUNK_ROWS, CHUNK_BYTES = 8192, 1 << 20
_YIELD_BYTES, _YIELD_ROWS = 4 << 20, 500


def rows_of(conversations: DataFrame, fill: str = "") -> DataFrame:
    """(conv_id, turn, role, text) with ``fill`` for a null role or text; further columns are ignored."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(fill)).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(fill)).alias("text"))


class Batcher:
    """Rows of a schema gathered to record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.size = schema, 0
        self.columns: list[list] = [[] for _ in schema]

    def add(self, row: tuple, size: int) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)
        self.size += size

    @property
    def full(self) -> bool:
        return self.size >= _YIELD_BYTES or len(self.columns[0]) >= _YIELD_ROWS

    def take(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.size = [[] for _ in self.schema], 0
        return out


def _cut(build: Callable[[list], tuple], schema: pa.Schema, most_rows: int, most_bytes: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """Chunks of the sorted rows of a task; ``build`` makes the further columns of (turn, role, text) rows, ``finish`` those of many chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), Batcher(schema)
        held: list = []
        owner, size, n, goes_on = None, 0, 0, False

        def close(more: bool) -> None:
            nonlocal n, held, size, goes_on
            out.add((owner, part, n, goes_on, more, *build(held)), size)
            n, held, size, goes_on = n + 1, [], 0, more

        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if held and (conv != owner or len(held) >= most_rows or size + len(text) > most_bytes):
                    close(conv == owner)
                    if out.full:
                        yield finish(out.take())
                owner, size = conv, size + len(text) + 16
                held.append((turn, role, text))
        if held:
            close(False)
        yield finish(out.take())
    return run


def chunked(rows: DataFrame, build: Callable[[list], tuple], columns: list[tuple[str, pa.DataType]], made_of: str, stem: str,
            most_rows: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES, finish: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch) -> DataFrame:
    """(conv_id, g, first, last, further columns) of every chunk, written to the shared folder.

    ``columns`` are those that ``build`` gives, ``made_of`` the Spark schema after ``finish``. ``g`` numbers all chunks in the order of their rows; ``first`` and ``last`` mark the ends of a conversation.
    """
    spark = rows.sparkSession
    salted = rows.withColumn("salt", (F.rand(7) * 4096).cast("int"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 256), F.xxhash64("text"), "salt"]
    ordered = salted.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("salt")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("goes_on", pa.bool_()), ("more", pa.bool_())] + columns)
    made = materialize(ordered.mapInArrow(_cut(build, schema, most_rows, most_bytes, finish), f"conv_id long, part int, n long, goes_on boolean, more boolean, {made_of}"), stem)
    # one row for each task goes through the driver: how many chunks, and the conversations at its ends
    ends = made.groupBy("part").agg(F.count("*").alias("k"), F.min_by("conv_id", "n").alias("lo"), F.max_by("conv_id", "n").alias("hi")).orderBy("part").collect()
    parts, base = [], 0
    for i, p in enumerate(ends):
        parts.append((p["part"], base, p["k"], i > 0 and ends[i - 1]["hi"] == p["lo"], i + 1 < len(ends) and ends[i + 1]["lo"] == p["hi"]))
        base += p["k"]
    known = spark.createDataFrame(parts, "part int, base long, k long, left boolean, right boolean")
    return (made.join(F.broadcast(known), "part").withColumn("g", F.col("base") + F.col("n"))
            .withColumn("first", ~F.col("goes_on") & ~((F.col("n") == 0) & F.col("left")))
            .withColumn("last", ~F.col("more") & ~((F.col("n") == F.col("k") - 1) & F.col("right")))
            .select("conv_id", "g", "first", "last", *made.columns[5:]))


def in_order(pieces: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One row for each conversation: ``fold`` reads its pieces in order as a stream.

    Conversations of one chunk stay where they are. A digest is a serial function, so the pieces of a longer one
    (columns conv_id, g, first, last) meet in one task, sorted outside of memory and read one batch at a time.
    """
    whole, cut = F.col("first") & F.col("last"), ~(F.col("first") & F.col("last"))
    streams = pieces.where(cut).repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "g")
    return pieces.where(whole).mapInArrow(fold, schema).unionByName(streams.mapInArrow(fold, schema))
