"""Token ids in a binary format of patched frame-of-reference blocks.

A frame holds the ids of consecutive documents:

    "PFR1" | ids u32 | documents u32 | blocks u32 | doc ids i64[] | document lengths u32[] |
    block index u32[blocks + 1] | blocks | crc32 u32 of all before

A block holds 128 ids: minimum u32 | width u8 | exceptions u8 | 16 * width bytes with the low ``width``
bits of each id less the minimum | position u8 of each exception | full value u32 of each exception. The
width is the one that ``SHARE`` of the block's values fit in; the rest are exceptions. The block index
gives the byte at which each block starts, so a range of ids is read without the blocks before it.

Documents are range-partitioned and sorted by id; each task writes its frames with the number of ids
before them in its part. Spark writes the frames and so takes care of commits, retries and any file system.

Null ids come first, null and empty texts are the end id alone, and repeated rows follow each other.
A document longer than a frame is a frame of its own. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrain import session
from tapegrain.llm import textops as X
from tapegrain.llm.common import partitions
from tapegrain.llm.tokens import encode_closed, vocabulary_path

END_ID, BLOCK, SHARE, FRAME_IDS = 0, 128, 0.9, 1 << 18
MAGIC = b"PFR1"
NULL_ID = np.iinfo(np.int64).min
FRAME = "part int, before long, n_ids long, n_docs int, frame binary"
_BITS = np.array([b.bit_length() for b in range(256)], np.uint8)


def _bit_length(v: np.ndarray) -> np.ndarray:
    b = v.astype("<u4").view(np.uint8).reshape(*v.shape, 4)
    top = np.where(b[..., 3] > 0, 24 + _BITS[b[..., 3]], np.where(b[..., 2] > 0, 16 + _BITS[b[..., 2]], np.where(b[..., 1] > 0, 8 + _BITS[b[..., 1]], _BITS[b[..., 0]])))
    return top.astype(np.uint8)


def pack_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(block index, bytes of all blocks)."""
    n = -(-len(ids) // BLOCK)
    v = np.empty(n * BLOCK, np.uint32)
    v[:len(ids)] = ids
    v[len(ids):] = ids[-1] if len(ids) else 0
    v = v.reshape(n, BLOCK)
    low = v.min(axis=1) if n else np.zeros(0, np.uint32)
    d = v - low[:, None]
    bits = _bit_length(d)
    fits = int(np.ceil(share * BLOCK))
    width = np.partition(bits, fits - 1, axis=1)[:, fits - 1] if n else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    exceptions = over.sum(axis=1)
    index = np.concatenate(([0], np.cumsum(6 + 16 * width.astype(np.int64) + 5 * exceptions)))
    out = np.zeros(int(index[-1]), np.uint8)
    at = index[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4] = width
    out[at + 5] = exceptions
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for part in (rows[k:k + 2048] for k in range(0, len(rows), 2048)):
            bit = ((d[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
            out[at[part][:, None] + 6 + np.arange(16 * w)] = np.packbits(bit.reshape(len(part), -1), axis=1, bitorder="little")
    row, pos = np.nonzero(over)
    place = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    list_at = at[row] + 6 + 16 * width[row].astype(np.int64)
    out[list_at + place] = pos
    out[(list_at + exceptions[row] + 4 * place)[:, None] + np.arange(4)] = d[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return index, out


def unpack_blocks(index: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Ids of whole blocks; ``index``: their starts in ``raw`` (and the end)."""
    at, n = index[:-1].astype(np.int64), len(index) - 1
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, exceptions = raw[at + 4], raw[at + 5].astype(np.int64)
    d = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for part in (rows[k:k + 2048] for k in range(0, len(rows), 2048)):
            bit = np.unpackbits(raw[at[part][:, None] + 6 + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(part), BLOCK, w)
            v = np.zeros((len(part), BLOCK), np.uint32)
            for k in range(w):
                v |= bit[:, :, k].astype(np.uint32) << np.uint32(k)
            d[part] = v
    row = np.repeat(np.arange(n), exceptions)
    place = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    list_at = at[row] + 6 + 16 * width[row].astype(np.int64)
    d[row, raw[list_at + place]] = raw[(list_at + exceptions[row] + 4 * place)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (d + low[:, None]).ravel()


def write_frame(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    index, blocks = pack_blocks(ids)
    body = b"".join((MAGIC, np.array([len(ids), len(lengths), len(index) - 1], "<u4").tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), index.astype("<u4").tobytes(), blocks.tobytes()))
    return body + zlib.crc32(body).to_bytes(4, "little")


class Frame:
    """A frame's directory; ids are unpacked on demand."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
            raise ValueError("not an intact frame")
        self.n, docs, blocks = (int(x) for x in np.frombuffer(raw, "<u4", 3, 4))
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 16)
        self.lengths = np.frombuffer(raw, "<u4", docs, 16 + 8 * docs).astype(np.int64)
        self.index = np.frombuffer(raw, "<u4", blocks + 1, 16 + 12 * docs)
        self.blocks = np.frombuffer(raw, np.uint8, offset=20 + 12 * docs + 4 * blocks)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids at positions lo to hi, from the blocks that hold them."""
        hi = self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // BLOCK, -(-hi // BLOCK)
        return unpack_blocks(self.index[first:last + 1], self.blocks)[lo - first * BLOCK:hi - first * BLOCK]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for piece in X.slices(batches, limit=1 << 20):
            ids, first = encode_closed(path, *X.text_buffer(piece.column("text")), end_id)
            doc_ids = piece.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(doc_ids):
                stop = max(at + 1, int(np.searchsorted(first, first[at] + FRAME_IDS, side="right")) - 1)
                n = int(first[stop] - first[at])
                raw = write_frame(doc_ids[at:stop], np.diff(first[at:stop + 1]), ids[first[at]:first[stop]])
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([n], pa.int64()), "n_docs": pa.array([stop - at], pa.int32()), "frame": pa.array([raw], pa.binary())})
                before, at = before + n, stop
    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Frames of all texts, in ascending order of the ids, under ``path``."""
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), FRAME).write.parquet(path)


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, base in zip(batch.column("frame"), batch.column("base").to_pylist()):
            f = Frame(raw.as_py())
            end = np.cumsum(f.lengths)
            whole = memoryview(f.ids().astype("<u4").tobytes())
            crc = [zlib.crc32(whole[4 * a:4 * b]) for a, b in zip((end - f.lengths).tolist(), end.tolist())]
            yield pa.record_batch({"doc_id": pa.array(f.doc_ids, pa.int64(), mask=f.doc_ids == NULL_ID), "start": base + end - f.lengths, "n_tokens": f.lengths, "ids_crc32": pa.array(crc, pa.int64())})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; one number for each part goes through the driver."""
    frames = spark.read.schema(FRAME).parquet(path)
    sizes = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toArrow()
    n = sizes.column("n").to_numpy()
    offsets = dict(zip(sizes.column("part").to_pylist(), (np.cumsum(n) - n).tolist()))
    if not offsets:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    parts = spark.createDataFrame(list(offsets.items()), "part int, offset long")
    based = frames.join(F.broadcast(parts), "part").select("frame", (F.col("before") + F.col("offset")).alias("base"))
    return based.mapInArrow(_directory, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of all texts to the shared folder and describe each document from the files."""
    path = session.fresh_path(docs.sparkSession, "llm-ids")
    write(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path)
