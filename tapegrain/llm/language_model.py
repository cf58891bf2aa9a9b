"""Text scores of a smoothed bigram model whose counts sit in a log-frequency Bloom filter.

Training documents give exact counts of tokens and bigrams. A count c is kept as the level
1 + floor(log_BASE c): the key enters the filter once for each level up to its own, and a reader probes
level after level until one is missing. Keys are dealt to buckets by hash; a bucket counts its keys and
makes its own stretch of the filter, the stretches are put together and broadcast. Probabilities are
Dirichlet-smoothed, P(w | h) = (c(h w) + PRIOR * P(w)) / (c(h) + PRIOR), all counts read from the filter.

The filter has BITS_PER_KEY bits for each entry and grows with the keys; no level is left out. What is
broadcast at once is bounded: a filter of more than MAX_BITS is read in blocks of neighbouring buckets of
at most MAX_BITS (one bucket at least), a pass over the texts for each block, and the levels found are put
together for each slice of texts. Scores do not depend on the number of blocks. The base score, n_known
and train_tokens are exact; they never touch the filter.

The base score needs the exact count of every token of every document. Slices of documents send each
bucket their distinct tokens with the documents they occur in, packed; the bucket answers with a sum for
each document of the slice. So no token is a row, and a token in a third of all documents weighs no more
than its occurrences in packed bytes.

Null and empty texts have the end token only. With no training documents N and V are 0 and the model gives
every token the base probability. Rows that share id and text are scored alike, each as its own row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm import textops as X
from tapegrain.llm.common import buckets_for, crc_mod, materialize, partitions

FOLDS, ADD = 10, 0.1
BASE, PRIOR = 1.5, 4.0
BITS_PER_KEY, HASHES, MAX_BITS = 6, 4, 1 << 31
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
LEVELS = 64
PACKED = "bucket int, packed binary"
PROBED = "slice long, block int, packed binary"
ANSWER = "slice long, sums binary, known binary, ids binary, bucket int, stretch binary, n_bits long, v long, n long"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text with the end token, and n+1 offsets."""
    data, off = X.text_buffer(column)
    s, e, first = X.words(data, off)
    n = len(first) - 1
    out = np.full(len(s) + n, END, np.uint64)
    out[np.arange(len(s)) + np.repeat(np.arange(n), np.diff(first))] = X.span_hashes(data, s, e, X.BYTE_CODE_LOWER)
    return out, first + np.arange(n + 1)


def bigrams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each (token before, token), and the token before; START stands before a text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = START
    return X.mix(before * np.uint64(0x9E3779B97F4A7C15) + h), before


def text_keys(column: pa.Array) -> np.ndarray:
    """64 bits of each text, to tell rows apart that share an id."""
    h, first = tokens(column)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(h + np.arange(len(h), dtype=np.uint64)))))
    return X.mix(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(np.uint64)).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of the values by place: the many zero bytes of small values come together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def _join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def _split(raw: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", raw)[0]
    sizes, at, out = struct.unpack_from(f"<{n}q", raw, 8), 8 + 8 * n, []
    for s in sizes:
        out.append(raw[at:at + s])
        at += s
    return out


def _gather(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, part_no, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for part in X.slices(batches):
            h, first = tokens(part.column("text"))
            train = part.column("train").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(part.num_rows, dtype=np.uint32), np.diff(first))
            learned = train[doc]
            number = (part_no << 32) | seq
            seq += 1
            t, code = np.unique(h, return_inverse=True)
            t_train = np.bincount(code[learned], minlength=len(t)).astype(np.uint32)
            order = np.argsort(code, kind="stable")
            places, each = doc[order], np.bincount(code, minlength=len(t)).astype(np.uint32)
            place_at = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
            key, before = bigrams(h, first)
            b, b_n = np.unique(key[learned], return_counts=True)
            starts = int(train.sum())
            t_edge = np.searchsorted(bucket_of(t, buckets), np.arange(buckets + 1))
            b_edge = np.searchsorted(bucket_of(b, buckets), np.arange(buckets + 1))
            ids = part.column("doc_id").cast(pa.int64())
            home = int(bucket_of(np.array([X.mix(np.array([number], np.uint64))[0]]), buckets)[0])
            out = []
            for k in range(buckets):
                i, j = t_edge[k], t_edge[k + 1]
                p, q = b_edge[k], b_edge[k + 1]
                own = places[place_at[i]:place_at[j]]
                step = np.diff(own.astype(np.int64), prepend=0).astype(np.int32)
                head = struct.pack("<6q", number, part.num_rows, j - i, len(own), q - p, starts if k == home else 0)
                body = _join(head, planes(np.diff(t[i:j], prepend=np.uint64(0))), planes(t_train[i:j]), planes(each[i:j]), planes(step),
                             planes(np.diff(b[p:q] >> np.uint64(12), prepend=np.uint64(0))), planes(b_n[p:q].astype(np.uint32)),
                             ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).tobytes() + text_keys(part.column("text")).tobytes() + np.diff(first).astype(np.int64).tobytes() if k == home else b"")
                out.append(zip_.compress(body))
            yield pa.record_batch({"bucket": pa.array(range(buckets), pa.int32()), "packed": pa.array(out, pa.binary())})
    return run


def levels(count: np.ndarray) -> np.ndarray:
    """Level of each count; 0 for none."""
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


#: Expected count of each level: the middle of the counts it stands for.
COUNT_OF = np.array([0.0] + [(np.ceil(BASE ** (k - 1) - 1e-9) + max(np.ceil(BASE ** (k - 1) - 1e-9), np.ceil(BASE ** k - 1e-9) - 1)) / 2 for k in range(1, LEVELS)])


def _bit(h: np.ndarray, level: int, k: int, n_bits) -> np.ndarray:
    x = X.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (level * HASHES + k + 1) & (2**64 - 1)))
    return ((x >> np.uint64(32)) * n_bits >> np.uint64(32)).astype(np.int64)


def stretch(h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, int]:
    """Bits of the keys of a bucket, each entered at all levels up to its own."""
    n_bits = max(64, int(BITS_PER_KEY * level.sum()))
    n_bits = -(-n_bits // 8) * 8
    bits = np.zeros(n_bits, bool)
    for at in range(1, int(level.max()) + 1 if len(level) else 0):
        own = h[level >= at]
        for k in range(HASHES):
            bits[_bit(own, at, k, np.uint64(n_bits))] = True
    return np.packbits(bits, bitorder="little"), n_bits


class Filter:
    """Stretches one after the other: of all buckets, or of neighbouring ones from ``low`` on of ``buckets``."""

    def __init__(self, raw: np.ndarray, n_bits: list[int], low: int = 0, buckets: int | None = None):
        self.raw, self.low, self.buckets = raw, low, buckets or len(n_bits)
        self.n_bits = np.array(n_bits, np.uint64)
        self.start = np.concatenate(([0], np.cumsum(n_bits)))[:-1].astype(np.int64)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Expected counts of the keys."""
        return COUNT_OF[self.level(h)]

    def level(self, h: np.ndarray) -> np.ndarray:
        """Levels of the keys, by probing level after level; all of them lie in the filter's buckets."""
        out, at = np.zeros(len(h), np.int64), np.arange(len(h))
        b = bucket_of(h, self.buckets) - self.low
        for level in range(1, LEVELS):
            for k in range(HASHES):
                pos = self.start[b] + _bit(h, level, k, self.n_bits[b])
                hit = (self.raw[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1
                at, h, b = at[hit], h[hit], b[hit]
            if not len(at):
                break
            out[at] = level
        return out

    def own(self, h: np.ndarray) -> np.ndarray:
        """Those of the ascending keys that lie in the filter's buckets."""
        b = bucket_of(h, self.buckets)
        return h[np.searchsorted(b, self.low):np.searchsorted(b, self.low + len(self.start))]


def bigram_keys(key: np.ndarray) -> np.ndarray:
    """Bigrams keep 52 bits of their key, as packed."""
    return key >> np.uint64(12) << np.uint64(12)


def _count(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        open_, bucket = zstandard.ZstdDecompressor(), group.column("bucket")[0].as_py()
        t_all, c_all, b_all, bc_all, slices, starts, ids = [], [], [], [], [], 0, []
        for blob in group.column("packed"):
            head, t, t_n, each, step, b, b_n, own = _split(open_.decompress(blob.as_py()))
            number, docs, n_t, n_own, n_b, s = struct.unpack("<6q", head)
            t_all.append(np.cumsum(unplanes(t, n_t, np.uint64), dtype=np.uint64))
            c_all.append(unplanes(t_n, n_t, np.uint32))
            b_all.append(np.cumsum(unplanes(b, n_b, np.uint64), dtype=np.uint64) << np.uint64(12))
            bc_all.append(unplanes(b_n, n_b, np.uint32))
            slices.append((number, docs, n_t, n_own, each, step))
            starts += s
            if own:
                ids.append((number, own))
        def totals(h, c):
            h, c = np.concatenate(h), np.concatenate(c)
            u, code = np.unique(h, return_inverse=True)
            return u, code, np.bincount(code, weights=c, minlength=len(u))
        t, code, c = totals(t_all, c_all)
        b, _, b_c = totals(b_all, bc_all)
        value, known = np.log10(c + ADD)[code], (c > 0)[code]
        rows, at = [], 0
        for number, docs, n_t, n_own, each, step in slices:
            each = unplanes(each, n_t, np.uint32)
            place = np.cumsum(unplanes(step, n_own, np.int32), dtype=np.int64)
            sums = np.bincount(place, weights=np.repeat(value[at:at + n_t], each), minlength=docs)
            hits = np.bincount(place, weights=np.repeat(known[at:at + n_t], each), minlength=docs).astype(np.uint32)
            rows.append((number, sums.tobytes(), hits.tobytes(), None, None, None, None, None, None))
            at += n_t
        rows += [(number, None, None, own, None, None, None, None, None) for number, own in ids]
        keys, count = np.concatenate((t, b)), np.concatenate((c, b_c))
        if starts:  # how many texts begin: partial counts of the START history, one entry in each home bucket
            rows.append((None, None, None, None, None, None, None, None, starts))
        keys, count = keys[count > 0], count[count > 0]
        bits, n_bits = stretch(keys, levels(count))
        rows.append((None, None, None, None, bucket, bits.tobytes(), n_bits, int((c > 0).sum()), int(c.sum())))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in ANSWER.split(", ")]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
    return run


def _add_up(group: pa.Table) -> pa.Table:
    """Sums of one slice over all buckets, with the ids of its documents."""
    sums = known = own = None
    for s, k, i in zip(*(group.column(c) for c in ("sums", "known", "ids"))):
        if i.is_valid:
            own = i.as_py()
        else:
            s, k = np.frombuffer(s.as_py(), np.float64), np.frombuffer(k.as_py(), np.uint32).astype(np.int64)
            sums, known = (s, k) if sums is None else (sums + s, known + k)
    n = len(sums)
    ids, valid = np.frombuffer(own, np.int64, n), np.frombuffer(own, bool, n, 8 * n)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~valid), "text_key": np.frombuffer(own, np.int64, n, 9 * n), "n_tokens": np.frombuffer(own, np.int64, n, 17 * n), "log_sum": sums, "n_known": known})


def _probabilities(column: pa.Array, count_of, n: int, v: int, starts: int) -> np.ndarray:
    """Score of each text; ``count_of`` gives the expected counts of distinct tokens and of distinct bigrams."""
    h, first = tokens(column)
    key, _ = bigrams(h, first)
    t, code = np.unique(h, return_inverse=True)
    u, u_code = np.unique(key, return_inverse=True)
    c, pairs = count_of(t, u)
    single = ((c + ADD) / (n + ADD * (v + 1)))[code]
    # the token before is the one at the place before, START at the first
    c_before = np.empty(len(h))
    c_before[1:] = c[code[:-1]]
    c_before[first[:-1]] = starts
    pair = np.minimum(pairs[u_code], c_before)
    run = np.concatenate(([0.0], np.cumsum(np.log10((pair + PRIOR * single) / (c_before + PRIOR)))))
    return run[first[1:]] - run[first[:-1]]


def _score(filter_, n: int, v: int, starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = filter_.value
        for part in X.slices(batches):
            score = _probabilities(part.column("text"), lambda t, u: (f.count(t), f.count(bigram_keys(u))), n, v, starts)
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "text_key": text_keys(part.column("text")), "score": score})
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of texts, each packed in a row."""
    zip_, part_no = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
    for seq, part in enumerate(X.slices(batches)):
        data = pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "text": part.column("text").cast(pa.large_string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, data.schema) as out:
            out.write_batch(data)
        yield pa.record_batch({"slice": pa.array([(part_no << 32) | seq], pa.int64()), "block": pa.array([-1], pa.int32()), "packed": pa.array([zip_.compress(sink.getvalue())], pa.binary())})


def _texts(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_next_batch()


def _probe(filter_, block: int):
    """Levels of each slice's distinct tokens and bigrams that lie in the filter's block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, zip_ = filter_.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for number, packed in zip(batch.column("slice"), batch.column("packed")):
                h, first = tokens(_texts(packed.as_py()).column("text"))
                t, u = f.own(np.unique(h)), f.own(np.unique(bigrams(h, first)[0]))
                found = _join(*(f.level(x).astype(np.uint8).tobytes() for x in (t, bigram_keys(u))))
                yield pa.record_batch({"slice": pa.array([number.as_py()], pa.int64()), "block": pa.array([block], pa.int32()), "packed": pa.array([zip_.compress(found)], pa.binary())})
                X.release()
    return run


def _score_slice(n: int, v: int, starts: int):
    """Scores of the texts of a slice from its levels of all blocks, which follow each other as the keys do."""
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("block").to_pylist(), group.column("packed").to_pylist()))
        part = _texts(rows[0][1])
        found = [_split(zstandard.ZstdDecompressor().decompress(x)) for _, x in rows[1:]]
        c, pairs = (COUNT_OF[np.frombuffer(b"".join(x[i] for x in found), np.uint8)] for i in (0, 1))
        score = _probabilities(part.column("text"), lambda t, u: (c, pairs), n, v, starts)
        return pa.table({"doc_id": part.column("doc_id"), "text_key": text_keys(part.column("text")), "score": score})
    return run


def blocks(n_bits: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Neighbouring buckets (low, high) of at most ``max_bits`` together; a larger bucket is a block of its own."""
    out, total = [[0, 0]], 0
    for k, bits in enumerate(n_bits):
        if k > out[-1][0] and total + bits > max_bits:
            out.append([k, k])
            total = 0
        out[-1][1] = k + 1
        total += bits
    return [tuple(x) for x in out]


def score(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``."""
    spark = docs.sparkSession
    buckets = buckets_for(docs, partitions(spark))
    source = docs.select("doc_id", "text", (crc_mod("doc_id", FOLDS) != 0).alias("train"))
    answer = source.mapInArrow(_gather(buckets), PACKED).groupBy("bucket").applyInArrow(_count(buckets), ANSWER)
    answer = materialize(answer, "counts")
    made = answer.where("stretch is not null").select("bucket", "n_bits", "v", "n").orderBy("bucket").toArrow()
    starts = answer.where("slice is null and stretch is null").agg(F.sum("n")).first()[0] or 0
    n, v = sum(made.column("n").to_pylist()), sum(made.column("v").to_pylist())
    base = answer.where("slice is not null").select("slice", "sums", "known", "ids").groupBy("slice").applyInArrow(_add_up, "doc_id long, text_key long, n_tokens long, log_sum double, n_known long")
    base = base.dropDuplicates(["doc_id", "text_key"])
    if not made.num_rows:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    n_bits, made_of = made.column("n_bits").to_pylist(), answer.where("stretch is not null").select("bucket", "stretch")

    def part(low: int, high: int):
        """Broadcast filter of the buckets from ``low`` to before ``high``."""
        own = made_of.where(F.col("bucket").between(low, high - 1)).orderBy("bucket").select("stretch").toArrow().column("stretch")
        return spark.sparkContext.broadcast(Filter(np.concatenate([X.text_buffer(c)[0] for c in own.chunks]), n_bits[low:high], low, buckets))

    cut = blocks(n_bits, max_bits)
    if len(cut) == 1:
        scored = source.select("doc_id", "text").mapInArrow(_score(part(*cut[0]), n, v, starts), "doc_id long, text_key long, score double")
    else:
        cut_texts = materialize(source.select("doc_id", "text").mapInArrow(_cut, PROBED), "slices")
        probed = cut_texts
        for k, (low, high) in enumerate(cut):
            filter_ = part(low, high)
            probed = probed.unionByName(materialize(cut_texts.mapInArrow(_probe(filter_, k), PROBED), "levels"))
            filter_.destroy()
        scored = probed.groupBy("slice").applyInArrow(_score_slice(n, v, starts), "doc_id long, text_key long, score double")
    scored = scored.alias("s")
    b = base.alias("b")
    both = scored.join(b, F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("s.text_key") == F.col("b.text_key")))
    whole = float(np.log10(n + ADD * (v + 1)))
    return both.select(F.col("s.doc_id").alias("doc_id"), (crc_mod("s.doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("log_sum") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")
