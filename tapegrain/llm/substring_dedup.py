"""Exact removal of repeated word windows, partitioned by super-k-mers.

Every window of ``window`` consecutive words has a minimiser: the least, in a fixed order, of the
runs of ``seed`` words in it. Consecutive windows with the same minimiser travel together as one packed
string (a super-k-mer) to the bucket of that minimiser, so equal windows always meet. A bucket sorts its
windows by hash, compares the words of equal hashes byte by byte and reports every window that also
starts earlier. Texts cross the network about three times compressed instead of once per window.

Skew: runs of words that are frequent over all texts come last in the order, so a common line or
passage is a minimiser only of windows that hold nothing else, and those are equal; equal super-k-mers of
one slice of input travel once. Hence no bucket gathers a frequent key.

Null and empty texts have no words and stay as they are. Rows that share a doc_id are judged each by its
text, at one place: of two windows that start at the same word of that id none is the earlier. Null ids
share the place after all others. Only where an id occurs twice, or is null, a hash of the text travels
with it to tell its rows apart. Further columns are kept.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm import textops as X
from tapegrain.llm.common import buckets_for, materialize, partitions

WINDOW, SEED = 20, 3
_LAST = np.iinfo(np.int64).max
_HEAVY = np.uint64(1) << np.uint64(63)
PACKED = "bucket int, packed binary"


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(_LAST)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _count_seeds(seed: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of words seen ``least`` times in a slice, and under hash 0 the number of all runs."""
        for part in X.slices(batches):
            data, off = X.text_buffer(part.column("text"))
            s, e, first = X.words(data, off)
            at, _ = X.window_starts(first, seed)
            h, n = np.unique(X.windows(X.span_hashes(data, s, e), seed)[at], return_counts=True)
            often = n >= least
            yield pa.record_batch({"seed": np.append(h[often].astype(np.int64), 0), "n": np.append(n[often], len(at)).astype(np.int64)})
    return run


def heavy_seeds(docs: DataFrame, seed: int, buckets: int) -> np.ndarray:
    """Runs of words that alone would fill a quarter of an average bucket: at most about 40 for each bucket."""
    counts = materialize(docs.select("text").mapInArrow(_count_seeds(seed, 4), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), "seeds")
    total = counts.where("seed = 0").agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.col("seed") != 0) & (F.col("n") > max(16, total // (40 * buckets)))).select("seed").toArrow()
    return np.sort(found.column("seed").to_numpy().astype(np.uint64))


def _pack(window: int, seed: int, buckets: int, heavy: np.ndarray, keyed: bool):
    width = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for part in X.slices(batches):
            part = part.take(pa.array(np.argsort(_ids(part.column("doc_id")), kind="stable")))
            ids = _ids(part.column("doc_id"))
            text_key = part.column("key").to_numpy(zero_copy_only=False)
            data, off = X.text_buffer(part.column("text"))
            s, e, first = X.words(data, off)
            if not len(s):
                continue
            data, s, e = X.joined(data, s, e)
            h = X.span_hashes(data, s, e)
            at, doc = X.window_starts(first, window)
            if not len(at):
                continue
            order = X.windows(h, seed)
            if len(heavy):
                place = np.minimum(np.searchsorted(heavy, order), len(heavy) - 1)
                order = np.where(heavy[place] == order, order | _HEAVY, order & ~_HEAVY)
            least, own = X.sliding_min(order, width)[at], X.windows(h, window)[at]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            run_at = np.flatnonzero(new)
            n_win = np.diff(np.append(run_at, len(at)))
            w0 = at[run_at]
            begin, end = s[w0], e[w0 + n_win + window - 2]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own)))
            key = X.mix(own[run_at]) + total[run_at + n_win] - total[run_at]
            _, back, code = np.unique(key, return_index=True, return_inverse=True)
            rep, raw = back[code], data.tobytes()
            known = np.zeros(len(key), bool)  # an equal string of a smaller (doc_id, start) is in this slice
            for i in np.flatnonzero(rep != np.arange(len(key))):
                j = rep[i]
                known[i] = ids[doc[run_at[i]]] != ids[doc[run_at[j]]] or doc[run_at[i]] == doc[run_at[j]]
                known[i] &= raw[begin[i]:end[i]] == raw[begin[j]:end[j]]
            length = np.where(known, 0, end - begin)
            bucket = (X.mix(least[run_at]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            doc_id, start = ids[doc[run_at]], w0 - first[doc[run_at]]
            out = []
            for b in np.flatnonzero(np.diff(edges)):
                k = by[edges[b]:edges[b + 1]]
                text = X.gather(data, begin[k], begin[k] + length[k])
                blob = struct.pack("<qq", len(k), keyed) + (text_key[doc[run_at[k]]].tobytes() if keyed else b"") + doc_id[k].tobytes() + start[k].astype(np.int64).tobytes() + n_win[k].astype(np.int64).tobytes() + length[k].astype(np.int64).tobytes() + text.tobytes()
                out.append((int(b), zip_.compress(blob)))
            yield pa.record_batch({"bucket": pa.array([b for b, _ in out], pa.int32()), "packed": pa.array([p for _, p in out], pa.binary())})
    return run


def _unpack(blobs) -> tuple[np.ndarray, ...]:
    """Text key, doc_id, start, windows and length of each super-k-mer, and all their bytes."""
    open_, cols, texts = zstandard.ZstdDecompressor(), [], []
    for b in blobs:
        raw = open_.decompress(b)
        n, keyed = struct.unpack_from("<qq", raw)
        rows = 4 + keyed
        held = np.frombuffer(raw, np.int64, rows * n, 16).reshape(rows, n)
        cols.append(held if keyed else np.vstack((np.zeros((1, n), np.int64), held)))
        texts.append(np.frombuffer(raw, np.uint8, offset=16 + 8 * rows * n))
    c = np.concatenate(cols, axis=1)
    return c[0], c[1], c[2], c[3], c[4], np.concatenate(texts)


def exact_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: by hash, checked on the bytes where ``used``."""
    _, back, code = np.unique(h, return_index=True, return_inverse=True)
    a, b = np.flatnonzero(used), back[code][used]
    if X.same_spans(data, s[a], e[a], s[b], e[b]):
        return code
    raw, ids = data.tobytes(), {}
    return np.array([ids.setdefault(raw[i:j], len(ids)) for i, j in zip(s, e)], np.int64)


def _find(window: int):
    def run(group: pa.Table) -> pa.Table:
        key, doc, start, n_win, length, data = _unpack(x.as_py() for x in group.column("packed"))
        done = length == 0
        lo, hi, ids, keys = [start[done]], [start[done] + n_win[done] + window - 1], [doc[done]], [key[done]]
        place = np.concatenate(([0], np.cumsum(length)[:-1]))
        keep = np.flatnonzero(~done)
        keep = keep[np.lexsort((start[keep], doc[keep]))]
        data = X.gather(data, place[keep], place[keep] + length[keep])
        key, doc, start, n_win, length = key[keep], doc[keep], start[keep], n_win[keep], length[keep]
        if len(keep):
            s, e, first = X.words(data, np.concatenate(([0], np.cumsum(length))))
            h = X.span_hashes(data, s, e)
            at, of = X.window_starts(first, window)
            w = X.windows(h, window)[at]
            order = np.argsort(w, kind="stable")
            begins = np.ones(len(w), bool)
            begins[1:] = w[order][1:] != w[order][:-1]
            head = np.empty(len(w), np.int64)
            head[order] = order[np.maximum.accumulate(np.where(begins, np.arange(len(w)), 0))]
            again = np.flatnonzero(head != np.arange(len(w)))
            used = np.zeros(len(s), bool)
            for k in range(window):
                used[at[again] + k] = True
            word = exact_ids(data, s, e, h, used) if len(again) else h
            equal = np.ones(len(again), bool)
            for k in range(window):
                equal &= word[at[again] + k] == word[at[head[again]] + k]
            if not equal.all():  # different windows with one hash: compare whole sequences
                seen: dict = {}
                for i in np.flatnonzero(np.isin(w, w[again[~equal]])):
                    head[i] = seen.setdefault(tuple(word[at[i]:at[i] + window]), i)
                again = np.flatnonzero(head != np.arange(len(w)))
            begin = start[of] + at - first[of]
            again = again[(doc[of[again]] != doc[of[head[again]]]) | (begin[again] != begin[head[again]])]
            if len(again):
                cut = np.ones(len(again), bool)
                cut[1:] = (np.diff(again) != 1) | (of[again[1:]] != of[again[:-1]])
                i = np.flatnonzero(cut)
                j = np.append(i[1:], len(again)) - 1
                lo.append(begin[again[i]])
                hi.append(begin[again[j]] + window)
                ids.append(doc[of[again[i]]])
                keys.append(key[of[again[i]]])
        return pa.table({"doc_id": np.concatenate(ids), "key": np.concatenate(keys), "span": pa.StructArray.from_arrays([pa.array(np.concatenate(lo), pa.int64()), pa.array(np.concatenate(hi), pa.int64())], ["lo", "hi"])})
    return run


def _with_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``_key``: a hash of the text where ids do not tell rows apart, else 0."""
    keyed = not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    return docs.withColumn("_key", F.xxhash64("text") if keyed else F.lit(0).cast("long")), keyed


def repeated_spans(docs: DataFrame, keyed: bool, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, key, spans): word ranges [lo, hi) of each text that windows starting earlier elsewhere cover."""
    buckets = buckets_for(docs, 8 * partitions(docs.sparkSession))
    heavy = heavy_seeds(docs, seed, buckets)
    packed = docs.select("doc_id", F.col("_key").alias("key"), "text").mapInArrow(_pack(window, seed, buckets, heavy, keyed), PACKED)
    found = packed.groupBy("bucket").applyInArrow(_find(window), "doc_id long, key long, span struct<lo:long,hi:long>")
    return found.groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, sha, text = [], [], [], []
        for raw, spans in zip(batch.column("text"), batch.column("_spans")):
            value = raw.as_py()
            w = (value or "").encode().split()
            n_words.append(len(w))
            if spans.is_valid and len(spans):
                flat = spans.values
                step = np.zeros(len(w) + 1, np.int64)
                np.add.at(step, flat.field("lo").to_numpy(), 1)
                np.add.at(step, flat.field("hi").to_numpy(), -1)
                gone = np.cumsum(step[:-1]) > 0
                w = [x for x, g in zip(w, gone.tolist()) if not g]
            n_removed.append(n_words[-1] - len(w))
            kept = b" ".join(w)
            sha.append(hashlib.sha256(kept).hexdigest())
            text.append(kept.decode() if n_removed[-1] else value)
        out = {n: batch.column(n) for n in batch.schema.names if n not in ("_spans", "_key")}
        out["text"] = pa.array(text, pa.string())
        yield pa.record_batch(out | {"_n_words": pa.array(n_words, pa.int64()), "_n_removed": pa.array(n_removed, pa.int64()), "_sha": pa.array(sha, pa.string())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: bool = True) -> DataFrame:
    """``docs`` with every word of a window that also starts earlier taken out of ``text``.

    Adds n_words, n_removed and kept_sha256 (of the kept words joined by one space); own columns of these
    names are replaced. A text from which nothing is removed stays as it was, byte for byte. With
    ``text=False`` only doc_id and the three figures are returned.
    """
    figures = {"n_words": "_n_words", "n_removed": "_n_removed", "kept_sha256": "_sha"}
    base = docs.drop(*figures)
    if not text:
        base = base.select("doc_id", "text")
    marked, keyed = _with_key(base)
    spans = repeated_spans(marked, keyed, window, seed).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), F.col("spans").alias("_spans"))
    both = marked.join(spans, (F.coalesce(F.col("doc_id"), F.lit(int(_LAST))) == F.col("_id")) & (F.col("_key") == F.col("_k")), "left").drop("_id", "_k")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    done = both.mapInArrow(_apply, f"{schema}, _n_words long, _n_removed long, _sha string").withColumnsRenamed({v: k for k, v in figures.items()})
    return done if text else done.select("doc_id", *figures)
