"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each text (lengths, shares of character kinds, repetition, frequent-word share) are scaled
and mapped to cosines of random projections, which approximate a Gaussian kernel. Tasks sum their parts
of the normal equations, the driver solves the small system, and scores are calibrated by isotonic
regression over their counts in fixed score bins. What the driver holds depends on the number of
features only. All labelled training rows are used; nothing is sampled.

Null and empty texts have statistics of zero and get a score like any other. Labels that are null or not
0/1 are ignored; a document labelled several times counts once for each label. Without labels of both
kinds every score is 0.5 (one kind: that label). Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm import textops as X
from tapegrain.llm.common import crc_mod, materialize

FEATURES, WIDTH, RIDGE, BINS = 256, 3.0, 1e-3, 1000
ACCEPT = 0.7
STATS = ["log_bytes", "log_words", "word_len", "word_len_sd", "long_words", "one_char_words", "upper", "digit", "punct", "symbol", "high", "newline", "line_len", "distinct_words", "top_word", "repeat_lines",
         "end_symbol", "all_upper_words", "pipes", "distinct_trigrams", "period", "comma", "capital_words", "hash_spread"]


def _kinds() -> dict[str, np.ndarray]:
    chars = [chr(b) for b in range(256)]
    ascii_ = np.arange(256) < 128
    def of(test):
        return np.array([test(c) for c in chars]) & ascii_
    return {"upper": of(str.isupper), "lower": of(str.islower), "digit": of(str.isdigit), "punct": of(lambda c: c in ".,;:!?'\"()-"),
            "symbol": of(lambda c: c in "#$%&*+/<=>@[\\]^_`{|}~"), "high": ~ascii_, "newline": of(lambda c: c == "\n"), "pipes": of(lambda c: c == "|"), "period": of(lambda c: c == "."), "comma": of(lambda c: c == ",")}


KINDS = _kinds()


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return run[first[1:]] - run[first[:-1]]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each text and the count of its most frequent value."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(h))))
    return np.bincount(d[at], minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    data, off = X.text_buffer(column)
    s, e, first = X.words(data, off)
    size, n = np.maximum(np.diff(off), 1).astype(float), np.maximum(np.diff(first), 1).astype(float)
    length = (e - s).astype(float)
    out = {"log_bytes": np.log1p(np.diff(off)), "log_words": np.log1p(np.diff(first))}
    out["word_len"] = _per_text(length, first) / n
    out["word_len_sd"] = np.sqrt(np.maximum(_per_text(length ** 2, first) / n - out["word_len"] ** 2, 0))
    out["long_words"] = _per_text(length > 15, first) / n
    out["one_char_words"] = _per_text(length == 1, first) / n
    for k in ("upper", "digit", "punct", "symbol", "high", "newline", "pipes", "period", "comma"):
        out[k] = _per_text(KINDS[k][data], off) / size
    lines = X.words(data, off, np.arange(256) == 10)
    n_lines = np.maximum(np.diff(lines[2]), 1)
    out["line_len"] = np.log1p(size / n_lines)
    h = X.span_hashes(data, s, e)
    out["distinct_words"], top = (x / n for x in _distinct(h, first))
    out["top_word"] = top
    out["repeat_lines"] = 1 - _distinct(X.span_hashes(data, lines[0], lines[1]), lines[2])[0] / n_lines
    ends = data[e - 1] if len(e) else data[:0]
    out["end_symbol"] = _per_text(KINDS["symbol"][ends], first) / n
    capital = KINDS["upper"][data[s]] if len(s) else np.zeros(0, bool)
    out["capital_words"] = _per_text(capital, first) / n
    low = np.concatenate(([0], np.cumsum(KINDS["lower"][data])))
    up = np.concatenate(([0], np.cumsum(KINDS["upper"][data])))
    out["all_upper_words"] = _per_text((low[e] == low[s]) & (up[e] > up[s] + 1), first) / n
    at, _ = X.window_starts(first, 3)
    tri = np.maximum(np.diff(first) - 2, 0)
    out["distinct_trigrams"] = _distinct(X.windows(h, 3)[at], np.concatenate(([0], np.cumsum(tri))))[0] / np.maximum(tri, 1)
    out["hash_spread"] = out["distinct_words"] * np.log1p(n)
    return np.stack([out[k] for k in STATS], axis=1)


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in X.slices(batches):
        x = statistics(part.column("text"))
        yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(pa.list_(pa.float64()))})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATS))


class Kernel:
    """Scaling and random projections, from the moments of the training rows."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.maximum(sd, 1e-9)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        return np.hstack((np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z, np.ones((len(x), 1))))


def _normal_equations(kernel: Kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = None
        for batch in batches:
            if batch.num_rows:
                phi, y = kernel(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
                a, b = (phi.T @ phi, phi.T @ y) if a is None else (a + phi.T @ phi, b + phi.T @ y)
        if a is not None:
            rows = np.hstack((a, b[:, None]))
            yield pa.record_batch({"row": pa.array(range(len(rows)), pa.int32()), "v": pa.array(list(rows), pa.list_(pa.float64()))})
    return run


def _bins(kernel: Kernel, beta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BINS + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = _bin_of(kernel(_matrix(batch.column("x"))) @ beta)
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(int)
                for k in (0, 1):
                    n[k] += np.bincount(at[y == k], minlength=BINS + 1)
        got = np.flatnonzero(n.sum(axis=0))
        yield pa.record_batch({"bin": got, "zeros": n[0][got], "ones": n[1][got]})
    return run


def _bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((raw + 0.5) / 2 * BINS), 0, BINS).astype(np.int64)


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Non-decreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame):
    """A function from a matrix of statistics to scores in [0, 1]; ``train``: x, y."""
    sums = [F.sum(F.col("x")[i]) for i in range(len(STATS))] + [F.sum(F.col("x")[i] * F.col("x")[i]) for i in range(len(STATS))]
    n, ones, *moments = train.agg(F.count("*"), F.sum("y"), *sums).first()
    if not n or ones in (0, n):
        level = 0.5 if not n else float(ones > 0)
        return lambda x: np.full(len(x), level)
    mean = np.array(moments[:len(STATS)]) / n
    sd = np.sqrt(np.maximum(np.array(moments[len(STATS):]) / n - mean ** 2, 0))
    kernel = Kernel(mean, sd)
    # one matrix for each task, added up row by row
    parts = train.mapInArrow(_normal_equations(kernel), "row int, v array<double>").select("row", F.posexplode("v").alias("k", "v"))
    cells = parts.groupBy("row", "k").agg(F.sum("v").alias("v")).toArrow()
    size = FEATURES + len(STATS) + 1
    full = np.zeros((size, size + 1))
    full[cells.column("row").to_numpy(), cells.column("k").to_numpy()] = cells.column("v").to_numpy()
    beta = np.linalg.solve(full[:, :size] + RIDGE * n * np.eye(size) / FEATURES, full[:, size])
    hist = train.mapInArrow(_bins(kernel, beta), "bin long, zeros long, ones long").groupBy("bin").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).orderBy("bin").toArrow()
    at, zeros, ones = (hist.column(c).to_numpy() for c in ("bin", "zeros", "ones"))
    level = isotonic(zeros + ones, ones / (zeros + ones))
    return lambda x: np.interp(_bin_of(kernel(x) @ beta), at, level)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": np.asarray(model(x), float) if len(x) else np.zeros(0)})
    return run


def _score_rows(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            score = np.asarray(model(statistics(part.column("text"))), float)
            yield pa.record_batch({n: part.column(n) for n in names} | {"_score": pa.array(score)})
    return run


def _train(stats: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    return materialize(stats.where(crc_mod("doc_id", 4) != 2).join(good, "doc_id").select("x", "y"), "train")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    stats = materialize(docs.select("doc_id", "text").mapInArrow(_with_statistics, "doc_id long, x array<double>"), "stats")
    model = fit(_train(stats, labels))
    out = stats.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be of low quality."""
    stats = docs.select("doc_id", "text").mapInArrow(_with_statistics, "doc_id long, x array<double>")
    model = fit(_train(stats, labels))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score_rows(model, docs.columns), f"{schema}, _score double").where(F.col("_score") >= ACCEPT).drop("_score")
