"""Approximate nearest neighbours by largest inner product, with an adaptive scan of dimensions.

With one more component, sqrt(largest squared norm - own squared norm), the largest inner product is the
smallest distance. Vectors are rotated by a fixed random orthogonal matrix, so the distance over the first
k of d components, times d / k, estimates the whole. They are assigned to lists around centroids fitted on a
bounded sample; every vector is indexed. In each probed list distances grow by blocks of columns, and
after each block a candidate is abandoned when a hypothesis test says that its whole distance exceeds the
query's current bound (estimate above bound * (1 + EPSILON / sqrt(k))^2). Survivors get the exact inner
product of the original vectors in double precision.

The share of lists to probe is the least that finds PROBE_RECALL of the sample's own neighbours, so data
without clusters are probed widely. Queries go in blocks of at most QUERY_BLOCK (a bounded broadcast)
over the stored index, and each task returns its best for each query of the block.

Vectors that are null, zero, of another length than the most common, or that hold null, NaN or infinite
components take no part. Ties go to the smaller vec_id. Rows that share an id are one candidate, by the
best score; the rows of a query's id are not its candidates. Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.llm.common import materialize, partitions

TOP = 20
SAMPLE, MAX_LISTS, PROBE_RECALL, PROBE_QUERIES = 20_000, 1024, 0.97, 200
QUERY_BLOCK, COLUMNS, EPSILON = 8192, 16, 1.5


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(finite & F.exists("x", lambda v: v != 0))
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (size["d"] if size else 0))


class Space:
    """Augmentation, rotation and centroids."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.largest = largest
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        z = self(sample)
        lists = max(1, min(MAX_LISTS, int(np.sqrt(rows)), len(z)))
        c = z[rng.choice(len(z), lists, replace=False)]
        for _ in range(10):
            own = self._nearest(z, c)
            n = np.bincount(own, minlength=lists)
            total = np.zeros_like(c)
            np.add.at(total, own, z)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        self.centroids = c
        self.probes = self._calibrate(sample, z, rng)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0))
        return np.hstack((x, more[:, None])) @ self.rotation

    @staticmethod
    def _nearest(z: np.ndarray, c: np.ndarray) -> np.ndarray:
        half = (c * c).sum(axis=1) / 2
        return np.concatenate([(z[i:i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(z), 4096)]) if len(z) else np.zeros(0, np.int64)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self(x), self.centroids)

    def ranking(self, x: np.ndarray) -> np.ndarray:
        """Lists in the order in which each vector, as a query, probes them."""
        query = np.hstack((x, np.zeros((len(x), 1)))) @ self.rotation
        c = self.centroids
        return np.argsort((c * c).sum(axis=1) / 2 - query @ c.T, axis=1, kind="stable")

    def _calibrate(self, sample: np.ndarray, z: np.ndarray, rng) -> int:
        own = self._nearest(z, self.centroids)
        q = rng.choice(len(sample), min(PROBE_QUERIES, len(sample)), replace=False)
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -np.inf
        top = np.argsort(-score, axis=1)[:, :TOP]
        place = np.argsort(self.ranking(sample[q]), axis=1)  # position of each list in the probing order
        need = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
        return int(need[min(len(need) - 1, int(PROBE_RECALL * len(need)))]) + 1


def _assign(space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = space.value.assign(_matrix(batch.column("x")))
                yield pa.record_batch({"list": pa.array(own, pa.int32()), "vec_id": batch.column("vec_id"), "x": batch.column("x")})
    return run


class Best:
    """The nearest of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        who = np.unique(q)
        old = self.score[who] > -np.inf
        q = np.concatenate((q, np.repeat(who, old.sum(axis=1))))
        ids, score = np.concatenate((ids, self.id[who][old])), np.concatenate((score, self.score[who][old]))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        q, ids, score = q[new], ids[new], score[new]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        q, rank = q[keep], rank[keep]
        self.score[who] = -np.inf
        self.score[q, rank], self.id[q, rank] = score[keep], ids[keep]
        self.count[who] = (self.score[who] > -np.inf).sum(axis=1)

    def bound(self, q: np.ndarray) -> np.ndarray:
        return np.where(self.count[q] == self.k, self.score[q, -1], -np.inf)


def scan(space: Space, best: Best, q: np.ndarray, query: np.ndarray, turned: np.ndarray, query_ids: np.ndarray, x: np.ndarray, z: np.ndarray, ids: np.ndarray) -> None:
    """Vectors of one list against the queries ``q`` that probe it."""
    d = z.shape[1]
    # squared distance = |q|^2 + largest - 2 score, so the bound on the score is one on the distance
    limit = (query[q] ** 2).sum(axis=1) + space.largest - 2 * best.bound(q)
    part, alive = np.zeros((len(q), len(z))), ids[None, :] != query_ids[q][:, None]
    for lo in range(0, d, COLUMNS):
        a, b = turned[q, lo:lo + COLUMNS], z[:, lo:lo + COLUMNS]
        part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
        k = min(lo + COLUMNS, d)
        slack = 1 + 1e-9 if k == d else (1 + EPSILON / np.sqrt(k)) ** 2
        alive &= part * (d / k) <= (limit * slack + 1e-9)[:, None]
        rest = np.count_nonzero(alive)
        if not rest:
            return
        if k < d and rest * 16 < alive.size:  # few are left: their whole inner products cost less
            break
    i, j = np.nonzero(alive)
    for at in range(0, len(i), 200_000):
        u, v = i[at:at + 200_000], j[at:at + 200_000]
        best.add(q[u], ids[v], (query[q[u]] * x[v]).sum(axis=1))


def _search(space, block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, (query_ids, query, probed) = space.value, block.value
        turned = np.hstack((query, np.zeros((len(query), 1)))) @ sp.rotation
        best = Best(len(query), k)
        for batch in batches:
            lists, ids, x = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("x"))
            if not len(ids):
                continue
            z = sp(x)
            cut = np.flatnonzero(np.diff(lists)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(ids)]):
                own = np.flatnonzero(probed[:, lists[lo]])
                for q in (own[a:a + 1024] for a in range(0, len(own), 1024)):
                    scan(sp, best, q, query, turned, query_ids, x[lo:hi], z[lo:hi], ids[lo:hi])
        q, r = np.nonzero(best.score > -np.inf)
        yield pa.record_batch({"query_id": query_ids[q], "vec_id": best.id[q, r], "score": best.score[q, r]})
    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    n, largest = rows.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    mark = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = rows.where(mark <= int(min(1.0, SAMPLE / n) * (1 << 30))).orderBy(mark, "vec_id").select("x").toArrow()
    if not sample.num_rows:
        sample = rows.select("x").limit(1).toArrow()
    space_ = Space(_matrix(sample.column("x").combine_chunks()), largest, n)
    space = spark.sparkContext.broadcast(space_)
    # a list that holds many vectors is spread over tasks by the second key
    index = rows.mapInArrow(_assign(space), "list int, vec_id long, x array<double>")
    index = index.repartition(partitions(spark), "list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).sortWithinPartitions("list")
    index = materialize(index, "index")
    size = np.zeros(len(space_.centroids), np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row a list
        size[r["list"]] = r["n"]
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)) == b).toArrow()
        if not got.num_rows:
            continue
        query_ids, query = got.column("vec_id").to_numpy(), _matrix(got.column("x").combine_chunks())
        order = space_.ranking(query)
        reached = np.cumsum(size[order], axis=1)
        # at least ``probes`` lists, and as many as hold k candidates beside the query
        depth = np.maximum(space_.probes, (reached < k + 1).sum(axis=1) + 1)
        probed = np.zeros(order.shape, bool)
        np.put_along_axis(probed, order, np.arange(order.shape[1])[None, :] < depth[:, None], axis=1)
        block = spark.sparkContext.broadcast((query_ids, query, probed))
        out = out.unionByName(index.mapInArrow(_search(space, block, k), schema))
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
