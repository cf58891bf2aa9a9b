"""Embedding whitening against dense linear algebra."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tapegrain.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, w string, n string, deviation string, component string"


def frame(spark, rows):
    from tapegrain.llm.common import prepare
    return prepare(spark).createDataFrame([(i, v, "clash", "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def check(got, kept):
    """Rows against numpy's symmetric solver over the exact grid numbers of ``kept`` [(id, vector)]."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], object)
    n, total = len(x), x.sum(axis=0)
    z = np.array([[float(Fraction(int(a) * n - int(s), n)) for a, s in zip(r, total)] for r in x])
    cov = z.T @ z / n
    value = np.sort(np.linalg.eigvalsh(cov))[::-1]
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"], r["deviation"]].setdefault(r["component"], []).append(r)
    width = max(r["component"] for r in got)
    assert len(got) == n * width and all(r["n"] == n and r["identity_error"] <= 1e-4 for r in got)
    white = np.zeros((n, width))
    for k, ((i, _), row) in enumerate(zip(kept, x)):
        deviation = sum((int(a) * n - int(s)) ** 2 for a, s in zip(row, total))
        for c, found in by[i, deviation].items():
            white[k, c - 1] = found[0]["whitened"]
            assert abs(found[0]["explained"] - value[c - 1] / cov.trace()) <= 1e-6 * value[c - 1] / cov.trace()
    parts = white.T @ z / n / np.sqrt(value[:width])[:, None]  # rows: the components, if whitened is z W
    assert np.allclose(parts @ parts.T, np.eye(width), atol=1e-7) and np.allclose(cov @ parts.T, parts.T * value[:width], atol=1e-7 * value[0])
    return width


def test_whitening_against_dense(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * np.geomspace(3, 0.2, 40)).astype(np.float32).tolist()
    kept = list(enumerate(vectors)) + [(None, vectors[0]), (5, vectors[7]), (5, vectors[5])]
    bad = [(500, None), (501, []), (502, [None] + vectors[0][1:]), (503, [float("nan")] + vectors[0][1:]), (504, [float("-inf")] + vectors[0][1:]), (505, [3e38] + vectors[0][1:]), (506, vectors[0][:39]), (507, vectors[0] * 2)]
    got = whitening.whitened(frame(spark, kept + bad)).collect()
    assert check(got, kept) == 32


def test_rank_and_large_entries(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 3))
    low = np.column_stack([base, base[:, 0] * 0 + 2, base[:, :1]]).astype(np.float32).tolist()
    assert check(whitening.whitened(frame(spark, list(enumerate(low)))).collect(), list(enumerate(low))) == 3
    far = [(i, [float(np.float32(v * 1e13)) for v in r]) for i, r in enumerate(base.tolist())]  # sums beyond a long's half
    assert check(whitening.whitened(frame(spark, far)).collect(), far) == 3


def test_no_variance(spark):
    assert whitening.whitened(frame(spark, [(1, [0.5, 1.0])])).count() == 0
    assert whitening.whitened(frame(spark, [(i, [0.5, 1.0]) for i in range(9)])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(frame(spark, [])).count() == 0


def test_small_eigenvalues_are_exact():
    """Columns of widely different scale: relative accuracy that a symmetric solver does not give."""
    d = np.diag([1.0, 1e-3, 1e-6, 1e-7])
    r = np.array([[1, 0.3, 0.2, 0.1], [0.3, 1, 0.4, 0.2], [0.2, 0.4, 1, 0.5], [0.1, 0.2, 0.5, 1]])
    value, parts = whitening.jacobi(whitening.pivoted_cholesky(d @ r @ d))
    assert len(value) == 4 and abs(np.prod(value) / (np.linalg.det(r) * np.prod(np.diag(d)) ** 2) - 1) < 1e-9
    assert np.allclose(parts.T @ parts, np.eye(4), atol=1e-12)


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_jacobi_against_symmetric_solver(d):
    rng = np.random.default_rng(d)
    a = np.cov(rng.normal(size=(d, 5 * d + 5)))
    a = np.atleast_2d(a)
    factor = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a)
    value, parts = whitening.jacobi(factor)
    assert np.allclose(value, np.sort(np.linalg.eigvalsh(a))[::-1]) and np.allclose(parts * value @ parts.T, a)


def test_query(spark):
    from tapegrain.llm import queries
    got = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint" and got.groupBy("vec_id").count().where("count <> 32").isEmpty()
