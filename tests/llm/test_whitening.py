"""Whitening, held against a whole covariance in memory."""

from __future__ import annotations

import math

import numpy as np
import pytest

from meshloom.llm import queries, whitening

NAN = float("nan")


def plain(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vec = np.linalg.eigh(centred.T @ centred / n)
    return x, n, total, values[::-1], vec[:, ::-1].T


def check(got, ids, vectors, k):
    x, n, total, values, components = plain(vectors)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == k * len(ids) and set(by) == set(ids)
    for j in range(k):
        want = (x - total / n) @ components[j] / math.sqrt(values[j])
        mine = np.array([by[i][j + 1].whitened for i in ids])
        assert np.abs(mine - want * np.sign(mine @ want)).max() < 1e-8
        assert all(abs(by[i][j + 1].explained / (values[j] / values.sum()) - 1) < 1e-9 for i in ids)
    for i, row in zip(ids, x.tolist()):
        want = sum((n * v - s) ** 2 for v, s in zip(row, total.tolist()))
        assert all(r.deviation == want and r.n == n and r.identity_error < 1e-8 for r in by[i].values())


def test_query_against_a_whole_covariance(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    check(queries.op13_whitening(spark, data).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 8)


@pytest.mark.parametrize("size,scale", [(3, 1.0), (40, 0.8), (100, 0.97)])
def test_blocks_of_all_widths(spark, size, scale):
    """Steep spectra end within the first block, flat ones widen it."""
    rng = np.random.default_rng(size)
    vectors = (rng.standard_normal((300, size)) * 20 * scale ** np.arange(size)) @ np.linalg.qr(rng.standard_normal((size, size)))[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>").repartition(5)
    found = whitening.fit(rows)
    assert found.passes <= 14 and (found.residuals <= 1e-12 * found.values[0]).all()
    check(whitening.whiten(rows).collect(), list(range(300)), vectors, min(size, 8))


def test_rows_that_are_left_out(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((50, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, NAN, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0]]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS cell", "4 AS n", "5 AS value", "6 AS component")
    check(whitening.whiten(rows.repartition(3)).collect(), list(range(50)), np.array(good, np.float32), 4)
    only = whitening.whiten(rows.where("vec_id >= 50 AND vec_id < 55"))
    assert only.count() == 0 and only.columns == whitening.whiten(rows).columns


def test_ties_repeats_nulls_and_no_variance(spark):
    rows = spark.createDataFrame([(None, [1.0, 1.0]), (1, [-1.0, -1.0]), (1, [-1.0, -1.0]), (None, [1.0, 1.0])], "vec_id int, embedding array<double>")
    got = whitening.whiten(rows).collect()
    assert len(got) == 8 and all(abs(abs(r.whitened) - 1) < 1e-9 and abs(r.explained - 1) < 1e-9 for r in got if r.component == 1)
    assert all(r.whitened is None and r.explained < 1e-9 for r in got if r.component == 2)
    one = whitening.whiten(rows.where("vec_id IS NULL")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, 0.0)] * 4
    eye = spark.createDataFrame([(i, [float(i == j) - float(i == j + 3) for j in range(3)]) for i in range(6)], "vec_id int, embedding array<double>")
    tied = whitening.whiten(eye).collect()  # one eigenvalue for all: any directions do
    assert len(tied) == 18 and all(abs(r.explained - 1 / 3) < 1e-9 and r.identity_error < 1e-9 for r in tied)


def test_deviations_that_no_long_holds():
    x = np.array([[1 << 30, 0], [5, 5]])
    assert whitening.deviations(x, 1 << 20, np.array([0, 0])) == [None, 50 << 40]
    assert whitening.deviations(x, 2, np.array([1, 1])) == [(2**31 - 1) ** 2 + 1, 162]
