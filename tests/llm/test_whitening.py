"""Exact sums against Python integers, components against a dense solve of exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from exposight.llm import whitening as Wh

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component string"


def rows(spark, vectors):
    return spark.createDataFrame([(i, v, None, "x", 1, None) for i, v in vectors], SCHEMA)


def brute(vectors):
    """{row number: deviation}, n, exact covariance, mean."""
    x = [None if v is None or not v or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in vectors]
    fit = sorted({t for t in x if t})
    n, d = len(fit), len(fit[0])
    s = [sum(t[j] for t in fit) for j in range(d)]
    cov = [[Fraction(sum((n * t[i] - s[i]) * (n * t[j] - s[j]) for t in fit), n**3) for j in range(d)] for i in range(d)]
    return x, n, s, np.array([[float(c) for c in r] for r in cov])


def test_limbs_and_gram():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5, 2**20, 2**40, 2**61):
        x = rng.integers(-size, size + 1, (37, 3))
        parts = Wh.limbs(x, 7)
        assert (sum(p.astype(int).astype(object) << 7 * k for k, p in enumerate(parts)) == x).all()
        assert (np.abs(parts) <= 64).all()
        want = x.astype(object).T @ x.astype(object)
        assert (Wh.gram(x, 7, 16) == want).all() and (Wh.gram(x) == want).all() and (Wh.gram(x.astype(object)) == want).all()
    big = np.array([[10**25, -3], [7, 2 * 10**24]], object)
    assert (Wh.gram(big) == big.T @ big).all()


def test_largest_block_is_exact():
    """The worst digits in a whole block stay below 2**53."""
    x = np.full((Wh.BLOCK, 2), -(1 << (Wh.BITS - 1)) + (-(1 << (Wh.BITS - 1)) << Wh.BITS))
    assert (Wh.gram(x) == Wh.BLOCK * int(x[0, 0]) ** 2).all()


def test_centred_and_squares():
    x = np.array([[1_000_000, 2**51], [5, -(2**51)]])
    for n, s in ((2, [1_000_005, 0]), (10**9, [10**18, -(10**20)])):
        want = [[n * int(a) - b for a, b in zip(r, s)] for r in x]
        got = Wh.centred(x, n, s)
        assert got.tolist() == want and Wh.squares(got) == [sum(a * a for a in r) for r in want]


@pytest.mark.parametrize("d", [1, 3, 20])
def test_whiten(spark, d):
    rng = np.random.default_rng(d)
    vectors = [(k, (rng.normal(size=d) * (np.arange(d) + 1)).astype(np.float32).tolist()) for k in range(90)]
    vectors += [(k, vectors[0][1]) for k in (200, 201, 200)] + [(300, None), (301, [None] * d), (302, [float("nan")] * d), (303, [float("inf")] * d), (304, []), (None, vectors[3][1])]
    x, n, s, cov = brute(vectors)
    got = Wh.whiten(rows(spark, vectors).repartition(7), most=16).collect()
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    assert len(got) == sum(t is not None for t in x) * min(16, d)
    by_id = {i: t for (i, _), t in zip(vectors, x) if t}
    signs: dict = {}
    for r in got:
        t, k = by_id[r.vec_id], r.component - 1
        assert r.n == n and int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(t, s))
        assert abs(r.explained - values[k] / np.trace(cov)) <= 1e-9 and r.identity_error < 1e-8
        want = float(np.array([float(Fraction(n * a - b, n)) for a, b in zip(t, s)]) @ axes[:, k] / math.sqrt(values[k]))
        if abs(want) > 1e-6:
            signs.setdefault(k, set()).add(round(r.whitened / want, 6))
    assert all(v in ({1.0}, {-1.0}) for v in signs.values()) and len(signs) == min(16, d)


def test_whiten_edges(spark):
    assert Wh.whiten(rows(spark, []).limit(0)).count() == 0
    assert Wh.whiten(rows(spark, [(1, None), (2, [])])).count() == 0
    assert Wh.whiten(rows(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0  # no variance
    flat = Wh.whiten(rows(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()  # one component
    assert len(flat) == 9 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    two = Wh.whiten(rows(spark, [(k, [float(k % 3), float(k % 2)] + [1.0 * k] * (k % 2)) for k in range(12)]))  # lengths 2 and 3 apart
    assert {r.n for r in two.select("n").distinct().collect()} == {3, 6}
    far = Wh.whiten(rows(spark, [(1, [1e30, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])])).collect()  # too large for a long
    assert {r.vec_id for r in far} == {2, 3}


def test_floor_of_negative_entries(spark):
    out = Wh.whiten(rows(spark, [(1, [-0.01]), (2, [0.01]), (3, [-0.015625])])).collect()  # x: -1, 0, -1
    assert {r.n for r in out} == {2} and {r.vec_id: int(r.deviation) for r in out} == {1: 1, 2: 1, 3: 1}


def test_table(spark):
    """Every row of a given table has 16 components whose covariance over different vectors is the identity."""
    got = Wh.whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (500, 16) and got["identity_error"].max() < 1e-9 and (np.diff(got.groupby("component")["explained"].first()) <= 0).all()
