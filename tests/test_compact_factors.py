"""LU factors of leaves kept as generators, and rows that meet their coefficients without the factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.operators import kernels
from ramify.plans import factors
from ramify.plans.hodlr import Hodlr


def block(seed, m, n, r, d):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(m, n, r)), rng.normal(size=(m, n, r))
    return u, v, np.broadcast_to(d, (m, n)).astype(float).copy()


def test_generators_give_the_factors_back():
    u, v, d = block(1, 7, 40, 3, 200.0)
    d[2, 5] = 0.0  # this leaf needs row exchanges
    lu, order = kernels.lu_factor(kernels.low_rank_block(u, v, d), "here")
    kept, good = kernels.lu_generators(u, v, d, lu, order)
    assert kept.shape == (7, 13, 40) and good.tolist() == [k != 2 for k in range(7)]
    assert np.allclose(kernels.lu_expanded(kept)[good], lu[good], rtol=0, atol=1e-11)
    columns = factors._kept_factors(u, v, d, lu, order)
    back, perm = factors._factors(*(factors._flat(c) for c in columns), 40, 0, 7)
    assert np.array_equal(perm, order) and np.array_equal(back[2], lu[2])
    assert np.allclose(back, lu, rtol=0, atol=1e-11)
    back, perm = factors._factors(*(factors._flat(c) for c in columns), 40, 2, 5)
    assert np.array_equal(perm, order[2:5]) and np.allclose(back, lu[2:5], rtol=0, atol=1e-11)
    assert [len(x) for x in columns[0]] == [13 * 40 if k != 2 else 1600 for k in range(7)]


@pytest.mark.parametrize("limit", [None, 0])
def test_stored_factors_are_small_and_stay_in_place(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(factors, "BROADCAST_BYTES", limit)
    n, r, leaf = 700, 2, 50
    u, v, d = (x[0] for x in block(2, 1, n, r, 150.0))
    d[60] = 0.0
    b = np.random.default_rng(3).normal(size=(n, 2))
    rows = [(i, u[i].tolist(), v[i].tolist(), float(d[i]), *map(float, b[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "i long, u array<double>, v array<double>, d double, p double, q double").coalesce(1).sort("i")
    kept = Hodlr(frame, rank=r).factor(leaf=leaf, keep=["p", "q"])
    sizes = sorted(x.k for x in kept.leaves.select(F.size("lu").alias("k")).collect())
    assert sizes == [(4 * r + 1) * leaf] * 13 + [leaf * leaf]
    solved = kept.solve(["p", "q"])
    x = {row.i: row.x for row in solved.collect()}
    assert np.allclose([x[i] for i in range(n)], np.linalg.solve(u @ v.T + np.diag(d), b))
    plan = kept.solve(["p", "q"])._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(plan) if "ReadSchema" in line and "lu:array" in line)
    above = [line for line in reversed(plan[:at]) if "MapInArrow" in line or "Join" in line or "Exchange" in line]
    assert "MapInArrow own" in above[0]
