"""Leaves are factored and solved many at once."""

import numpy as np
import pytest

from ramify.operators import kernels
from ramify.plans import factors
from ramify.plans.hodlr import Hodlr


def frame(spark, n, r, d):
    rng = np.random.default_rng(n)
    u, v, b = rng.normal(size=(n, r)), rng.normal(size=(n, r)), rng.normal(size=(n, 2))
    rows = [(i, u[i].tolist(), v[i].tolist(), float(d[i]), *map(float, b[i])) for i in range(n)]
    return spark.createDataFrame(rows, "i long, u array<double>, v array<double>, d double, p double, q double").coalesce(1), u @ v.T + np.diag(d), b


@pytest.mark.parametrize("n, stack", [(203, 4 << 20), (203, 2500), (20, 4 << 20), (7, 4 << 20)])
def test_a_task_factors_its_leaves_in_stacks(spark, monkeypatch, n, stack):
    monkeypatch.setattr(factors, "STACK_BYTES", stack)
    rows, a, b = frame(spark, n, 3, 60.0 + np.arange(n) % 5)
    kept = Hodlr(rows, rank=3).factor(leaf=10, keep=["p", "q"])
    assert kept.count == -(-n // 10)
    x = {q.i: q.x for q in kept.solve(["p", "q"]).collect()}
    assert np.allclose([x[i] for i in range(n)], np.linalg.solve(a, b))


def test_factoring_is_called_once_for_many_leaves(spark, monkeypatch):
    leaves = list(factors._stacks(np.array([64] * 300 + [5])))
    assert leaves[0] == (64, 0, 128) and leaves[-1] == (5, 300, 301) and len(leaves) == 4


def test_a_singular_leaf_in_a_stack_is_named(spark):
    n = 50
    d = np.full(n, 60.0)
    rows, _, _ = frame(spark, n, 1, d)
    zeros = rows.selectExpr("i", "if(i div 10 = 3, array(0.0D), u) as u", "v", "if(i = 34, 0.0D, d) as d", "p")
    with pytest.raises(Exception, match=r"leaf \(0, 3\)"):
        Hodlr(zeros, rank=1).factor(leaf=10, keep=["p"])
    assert kernels.lu_factor(np.eye(2)[None], "x")[0].shape == (1, 2, 2)
