"""Stored factors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.operators import kernels
from ramify.plans import factors
from ramify.plans.hodlr import Hodlr, heavy_layout, uniform_layout


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 100])
def test_factors_of_a_stack(n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(5, n, n)), rng.normal(size=(5, n, 3))
    a[0] = a[0][rng.permutation(n)] * np.where(np.arange(n) % 2, 1e-9, 1.0)  # needs pivots
    a[1] = np.eye(n)[rng.permutation(n)]
    lu, order = kernels.lu_factor(a, "here")
    lower, upper = np.tril(lu, -1) + np.eye(n), np.triu(lu)
    assert np.allclose(lower @ upper, np.take_along_axis(a, order[:, :, None], 1))
    assert (np.abs(np.tril(lu, -1)) <= 1).all()
    assert np.allclose(a @ kernels.lu_solve(lu, order, b), b)
    with pytest.raises(ValueError, match="singular system at here"):
        kernels.lu_factor(np.zeros((1, n, n)), "here")


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13])
def test_replayed_sweep_equals_sweep(count):
    rng = np.random.default_rng(count)
    grams = rng.normal(size=(count, 4, 6)) / 10
    steps, merged = kernels.factor_sweep(grams[:, :, 2:], "x")
    sums, x = kernels.replay_sweep(steps, grams[:, :, :2])
    gram, full = kernels.sweep(grams, 2, "x")
    assert np.allclose(merged, gram[:, 2:]) and np.allclose(sums, gram[:, :2])
    assert np.allclose(x, full[:, :, :2])


def made(spark, n, r, seed, d=None):
    rng = np.random.default_rng(seed)
    u, v, b = rng.normal(size=(n, r)), rng.normal(size=(n, r)), rng.normal(size=(n, 2))
    d = 50 + rng.random(n) if d is None else d
    rows = [(i, u[i].tolist(), v[i].tolist(), float(d[i]), float(b[i, 0])) for i in range(n)]
    frame = spark.createDataFrame(rows, "i long, u array<double>, v array<double>, d double, b double").repartition(3, "i")
    return frame, u @ v.T + np.diag(d), b


@pytest.mark.parametrize("fan_in, layout", [(6, None), (1, None), (2, "heavy"), (6, "uniform")])
def test_many_right_hand_sides(spark, monkeypatch, fan_in, layout):
    monkeypatch.setattr(factors, "FAN_IN", fan_in)
    n, r = 203, 4
    frame, a, b = made(spark, n, r, 1)
    where = {"heavy": heavy_layout("i", 10, 10, 3), "uniform": uniform_layout("i", n, 4, 4), None: None}[layout]
    h = Hodlr(frame, rank=r)
    kept = h.factor(leaf=10, keep=["b"], layout=where)
    x = {q.i: q.x for q in kept.solve("b").collect()}
    assert np.allclose([x[i][0] for i in range(n)], np.linalg.solve(a, b[:, 0]))
    # a frame with absent rows and nulls, which are zero
    some = spark.createDataFrame([(i, float(b[i, 0]), None if i % 3 else float(b[i, 1])) for i in range(0, n, 2)], "i long, p double, q double")
    rhs = np.where(np.arange(n)[:, None] % 2 == 0, b, 0.0)
    rhs[:, 1] = np.where(np.arange(n) % 3 == 0, rhs[:, 1], 0.0)
    x = {q.i: q.x for q in kept.solve(some).collect()}
    assert np.allclose([x[i] for i in range(n)], np.linalg.solve(a, rhs))
    with pytest.raises(ValueError, match="several rows"):
        kept.solve(some.unionByName(some))
    with pytest.raises(ValueError, match="lacks"):
        kept.solve(spark.createDataFrame([(n, 1.0)], "i long, p double"))
    h.clear()


def test_leaves_without_a_diagonal_need_pivots(spark):
    d = np.where(np.arange(40) % 3, 3.0, 0.0)  # 14 zeros, fewer than the rank: regular, also in every leaf
    frame, a, b = made(spark, 40, 16, 5, d)
    x = {q.i: q.x[0] for q in Hodlr(frame.coalesce(1).sort("i"), rank=16).factor(leaf=20, keep=["b"]).solve("b").collect()}
    assert np.allclose(a @ np.array([x[i] for i in range(40)]), b[:, 0], atol=1e-6)


def test_repeated_keys_keep_their_rows(spark):
    frame, a, b = made(spark, 30, 2, 6)
    twice = frame.withColumn("k", F.col("i") % 5).drop("i").withColumnRenamed("k", "i")
    got = sorted(q.x[0] for q in Hodlr(twice, rank=2).factor(leaf=8, keep=["b"]).solve("b").collect())
    assert np.allclose(got, sorted(np.linalg.solve(a, b[:, 0])))


def test_a_later_solve_reads_no_matrix(spark):
    frame, _, _ = made(spark, 64, 2, 7)
    kept = Hodlr(frame, rank=2).factor(leaf=8, keep=["b"])
    plan = kept.solve("b")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "ReadSchema" in line and "/leaves" in line]
    first = [s for s in scans if "s:array<double>" in s]
    last = [s for s in scans if "lu:array<double>" in s]
    assert first and last and all("lu:" not in s and "u:array" not in s for s in first) and all("s:array<double>" not in s.replace("rows:array", "") for s in last)


def test_empty_system_and_small_leaves(spark):
    frame, _, _ = made(spark, 8, 2, 8)
    with pytest.raises(ValueError, match="no rows"):
        Hodlr(frame.limit(0), rank=2).factor(leaf=4)
    with pytest.raises(ValueError, match="exceed the rank"):
        Hodlr(frame, rank=2).factor(leaf=2)
