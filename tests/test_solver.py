import numpy as np
import pytest
from pyspark.sql import functions as F

import ramify.plans.tree as tree
from ramify import Hodlr, Matrix, Vector
from ramify.plans.hodlr import heavy_layout, is_power_of_two
from ramify.plans.irregular import solve_two_ranks
from ramify.sources.generators import seeded_system


def system(spark, n, r, k=1, seed=0, shift=1000.0, parts=4):
    rng = np.random.default_rng(seed)
    u, v, d, b = rng.random((n, r)), rng.random((n, r)), shift + rng.random(n), rng.random((n, k))
    rows = [(i, u[i].tolist(), v[i].tolist(), float(d[i]), b[i].tolist()) for i in range(n)]
    schema = "i bigint, u array<double>, v array<double>, d double, b array<double>"
    frame = spark.createDataFrame(rows, schema).repartition(parts, "i")
    return frame, u @ v.T + np.diag(d), b


def collected(solved, n):
    rows = {r.i: r.x for r in solved.collect()}
    assert len(rows) == n
    return np.array([rows[i] for i in range(n)])


def relative(a, x, b):
    return np.linalg.norm(b - a @ x) / np.linalg.norm(b)


@pytest.mark.parametrize("level", [0, 1, 2, 3, 5])
def test_residual_on_regular_trees(spark, level):
    n = 20 << level
    frame, a, b = system(spark, n, 7)
    x = collected(Hodlr(frame).solve_levels("b", n, level), n)
    assert relative(a, x, b) < 1e-14


@pytest.mark.parametrize("launch", [0, 1, 2, 3])
def test_launch_level_does_not_matter(spark, launch):
    n = 160
    frame, a, b = system(spark, n, 5, k=2)
    x = collected(Hodlr(frame, rank=5).solve_levels("b", n, 3, launch), n)
    assert np.allclose(x, np.linalg.solve(a, b), rtol=1e-12, atol=0)


def test_strong_coupling_is_not_swapped(spark):
    """A small diagonal makes a swap of the two halves visible at once."""
    n = 64
    frame, a, b = system(spark, n, 4, shift=5.0)
    x = collected(Hodlr(frame).solve_levels("b", n, 2), n)
    assert relative(a, x, b) < 1e-11
    assert np.allclose(x, np.linalg.solve(a, b), rtol=1e-8)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_input_order_tree(spark, parts):
    """Uneven partitions, leaves that do not divide the part, several right-hand sides."""
    n = 203
    frame, a, b = system(spark, n, 6, k=3, parts=parts)
    x = collected(Hodlr(frame).solve("b", leaf=17, nrhs=3), n)
    assert relative(a, x, b) < 1e-14


@pytest.mark.parametrize("fan_in,limit", [(1, 64 << 20), (2, 0), (6, 0)])
def test_deep_tree_and_shuffled_coefficients(spark, monkeypatch, fan_in, limit):
    """Many small parts, few levels per shuffle, coefficients joined by shuffle."""
    monkeypatch.setattr(tree, "FAN_IN", fan_in)
    monkeypatch.setattr(tree, "BROADCAST_BYTES", limit)
    n = 300
    frame, a, b = system(spark, n, 3, k=2)
    h = Hodlr(frame, rank=3)
    x = collected(h.solve("b", leaf=5, part_rows=10, nrhs=2), n)
    assert relative(a, x, b) < 1e-14
    h.clear()


def test_one_partition_holds_most_rows(spark):
    """A hot partition is cut into parts of bounded size."""
    n = 240
    frame, a, b = system(spark, n, 3)
    skewed = frame.repartition(6, F.when(F.col("i") < 200, F.lit(0)).otherwise(F.col("i")))
    x = collected(Hodlr(skewed, rank=3).solve("b", leaf=8, part_rows=24, nrhs=1), n)
    assert relative(a, x, b) < 1e-14


def test_irregular_leaves(spark):
    n, leaf = 2 * 80 + 5 * 8, 8
    frame, a, b = system(spark, n, 4)
    layout = heavy_layout("i", 8, leaf, heavy=2)
    x = collected(Hodlr(frame).solve("b", leaf=leaf, layout=layout), n)
    assert relative(a, x, b) < 1e-14
    # A heavy part above the part limit is cut, with the same answer.
    again = collected(Hodlr(frame).solve("b", leaf=leaf, layout=layout, part_rows=16), n)
    assert np.allclose(again, x, rtol=1e-12)


@pytest.mark.parametrize("ranks,leaf", [((2, 7), 9), ((7, 2), 30)])
def test_two_ranks(spark, ranks, leaf):
    rng = np.random.default_rng(5)
    n, k = 80, 2
    frames, u, v, w, d = [], [], [], [], []
    b = rng.random((2 * n, k))
    for s in (0, 1):
        u.append(rng.random((n, ranks[s])))
        v.append(rng.random((n, ranks[s])))
        w.append(rng.random((n, ranks[1 - s])))
        d.append(50 + rng.random(n))
        rows = [
            (s * n + i, u[s][i].tolist(), v[s][i].tolist(), w[s][i].tolist(), float(d[s][i]), b[s * n + i].tolist())
            for i in range(n)
        ]
        schema = "i bigint, u array<double>, v array<double>, w array<double>, d double, b array<double>"
        frames.append(spark.createDataFrame(rows, schema).repartition(3, "i"))
    a = np.block(
        [
            [u[0] @ v[0].T + np.diag(d[0]), u[0] @ w[1].T],
            [u[1] @ w[0].T, u[1] @ v[1].T + np.diag(d[1])],
        ]
    )
    x = collected(solve_two_ranks(tuple(frames), ranks, nrhs=k, leaf=leaf, part_rows=18), 2 * n)
    assert relative(a, x, b) < 1e-13


def test_matrices_and_separate_right_hand_sides(spark):
    n = 60
    frame, a, b = system(spark, n, 3, k=2)
    u = Matrix.from_rows(frame.select("i", "u"), "i", "u", 3, n)
    v = Matrix(Matrix.from_rows(frame.select("i", "v"), "i", "v", 3, n).df, n, 3)
    d = Vector(frame.select("i", F.col("d").alias("v")), n)
    h = Hodlr.from_matrices(u, v, d)
    rhs = frame.select("i", F.col("b")[0].alias("b0"), F.col("b")[1].alias("b1"))
    assert relative(a, collected(h.solve(rhs, leaf=10), n), b) < 1e-14


def test_matvec_and_residual(spark):
    n = 50
    frame, a, b = system(spark, n, 20)
    rows = frame.withColumn("x", F.col("i") % 5 + 1.0)
    h = Hodlr(rows)
    x = np.arange(n) % 5 + 1.0
    got = {r.i: r.v for r in h.matvec("x").collect()}
    assert np.allclose([got[i] for i in range(n)], a @ x)
    gap = h.residual("x", F.col("b")[0]).first()
    assert np.isclose(gap.residual, np.linalg.norm(b[:, 0] - a @ x))
    assert np.isclose(gap.relative, gap.residual / np.linalg.norm(b))


def test_seeded_system_residual(spark):
    rows = seeded_system(spark, 40, 4, 10, seed=11)
    h = Hodlr(rows, rank=10)
    solved = h.solve("b", leaf=40).select("i", F.col("x")[0].alias("x"))
    back = Hodlr(rows.join(solved, "i"), rank=10)
    assert back.residual("x", "b").first().relative < 1e-14


def test_string_keys(spark):
    frame, a, b = system(spark, 40, 3)
    named = frame.withColumn("name", F.concat(F.lit("row"), "i"))
    solved = Hodlr(named, keys=("name", "i"), rank=3).solve("b", leaf=9, nrhs=1)
    assert solved.columns == ["name", "i", "x"]
    assert relative(a, collected(solved, 40), b) < 1e-14


def test_clear_removes_tables(spark):
    frame, _, _ = system(spark, 40, 3)
    h = Hodlr(frame, rank=3)
    solved = h.solve("b", leaf=9, nrhs=1)
    assert solved.count() == 40
    h.clear()
    with pytest.raises(Exception):
        solved.collect()


def test_errors(spark):
    frame, _, _ = system(spark, 40, 3)
    h = Hodlr(frame, rank=3)
    for bad in (
        lambda: h.solve("b", leaf=3),
        lambda: h.solve_levels("b", 40, 4),
        lambda: h.solve_levels("b", 40, 2, 3),
        lambda: h.solve(F.col("b"), nrhs=1).count() and h.solve("b", leaf=2),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="singular system at part"):
        Hodlr(frame.withColumn("d", F.lit(0.0)), rank=3).solve("b", leaf=9, nrhs=1).count()
    assert is_power_of_two(8) and not is_power_of_two(6) and not is_power_of_two(0)


def test_absent_entries_of_the_right_hand_side_are_zero(spark):
    frame, a, _ = system(spark, 12, 2, shift=5.0)
    b = np.zeros(12)
    b[3], b[7] = 1.0, 2.0
    given = spark.createDataFrame([(3, 1.0), (7, 2.0)], "i bigint, b double")
    x = collected(Hodlr(frame, rank=2).solve(given, leaf=4), 12)
    assert np.allclose(x[:, 0], np.linalg.solve(a, b), rtol=1e-12)


@pytest.mark.parametrize("rows", [[(3, 1.0), (3, 2.0)], [(99, 1.0)]])
def test_keys_of_the_right_hand_side_are_checked(spark, rows):
    frame, _, _ = system(spark, 12, 2)
    with pytest.raises(ValueError, match="right-hand side"):
        Hodlr(frame, rank=2).solve(spark.createDataFrame(rows, "i bigint, b double"), leaf=4)


def test_absent_entries_of_the_matrices_are_zero(spark):
    rng = np.random.default_rng(3)
    u, v = rng.random((12, 2)), rng.random((12, 2))
    u[4], d = 0.0, rng.random(12) + 5
    entries = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(2) if m[i, j]], "i bigint, j int, v double")
    diag = spark.createDataFrame([(i, float(d[i])) for i in range(12)], "i bigint, v double")
    h = Hodlr.from_matrices(Matrix(entries(u), 12, 2), Matrix(entries(v), 12, 2), Vector(diag, 12))
    b = rng.random(12)
    given = spark.createDataFrame([(i, float(b[i])) for i in range(12)], "i bigint, b double")
    x = collected(h.solve(given, leaf=4), 12)
    assert np.allclose(x[:, 0], np.linalg.solve(u @ v.T + np.diag(d), b), rtol=1e-12)


def test_kept_columns_stay_on_their_row_where_keys_repeat(spark):
    frame, a, b = system(spark, 20, 3)
    twice = frame.withColumn("row", F.col("i")).withColumn("i", F.col("i") % 10)
    rows = {r.row: r.x[0] for r in Hodlr(twice, rank=3).solve("b", leaf=5, keep=["row"]).collect()}
    assert np.allclose([rows[i] for i in range(20)], np.linalg.solve(a, b)[:, 0], rtol=1e-12)


@pytest.mark.parametrize("n", [37, 499])
def test_rows_that_do_not_divide(spark, n):
    frame, a, b = system(spark, n, 3)
    assert relative(a, collected(Hodlr(frame, rank=3).solve_levels("b", n, 3, 1), n), b) < 1e-13
