import numpy as np
import pytest
from pyspark.sql import functions as F

import ramify.functions.algebra as algebra
import ramify.operators.products as products
from ramify import Matrix, Vector
from ramify.sources.generators import random_matrix, random_vector


def dense(spark, array):
    array = np.asarray(array, float)
    rows = [(i, row.tolist()) for i, row in enumerate(array)]
    frame = spark.createDataFrame(rows, "i bigint, row array<double>")
    return Matrix.from_rows(frame, "i", "row", array.shape[1], array.shape[0])


def sparse(spark, array):
    array = np.asarray(array, float)
    cells = [(int(i), int(j), float(array[i, j])) for i, j in zip(*np.nonzero(array))]
    return Matrix(spark.createDataFrame(cells, "i bigint, j bigint, v double"), *array.shape)


def vector(spark, array):
    rows = [(i, float(v)) for i, v in enumerate(array) if v]
    return Vector(spark.createDataFrame(rows, "i bigint, v double"), len(array))


def one(df):
    return df.first()[0]


@pytest.fixture(params=[dense, sparse])
def build(request):
    return request.param


def test_vector_fixture(spark):
    n = 16
    ones = Vector.constant(spark, 1, n)
    assert ones.rows == n and abs(one(ones.norm()) - 4) < 1e-10
    v = random_vector(spark, n, 4, seed=1)
    assert v.parts == 4
    assert v + v == 2 * v
    assert v - v == Vector.constant(spark, 0, n)
    assert v + v != v
    assert Vector.constant(spark, 3, n).multiply(Vector.constant(spark, 5, n)) == Vector.constant(spark, 15, n)


def test_matrix_fixture(spark):
    m, n = 16, 4
    a = random_matrix(spark, m, n, 4, seed=2)
    assert (a.rows, a.cols, a.parts) == (m, n, 4)
    assert a + a == 2 * a
    assert a - a == Matrix.constant(spark, 0, m, n)
    ones = Matrix.constant(spark, 1, m, n)
    assert ones * Vector.constant(spark, 1, n) == Vector.constant(spark, n, m)
    assert Matrix.constant(spark, 17, m, n).T == Matrix.constant(spark, 17, n, m)
    assert ones.T * Vector.constant(spark, 1, m) == Vector.constant(spark, m, n)
    square = Matrix.constant(spark, 1, n, n)
    assert square * square == Matrix.constant(spark, n, n, n)
    tens = Matrix.constant(spark, 10, n, n)
    assert tens * Vector.constant(spark, 1, n).diagonal() == tens


def test_elementwise_against_numpy(spark, build):
    rng = np.random.default_rng(0)
    a, b = rng.random((9, 5)) * (rng.random((9, 5)) > 0.4), rng.random((9, 5)) * (rng.random((9, 5)) > 0.4)
    d = rng.random(9)
    x, y = build(spark, a), build(spark, b)
    assert np.allclose((x + y).to_numpy(), a + b)
    assert np.allclose((x - y).to_numpy(), a - b)
    assert np.allclose(x.combine(2.0, y, -0.5).to_numpy(), 2 * a - 0.5 * b)
    assert np.allclose((-3 * x).to_numpy(), -3 * a)
    assert np.allclose(x.T.to_numpy(), a.T)
    assert np.allclose(x.block(2, 7, 1, 4).to_numpy(), a[2:7, 1:4])
    assert np.allclose(x.row_block(3, 9).to_numpy(), a[3:])
    assert np.allclose(x.column(2).to_numpy(), a[:, 2])
    assert np.allclose(vector(spark, d).multiply(x).to_numpy(), d[:, None] * a)
    assert np.isclose(one(x.norm()), np.linalg.norm(a))
    assert x.entry(4, 4).count() == (1 if a[4, 4] or build is dense else 0)


def test_rows_missing_on_one_side(spark):
    """A row frame may lack rows; they count as zero."""
    a = Matrix.from_rows(spark.createDataFrame([(0, [1.0, 2.0])], "i bigint, row array<double>"), "i", "row", 2, 3)
    b = Matrix.from_rows(spark.createDataFrame([(2, [3.0, 4.0])], "i bigint, row array<double>"), "i", "row", 2, 3)
    assert (a + b).to_numpy().tolist() == [[1, 2], [0, 0], [3, 4]]
    assert a != b and a == a


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_products_against_numpy(spark, build, monkeypatch, limit):
    """With the limit at zero nothing may be broadcast and hot keys are split."""
    monkeypatch.setattr(algebra, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(products, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    a = rng.random((13, 6)) * (rng.random((13, 6)) > 0.3)
    b = rng.random((6, 7)) * (rng.random((6, 7)) > 0.3)
    c = rng.random((13, 4))
    x, xt = rng.random(6), rng.random(13)
    am, bm, cm = build(spark, a), build(spark, b), build(spark, c)
    assert np.allclose((am * vector(spark, x)).to_numpy(), a @ x)
    assert np.allclose((am.T * vector(spark, xt)).to_numpy(), a.T @ xt)
    assert np.allclose((am * bm).to_numpy(), a @ b)
    assert np.allclose((am.T * cm).to_numpy(), a.T @ c)
    assert np.allclose((am.T * am).to_numpy(), a.T @ a)
    assert np.allclose(vector(spark, xt).multiply(am).to_numpy(), xt[:, None] * a)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_product_over_several_tiles(spark, monkeypatch, limit):
    monkeypatch.setattr(products, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(products, "HELD_TILES", 2)
    rng = np.random.default_rng(2)
    a = rng.random((600, 300)) * (rng.random((600, 300)) > 0.95)
    b = rng.random((300, 520)) * (rng.random((300, 520)) > 0.95)
    a[:, 7] = 1.0  # one hot column
    assert np.allclose((sparse(spark, a) * sparse(spark, b)).to_numpy(), a @ b)


def test_hot_column_keeps_every_entry(spark, monkeypatch):
    """A third of all entries share one column and the vector is too large to broadcast."""
    monkeypatch.setattr(algebra, "BROADCAST_BYTES", 0)
    n = 3000
    cells = spark.range(n).select(
        F.col("id").alias("i"), F.expr("if(id % 3 = 0, 5, id)").alias("j"), F.lit(1.0).alias("v")
    )
    x = Vector(spark.range(n).selectExpr("id as i", "cast(id as double) as v"), n)
    got = (Matrix(cells, n, n) * x).to_numpy()
    assert got.tolist() == [5.0 if i % 3 == 0 else float(i) for i in range(n)]


def test_wide_sums_by_position(spark):
    rows = np.arange(60, dtype=float).reshape(3, 20)
    m = dense(spark, rows)
    got = (m.T * vector(spark, [1, 2, 3])).to_numpy()
    assert np.allclose(got, rows.T @ [1, 2, 3])


def test_nan_is_never_equal(spark):
    a = Vector(spark.createDataFrame([(0, float("nan"))], "i bigint, v double"), 2)
    assert a != a
    m = dense(spark, [[1.0, float("nan")]])
    assert m != m


def test_equality_has_tolerance(spark):
    a, b = dense(spark, [[1.0, 2.0]]), dense(spark, [[1.0, 2.0 + 5e-11]])
    assert a == b
    assert dense(spark, [[1.0]]) != dense(spark, [[1.0 + 5e-10]])


def test_identity_is_diagonal(spark):
    assert np.array_equal(Matrix.identity(spark, 5).to_numpy(), np.eye(5))


def test_shape_errors(spark):
    a, v = Matrix.constant(spark, 1, 3, 2), Vector.constant(spark, 1, 3)
    for bad in (
        lambda: a + a.T,
        lambda: a * a,
        lambda: a * v,
        lambda: a.block(0, 4, 0, 1),
        lambda: a.entry(3, 0),
        lambda: v.entry(-1),
        lambda: v + Vector.constant(spark, 1, 4),
        lambda: Matrix.constant(spark, 1, 0, 2),
    ):
        with pytest.raises(ValueError):
            bad()
