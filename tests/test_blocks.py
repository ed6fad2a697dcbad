import numpy as np
import pytest

import ramify.operators.blocks as blocks
from ramify import Matrix, RowBlocks, Vector
from ramify.operators.blocks import Partition, node_solve_ragged
from ramify.plans.levels import LevelStorage, solve_by_levels
from ramify.sources.generators import random_matrix, random_vector


def split(spark, rows, cols, parts, level, seed, block_rows=None):
    m = random_matrix(spark, rows, cols, parts, seed)
    return RowBlocks.from_matrix(m, level, block_rows), m.to_numpy()


def column(v):
    return Matrix(v.df.selectExpr("i", "0 as j", "v"), v.rows, 1)


def coupling(vtu0, vtu1):
    r0, r1 = vtu1.shape
    return np.block([[np.eye(r0), vtu1], [vtu0, np.eye(r1)]])


@pytest.mark.parametrize("block_rows", [None, 5])
def test_round_trip_and_ranges(spark, block_rows):
    b, m = split(spark, 96, 2, 32, 3, 1, block_rows)
    assert np.array_equal(b.to_matrix().to_numpy(), m)
    assert np.array_equal(b.to_matrix(col0=1, col1=2).to_numpy(), m[:, 1:])
    assert np.array_equal(b.to_matrix(7, 50, 0, 1).to_numpy(), m[7:50, :1])
    assert np.array_equal(b.window(1, 1).to_vector().to_numpy(), m[:, 1])
    assert b.shape() == {"rows": 96, "cols": 2, "part_rows": 12, "column_begin": 0, "parts": 8, "levels": 1}
    assert b.measure().first().asDict() == {"rows": 96, "width": 2, "parts": 8, "part_rows": 12}


def test_any_number_of_parts(spark):
    m = random_matrix(spark, 21, 2, 3, 1)
    b = RowBlocks.from_matrix(m, block_rows=4, cut=Partition.equal(21, 3))
    assert b.part_rows == 7 and b.df.count() == 6
    assert np.array_equal(b.init_data(m).to_matrix().to_numpy(), m.to_numpy())
    w = RowBlocks.gemm_red("t", "n", 1.0, b, b)
    assert np.allclose(w.to_matrix().to_numpy(), m.to_numpy().T @ m.to_numpy())


def test_sparse_source_keeps_empty_blocks(spark):
    m = Matrix(spark.createDataFrame([(5, 1, 2.0)], "i bigint, j bigint, v double"), 8, 2)
    b = RowBlocks.from_matrix(m, 2)
    assert b.df.count() == 4
    assert np.array_equal(b.to_matrix().to_numpy(), m.to_numpy())


def test_level_storage_tiles_u(spark):
    u, rhs = random_matrix(spark, 96, 2, 32, 1), random_matrix(spark, 96, 1, 32, 2)
    storage = LevelStorage.init(u, rhs, 5, 3)
    got = storage.blocks.to_matrix().to_numpy()
    assert np.array_equal(got, np.hstack([rhs.to_numpy()] + [u.to_numpy()] * 5))
    assert np.array_equal(storage.solution().to_numpy(), rhs.to_numpy())
    assert np.array_equal(storage.u(3).to_matrix().to_numpy(), u.to_numpy())
    assert storage.d(3).cols == 1 + 3 * 2
    with pytest.raises(ValueError):
        storage.u(5)


def test_elementwise_and_windows(spark):
    b, m = split(spark, 16, 4, 4, 2, 1, block_rows=3)
    c, n = split(spark, 16, 4, 4, 2, 2, block_rows=3)
    assert np.allclose(RowBlocks.add(2.0, b, -1.0, c).to_matrix().to_numpy(), 2 * m - n)
    mixed = RowBlocks.add(1.0, b.window(0, 2), 1.0, b.window(2, 2))
    assert np.allclose(mixed.to_matrix().to_numpy(), m[:, :2] + m[:, 2:])
    want = m.copy()
    want[:, 1:3] *= -4
    assert np.allclose(b.window(1, 2).scale(-4.0).window(0, 4).to_matrix().to_numpy(), want)
    assert b.scale(1.0) is b
    want[:, 1:3] = 7
    assert np.allclose(b.window(1, 2).clear(7).window(0, 4).to_matrix().to_numpy(), want)
    assert not RowBlocks.zeros(spark, 16, 4, 2, 3).to_matrix().to_numpy().any()


@pytest.mark.parametrize("block_rows", [None, 2])
@pytest.mark.parametrize("levels", [1, 2])
def test_gemm_reduce(spark, block_rows, levels):
    u, um = split(spark, 16, 3, 4, 2, 1, block_rows)
    v, vm = split(spark, 16, 3, 4, 2, 2, block_rows)
    w = RowBlocks.gemm_red("t", "n", 1.0, v, u, parts=2, levels=levels)
    got = w.to_matrix().to_numpy()
    want = np.vstack([vm[:8].T @ um[:8], vm[8:].T @ um[8:]])
    assert np.linalg.norm(got - want) < 1e-13


def test_gemm_reduce_many_groups_per_task(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD_GROUPS", 2)
    u, um = split(spark, 64, 3, 16, 4, 1)
    w = RowBlocks.gemm_red("t", "n", 1.0, u, u, parts=8)
    want = np.vstack([um[8 * p : 8 * p + 8].T @ um[8 * p : 8 * p + 8] for p in range(8)])
    assert np.allclose(w.to_matrix().to_numpy(), want)


@pytest.mark.parametrize("flags", ["nn", "nt", "tn", "tt"])
def test_gemm_transposes(spark, flags):
    a, am = split(spark, 8, 4, 2, 1, 1)
    b, bm = split(spark, 8, 4, 2, 1, 2)
    w = RowBlocks.gemm_red(flags[0], flags[1], 2.0, a, b, parts=1)
    op = {"n": lambda m: m, "t": lambda m: m.T}
    want = sum(2 * op[flags[0]](am[s]) @ op[flags[1]](bm[s]) for s in (slice(0, 4), slice(4, 8)))
    assert np.allclose(w.to_matrix().to_numpy(), want)


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("beta", [0.0, 1.0])
def test_gemm_broadcast(spark, monkeypatch, limit, beta):
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", limit)
    u, um = split(spark, 16, 3, 8, 3, 1)
    v, vm = split(spark, 6, 3, 2, 1, 2)
    c, cm = split(spark, 16, 3, 8, 3, 3)
    w = RowBlocks.gemm_bro("n", "n", 1.0, u, v, beta, c)
    want = beta * cm + np.vstack([um[:8] @ vm[:3], um[8:] @ vm[3:]])
    assert np.linalg.norm(w.to_matrix().to_numpy() - want) < 1e-13


def test_gemm_inplace_within_one_storage(spark):
    s, m = split(spark, 16, 5, 4, 2, 1, block_rows=3)
    b, bm = split(spark, 2, 3, 1, 0, 2)
    w = RowBlocks.gemm_inplace(-1.0, s.window(0, 2), b, s.window(2, 3)).window(0, 5)
    want = m.copy()
    want[:, 2:] -= m[:, :2] @ bm
    assert np.allclose(w.to_matrix().to_numpy(), want)


@pytest.mark.parametrize("two_level", [False, True])
def test_node_solve(spark, two_level):
    r = 3
    u, um = split(spark, 4 * r, r, 2, 1, 1)
    d, dm = split(spark, 4 * r, 2, 2, 1, 2)
    if two_level:
        u, d = u.two_level_partition(), d.two_level_partition()
        assert [tuple(x)[:2] for x in u.colors().orderBy("node", "side").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    got = RowBlocks.node_solve(u, d).to_matrix().to_numpy()
    for node in range(2):
        s = slice(2 * r * node, 2 * r * (node + 1))
        un, dn = um[s], dm[s]
        want = np.linalg.solve(coupling(un[:r], un[r:]), np.vstack([dn[r:], dn[:r]]))
        assert np.linalg.norm(got[s] - want) < 1e-12


def test_node_solve_two_ranks(spark):
    rng = np.random.default_rng(3)
    r0, r1, k = 2, 5, 3
    vtu = [rng.random((r1, r0)), rng.random((r0, r1))]
    vtd = [rng.random((r1, k)), rng.random((r0, k))]
    rows = [
        (4, s, (r0, r1)[s], vtu[s].ravel().tolist(), vtd[s].ravel().tolist()) for s in (0, 1)
    ]
    frame = spark.createDataFrame(rows, "node bigint, side int, rank int, vtu array<double>, vtd array<double>")
    got = {r.side: np.array(r.eta) for r in node_solve_ragged(frame, k).collect()}
    want = np.linalg.solve(coupling(*vtu), np.vstack([vtd[1], vtd[0]]))
    assert np.allclose(got[0].reshape(r0, k), want[:r0])
    assert np.allclose(got[1].reshape(r1, k), want[r0:])


def test_dense_blocks_and_leaf_solve(spark):
    u, um = split(spark, 32, 3, 4, 2, 1)
    v, vm = split(spark, 32, 3, 4, 2, 2)
    d = random_vector(spark, 32, 4, 3, offset=100)
    b, bm = split(spark, 32, 2, 4, 2, 4)
    k = RowBlocks.dense_blocks(u, v, RowBlocks.from_matrix(column(d), 2))
    dense = um @ vm.T + np.diag(d.to_numpy())
    got, x = k.to_matrix().to_numpy(), k.leaf_solve(b).to_matrix().to_numpy()
    for p in range(4):
        s = slice(8 * p, 8 * p + 8)
        assert np.allclose(got[s], dense[s, s], rtol=0, atol=1e-12)
        assert np.linalg.norm(x[s] - np.linalg.solve(dense[s, s], bm[s])) < 1e-13
    # The blocks are not overwritten: a second solve gives the same answer.
    assert np.array_equal(k.leaf_solve(b).to_matrix().to_numpy(), x)


def test_singular_leaf_names_its_part(spark):
    zero = RowBlocks.zeros(spark, 8, 4, 1)
    b = RowBlocks.zeros(spark, 8, 1, 1)
    with pytest.raises(Exception, match="singular system at part"):
        zero.leaf_solve(b).to_matrix().to_numpy()


@pytest.mark.parametrize("level,launch", [(2, 2), (3, 2), (2, 0)])
def test_level_by_level_solve(spark, level, launch):
    rows, r = 16 << level, 4
    u, v = random_matrix(spark, rows, r, 1 << level, 1), random_matrix(spark, rows, r, 1 << level, 2)
    d, b = random_vector(spark, rows, 1 << level, 3, offset=1000), random_matrix(spark, rows, 2, 1 << level, 4)
    x = solve_by_levels(u, v, d, b, level, launch).solution().to_numpy()
    dense = u.to_numpy() @ v.to_numpy().T + np.diag(d.to_numpy())
    assert np.linalg.norm(dense @ x - b.to_numpy()) / np.linalg.norm(b.to_numpy()) < 1e-14


def test_repartition_keeps_values(spark):
    b, m = split(spark, 24, 3, 8, 3, 1)
    for level in (0, 1, 3):
        again = b.window(1, 2).partition(level)
        assert again.parts == 1 << level
        assert np.array_equal(again.to_matrix().to_numpy(), m[:, 1:])


def test_argument_errors(spark):
    b = RowBlocks.zeros(spark, 8, 2, 2)
    c = RowBlocks.zeros(spark, 8, 2, 1)
    for bad in (
        lambda: RowBlocks.zeros(spark, 0, 1, 2),
        lambda: b.window(1, 2),
        lambda: RowBlocks.add(1, b, 1, c),
        lambda: RowBlocks.gemm_red("x", "n", 1, b, b),
        lambda: RowBlocks.gemm_red("t", "n", 1, b, c),
        lambda: RowBlocks.gemm_red("t", "n", 1, b, b, parts=3),
        lambda: RowBlocks.node_solve(b, b),
        lambda: b.to_matrix(0, 9),
        lambda: b.init_data(Matrix.constant(spark, 1, 8, 2), 0, 1),
        lambda: Vector.constant(spark, 1, 0),
    ):
        with pytest.raises(ValueError):
            bad()
