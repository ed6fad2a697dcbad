"""Row parts of any size, against numpy and against the SQL of the block queries."""

import pathlib
import shutil

import duckdb
import numpy as np
import pytest
from oracle import TESTDATA, compare, connect

from ramify.catalog import ORACLES, QUERIES
from ramify.catalog import blocks as block_queries
from ramify.functions.algebra import Matrix, Vector
from ramify.operators.blocks import Partition, RowBlocks
from ramify.plans.levels import solve_by_levels

EDGES = {
    "heavy": [0, 200, 220, 240, 260],
    "empty": [0, 0, 150, 150, 260],
    "one": [0, 260, 260, 260, 260],
    "equal": None,
}


def matrix(spark, values):
    n, k = values.shape
    rows = [(i, j, float(values[i, j])) for i in range(n) for j in range(k)]
    return Matrix(spark.createDataFrame(rows, "i long, j int, v double"), n, k)


def dense(blocks):
    out = np.zeros((blocks.rows, blocks.cols))
    for r in blocks.entries().collect():
        out[r.i, r.j] = r.v
    return out


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    return rng.normal(size=(260, 3)), rng.normal(size=(260, 3)), 500 + rng.random((260, 1)), rng.normal(size=(260, 2))


@pytest.mark.parametrize("name", EDGES)
def test_operators_on_any_ranges(spark, values, name):
    u, v, d, b = values
    cut = Partition.ranges(EDGES[name]) if EDGES[name] else Partition.equal(260, 4)
    edges = EDGES[name] or [0, 65, 130, 195, 260]
    ub, vb, bb = RowBlocks.together([matrix(spark, m) for m in (u, v, b)], block_rows=30, cut=cut)
    assert np.allclose(dense(ub), u) and np.allclose(dense(bb), b)
    assert np.allclose(dense(RowBlocks.add(2.0, ub, -1.0, vb)), 2 * u - v)
    sums = RowBlocks.gemm_red("t", "n", 2.0, vb, ub, parts=2)
    halves = [2 * v[s].T @ u[s] for s in (slice(0, edges[2]), slice(edges[2], 260))]
    assert np.allclose(dense(sums), np.concatenate(halves))
    c = RowBlocks.gemm("t", "n", 1.0, ub, ub)
    assert np.allclose(dense(RowBlocks.gemm("t", "n", 2.0, vb, ub, -0.5, c)), 2 * v.T @ u - 0.5 * u.T @ u)
    wide = RowBlocks.gemm_bro("n", "n", 1.0, ub, sums, 0.0, RowBlocks.zeros(spark, 260, 3, block_rows=30, cut=cut))
    expected = np.concatenate([u[: edges[2]] @ halves[0], u[edges[2] :] @ halves[1]])
    assert np.allclose(dense(wide), expected)
    shown = {r.part: (r.row0, r.nrow) for r in ub.colors().collect()}
    assert shown == {p: (a, e - a) for p, (a, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > a}
    two = ub.two_level_partition()
    assert two.parts == 8 and np.allclose(dense(two), u)
    assert np.allclose(dense(two.partition(1)), u)


@pytest.mark.parametrize("name", EDGES)
def test_level_solve_on_any_ranges(spark, values, name):
    u, v, d, b = values
    cut = Partition.ranges(EDGES[name]) if EDGES[name] else None
    diagonal = Vector(spark.createDataFrame([(i, float(d[i, 0])) for i in range(260)], "i long, v double"), 260)
    solved = solve_by_levels(matrix(spark, u), matrix(spark, v), diagonal, matrix(spark, b), 4, 2, cut=cut).solution()
    x = np.zeros((260, 2))
    for r in solved.df.collect():
        x[r.i, r.j] = r.v
    assert np.allclose(x, np.linalg.solve(u @ v.T + np.diag(d[:, 0]), b))


def test_partitions_are_checked():
    for edges in ([], [0], [1, 2], [0, 3, 2], [0, 0]):
        with pytest.raises(ValueError, match="edges"):
            Partition.ranges(edges)
    with pytest.raises(ValueError, match="rows"):
        Partition.equal(0, 2)
    assert Partition.equal(9, 4).empty_groups(1) == range(3, 4) and Partition.ranges([0, 0, 4]).empty_groups(1) == [0]


def test_operators_on_one_storage_do_not_join(spark, values):
    u, v, _, _ = values
    ub, vb = RowBlocks.together([matrix(spark, u), matrix(spark, v)], 2)
    plan = RowBlocks.add(1.0, ub, 1.0, vb).df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


#: Queries over four parts, leaves and levels.
NAMES = sorted(n for n in [*QUERIES, "hodlr_by_levels"] if f'"{n}"' in pathlib.Path(block_queries.__file__).read_text() or n in ("hodlr_by_levels", "hodlr_factor_once"))


@pytest.fixture(scope="module", params=[1, 126, 451, 1001])
def folder(request, tmp_path_factory):
    path = tmp_path_factory.mktemp(f"rows{request.param}")
    for table in (TESTDATA / "sf0.001").glob("*.parquet"):
        if table.stem != "embeddings":
            shutil.copy(table, path / table.name)
    source = TESTDATA / "sf0.1" / "embeddings.parquet"
    duckdb.sql(f"COPY (SELECT * FROM '{source}' WHERE vec_id < {request.param}) TO '{path}/embeddings.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_block_query(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None
