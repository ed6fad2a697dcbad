"""Products of sparse matrices too large to broadcast."""

import numpy as np
import pyarrow as pa
import pytest

from ramify.functions.algebra import Matrix
from ramify.operators import products

N = 2600  # 12 bytes a cell are above the broadcast limit


def sparse(spark, rng, shape, count):
    rows, cols = rng.integers(0, shape[0], count), rng.integers(0, shape[1], count)
    rows[: count // 3] = 7  # one crowded row, one crowded column
    cols[count // 3 : count // 2] = 11
    cells = {(int(i), int(j)): float(v) for i, j, v in zip(rows, cols, rng.integers(-9, 10, count)) if v}
    dense = np.zeros(shape)
    for at, v in cells.items():
        dense[at] = v
    frame = spark.createDataFrame([(*at, v) for at, v in cells.items()], "i long, j long, v double")
    return Matrix.from_entries(frame, "i", "j", "v", *shape), dense


@pytest.mark.parametrize("limits", [{}, {"HELD_PRODUCTS": 50, "MADE_PRODUCTS": 20, "LIST_COLUMNS": 300, "ROW_BLOCK": 64}])
def test_only_stored_entries_are_multiplied(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(products, name, value)
    monkeypatch.setattr(products, "multiply_tiles", None)
    rng = np.random.default_rng(3)
    a, left = sparse(spark, rng, (N, N + 300), 3000)
    b, right = sparse(spark, rng, (N + 300, N), 2500)
    cells = (a * b).df.collect()
    got = np.zeros((N, N))
    for i, j, v in cells:
        got[i, j] = v
    assert np.array_equal(got, left @ right)
    # as in SQL, a cell is there if any pair of entries meets in it, also if their sum is zero
    met = (left != 0).astype(float) @ (right != 0)
    assert len(cells) == len({(c.i, c.j) for c in cells}) == np.count_nonzero(met)
    assert (got[met > 0] == 0).any()


def test_a_product_with_the_transpose_deals_the_entries_once(spark):
    rng = np.random.default_rng(4)
    a, dense = sparse(spark, rng, (N, N + 300), 3000)
    product = (a * a.T).df
    cells = product.collect()
    got = np.zeros((N, N))
    for i, j, v in cells:
        got[i, j] = v
    assert np.array_equal(got, dense @ dense.T)
    plan = product._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    written = [line for line in plan.split("\n") if "- Exchange hashpartitioning" in line]
    # cells are added up, dealt by the inner index for both sides, met by row block, and dealt by row: packed from there on
    assert len(written) == 4 and "ReusedExchange" in plan
    assert "pack" in plan


def test_packed_pairs_come_back():
    rng = np.random.default_rng(6)
    lists = lambda kind, n: pa.array([rng.integers(0, 1000, k).tolist() for k in n], pa.list_(kind))
    n_a, n_b = rng.integers(1, 9, 50), rng.integers(1, 9, 50)
    columns = {"bi": pa.array(rng.integers(0, 3, 50)), "range": pa.array(rng.integers(0, 2, 50)), "bj": pa.array(np.arange(50))}
    columns |= {"a_at": lists(pa.int32(), n_a), "a_v": lists(pa.float64(), n_a), "b_at": lists(pa.int32(), n_b), "b_v": lists(pa.float64(), n_b)}
    batch = pa.RecordBatch.from_pydict(columns)
    (out,) = products._pack_pairs(iter([batch.slice(0, 20), batch.slice(20)]))
    found = {}
    for packed in out.column("pack"):
        bj, a_ends, b_ends, a_at, a_v, b_at, b_v = products._unpack_pairs(packed.as_buffer())
        for k, x in enumerate(bj):
            of_a, of_b = slice(a_ends[k], a_ends[k + 1]), slice(b_ends[k], b_ends[k + 1])
            found[int(x)] = [y.tolist() for y in (a_at[of_a], a_v[of_a], b_at[of_b], b_v[of_b])]
    assert found == {k: [batch.column(c)[k].as_py() for c in ("a_at", "a_v", "b_at", "b_v")] for k in range(50)}
    assert out.num_rows == len(set(zip(columns["bi"].to_pylist(), columns["range"].to_pylist(), strict=True)))
