"""Parts of few rows are drawn many at once."""

import numpy as np
import pytest

from ramify.operators.kernels import uniform, uniform_many
from ramify.sources.generators import seeded_rows


def test_draws_of_many_seeds_equal_those_of_each():
    seeds = np.array([0, 1, 7, 2**31 - 1, 2**32 + 5, -3])
    assert np.array_equal(uniform_many(seeds, 6), np.stack([uniform(int(s), 0, 6) for s in seeds]))


@pytest.mark.parametrize("rows", [None, 5, 2])
def test_short_parts(spark, rows):
    seeds = spark.createDataFrame([(p, 10 + p) for p in range(4)], "part int, seed long")
    got = {r.i: r.row for r in seeded_rows(seeds, 2, 3, 1, rows).collect()}
    expected = {p * 2 + k: uniform(10 + p, k * 3, 3) + 1 for p in range(4) for k in range(2)}
    assert sorted(got) == list(range(rows or 8))
    assert all(np.array_equal(got[i], expected[i]) for i in got)
