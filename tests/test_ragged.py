"""Queries over an embedding table whose row count divides by nothing."""

import shutil

import duckdb
import pytest
from oracle import TESTDATA, compare, connect

from ramify.catalog import ORACLES, QUERIES
from ramify.catalog.base import Known

NAMES = sorted(n for n, sql in ORACLES.items() if "embeddings" in sql or "FROM E" in sql or "FROM X" in sql)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("ragged")
    for table in (TESTDATA / "sf0.001").glob("*.parquet"):
        shutil.copy(table, path / table.name)
    source = TESTDATA / "sf0.001" / "embeddings.parquet"
    (path / "embeddings.parquet").unlink()
    duckdb.sql(f"COPY (SELECT * FROM '{source}' WHERE vec_id < 499) TO '{path}/embeddings.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None


def test_leaf_size_is_fixed(spark, folder):
    known = Known(spark, folder)
    assert (known.n, known.leaf, known.level) == (499, 125, 2)
