"""Compare a query with its SQL on the same tables."""

import pathlib

import duckdb
import pandas as pd

TESTDATA = pathlib.Path("/root/testdata")


def connect(folder: str):
    db = duckdb.connect()
    for path in pathlib.Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean", "VARCHAR": "string", "HUGEINT": "double"}


def compare(spark_df, db, sql: str) -> str | None:
    """``None`` when equal, otherwise what differs."""
    result = db.execute(sql)
    stored = {d[0]: KINDS.get(str(d[1])) for d in result.description}
    expected = result.df()
    got = spark_df.toPandas()
    names = sorted(got.columns)
    if names != sorted(expected.columns):
        return f"columns {names} != {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    kinds = {c: (dict(spark_df.dtypes)[c], stored[c]) for c in names}
    wrong = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if wrong:
        return f"types {wrong}"
    a = got[names].sort_values(names, ignore_index=True)
    b = expected[names].sort_values(names, ignore_index=True)
    if a.equals(b):
        return None
    bad = ((a != b) & ~(a.isna() & b.isna())).any(axis=1)
    if not bad.any():
        return None
    return f"{int(bad.sum())} rows differ\n{pd.concat([a[bad].head(3), b[bad].head(3)])}"
