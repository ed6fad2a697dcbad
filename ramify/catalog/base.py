"""Registry of the queries with the SQL that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.functions.algebra import Matrix, Vector
from ramify.operators.blocks import Partition, RowBlocks
from ramify.session import ship_package
from ramify.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


#: The matrix of the embedding rows, the same rows rolled down by one, and a known
#: solution x with a diagonal d, as SQL.
BASE = """
WITH RECURSIVE N AS (SELECT count(*) AS n FROM embeddings),
E AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
V AS (SELECT (i + 1) % n AS i, j, v FROM E, N),
X AS (SELECT vec_id AS i, label + 1.0::DOUBLE AS x, (1000 + vec_id % 7)::DOUBLE AS d FROM embeddings)
"""


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded, with negative zero turned into zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def entries(m: Matrix, digits: int = 6) -> DataFrame:
    return m.df.select("i", "j", rounded("v", digits).alias("v"))


def values(x: Vector, digits: int = 6) -> DataFrame:
    return x.df.select("i", rounded("v", digits).alias("v"))


class Known:
    """A system with a known solution, made of the embedding table.

    U is the embedding rows, V the same rows rolled down by one, d the diagonal and
    x the solution.  The table is opened and counted once for all of them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.table = read_table(spark, folder, "embeddings")
        self.n = self.table.count()

    @cached_property
    def rank(self) -> int:
        return self.table.select(F.size("embedding").alias("r")).first()["r"]

    #: Rows of a leaf, whatever the size of the table; above the rank of 64.
    leaf = 125

    @property
    def level(self) -> int:
        """Levels of the deepest regular tree whose leaves have more rows than the rank."""
        level = 0
        while -(-self.n // (2 << level)) > self.rank:
            level += 1
        return level

    @cached_property
    def u(self) -> Matrix:
        return Matrix.from_rows(self.table, "vec_id", "embedding", self.rank, self.n)

    @cached_property
    def v(self) -> Matrix:
        moved = self.table.withColumn("to", (F.col("vec_id") + 1) % self.n)
        return Matrix.from_rows(moved, "to", "embedding", self.rank, self.n)

    @cached_property
    def d(self) -> Vector:
        value = (F.lit(1000) + F.col("vec_id") % 7).cast("double")
        return Vector.from_column(self.table, "vec_id", value, self.n)

    @cached_property
    def x(self) -> Vector:
        return Vector.from_column(self.table, "vec_id", F.col("label") + 1.0, self.n)


def balances(spark: SparkSession, folder: str) -> Vector:
    return Vector.from_column(read_table(spark, folder, "customer"), "c_custkey", "c_acctbal")


def spending(spark: SparkSession, folder: str) -> Vector:
    """Order totals per customer; customers without orders have no entry, that is zero."""
    orders = read_table(spark, folder, "orders")
    totals = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return Vector.from_column(totals, "o_custkey", "v", read_table(spark, folder, "customer").count())


def supply(spark: SparkSession, folder: str, value: Column | str = "l_quantity") -> Matrix:
    """Sparse supplier-by-part matrix of the line items."""
    rows = read_table(spark, folder, "supplier").count()
    cols = read_table(spark, folder, "part").count()
    return Matrix.from_entries(
        read_table(spark, folder, "lineitem"), "l_suppkey", "l_partkey", value, rows, cols
    )


def column_matrix(x: Vector) -> Matrix:
    return Matrix(x.df.select("i", F.lit(0).alias("j"), "v"), x.rows, 1)


def quarters(*ms: Matrix) -> RowBlocks | list[RowBlocks]:
    """Four row parts; several matrices share one storage."""
    return RowBlocks.from_matrix(ms[0], 2) if len(ms) == 1 else RowBlocks.together(ms, 2)


def leaves(*ms: Matrix, rows: int) -> list[RowBlocks]:
    """Parts of exactly ``rows`` rows, each in one block, only the last one shorter."""
    return RowBlocks.together(ms, block_rows=rows, cut=Partition.of_size(ms[0].rows, rows))
