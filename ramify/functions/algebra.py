"""Vectors and matrices as DataFrames of entries, with the algebra on them.

A vector is ``(i, v)`` and a matrix ``(i, j, v)``; indices are unique and an absent
entry is zero, so identities and diagonals stay linear in size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ramify.operators.kernels import dense_rows
from ramify.operators.products import multiply_entries, multiply_rows, multiply_tiles, spread_keys
from ramify.session import BROADCAST_BYTES

#: Fixed tolerance of ``==`` on vectors and matrices (absolute).
TOLERANCE = 1e-10
#: Up to this many sums are separate aggregates; longer arrays are exploded.
WIDE_SUMS = 16
#: Vectors up to this length may be packed into one array.
PACKED_ROWS = 4096
#: Inner products up to this length are written out term by term.
SHORT_DOT = 16


def array_sums(df: DataFrame, array: Column, weights: Sequence[Column], width: int) -> DataFrame:
    """One row ``s array<array>``: for each weight, the weighted sums of the array positions.

    All sums come from one scan and are combined before the shuffle.
    """
    names = [f"w{k}" for k in range(len(weights))]
    picked = [w.cast("double").alias(n) for w, n in zip(weights, names)]
    if width * len(weights) <= WIDE_SUMS:
        rows = df.select(array.alias("a"), *picked)
        sums = [
            F.array(*[F.coalesce(F.sum(F.col("a")[k] * F.col(n)), F.lit(0.0)) for k in range(width)]) for n in names
        ]
        return rows.agg(F.array(*sums).alias("s"))
    entries = df.select(F.posexplode(array).alias("k", "a"), *picked)
    sums = entries.groupBy("k").agg(*[F.sum(F.col("a") * F.col(n)).alias(n) for n in names])
    ordered = sums.agg(F.array_sort(F.collect_list(F.struct("k", *names))).alias("s"))
    return ordered.select(F.array(*[F.col("s")[n] for n in names]).alias("s"))


@F.arrow_udf(DoubleType())
def _long_dot(a: pa.Array, b: pa.Array) -> pa.Array:
    n = len(a)
    return pa.array(np.einsum("ij,ij->i", dense_rows(a, n), dense_rows(b, n)))


def dot(a: Column, b: Column, width: int) -> Column:
    """Inner product of two array columns.

    Short ones are written out for code generation.  Long ones go through Arrow in
    batches, which measures about twice as fast as lambda functions over the arrays.
    """
    if width <= SHORT_DOT:
        return reduce(Column.__add__, [a[k] * b[k] for k in range(width)])
    return _long_dot(a, b)


def fits(rows: int, row_bytes: int) -> bool:
    """Whether a frame of known length may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its known size allows it."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def _sum_entries(frames: list[tuple[float, DataFrame]], keys: list[str]) -> DataFrame:
    """Scaled sum of entry frames: one shuffle, combined before it."""
    scaled = [df.select(*keys, (F.lit(float(a)) * F.col("v")).alias("v")) for a, df in frames]
    return reduce(DataFrame.unionAll, scaled).groupBy(*keys).agg(F.sum("v").alias("v"))


def _max_gap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Largest absolute difference as one row; a NaN anywhere makes it NaN."""
    return _sum_entries([(1.0, a), (-1.0, b)], keys).agg(
        F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("gap")
    )


class Vector:
    def __init__(self, df: DataFrame, rows: int, parts: int = 1, offset: int = 0):
        _check(rows > 0, "a vector needs at least one row")
        self.df = df.select(F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("v"))
        self.rows = rows
        self.parts = parts
        self.offset = offset

    @classmethod
    def from_column(cls, df: DataFrame, index: str, value: Column | str, rows: int | None = None):
        """A table column indexed by a unique 0-based key; ``rows`` defaults to the row count."""
        value = F.col(value) if isinstance(value, str) else value
        return cls(df.select(F.col(index).alias("i"), value.alias("v")), rows or df.count())

    @classmethod
    def constant(cls, spark: SparkSession, value: float, rows: int):
        return cls(spark.range(rows).select(F.col("id").alias("i"), F.lit(float(value)).alias("v")), rows)

    def _like(self, df: DataFrame) -> Vector:
        return Vector(df, self.rows, self.parts, self.offset)

    def entry(self, i: int) -> DataFrame:
        """The entry at ``i`` as a one-row frame; the index filter reaches the scan."""
        _check(0 <= i < self.rows, f"index {i} is outside 0..{self.rows - 1}")
        return self.df.where(F.col("i") == i)

    def _combine(self, other: Vector, a: float, b: float) -> Vector:
        _check(self.rows == other.rows, "vectors differ in length")
        return self._like(_sum_entries([(a, self.df), (b, other.df)], ["i"]))

    def __add__(self, other: Vector) -> Vector:
        return self._combine(other, 1.0, 1.0)

    def __sub__(self, other: Vector) -> Vector:
        return self._combine(other, 1.0, -1.0)

    def __rmul__(self, alpha: float) -> Vector:
        return self._like(self.df.withColumn("v", F.lit(float(alpha)) * F.col("v")))

    def multiply(self, other: Vector | Matrix) -> Vector | Matrix:
        """``diag(self) @ other``: entry-wise for a vector, row scaling for a matrix."""
        if isinstance(other, Matrix):
            return other.scaled_rows(self)
        _check(self.rows == other.rows, "vectors differ in length")
        scale = small(self.df.withColumnRenamed("v", "s"), self.rows, 16)
        return other._like(other.df.join(scale, "i").withColumn("v", F.col("v") * F.col("s")))

    def packed(self) -> DataFrame:
        """One row ``x array`` with zeros filled in; only for short vectors."""
        _check(self.rows <= PACKED_ROWS, f"a vector of {self.rows} entries is too long to pack")
        zeros = self.df.sparkSession.range(self.rows).select(F.col("id").alias("i"), F.lit(0.0).alias("v"))
        cells = _sum_entries([(1.0, self.df), (1.0, zeros)], ["i"])
        ordered = cells.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
        return ordered.select(F.col("x.v").alias("x"))

    def diagonal(self) -> Matrix:
        return Matrix(self.df.select("i", F.col("i").alias("j"), "v"), self.rows, self.rows)

    def norm(self) -> DataFrame:
        """Euclidean norm as a one-row frame ``(norm)``."""
        return self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))

    def equals(self, other: Vector) -> DataFrame:
        """One row ``(equal)``; missing entries count as zero and NaN never compares equal."""
        _check(self.rows == other.rows, "vectors differ in length")
        return _max_gap(self.df, other.df, ["i"]).select((F.col("gap") <= TOLERANCE).alias("equal"))

    def __eq__(self, other: object) -> bool:
        return self.equals(other).first()["equal"] if isinstance(other, Vector) else NotImplemented

    __hash__ = None

    def to_numpy(self):
        """The whole vector on the driver; for small results only."""
        out = np.zeros(self.rows)
        for row in self.df.toLocalIterator():
            out[row.i] = row.v
        return out

    def display(self, name: str, n: int = 20) -> None:
        print(f"{name}:")
        self.df.orderBy("i").show(n, truncate=False)


class Matrix:
    """Entries ``df``, and where known also whole rows ``(i, row array)`` or whole columns.

    Dense operations use the whole rows: one record per row to scan, join and shuffle
    instead of one per entry.  The transpose of a matrix with rows has columns.
    """

    def __init__(
        self,
        df: DataFrame | None,
        rows: int,
        cols: int,
        parts: int = 1,
        by_row: DataFrame | None = None,
        by_col: DataFrame | None = None,
        source: tuple[DataFrame, str, str] | None = None,
    ):
        _check(rows > 0 and cols > 0, "a matrix needs at least one row and one column")
        if df is None and by_row is not None:
            df = by_row.select("i", F.posexplode("row").alias("j", "v"))
        elif df is None:
            df = by_col.select(F.posexplode("row").alias("i", "v"), F.col("i").alias("j"))
        self.df = df.select(
            F.col("i").cast("bigint").alias("i"),
            F.col("j").cast("bigint").alias("j"),
            F.col("v").cast("double").alias("v"),
        )
        self.rows = rows
        self.cols = cols
        self.parts = parts
        self.by_row = by_row
        self.by_col = by_col
        #: The stored cells of a matrix and its transpose, with the names of the row and the column.
        self.source = source

    @classmethod
    def from_rows(cls, df: DataFrame, index: str, row: Column | str, cols: int | None = None, rows: int | None = None):
        """A table whose array column holds the matrix rows, indexed by a unique 0-based key."""
        row = F.col(row) if isinstance(row, str) else row
        frame = df.select(F.col(index).cast("bigint").alias("i"), row.cast("array<double>").alias("row"))
        cols = cols or frame.select(F.size("row").alias("n")).first()["n"]
        return cls(None, rows or df.count(), cols, by_row=frame)

    @classmethod
    def from_entries(cls, df: DataFrame, i: str, j: str, value: Column | str, rows: int, cols: int):
        """A table of entries; several rows for one cell are added up."""
        value = F.col(value) if isinstance(value, str) else value
        entries = df.select(F.col(i).alias("i"), F.col(j).alias("j"), value.alias("v"))
        cells = entries.groupBy("i", "j").agg(F.sum("v").alias("v"))
        return cls(cells, rows, cols, source=(cells, "i", "j"))

    @classmethod
    def constant(cls, spark: SparkSession, value: float, rows: int, cols: int):
        frame = spark.range(rows).select(
            F.col("id").alias("i"), F.array_repeat(F.lit(float(value)), cols).alias("row")
        )
        return cls(None, rows, cols, by_row=frame)

    @classmethod
    def identity(cls, spark: SparkSession, n: int):
        return Vector.constant(spark, 1.0, n).diagonal()

    def _like(self, df: DataFrame | None = None, by_row: DataFrame | None = None) -> Matrix:
        return Matrix(df, self.rows, self.cols, self.parts, by_row=by_row)

    @property
    def stored_sparse(self) -> bool:
        """Whether only entries are stored, no whole rows or columns."""
        return self.by_row is None and self.by_col is None

    def row_frame(self) -> DataFrame:
        """``(i, row array)``, each stored row dense."""
        if self.by_row is not None:
            return self.by_row
        cells = [F.coalesce(F.sum(F.when(F.col("j") == k, F.col("v"))), F.lit(0.0)) for k in range(self.cols)]
        return self.df.groupBy("i").agg(F.array(*cells).alias("row"))

    def entry(self, i: int, j: int) -> DataFrame:
        _check(0 <= i < self.rows and 0 <= j < self.cols, f"cell ({i}, {j}) is outside the matrix")
        return self.df.where((F.col("i") == i) & (F.col("j") == j))

    def block(self, row0: int, row1: int, col0: int, col1: int) -> Matrix:
        """Half-open block, with indices starting at zero again."""
        _check(0 <= row0 < row1 <= self.rows and 0 <= col0 < col1 <= self.cols, "block is outside the matrix")
        i = (F.col("i") - row0).alias("i")
        in_rows = F.col("i").between(row0, row1 - 1)
        if self.by_row is not None:
            kept = F.slice("row", col0 + 1, col1 - col0).alias("row")
            return Matrix(None, row1 - row0, col1 - col0, by_row=self.by_row.where(in_rows).select(i, kept))
        df = self.df.where(in_rows & F.col("j").between(col0, col1 - 1))
        return Matrix(df.select(i, (F.col("j") - col0).alias("j"), "v"), row1 - row0, col1 - col0)

    def row_block(self, row0: int, row1: int) -> Matrix:
        return self.block(row0, row1, 0, self.cols)

    def column(self, j: int) -> Vector:
        _check(0 <= j < self.cols, f"column {j} is outside the matrix")
        if self.by_row is not None:
            return Vector(self.by_row.select("i", F.col("row")[j].alias("v")), self.rows)
        return Vector(self.df.where(F.col("j") == j).select("i", "v"), self.rows)

    @property
    def T(self) -> Matrix:
        df = self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        source = self.source and (self.source[0], self.source[2], self.source[1])
        return Matrix(df, self.cols, self.rows, by_row=self.by_col, by_col=self.by_row, source=source)

    def _paired_rows(self, other: Matrix) -> DataFrame:
        """Rows of both matrices side by side; a row only one of them stores is zero in the other."""
        zeros = F.array_repeat(F.lit(0.0), self.cols)
        mine = self.by_row.withColumnRenamed("row", "a")
        theirs = other.by_row.withColumnRenamed("row", "b")
        pairs = mine.join(theirs, "i", "full_outer")
        return pairs.select("i", F.coalesce("a", zeros).alias("a"), F.coalesce("b", zeros).alias("b"))

    def combine(self, alpha: float, other: Matrix, beta: float) -> Matrix:
        """``alpha * self + beta * other``."""
        _check((self.rows, self.cols) == (other.rows, other.cols), "matrices differ in shape")
        if self.by_row is None or other.by_row is None:
            return self._like(_sum_entries([(alpha, self.df), (beta, other.df)], ["i", "j"]))
        a, b = F.lit(float(alpha)), F.lit(float(beta))
        row = F.zip_with("a", "b", lambda x, y: a * x + b * y)
        return self._like(by_row=self._paired_rows(other).select("i", row.alias("row")))

    def __add__(self, other: Matrix) -> Matrix:
        return self.combine(1.0, other, 1.0)

    def __sub__(self, other: Matrix) -> Matrix:
        return self.combine(1.0, other, -1.0)

    def __rmul__(self, alpha: float) -> Matrix:
        if self.by_row is not None:
            scaled = F.transform("row", lambda x: F.lit(float(alpha)) * x)
            return self._like(by_row=self.by_row.select("i", scaled.alias("row")))
        return self._like(self.df.withColumn("v", F.lit(float(alpha)) * F.col("v")))

    def scaled_rows(self, d: Vector) -> Matrix:
        """``diag(d) @ self``."""
        _check(self.rows == d.rows, "row counts differ")
        scale = d.df.withColumnRenamed("v", "s")
        if self.by_row is not None:
            joined = self.by_row.join(small(scale, d.rows, 16), "i")
            row = F.transform("row", lambda x: F.col("s") * x)
            return self._like(by_row=joined.select("i", row.alias("row")))
        if fits(d.rows, 16):
            joined = self.df.join(F.broadcast(scale), "i")
        else:
            # One row may hold a third of all entries: split it over several keys.
            entries, scale = spread_keys(self.df, scale, F.col("j"))
            joined = entries.join(scale, ["i", "salt"])
        return self._like(joined.withColumn("v", F.col("v") * F.col("s")))

    def __mul__(self, other: Vector | Matrix) -> Vector | Matrix:
        _check(self.cols == other.rows, "inner dimensions differ")
        if isinstance(other, Vector):
            return Vector(self._times_vector(other), self.rows)
        whole = self.by_col is not None and other.by_row is not None
        if whole and fits(self.rows * other.cols, 8):
            df = multiply_rows(self.by_col, other.by_row)
        elif self.stored_sparse and other.stored_sparse and not (fits(self.rows * self.cols, 12) or fits(other.rows * other.cols, 12)):
            df = multiply_entries(self, other)
        else:
            df = multiply_tiles(self, other)
        return Matrix(df, self.rows, other.cols)

    def _times_vector(self, x: Vector) -> DataFrame:
        if self.by_row is not None and self.cols <= PACKED_ROWS:
            # x becomes one array for all tasks: a map over the rows, no shuffle.
            rows = self.by_row.withColumn("x", x.packed().scalar())
            return rows.select("i", dot(F.col("row"), F.col("x"), self.cols).alias("v"))
        values = x.df.select(F.col("i").alias("j"), F.col("v").alias("x"))
        if self.by_col is not None and self.rows <= PACKED_ROWS:
            pairs = self.by_col.withColumnRenamed("i", "j").join(small(values, x.rows, 16), "j")
            sums = array_sums(pairs, F.col("row"), [F.col("x")], self.rows)
            return sums.select(F.posexplode(F.col("s")[0]).alias("i", "v"))
        if fits(x.rows, 16):
            joined = self.df.join(F.broadcast(values), "j")
        else:
            # One column may hold a third of all entries: split it over several keys.
            entries, values = spread_keys(self.df, values, F.col("i"))
            joined = entries.join(values, ["j", "salt"])
        return joined.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))

    def norm(self) -> DataFrame:
        """Frobenius norm as a one-row frame ``(norm)``."""
        return self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))

    def equals(self, other: Matrix) -> DataFrame:
        """One row ``(equal)``; missing entries count as zero and NaN never compares equal."""
        _check((self.rows, self.cols) == (other.rows, other.cols), "matrices differ in shape")
        if self.by_row is None or other.by_row is None:
            gap = _max_gap(self.df, other.df, ["i", "j"])
        else:
            row_gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
            gap = self._paired_rows(other).agg(F.coalesce(F.max(row_gap), F.lit(0.0)).alias("gap"))
        return gap.select((F.col("gap") <= TOLERANCE).alias("equal"))

    def __eq__(self, other: object) -> bool:
        return self.equals(other).first()["equal"] if isinstance(other, Matrix) else NotImplemented

    __hash__ = None

    def to_numpy(self):
        """The whole matrix on the driver; for small results only."""
        out = np.zeros((self.rows, self.cols))
        for row in self.df.toLocalIterator():
            out[row.i, row.j] = row.v
        return out

    def display(self, name: str, n: int = 20) -> None:
        print(f"{name}:")
        self.df.orderBy("i", "j").show(n, truncate=False)
