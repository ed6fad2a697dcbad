"""``Hodlr``: the solver for ``(U V' + diag(D)) x = b``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.functions.algebra import Matrix, Vector, array_sums, dot
from ramify.plans.factors import Factorization
from ramify.plans.tree import (
    Layout,
    apply_coefficients,
    merge_tree,
    push_down,
    solve_parts,
)
from ramify.session import RunFolder


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def uniform_layout(row: str, rows: int, level: int, launch_level: int) -> Layout:
    """``2**launch_level`` parts, each holding ``2**(level - launch_level)`` leaves.

    Leaves are equal; where the rows do not divide, the last ones are shorter or absent.
    """
    if not 0 <= launch_level <= level:
        raise ValueError(f"launch level {launch_level} is outside 0..{level}")
    leaf = -(-rows // (1 << level))
    return blocked_layout(row, leaf << (level - launch_level), leaf)


def blocked_layout(row: str, part_rows: int, leaf: int) -> Layout:
    """Parts of ``part_rows`` rows by row number, the last one possibly shorter."""
    return Layout(F.expr(f"`{row}` div {part_rows}"), F.expr(f"`{row}` % {part_rows}"), F.lit(leaf))


def heavy_layout(row: str, part_rows: int, leaf: int, heavy: int, factor: int = 10) -> Layout:
    """Irregular leaves: the first ``heavy`` parts and their leaves are ``factor`` times larger."""
    large = part_rows * factor
    edge = heavy * large
    return Layout(
        F.expr(f"if(`{row}` < {edge}, `{row}` div {large}, {heavy} + (`{row}` - {edge}) div {part_rows})"),
        F.expr(f"if(`{row}` < {edge}, `{row}` % {large}, (`{row}` - {edge}) % {part_rows})"),
        F.expr(f"if(`{row}` < {edge}, {leaf * factor}, {leaf})"),
    )


class Hodlr:
    """The matrix ``U V' + diag(D)`` held as one DataFrame row per matrix row.

    ``system`` has key columns and ``u array``, ``v array`` and ``d double``.  The
    row order of the tree is the input's own order unless a layout is given.
    """

    def __init__(self, system: DataFrame, keys: Sequence[str] = ("i",), rank: int | None = None):
        self.keys = list(keys)
        self.system = system.select(
            *self.keys,
            F.col("u").cast("array<double>").alias("u"),
            F.col("v").cast("array<double>").alias("v"),
            F.col("d").cast("double").alias("d"),
            *[c for c in system.columns if c not in {*self.keys, "u", "v", "d"}],
        )
        self.rank = rank or system.select(F.size("u").alias("r")).first()["r"]
        self._folders: list[RunFolder] = []

    @classmethod
    def from_matrices(cls, u: Matrix, v: Matrix, d: Vector) -> Hodlr:
        """Assemble the rows of U, V and D; the three frames are shuffled once by row.

        Entries that are not stored are zero, so every row of the shape is in the system.
        """
        if (u.rows, u.cols) != (v.rows, v.cols) or u.rows != d.rows:
            raise ValueError("U, V and D disagree in shape")
        spark = u.df.sparkSession
        frames = [
            u.row_frame().select("i", F.col("row").alias("u")),
            v.row_frame().select("i", F.col("row").alias("v")),
            d.df.select("i", F.col("v").alias("d")),
            spark.range(u.rows).select(F.col("id").alias("i")),
        ]
        stacked = frames[0]
        for frame in frames[1:]:
            stacked = stacked.unionByName(frame, allowMissingColumns=True)
        zeros = F.array_repeat(F.lit(0.0), u.cols)
        rows = stacked.groupBy("i").agg(
            F.coalesce(F.first("u", ignorenulls=True), zeros).alias("u"),
            F.coalesce(F.first("v", ignorenulls=True), zeros).alias("v"),
            F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"),
        )
        return cls(rows, rank=u.cols)

    def folder(self) -> RunFolder:
        folder = RunFolder(self.system.sparkSession)
        self._folders.append(folder)
        return folder

    def clear(self) -> None:
        """Delete the tables written by earlier solves."""
        for folder in self._folders:
            folder.release()
        self._folders = []

    def _with_rhs(self, b: DataFrame | Column | str) -> tuple[DataFrame, int]:
        if isinstance(b, DataFrame):
            rhs = [c for c in b.columns if c not in self.keys]
            self._check_keys(b)
            # absent entries are zero: every row of the system stays
            values = b.select(*self.keys, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in rhs]).alias("b"))
            zeros = F.array_repeat(F.lit(0.0), len(rhs))
            rows = self.system.drop("b").join(values, self.keys, "left").withColumn("b", F.coalesce("b", zeros))
        else:
            column = F.col(b) if isinstance(b, str) else b
            rows = self.system.withColumn("b", column)
            rhs = [b]
        if dict(rows.dtypes)["b"].startswith("array"):
            rows = rows.withColumn("b", F.col("b").cast("array<double>"))
            nrhs = len(rhs)
            if not isinstance(b, DataFrame):
                nrhs = rows.select(F.size("b").alias("k")).first()["k"]
            return rows, nrhs
        return rows.withColumn("b", F.array(F.col("b").cast("double"))), 1

    def _check_keys(self, b: DataFrame) -> None:
        """The keys of a right-hand side are unique and all in the system."""
        if not b.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("the right-hand side has several rows for one key")
        if not b.join(self.system.select(*self.keys), self.keys, "left_anti").isEmpty():
            raise ValueError("the right-hand side has keys that the system lacks")

    def solve(
        self,
        b: DataFrame | Column | str,
        leaf: int | None = None,
        layout: Layout | None = None,
        part_rows: int | None = None,
        nrhs: int | None = None,
        keep: Sequence[str] = (),
    ) -> DataFrame:
        """Solve for one or several right-hand sides.

        ``b`` is a column of the system (a number, or an array with one value per
        right-hand side) or a frame of keys and one column per right-hand side, whose
        absent rows are zero.  Returns the keys, the system's columns named in ``keep``, and
        ``x``, an array with one value per right-hand side.  Kept columns stay on their own
        row, so x can be put back without a join, also where keys repeat.
        """
        leaf = leaf or max(64, 2 * self.rank)
        if leaf <= self.rank:
            raise ValueError(f"leaf size {leaf} must exceed the rank {self.rank}")
        if nrhs is None:
            rows, nrhs = self._with_rhs(b)
        else:
            rows = self.system.withColumn("b", b if isinstance(b, Column) else F.col(b))
        carried = {c: f"_keep{k}" for k, c in enumerate(keep)}
        rows = rows.withColumns({to: F.col(c) for c, to in carried.items()})
        folder = self.folder()
        parts = solve_parts(
            rows, [*self.keys, *carried.values()], self.rank, self.rank, nrhs, leaf, folder, "parts", part_rows, layout
        )
        stages = merge_tree(parts, folder, "tree")
        solved = apply_coefficients(parts, push_down(stages, parts))
        return solved.withColumnsRenamed({to: c for c, to in carried.items()})

    def factor(self, leaf: int | None = None, layout: Layout | None = None, keep: Sequence[str] = ()) -> Factorization:
        """Factors for any number of right-hand sides; columns named in ``keep`` stay with them."""
        found = Factorization(self.system, self.keys, self.rank, leaf or max(64, 2 * self.rank), keep, layout)
        self._folders.append(found.folder)
        return found

    def solve_levels(
        self, b, rows: int, level: int, launch_level: int | None = None, nrhs: int | None = None
    ) -> DataFrame:
        """Solve on the tree of ``2**level`` leaves, the last ones maybe shorter, over rows ``0..rows-1``."""
        launch_level = level if launch_level is None else launch_level
        layout = uniform_layout(self.keys[0], rows, level, launch_level)
        return self.solve(b, leaf=-(-rows // (1 << level)), layout=layout, nrhs=nrhs)

    def products(self, *xs: Column | str) -> DataFrame:
        """The system with ``ax array``: ``U (V' x) + D x`` for each column ``x``.

        ``V' x`` of all columns is one scan that ends in one row; ``U V'`` is never formed.
        """
        xs = [F.col(x) if isinstance(x, str) else x for x in xs]
        y = array_sums(self.system, F.col("v"), xs, self.rank).scalar()
        rows = self.system.withColumn("_y", y)
        ax = [dot(F.col("u"), F.col("_y")[k], self.rank) + F.col("d") * x for k, x in enumerate(xs)]
        return rows.withColumn("ax", F.array(*ax)).drop("_y")

    def matvec(self, x: Column | str) -> DataFrame:
        """``A x`` for a column ``x`` of the system."""
        return self.products(x).select(*self.keys, F.col("ax")[0].alias("v"))

    def residual(self, x: Column | str, b: Column | str) -> DataFrame:
        """One row ``(residual, relative)`` of ``b - A x`` for columns of the system."""
        b = F.col(b) if isinstance(b, str) else b
        rows = self.products(x).select((b - F.col("ax")[0]).alias("gap"), b.alias("b"))
        sums = rows.agg(F.sum(F.col("gap") * F.col("gap")).alias("gap"), F.sum(F.col("b") * F.col("b")).alias("base"))
        return sums.select(
            F.sqrt("gap").alias("residual"), F.sqrt(F.col("gap") / F.col("base")).alias("relative")
        )
