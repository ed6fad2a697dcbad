"""Block-partitioned matrices and the distributed operators on them.

A matrix is a frame ``(part, row0, nrow, data)``: ``data`` is row-major over the
full stored width, ``part`` is the tree position.  A part may be stored as several
blocks of at most ``block_rows`` rows, so no cell grows with the part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.functions.algebra import Matrix, Vector
from ramify.operators.kernels import coupling, dense_rows, list_column, low_rank_block, solve, solve_part
from ramify.session import BROADCAST_BYTES, RunFolder

SCHEMA = "part bigint, row0 bigint, nrow int, data array<double>"
#: A stored block stays near this size.
BLOCK_BYTES = 4 << 20
#: Partial products a task holds before handing them to the shuffle, and their bytes.
HELD_GROUPS = 256
HELD_BYTES = 16 << 20


def _cells(batch: pa.RecordBatch | pa.Table, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _ragged(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    flat = np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _per_block(work: Callable[..., np.ndarray], *names: str):
    """A map over blocks: ``work(nrow, part, *cells)`` gives the new ``data``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = batch.column("nrow").to_pylist(), batch.column("part").to_pylist()
            out, first, held = [], 0, 0
            for k, args in enumerate(zip(rows, parts, *(_cells(batch, n) for n in names)), 1):
                out.append(work(*args))
                held += out[-1].nbytes
                # new blocks may be wider than the old ones
                if held >= BLOCK_BYTES or k == len(rows):
                    columns = [batch.column(c).slice(first, k - first) for c in ("part", "row0", "nrow")]
                    yield pa.RecordBatch.from_arrays([*columns, _ragged(out)], ["part", "row0", "nrow", "data"])
                    out, first, held = [], k, 0

    return run


def _op(cell: np.ndarray, trans: str) -> np.ndarray:
    return cell.T if trans == "t" else cell


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def _check_trans(*flags: str) -> None:
    _check(all(f in ("n", "t") for f in flags), f"transpose flags must be 'n' or 't', not {flags}")


@dataclass(frozen=True)
class Partition:
    """Where the row parts of a matrix begin and end.

    Equal parts are arithmetic: ``part_rows`` rows each, the last ones shorter or empty where the
    rows do not divide.  Unequal ones are an index of intervals: part ``p`` has the rows from
    ``edges[p]`` up to ``edges[p + 1]``, which may be none.
    """

    rows: int
    parts: int
    part_rows: int
    edges: tuple[int, ...] | None = None

    @classmethod
    def equal(cls, rows: int, parts: int) -> Partition:
        _check(rows > 0 and parts > 0, f"{rows} rows in {parts} parts")
        return cls(rows, parts, -(-rows // parts))

    @classmethod
    def of_size(cls, rows: int, part_rows: int) -> Partition:
        """Parts of exactly ``part_rows`` rows, only the last one shorter."""
        _check(rows > 0 and part_rows > 0, f"{rows} rows in parts of {part_rows}")
        return cls(rows, -(-rows // part_rows), min(rows, part_rows))

    @classmethod
    def ranges(cls, edges: Sequence[int]) -> Partition:
        """Any ranges that follow each other from row 0 on."""
        edges = tuple(int(e) for e in edges)
        sizes = [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]
        _check(edges[:1] == (0,) and bool(sizes) and min(sizes) >= 0 and edges[-1] > 0, "edges must begin with 0 and never fall")
        return cls(edges[-1], len(sizes), max(sizes), edges)

    def empty_groups(self, size: int) -> Sequence[int]:
        """Groups of ``size`` consecutive parts that have no row at all."""
        groups = self.parts // size
        if self.edges is None:
            return range(min(groups, -(-self.rows // (self.part_rows * size))), groups)
        return [g for g in range(groups) if self.edges[g * size] == self.edges[(g + 1) * size]]

    def place(self, df: DataFrame, block_rows: int) -> DataFrame:
        """``df`` with the ``part`` and the block's ``row0`` of its row ``i``."""
        if self.edges is None:
            n = self.part_rows
            part = F.expr(f"i div {n}")
            return df.withColumns({"part": part, "row0": F.expr(f"i div {n} * {n} + i % {n} div {block_rows} * {block_rows}")})
        edges = np.array(self.edges)
        schema = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes) + ", part bigint, row0 bigint"

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i = batch.column("i").to_numpy()
                part = np.searchsorted(edges, i, "right") - 1  # of empty parts at one place the last, which has rows
                row0 = edges[part] + (i - edges[part]) // block_rows * block_rows
                columns = [*batch.columns, pa.array(part), pa.array(row0)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "row0"])

        return df.mapInArrow(look_up, schema)

    def blocks(self, spark: SparkSession, block_rows: int) -> DataFrame:
        """``(part, row0, nrow)`` of every block; empty parts have none."""
        if self.edges is None:
            first = F.col("id") * self.part_rows
            ends = F.least(F.lit(self.part_rows), F.lit(self.rows) - first)
            parts = spark.range(self.parts).select(F.col("id").alias("part"), first.alias("first"), ends.alias("own"))
        else:
            values = np.array(self.edges)
            index = pa.table({"part": np.arange(self.parts), "first": values[:-1], "own": np.diff(values)})
            parts = spark.createDataFrame(index)
        at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own") - 1, F.lit(block_rows).cast("bigint")))
        return parts.where("own > 0").select("part", "first", "own", at.alias("at")).select(
            "part", (F.col("first") + F.col("at")).alias("row0"), F.least(F.lit(block_rows), F.col("own") - F.col("at")).cast("int").alias("nrow")
        )


@dataclass(frozen=True, eq=False)
class RowBlocks:
    """``rows`` by ``width`` storage in row parts, seen through a column window.

    Parts are equal (``edges`` is None; the last ones may be shorter or empty) or any ranges of rows.
    """

    df: DataFrame
    rows: int
    width: int
    parts: int
    block_rows: int
    col0: int = 0
    ncols: int | None = None
    levels: int = 1
    cut_at: Partition | None = None

    # -- shape ---------------------------------------------------------------

    @property
    def cols(self) -> int:
        return self.width - self.col0 if self.ncols is None else self.ncols

    @property
    def partition_of(self) -> Partition:
        return self.cut_at or Partition.equal(self.rows, self.parts)

    @property
    def part_rows(self) -> int:
        """Rows of the largest part: of every one but the last ones, where parts are equal."""
        return self.partition_of.part_rows

    @property
    def whole_parts(self) -> bool:
        """Whether every part is a single block."""
        return self.block_rows >= self.part_rows

    def shape(self) -> dict[str, int]:
        return {
            "rows": self.rows,
            "cols": self.cols,
            "part_rows": self.part_rows,
            "column_begin": self.col0,
            "parts": self.parts,
            "levels": self.levels,
        }

    def window(self, col0: int, cols: int) -> RowBlocks:
        """Another view of the same storage; no data moves."""
        _check(0 <= col0 and cols > 0 and col0 + cols <= self.width, "window is outside the storage")
        return replace(self, col0=col0, ncols=cols)

    def _view(self) -> Callable[[np.ndarray], np.ndarray]:
        width, lo, hi = self.width, self.col0, self.col0 + self.cols
        return lambda cell: cell.reshape(-1, width)[:, lo:hi]

    # -- in and out ----------------------------------------------------------

    @staticmethod
    def _block_rows(cut: Partition, width: int, block_rows: int | None) -> int:
        return min(block_rows or max(1, BLOCK_BYTES // (8 * width)), cut.part_rows)

    @classmethod
    def from_matrix(cls, m: Matrix, level: int = 0, block_rows: int | None = None, cut: Partition | None = None) -> RowBlocks:
        """Partition a matrix into ``2**level`` equal row parts, or as ``cut`` says: one shuffle by block."""
        return cls.together([m], level, block_rows, cut)[0]

    @classmethod
    def together(
        cls, ms: Sequence[Matrix], level: int = 0, block_rows: int | None = None, cut: Partition | None = None
    ) -> list[RowBlocks]:
        """Several matrices with the same rows as windows of one storage, assembled in one shuffle.

        Operators on them need no join.
        """
        rows, width = ms[0].rows, sum(m.cols for m in ms)
        cut = cut or Partition.equal(rows, 1 << level)
        _check(all(m.rows == cut.rows for m in ms), f"a partition of {cut.rows} rows for other matrices")
        block_rows = cls._block_rows(cut, width, block_rows)
        # One empty row per block, so that a block without entries still exists.
        entries = cut.blocks(ms[0].df.sparkSession, block_rows)
        col0, first = 0, []
        for m in ms:
            if m.by_row is not None:
                found = m.by_row.select("i", F.lit(col0).alias("j"), "row")
            else:
                found = m.df.select("i", (F.col("j") + col0).cast("int").alias("j"), "v")
            entries = entries.unionByName(cut.place(found, block_rows), allowMissingColumns=True)
            first.append(col0)
            col0 += m.cols

        def assemble(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            p, row0 = (value.as_py() for value in group)
            data = np.zeros((pc.max(table.column("nrow")).as_py(), width))
            if "row" in table.column_names:
                whole = table.filter(table.column("row").is_valid())
                j = whole.column("j").to_numpy()
                for at in np.unique(j):
                    part = whole.filter(pa.array(j == at))
                    cells = part.column("row").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
                    data[part.column("i").to_numpy() - row0, at : at + cells.shape[1]] = cells
            if "v" in table.column_names:
                single = table.filter(table.column("v").is_valid())
                data[single.column("i").to_numpy() - row0, single.column("j").to_numpy()] = single.column("v").to_numpy()
            return pa.Table.from_arrays(
                [pa.array([p]), pa.array([row0]), pa.array([len(data)], pa.int32()), list_column(data.reshape(1, -1))],
                ["part", "row0", "nrow", "data"],
            )

        df = entries.groupBy("part", "row0").applyInArrow(assemble, SCHEMA)
        storage = cls(df, rows, width, cut.parts, block_rows, cut_at=cut)
        return [storage.window(at, m.cols) if len(ms) > 1 else storage for at, m in zip(first, ms, strict=True)]

    def columns(self, *ranges: tuple[int, int]) -> RowBlocks:
        """Storage of only these (first, number) of the stored columns, side by side; the rest is not written."""
        width = self.width

        def take(nrow, part, cell):
            return np.concatenate([cell.reshape(nrow, width)[:, a : a + n] for a, n in ranges], axis=1)

        df = self.df.mapInArrow(_per_block(take, "data"), SCHEMA)
        return replace(self, df=df, width=sum(n for _, n in ranges), col0=0, ncols=None)

    @classmethod
    def zeros(
        cls, spark: SparkSession, rows: int, cols: int, level: int = 0, block_rows: int | None = None, cut: Partition | None = None
    ) -> RowBlocks:
        """Zero-filled storage; every block exists, so later joins keep all rows."""
        cut = cut or Partition.equal(rows, 1 << level)
        block_rows = cls._block_rows(cut, cols, block_rows)
        data = F.array_repeat(F.lit(0.0), F.col("nrow") * cols).alias("data")
        df = cut.blocks(spark, block_rows).select("part", "row0", "nrow", data)
        return cls(df, rows, cols, cut.parts, block_rows, cut_at=cut)

    def entries(self, row0: int = 0, row1: int | None = None, col0: int = 0, col1: int | None = None) -> DataFrame:
        """Entries ``(i, j, v)`` of a half-open range of the window, counted from its corner."""
        row1 = self.rows if row1 is None else row1
        col1 = self.cols if col1 is None else col1
        _check(0 <= row0 <= row1 <= self.rows and 0 <= col0 <= col1 <= self.cols, "range is outside the matrix")
        blocks = self.df.where((F.col("row0") < row1) & (F.col("row0") + F.col("nrow") > row0))
        width, lo, hi = self.width, self.col0 + col0, self.col0 + col1

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, cell in zip(batch.column("row0").to_pylist(), _cells(batch, "data")):
                    # the range is cut out of the block before it becomes entries
                    begin = max(0, row0 - first)
                    part = cell.reshape(-1, width)[begin : row1 - first, lo:hi]
                    i = np.repeat(np.arange(len(part)) + first + begin - row0, hi - lo)
                    j = np.tile(np.arange(hi - lo), len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(part.ravel())], ["i", "j", "v"])

        return blocks.select("row0", "data").mapInArrow(cells, "i bigint, j bigint, v double")

    def to_matrix(self, row0: int = 0, row1: int | None = None, col0: int = 0, col1: int | None = None) -> Matrix:
        row1 = self.rows if row1 is None else row1
        col1 = self.cols if col1 is None else col1
        return Matrix(self.entries(row0, row1, col0, col1), row1 - row0, col1 - col0)

    def measure(self) -> DataFrame:
        """One row with the stored shape, counted from the blocks themselves."""
        sizes = self.df.groupBy("part").agg(F.sum("nrow").alias("nrow"), F.max(F.expr("size(data) div nrow")).alias("width"))
        # empty parts have no block
        sizes = self.df.sparkSession.range(self.parts).select(F.col("id").alias("part")).join(sizes, "part", "left")
        return sizes.agg(
            F.sum("nrow").alias("rows"),
            F.max("width").alias("width"),
            F.count("*").alias("parts"),
            F.max("nrow").alias("part_rows"),
        )

    def to_vector(self) -> Vector:
        """The first column of the window."""
        return Vector(self.entries(col1=1).select("i", "v"), self.rows)

    def display(self, name: str, n: int = 20) -> None:
        self.to_matrix().display(name, n)

    def cut(self, folder: RunFolder, name: str) -> RowBlocks:
        """The same blocks read back from a written table, for loops over levels."""
        return replace(self, df=folder.cut(self.df, name))

    # -- partitions ----------------------------------------------------------

    def partition(self, level: int = 0, block_rows: int | None = None, cut: Partition | None = None) -> RowBlocks:
        """Re-cut into ``2**level`` equal parts, or as ``cut`` says; blocks move only if they cross the new edges."""
        cut = cut or Partition.equal(self.rows, 1 << level)
        part_rows, equal = cut.part_rows, cut.edges is None and self.partition_of.edges is None
        if equal and part_rows % self.block_rows == 0 and self.part_rows % self.block_rows == 0:
            df = self.df.withColumn("part", F.expr(f"row0 div {part_rows}"))
            return replace(self, df=df, parts=cut.parts, levels=1, cut_at=cut)
        whole = replace(self, col0=0, ncols=None)
        moved = RowBlocks.from_matrix(whole.to_matrix(), block_rows=block_rows, cut=cut)
        return replace(moved, col0=self.col0, ncols=self.ncols)

    def two_level_partition(self) -> RowBlocks:
        """Split every part in halves; part ``p`` becomes node ``p`` with sides 0 and 1."""
        edges = self.partition_of.edges
        if edges is not None:
            middle = [e for a, b in zip(edges[:-1], edges[1:]) for e in (a, (a + b + 1) // 2)]
            return replace(self.partition(cut=Partition.ranges([*middle, edges[-1]])), levels=2)
        level = (self.parts - 1).bit_length() + 1
        return replace(self.partition(level), levels=2)

    def colors(self) -> DataFrame:
        """Row ranges of the parts, with ``(node, side)`` for a two-level partition."""
        sizes = self.df.groupBy("part").agg(F.min("row0").alias("row0"), F.sum("nrow").alias("nrow"))
        if self.levels == 2:
            return sizes.select(F.expr("part div 2").alias("node"), F.expr("part % 2").alias("side"), "row0", "nrow")
        return sizes

    # -- element-wise --------------------------------------------------------

    def scale(self, alpha: float) -> RowBlocks:
        """Scale the window; a factor of one returns the same blocks."""
        if abs(alpha - 1.0) < 1e-10:
            return self
        return self._on_window(lambda x: f"{float(alpha)!r}D * {x}")

    def clear(self, value: float) -> RowBlocks:
        """Set the window to ``value``."""
        return self._on_window(lambda x: f"{float(value)!r}D")

    def _on_window(self, expr: Callable[[str], str]) -> RowBlocks:
        if self.cols == self.width:
            body = expr("x")
        else:
            inside = f"k % {self.width} between {self.col0} and {self.col0 + self.cols - 1}"
            body = f"if({inside}, {expr('x')}, x)"
        return replace(self, df=self.df.withColumn("data", F.expr(f"transform(data, (x, k) -> {body})")))

    def init_data(self, m: Matrix, col0: int = 0, col1: int | None = None) -> RowBlocks:
        """Fill columns ``col0..col1`` with side-by-side copies of ``m``."""
        col1 = m.cols if col1 is None else col1
        _check(0 <= col0 and col1 <= self.width, "columns are outside the storage")
        _check((col1 - col0) >= m.cols and (col1 - col0) % m.cols == 0, "columns do not hold whole copies")
        source = RowBlocks.from_matrix(m, block_rows=self.block_rows, cut=self.partition_of)
        width, copies = self.width, (col1 - col0) // m.cols
        see = source._view()

        def fill(nrow, part, data, values):
            data = data.reshape(nrow, width).copy()
            data[:, col0:col1] = np.tile(see(values), copies)
            return data

        joined = self.df.join(source.df.select("row0", F.col("data").alias("other")), "row0")
        return replace(self, df=joined.mapInArrow(_per_block(fill, "data", "other"), SCHEMA))

    @staticmethod
    def add(alpha: float, a: RowBlocks, beta: float, b: RowBlocks) -> RowBlocks:
        """``alpha A + beta B`` for equally partitioned matrices."""
        _check((a.cols, a.partition_of) == (b.cols, b.partition_of), "matrices differ in shape or parts")
        see_a, see_b = a._view(), b._view()

        def work(nrow, part, x, y):
            return alpha * see_a(x) + beta * see_b(y)

        pairs, names = _paired(a, b)
        df = pairs.mapInArrow(_per_block(work, *names), SCHEMA)
        return RowBlocks(df, a.rows, a.cols, a.parts, a.block_rows, levels=a.levels, cut_at=a.cut_at)

    # -- products ------------------------------------------------------------

    @staticmethod
    def gemm_red(
        ta: str,
        tb: str,
        alpha: float,
        a: RowBlocks,
        b: RowBlocks,
        parts: int = 1,
        levels: int = 1,
        beta: float = 0.0,
        c: RowBlocks | None = None,
    ) -> RowBlocks:
        """``C_c <- beta C_c + alpha * sum over parts p of color c of op(A_p) op(B_p)``.

        Consecutive parts share a color.  Each task adds its blocks' products per
        color before the shuffle, which moves whole arrays.  C, if given, is one more summand.
        """
        _check_trans(ta, tb)
        _check(a.parts == b.parts, "A and B differ in parts")
        _check(a.parts % parts == 0, f"{a.parts} parts do not group into {parts}")
        _check(c is None or alpha != 0, "a sum with C needs a factor of A B other than zero")
        a_rows, b_rows = a.part_rows, b.part_rows
        m, k = (a_rows, a.cols) if ta == "n" else (a.cols, a_rows)
        k2, n = (b_rows, b.cols) if tb == "n" else (b.cols, b_rows)
        _check(k == k2, f"inner dimensions {k} and {k2} differ")
        by_row = ta == "t" and tb == "n"
        _check(by_row or (a.whole_parts and b.whole_parts), "this product needs every part in one block")
        color = a.parts // parts
        see_a, see_b = a._view(), b._view()
        limit = max(1, min(HELD_GROUPS, HELD_BYTES // (8 * m * n)))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}

            def emit() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.int64()), _ragged(list(held.values()))], ["part", "c"]
                )
                held.clear()
                return out

            for batch in batches:
                colors = (batch.column("part").to_numpy() // color).tolist()
                for c, x, y in zip(colors, *(_cells(batch, name) for name in names)):
                    if c not in held and len(held) >= limit:
                        yield emit()
                    product = _product(_op(see_a(x), ta), _op(see_b(y), tb))
                    total = held.setdefault(c, np.zeros((m, n)))
                    total[: product.shape[0], : product.shape[1]] += product
            yield emit()

        pairs, names = _paired(a, b, on="row0" if by_row else "part")
        if c is None and color == 1 and a.whole_parts and b.whole_parts:
            # Nothing to add up: one product per part, no shuffle of the results.
            def whole(nrow, part, x, y):
                return alpha * _product(_op(see_a(x), ta), _op(see_b(y), tb))

            df = pairs.mapInArrow(_per_block(whole, *names), SCHEMA)
            own = (F.size("data") / n).cast("int")
            if ta == "n":
                df = df.select("part", "row0", own.alias("nrow"), "data")
                return RowBlocks(df, a.rows, n, parts, m, levels=levels, cut_at=a.cut_at)
            df = df.select("part", (F.col("part") * m).alias("row0"), own.alias("nrow"), "data")
            return RowBlocks(_with_zeros(df, a.partition_of.empty_groups(color), m, n), m * parts, n, parts, m, levels=levels)
        products = pairs.mapInArrow(partial, "part bigint, c array<double>")
        if c is not None:
            _check((c.parts, c.cols) == (parts, n) and c.part_rows == m, "C has not the shape of the product")
            see_c = c._view()
            old = c.df.mapInArrow(_per_block(lambda nrow, part, x: (beta / alpha) * see_c(x), "data"), SCHEMA)
            products = products.unionByName(old.select("part", F.col("data").alias("c")))
        sums = sum_arrays(products, "part", "c", alpha)
        df = sums.select("part", (F.col("part") * m).alias("row0"), F.lit(m).alias("nrow"), F.col("c").alias("data"))
        return RowBlocks(_with_zeros(df, a.partition_of.empty_groups(color), m, n), m * parts, n, parts, m, levels=levels)

    @staticmethod
    def gemm_bro(
        ta: str, tb: str, alpha: float, a: RowBlocks, b: RowBlocks, beta: float, c: RowBlocks
    ) -> RowBlocks:
        """``C_p = alpha op(A_p) op(B_color(p)) + beta C_p``, written in C's window.

        A and C may be windows of one storage, which then needs no join at all.
        """
        _check_trans(ta, tb)
        _check(b.whole_parts, "B needs every part in one block")
        same = a.parts == c.parts and (ta == "t" or a.partition_of == c.partition_of)
        _check(same and a.parts % b.parts == 0, "parts of A, B and C do not match")
        _check(ta == "n" or a.whole_parts, "a transposed A needs every part in one block")
        m, k = (a.part_rows, a.cols) if ta == "n" else (a.cols, a.part_rows)
        k2, n = (b.part_rows, b.cols) if tb == "n" else (b.cols, b.part_rows)
        _check(k == k2 and (m, n) == (c.part_rows, c.cols), "shapes of A, B and C do not match")
        see_a, see_b, see_c = a._view(), b._view(), c._view()

        def work(nrow, part, old, x, y):
            data = old.reshape(nrow, -1).copy()
            window = see_c(data)
            product = alpha * (_op(see_a(x), ta) @ _op(see_b(y), tb))
            window[...] = product if beta == 0 else beta * window + product
            return data

        small = b.df.select(F.col("part").alias("color"), F.col("data").alias("b"))
        if b.rows * b.width * 8 <= BROADCAST_BYTES:
            small = F.broadcast(small)
        pairs, names = _paired(c, a, on="row0" if ta == "n" else "part")
        joined = pairs.withColumn("color", F.expr(f"part div {a.parts // b.parts}")).join(small, "color")
        df = joined.mapInArrow(_per_block(work, *names, "b"), SCHEMA)
        return replace(c, df=df)

    @staticmethod
    def gemm(
        ta: str, tb: str, alpha: float, a: RowBlocks, b: RowBlocks, beta: float = 0.0, c: RowBlocks | None = None
    ) -> RowBlocks:
        """``alpha op(A) op(B) + beta C`` summed over all parts into one block."""
        return RowBlocks.gemm_red(ta, tb, alpha, a, b, beta=beta, c=c)

    @staticmethod
    def gemm_inplace(alpha: float, a: RowBlocks, b: RowBlocks, c: RowBlocks) -> RowBlocks:
        """``C += alpha A B`` with one B for all parts."""
        return RowBlocks.gemm_bro("n", "n", alpha, a, b, 1.0, c)

    # -- solves --------------------------------------------------------------

    @classmethod
    def dense_blocks(cls, u: RowBlocks, v: RowBlocks, d: RowBlocks) -> RowBlocks:
        """``K_p = U_p V_p' + diag(D_p)`` for every part, stacked; parts are the leaves.

        A shorter last leaf is padded with zero columns to the width of the others.
        """
        _check((u.cols, u.partition_of) == (v.cols, v.partition_of), "U and V differ in shape or parts")
        _check((d.cols, d.partition_of) == (1, u.partition_of), "D must be one column with the parts of U")
        _check(u.whole_parts and v.whole_parts and d.whole_parts, "a leaf must be one block")
        see_u, see_v, see_d = u._view(), v._view(), d._view()

        width = u.part_rows

        def work(nrow, part, x, y, z):
            block = np.zeros((nrow, width))
            block[:, :nrow] = low_rank_block(see_u(x), see_v(y), see_d(z)[:, 0])
            return block

        pairs, names = _paired(u, v, d)
        df = pairs.mapInArrow(_per_block(work, *names), SCHEMA)
        return cls(df, u.rows, u.part_rows, u.parts, u.part_rows, cut_at=u.cut_at)

    def leaf_solve(self, b: RowBlocks) -> RowBlocks:
        """``B_p <- A_p^-1 B_p`` for square parts A_p (this matrix stays as it is)."""
        _check(self.cols == self.part_rows, "the parts are not square")
        _check(self.partition_of == b.partition_of, "A and B differ in rows or parts")
        _check(self.whole_parts and b.whole_parts, "a leaf must be one block")
        see_a, see_b = self._view(), b._view()

        def work(nrow, part, data, k):
            data = data.reshape(nrow, -1).copy()
            window = see_b(data)
            window[...] = solve(see_a(k)[:, :nrow], window, f"part {part}")
            return data

        pairs, names = _paired(b, self)
        df = pairs.mapInArrow(_per_block(work, *names), SCHEMA)
        return replace(b, df=df)

    @staticmethod
    def part_solve(u: RowBlocks, v: RowBlocks, d: RowBlocks, b: RowBlocks, leaf: int, copies: int = 1, with_v: bool = False) -> RowBlocks:
        """``[b | u | u ...]`` of every part solved against its diagonal block.

        A part holds several leaves of ``leaf`` rows, whose levels are merged inside
        the task; the solved u is stored ``copies`` times, once per level above.  ``with_v``
        puts V behind them, so that later products of both need no join.
        """
        _check(leaf > u.cols, f"leaf size {leaf} must exceed the rank {u.cols}")
        for m in (u, v, d, b):
            _check(m.whole_parts and m.partition_of == u.partition_of, "U, V, D and b must share whole parts")
        views, nrhs = [m._view() for m in (u, v, d, b)], b.cols

        def work(nrow, part, *cells):
            uu, vv, dd, bb = (see(cell) for see, cell in zip(views, cells))
            w = solve_part(uu, vv, dd[:, 0], bb, leaf, f"part {part}")[0]
            return np.concatenate([w[:, :nrhs], np.tile(w[:, nrhs:], copies), *([vv] if with_v else [])], axis=1)

        pairs, names = _paired(u, v, d, b)
        df = pairs.mapInArrow(_per_block(work, *names), SCHEMA)
        width = nrhs + copies * u.cols + (v.cols if with_v else 0)
        return RowBlocks(df, u.rows, width, u.parts, u.block_rows, cut_at=u.cut_at)

    @staticmethod
    def node_solve(vtu: RowBlocks, vtd: RowBlocks) -> RowBlocks:
        """Solve ``[[I, V1'u1], [V0'u0, I]] eta = [V1'd1; V0'd0]`` for every node.

        A node holds its two sides below each other: either both in one part, or
        (two-level partition) in parts ``2 node`` and ``2 node + 1``.
        """
        _check(vtu.rows == vtd.rows and vtu.parts == vtd.parts, "V'u and V'd differ in rows or parts")
        nodes = vtu.parts // 2 if vtu.levels == 2 else vtu.parts
        size, r = vtu.rows // nodes, vtu.cols
        _check(size == 2 * r, f"a node of rank {r} needs {2 * r} rows, not {size}")
        see_u, see_d, width = vtu._view(), vtd._view(), vtd.width

        def work(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            (node,) = (value.as_py() for value in group)
            table = table.sort_by("row0")
            u = np.concatenate([see_u(c) for c in _cells(table, names[1])])
            stored = _cells(table, names[0])
            d = np.concatenate([see_d(c) for c in stored])
            eta = solve(coupling(u[:r], u[r:]), np.concatenate([d[r:], d[:r]]), f"node {node}")
            out, at = [], 0
            for cell in stored:
                data = cell.reshape(-1, width).copy()
                see_d(data)[...] = eta[at : at + len(data)]
                out.append(data)
                at += len(data)
            keep = [table.column(c) for c in ("part", "row0", "nrow")]
            return pa.Table.from_arrays([*keep, _ragged(out)], ["part", "row0", "nrow", "data"])

        pairs, names = _paired(vtd, vtu)
        df = pairs.withColumn("node", F.expr(f"row0 div {size}")).groupBy("node").applyInArrow(work, SCHEMA)
        return replace(vtd, df=df)


def sum_arrays(df: DataFrame, key: str, value: str, alpha: float = 1.0) -> DataFrame:
    """``(key, value)``: ``alpha`` times the sum of each key's equally long arrays.

    Whole arrays are shuffled, a row each.  A key's arrays are first added in shares by the task they
    come from, so no task gets more of a key than the square root of all tasks.
    """
    shares = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
    kind = dict(df.dtypes)[key]

    def add(scale: float) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
        def work(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            total = scale * np.sum(dense_rows(table.column(value), table.num_rows), axis=0)
            return pa.Table.from_arrays([pa.array([group[0].as_py()], table.schema.field(key).type), list_column(total[None])], [key, value])

        return work

    schema = f"`{key}` {kind}, `{value}` array<double>"
    shared = df.withColumn("_share", F.spark_partition_id() % shares)
    return shared.groupBy(key, "_share").applyInArrow(add(1.0), schema).groupBy(key).applyInArrow(add(alpha), schema)


def _with_zeros(df: DataFrame, empty: Sequence[int], m: int, n: int) -> DataFrame:
    """Blocks with zero ones of ``m`` by ``n`` for parts that have no rows to sum."""
    if not len(empty):
        return df
    spark = df.sparkSession
    grid = spark.range(empty.start, empty.stop) if isinstance(empty, range) else spark.createDataFrame([(g,) for g in empty], "id long")
    part = F.col("id").alias("part")
    return df.unionByName(grid.select(part, (part * m).alias("row0"), F.lit(m).alias("nrow"), F.array_repeat(F.lit(0.0), m * n).alias("data")))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``A B`` over the inner indices both have: a shorter last part ends in zeros that are not stored."""
    k = min(a.shape[1], len(b))
    return a[:, :k] @ b[:k]


def node_sides(grams: RowBlocks, ranks: DataFrame, nrhs: int = 0) -> DataFrame:
    """The two sides of every node for ``node_solve_ragged``, out of full grams ``V' [d | u]``.

    ``grams`` is a two-level partition; ``ranks`` has a row ``(node, rank0, rank1)`` per node.  Side 0 owns the
    first ``rank0`` columns of u and v, side 1 the last ``rank1``.
    """
    _check(grams.levels == 2 and grams.whole_parts, "the grams of a node are two parts of one block each")
    see = grams._view()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, both = [], [batch.column(c).to_pylist() for c in ("rank0", "rank1")]
            rank, vtu, vtd = [], [], []
            for k, (p, cell) in enumerate(zip(batch.column("part").to_pylist(), _cells(batch, "data"))):
                g, r = see(cell), (both[0][k], both[1][k])
                s, full = p % 2, see(cell).shape[1] - nrhs
                _check(max(r) <= full, f"ranks {r} of node {p // 2} exceed {full}")
                columns = [slice(0, r[0]), slice(full - r[1], full)]
                part = g[columns[1 - s]]
                side.append(s)
                rank.append(r[s])
                vtd.append(part[:, :nrhs])
                vtu.append(part[:, nrhs:][:, columns[s]])
            columns = [batch.column("node"), pa.array(side, pa.int32()), pa.array(rank, pa.int32()), _ragged(vtu), _ragged(vtd)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "side", "rank", "vtu", "vtd"])

    paired = grams.df.withColumn("node", F.expr("part div 2")).join(ranks, "node")
    return paired.select("node", "part", "data", "rank0", "rank1").mapInArrow(
        cut, "node bigint, side int, rank int, vtu array<double>, vtd array<double>"
    )


def node_solve_ragged(sides: DataFrame, nrhs: int) -> DataFrame:
    """Node solves with a rank per side.

    ``sides`` is ``(node, side, rank, vtu, vtd)``: side s has its own rank, ``vtu``
    = V_s'u_s (other rank by own rank) and ``vtd`` = V_s'd_s (other rank by nrhs),
    row-major.  Returns ``(node, side, eta)`` where ``eta`` multiplies u of that side.
    """

    def work(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        r0, r1 = table.column("rank").to_pylist()
        vtu, vtd = _cells(table, "vtu"), _cells(table, "vtd")
        s = coupling(vtu[0].reshape(r1, r0), vtu[1].reshape(r0, r1))
        rhs = np.concatenate([vtd[1].reshape(r0, nrhs), vtd[0].reshape(r1, nrhs)])
        eta = solve(s, rhs, f"node {group[0].as_py()}")
        return pa.Table.from_arrays(
            [table.column("node"), table.column("side"), _ragged([eta[:r0], eta[r0:]])],
            ["node", "side", "eta"],
        )

    schema = "node bigint, side int, eta array<double>"
    return sides.select(
        F.col("node").cast("bigint"), F.col("side").cast("int"), F.col("rank").cast("int"), "vtu", "vtd"
    ).groupBy("node").applyInArrow(work, schema)


def _paired(*ms: RowBlocks, on: str = "row0") -> tuple[DataFrame, list[str]]:
    """Blocks of several matrices on one row, and the column of each; windows of one storage need no join."""
    first, names = ms[0], ["data"]
    df = first.df
    for k, m in enumerate(ms[1:]):
        same = next((n for n, other in zip(names, ms) if other.df is m.df), None)
        if same is None:
            if on == "row0":
                _check(m.block_rows == first.block_rows, "the matrices are cut into different blocks")
            same = f"data{k}"
            df = df.join(m.df.select(on, F.col("data").alias(same)), on)
        names.append(same)
    return df.select("part", "row0", "nrow", *dict.fromkeys(names)), names
