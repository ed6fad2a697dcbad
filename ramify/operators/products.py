"""Matrix products over whole rows, over square tiles of entries, and over sparse entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.operators.kernels import dense_rows, list_column, squeezed, unsqueezed
from ramify.session import BROADCAST_BYTES

#: Tile edge; a tile is at most 512 KiB dense.
TILE = 256
#: Copies of the other side a possibly hot key is split over.
SPREAD = 16
#: Result tiles a task adds up before handing them to the shuffle.
HELD_TILES = 64
#: Row blocks of a sparse product that the left factor has at least, where it has the rows, rows of the largest,
#: and ranges of the inner index that each is cut into, so that a crowded block takes several tasks.
ROW_BLOCKS = 16
ROW_BLOCK = 1024
INNER_RANGES = 4
#: Columns of the right factor in one list of entries.
LIST_COLUMNS = 1 << 16
#: Single products that a task holds before it adds up equal cells, and that it makes at once.
HELD_PRODUCTS = 1 << 22
MADE_PRODUCTS = 1 << 18
#: Bytes of lists that a task gathers before it packs them by row block and range.
PACK_BYTES = 32 << 20


def spread_keys(large: DataFrame, other: DataFrame, by: Column, ways: int = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Add a ``salt`` that splits each join key of ``large``; ``other`` is repeated for each."""
    large = large.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(ways)))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ways - 1).cast("bigint")))
    return large, other.withColumn("salt", copies)


def _tiles(entries: DataFrame, outer: str, inner: str, prefix: str) -> DataFrame:
    """Group entries by tile; a tile has at most ``TILE**2`` cells whatever the data.

    ``outer`` and ``inner`` name the index that stays and the one summed over.
    """
    cell = F.struct(
        F.expr(f"cast(i % {TILE} * {TILE} + j % {TILE} as int)").alias("at"), F.col("v").alias("v")
    )
    grouped = entries.groupBy(
        F.expr(f"{outer} div {TILE}").alias(f"b{outer}"), F.expr(f"{inner} div {TILE}").alias("bk")
    ).agg(F.collect_list(cell).alias("cells"))
    return grouped.select(
        f"b{outer}", "bk", F.col("cells.at").alias(f"{prefix}_at"), F.col("cells.v").alias(f"{prefix}_v")
    )


def _dense(at: pa.ListArray, values: pa.ListArray) -> Iterator[np.ndarray]:
    starts = at.offsets.to_numpy()
    cells, v = at.values.to_numpy(), values.values.to_numpy()
    for lo, hi in zip(starts[:-1], starts[1:]):
        tile = np.zeros(TILE * TILE)
        tile[cells[lo:hi]] = v[lo:hi]
        yield tile.reshape(TILE, TILE)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiply joined tile pairs, add up results per output tile, emit their non-zero rows."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (bi, bj), tile in held.items():
            rows = np.flatnonzero(tile.any(axis=1))
            width = np.flatnonzero(tile.any(axis=0))[-1:].sum() + 1
            columns = [
                pa.array(bi * TILE + rows),
                pa.array(np.full(len(rows), bj, np.int64)),
                list_column(tile[rows, :width]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["i", "bj", "run"])
        held.clear()

    for batch in batches:
        left = _dense(batch.column("a_at"), batch.column("a_v"))
        right = _dense(batch.column("b_at"), batch.column("b_v"))
        rows, cols = batch.column("bi").to_pylist(), batch.column("bj").to_pylist()
        for at, a, b in zip(zip(rows, cols), left, right):
            if at not in held and len(held) >= HELD_TILES:
                yield from emit()
            held[at] = held.get(at, 0.0) + a @ b
    yield from emit()


def multiply_tiles(a, b) -> DataFrame:
    """Entries of ``a @ b``.

    Tiles meet on the inner index.  A small factor (its size follows from its shape)
    is broadcast; otherwise the inner tile is split over several keys, as a tall
    factor may have only a few inner tiles.  Results are added inside the task first
    and cross the shuffle as runs of up to ``TILE`` numbers, summed behind it.
    """
    left = _tiles(a.df, "i", "j", "a")
    right = _tiles(b.df, "j", "i", "b")
    if b.rows * b.cols * 12 <= BROADCAST_BYTES:
        pairs = left.join(F.broadcast(right), "bk")
    elif a.rows * a.cols * 12 <= BROADCAST_BYTES:
        pairs = right.join(F.broadcast(left), "bk")
    else:
        # An inner tile meets at most one left tile per row tile.
        left, right = spread_keys(left, right, F.col("bi"), min(SPREAD, -(-a.rows // TILE)))
        pairs = left.join(right, ["bk", "salt"])
    pairs = pairs.select("bi", "bj", "a_at", "a_v", "b_at", "b_v")
    runs = pairs.mapInArrow(_multiply, "i bigint, bj bigint, run array<double>").repartition("i", "bj")
    cells = runs.select("i", "bj", F.posexplode("run").alias("k", "v")).where("v != 0")
    sums = cells.groupBy("i", "bj", "k").agg(F.sum("v").alias("v"))
    return sums.select("i", F.expr(f"bj * {TILE} + k").alias("j"), "v")


def _lists(entries: DataFrame, keys: list[str], at: str, prefix: str) -> DataFrame:
    """Entries with the same keys as two lists: where they are, and their values."""
    cells = F.collect_list(F.struct(F.expr(at).cast("int").alias("at"), F.col("v").alias("v")))
    grouped = entries.groupBy(*keys).agg(cells.alias("cells"))
    return grouped.select(*keys, F.col("cells.at").alias(f"{prefix}_at"), F.col("cells.v").alias(f"{prefix}_v"))


def _cell_sums(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct cells and the sum of each one's values; by counting where the cells lie close together."""
    first, width = cols.min(), int(cols.max() - cols.min()) + 1
    key = rows * width + (cols - first)
    if (int(rows.max()) + 1) * width <= 2 * len(key):
        sums, seen = np.bincount(key, values), np.zeros(int(key.max()) + 1, bool)
        seen[key] = True
        key = np.flatnonzero(seen)
        sums = sums[key]
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, sums = key[at], np.add.reduceat(values[order], at)
    return key // width, key % width + first, sums


def _by_inner(m, inner: str) -> DataFrame:
    """Entries (i, j, v) dealt by one index; a matrix and its transpose share the shuffle, so it comes before their own columns."""
    if m.source is None:
        return m.df.repartition(inner)
    cells, i, j = m.source
    cells = cells.repartition({"i": i, "j": j}[inner])
    return cells.select(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined lists (bi, range, bj, a_at, a_v, b_at, b_v) with equal row block and range, packed together."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(np.lexsort([table.column(c).to_numpy() for c in ("range", "bi")]))
        bi, ranges, bj = (table.column(c).to_numpy() for c in ("bi", "range", "bj"))
        lists = [table.column(c).combine_chunks() for c in ("a_at", "b_at", "a_v", "b_v")]
        (a_ends, a_at), (b_ends, b_at), (_, a_v), (_, b_v) = ((x.offsets.to_numpy(), x.values.to_numpy()) for x in lists)
        first = np.flatnonzero(np.concatenate([[True], (bi[1:] != bi[:-1]) | (ranges[1:] != ranges[:-1])]))
        packs = []
        for lo, hi in zip(first, np.append(first[1:], len(bi)), strict=True):
            of_a, of_b = slice(a_ends[lo], a_ends[hi]), slice(b_ends[lo], b_ends[hi])
            whole = np.concatenate([bj[lo:hi], np.diff(a_ends[lo : hi + 1]), np.diff(b_ends[lo : hi + 1]), a_at[of_a], b_at[of_b]])
            packs.append(np.int64([hi - lo, len(whole)]).tobytes() + squeezed(whole) + squeezed(np.concatenate([a_v[of_a], b_v[of_b]])))
        return pa.RecordBatch.from_arrays([pa.array(bi[first]), pa.array(ranges[first]), pa.array(packs, pa.binary())], ["bi", "range", "pack"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.get_total_buffer_size()
        if size > PACK_BYTES:
            yield emit(held)
            held, size = [], 0
    if held:
        yield emit(held)


def _unpack_pairs(packed: pa.Buffer) -> tuple[np.ndarray, ...]:
    """bj, ends of the lists of both sides, and what is in them: a_at, a_v, b_at, b_v."""
    n, total = (int(x) for x in np.frombuffer(packed, np.int64, 2))
    whole, values = unsqueezed(packed.slice(16), 2)
    bj, a_n, b_n, at = np.split(whole.view(np.int64)[:total], [n, 2 * n, 3 * n])
    a_ends, b_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (a_n, b_n))
    values = values.view(np.float64)
    return bj, a_ends, b_ends, at[: a_ends[-1]], values[: a_ends[-1]], at[a_ends[-1] :], values[a_ends[-1] :]


def multiply_entries(a, b) -> DataFrame:
    """Entries of ``a @ b`` for two sparse matrices: only pairs of stored entries are multiplied.

    A row block of ``a`` meets the rows of ``b`` as lists per inner index.  The pairs are dealt by row block and
    range of the inner index, packed, and a task adds up its blocks' cells before they are shuffled as rows.
    """
    block, inner = min(ROW_BLOCK, -(-a.rows // ROW_BLOCKS)), -(-a.cols // INNER_RANGES)
    left = _by_inner(a, "j").select(F.expr(f"i div {block}").alias("bi"), F.col("j").alias("k"), "i", "v")
    right = _by_inner(b, "i").select(F.col("i").alias("k"), F.expr(f"j div {LIST_COLUMNS}").alias("bj"), "j", "v")
    pairs = _lists(left, ["bi", "k"], f"i % {block}", "a").join(_lists(right, ["k", "bj"], f"j % {LIST_COLUMNS}", "b"), "k")
    pairs = pairs.select("bi", F.expr(f"k div {inner}").alias("range"), "bj", "a_at", "a_v", "b_at", "b_v")
    pairs = pairs.mapInArrow(_pack_pairs, "bi bigint, range bigint, pack binary")
    pairs = pairs.repartition("bi", "range").sortWithinPartitions("bi", "range")
    kind = pa.int32() if b.cols < 1 << 31 else pa.int64()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, count = 0, 0

        def emit() -> pa.RecordBatch:
            rows, cols, sums = _cell_sums(*map(np.concatenate, zip(*held)))
            held.clear()
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            ends = pa.array(np.append(first, len(rows)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(cols, kind), pa.array(sums))]
            return pa.RecordBatch.from_arrays([pa.array(at * block + rows[first]), *lists], ["i", "j", "v"])

        for batch in batches:
            for bi, packed in zip(batch.column("bi").to_pylist(), batch.column("pack")):
                if held and bi != at:
                    yield emit()
                    count = 0
                at = bi
                bj, a_ends, b_ends, a_at, a_v, b_at, b_v = _unpack_pairs(packed.as_buffer())
                first = bj * LIST_COLUMNS
                # a step for each entry of the left lists, which is multiplied by the whole right list of its pair
                pair = np.repeat(np.arange(len(bj)), np.diff(a_ends))
                sizes = np.diff(b_ends)[pair]
                cuts = np.unique([0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // MADE_PRODUCTS)) + 1), len(pair)])
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    own, n = pair[lo:hi], sizes[lo:hi]
                    ends = np.cumsum(n)
                    found = np.arange(ends[-1]) + np.repeat(b_ends[own] - (ends - n), n)
                    cols = b_at[found] + np.repeat(first[own], n)
                    held.append((np.repeat(a_at[lo:hi], n), cols, np.repeat(a_v[lo:hi], n) * b_v[found]))
                    count += len(found)
                    if count > HELD_PRODUCTS:
                        held[:] = [_cell_sums(*map(np.concatenate, zip(*held)))]
                        count = len(held[0][0])
                        if count > HELD_PRODUCTS // 2:
                            yield emit()
                            count = 0
        if held:
            yield emit()

    rows = pairs.mapInArrow(multiply, f"i bigint, j array<{'int' if kind == pa.int32() else 'bigint'}>, v array<double>").repartition("i")
    cells = rows.select("i", F.explode(F.arrays_zip("j", "v")).alias("cell"))
    return cells.groupBy("i", F.col("cell.j").cast("bigint").alias("j")).agg(F.sum("cell.v").alias("v"))


def multiply_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries of ``L' R`` for two frames ``(i, row array)`` joined on ``i``.

    The result has only (row length of L) x (row length of R) cells, so every task
    keeps one running sum over its rows and hands out that alone.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n = batch.num_rows
            if n:
                product = dense_rows(batch.column("a"), n).T @ dense_rows(batch.column("b"), n)
                total = product if total is None else total + product
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"]
            )

    if left is right:
        pairs = left.select(F.col("row").alias("a"), F.col("row").alias("b"))
    else:
        pairs = left.withColumnRenamed("row", "a").join(right.withColumnRenamed("row", "b"), "i").select("a", "b")
    products = pairs.mapInArrow(partial, "i bigint, j bigint, v double")
    return products.groupBy("i", "j").agg(F.sum("v").alias("v"))
