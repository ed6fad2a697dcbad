"""The solver's stages: solve the parts, merge the tree, push coefficients down.

Only the first stage and the last one touch the N rows.  Every update above the
parts multiplies ``[d | u]`` from the right by a small matrix, so the tree works
on the r-by-(r + nrhs) grams ``V' [d | u]`` alone and the rows get one final
``x = d - u c`` with the coefficients of their part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ramify.functions.algebra import dot
from ramify.operators.kernels import dense_rows, list_column, solve_part, sweep
from ramify.session import BROADCAST_BYTES, RunFolder

#: Tree levels merged per shuffle; a node then gathers at most 2**FAN_IN grams,
#: fewer where the rank makes them large.
FAN_IN = 6
NODE_BYTES = 64 << 20
#: A part's input stays near this size; a task holds several copies of it.
PART_BYTES = 8 << 20


@dataclass(frozen=True)
class Layout:
    """Tree position of a row as expressions: its part, its place there, its leaf size."""

    part: Column
    pos: Column
    leaf: Column


def default_part_rows(leaf: int, width: int) -> int:
    return leaf * max(1, PART_BYTES // (8 * width * leaf))


@dataclass
class Parts:
    """Rows ``[d | u]`` solved inside their part, and one gram per part."""

    rows: DataFrame
    grams: DataFrame
    rank: int
    gram_rows: int
    nrhs: int
    groups: int
    seqs: int
    keys: list[str]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Re-cut a stream of batches into tables of ``rows`` rows (the last may be shorter)."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        while count >= rows:
            table = pa.concat_tables(held)
            yield table.slice(0, rows)
            held, count = [table.slice(rows)], count - rows
    if count:
        yield pa.concat_tables(held)


def _solved(table: pa.Table, grp: int, seq: int, leaf: int, keys: list[str], names: list[str]):
    """Solve one part; its gram sits on the part's first row and is null elsewhere."""
    n = table.num_rows
    u, v, d, b = (dense_rows(table.column(c), n) for c in ("u", "v", "d", "b"))
    nrhs = b.shape[1]
    w, gram = solve_part(u, v, d[:, 0], b, leaf, f"part ({grp}, {seq})")
    offsets = np.zeros(n + 1, np.int32)
    offsets[1:] = gram.size
    mask = np.ones(n + 1, bool)
    mask[0] = mask[n] = False
    g = pa.ListArray.from_arrays(pa.array(offsets, mask=mask), pa.array(gram.ravel()))
    if n == 1:
        g = list_column(gram.reshape(1, -1))
    columns = [table.column(k).combine_chunks() for k in keys] + [
        pa.array(np.full(n, grp, np.int64)),
        pa.array(np.full(n, seq, np.int64)),
        list_column(w[:, :nrhs]),
        list_column(w[:, nrhs:]),
        g,
    ]
    return pa.Table.from_arrays(columns, names)


def solve_parts(
    rows: DataFrame,
    keys: list[str],
    rank: int,
    gram_rows: int,
    nrhs: int,
    leaf: int,
    folder: RunFolder,
    name: str,
    part_rows: int | None = None,
    layout: Layout | None = None,
) -> Parts:
    """Solve each part's diagonal block against ``[b | u]``.

    Without ``layout`` the parts follow the input's own partitions, so the N rows
    are not shuffled.  With it rows are grouped by part; a part above ``part_rows``
    rows is cut further by position, which is exact because any cut of the rows
    gives the same solution.
    """
    key_fields = [rows.schema[k] for k in keys]
    carried = sum(rank if f.dataType.typeName() == "array" else 1 for f in key_fields)
    part_rows = part_rows or default_part_rows(leaf, rank + gram_rows + nrhs + 1 + carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    schema += ", grp bigint, seq bigint, d array<double>, u array<double>, g array<double>"
    names = [*keys, "grp", "seq", "d", "u", "g"]
    inputs = [F.col(k) for k in keys] + [F.col(c) for c in ("u", "v", "d", "b")]

    if layout is None:

        def by_input(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grp = TaskContext.get().partitionId()
            for seq, table in enumerate(_chunks(batches, part_rows)):
                yield from _solved(table, grp, seq, leaf, keys, names).to_batches()

        solved = rows.select(*inputs).mapInArrow(by_input, schema)
    else:
        grouped = rows.select(
            *inputs,
            layout.part.cast("bigint").alias("_grp"),
            F.floor(layout.pos / part_rows).alias("_cut"),
            layout.pos.cast("bigint").alias("_pos"),
            layout.leaf.cast("bigint").alias("_leaf"),
        )

        def by_position(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            grp, cut = (value.as_py() for value in group)
            table = table.sort_by("_pos")
            own_leaf = table.column("_leaf")[0].as_py()
            return _solved(table, grp, cut, own_leaf, keys, names)

        solved = grouped.groupBy("_grp", "_cut").applyInArrow(by_position, schema)

    seen = Observation()
    solved = solved.observe(seen, F.max("grp").alias("grp"), F.max("seq").alias("seq"))
    solved = folder.cut(solved, name)
    top = seen.get
    if top["grp"] is None:
        raise ValueError("the system has no rows")
    grams = solved.where("g is not null").select("grp", "seq", "g")
    return Parts(solved, grams, rank, gram_rows, nrhs, top["grp"] + 1, top["seq"] + 1, keys)


def merge_tree(parts: Parts, folder: RunFolder, name: str, keep_root: bool = False) -> list[DataFrame]:
    """Merge grams up to the root, several levels per shuffle.

    Returns one frame per shuffle, bottom first: ``(id, node, x, g)`` with the
    child's coefficients relative to its node and, on one row per node, the node's
    gram.  All but the last are written out, since both directions read them; the
    last is lazy unless the caller needs the root gram too.
    """
    r, m, q = parts.rank, parts.gram_rows, parts.rank + parts.nrhs
    seq_bits = (parts.seqs - 1).bit_length()
    bits = (parts.groups - 1).bit_length() + seq_bits
    nodes = parts.grams.select(
        F.expr(f"shiftleft(grp, {seq_bits}) | seq").alias("id"), "g"
    )
    levels = min(FAN_IN, max(1, (NODE_BYTES // (8 * m * q)).bit_length() - 1))
    stages = []
    while bits > 0 or (keep_root and not stages):
        step = min(levels, bits)

        def merge(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            (node,) = (value.as_py() for value in group)
            table = table.sort_by("id")
            n = table.num_rows
            grams = dense_rows(table.column("g"), n).reshape(n, m, q)
            gram, x = sweep(grams, q - r, f"node {node}")
            first = pa.array([gram.ravel().tolist()] + [None] * (n - 1), pa.list_(pa.float64()))
            return pa.Table.from_arrays(
                [
                    table.column("id").combine_chunks(),
                    pa.array(np.full(n, node, np.int64)),
                    list_column(x.reshape(n, -1)),
                    first,
                ],
                ["id", "node", "x", "g"],
            )

        stage = (
            nodes.withColumn("node", F.shiftright("id", step))
            .groupBy("node")
            .applyInArrow(merge, "id bigint, node bigint, x array<double>, g array<double>")
        )
        bits -= step
        if bits > 0 or keep_root:
            stage = folder.cut(stage, f"{name}-{len(stages)}")
        stages.append(stage)
        nodes = stage.where("g is not null").select(F.col("node").alias("id"), "g")
    return stages


def push_down(stages: list[DataFrame], parts: Parts, root: DataFrame | None = None) -> DataFrame | None:
    """Coefficients ``c`` of each part, root first: nrhs runs of rank numbers.

    ``root`` optionally gives the root's own coefficients as ``(node, c)`` with
    node 0; without it they are zero and a one-part tree needs none (``None``).
    """
    r, nrhs = parts.rank, parts.nrhs
    q = r + nrhs

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = dense_rows(batch.column("x"), n).reshape(n, r, q)
            c = x[:, :, :nrhs]
            if "c" in batch.schema.names:
                above = np.swapaxes(dense_rows(batch.column("c"), n).reshape(n, nrhs, r), 1, 2)
                c = c + above - x[:, :, nrhs:] @ above
            c = np.swapaxes(c, 1, 2).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_column(c)], ["node", "c"])

    above = root
    for stage in reversed(stages):
        stage = stage.select("id", "node", "x")
        if above is not None:
            stage = stage.join(above, "node").select("id", "x", "c")
        above = stage.mapInArrow(own, "node bigint, c array<double>")
    return above


def apply_coefficients(parts: Parts, coefficients: DataFrame | None) -> DataFrame:
    """``x = d - u c`` on every row, as an array with one value per right-hand side.

    The coefficients are broadcast while parts times rank stays below the limit;
    beyond it the rows are shuffled once by part, each part being bounded.
    """
    keys = parts.keys
    if coefficients is None:
        return parts.rows.select(*keys, F.col("d").alias("x"))
    seq_bits = (parts.seqs - 1).bit_length()
    rows = parts.rows.select(
        *keys, "d", "u", F.expr(f"shiftleft(grp, {seq_bits}) | seq").alias("node")
    )
    nrhs = parts.nrhs
    bound = parts.groups * parts.seqs * 8 * (parts.rank * nrhs + 2)
    if bound <= BROADCAST_BYTES:
        coefficients = F.broadcast(coefficients)
    per_rhs = [
        F.slice("c", k * parts.rank + 1, parts.rank) if nrhs > 1 else F.col("c") for k in range(nrhs)
    ]
    x = F.array(*[F.col("d")[k] - dot(F.col("u"), c, parts.rank) for k, c in enumerate(per_rhs)])
    return rows.join(coefficients, "node").select(*keys, x.alias("x"))
