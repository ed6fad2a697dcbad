"""Factor once, solve many right-hand sides.

``Factorization`` keeps what a solve of ``(U V' + diag(D)) x = b`` makes out of the matrix alone:

* one row per leaf: its rows' keys, the LU factors and pivots of its dense block ``K``, ``u = K^-1 U`` and
  ``s = K^-T V`` (leaves are factored and solved many at once).  Factors that took no row exchanges are kept as
  generators, 4 r + 1 numbers a row instead of one per row of the leaf, where these give them back to the last digits;
* one row per inner node of the tree (which merges up to ``2**FAN_IN`` children): the LU factors of its
  coupling systems with the grams and solutions that they go with.

A right-hand side then needs no U, V, D and no factorization.  ``V'd`` of a leaf is ``s'b``, so the
first pass over the leaves reads ``s`` only and ends in a small array per leaf; the nodes turn these into
coefficients, up and down the tree; and one last pass gives ``x = K^-1 b - u c`` row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ramify.operators.kernels import (
    dense_rows,
    factor_sweep,
    list_column,
    low_rank_block,
    lu_expanded,
    lu_factor,
    lu_generators,
    lu_solve,
    replay_sweep,
    solve,
)
from ramify.plans.tree import FAN_IN, NODE_BYTES, Layout, _chunks
from ramify.session import BROADCAST_BYTES, RunFolder

#: Row groups of the leaf table stay small, so that a scan of it is dealt over many tasks.
LEAF_GROUP_BYTES = 16 << 20
#: Leaves are worked on in stacks whose dense blocks take about this many bytes.
STACK_BYTES = 4 << 20
_STEPS = ("lu", "perm", "g0", "g1", "eta")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    return column.offsets.to_numpy(), column.values.to_numpy()


def _stacks(sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Neighbouring leaves of equal size as ``(size, first, end)``, bounded by the bytes of their blocks."""
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        n = int(sizes[lo]) if hi > lo else 1
        step = max(1, STACK_BYTES // (8 * n * n))
        yield from ((n, at, min(at + step, hi)) for at in range(lo, hi, step))


def _kept_factors(u: np.ndarray, v: np.ndarray, d: np.ndarray, lu: np.ndarray, order: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The factors of a stack of leaves as list columns: generators and no row order where these do, else both as they are."""
    m, n, r = u.shape
    kept, good = lu_generators(u, v, d, lu, order) if 4 * r + 1 < n else (lu, np.zeros(m, bool))
    ends = lambda full: pa.array(np.concatenate([[0], np.cumsum(full)]), pa.int32())
    parts = [kept[k] if good[k] else lu[k] for k in range(m)]
    values = kept if good.all() else np.concatenate([x.ravel() for x in parts])
    factors = pa.ListArray.from_arrays(ends([x.size for x in parts]), pa.array(values.ravel()))
    return factors, pa.ListArray.from_arrays(ends(np.where(good, 0, n)), pa.array(order[~good].astype(np.int32).ravel()))


def _factors(lu: tuple[np.ndarray, np.ndarray], perm: tuple[np.ndarray, np.ndarray], n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``_kept_factors`` was given for the leaves ``lo`` to ``hi``, which have ``n`` rows."""
    (lu_at, lu_values), (perm_at, perm_values) = lu, perm
    out, order = np.empty((hi - lo, n, n)), np.tile(np.arange(n), (hi - lo, 1))
    dense = np.diff(perm_at[lo : hi + 1]) > 0
    for these, give in ((dense, lambda x: x.reshape(-1, n, n)), (~dense, lambda x: lu_expanded(x.reshape(len(x), -1, n)))):
        if these.any():
            at = lo + np.flatnonzero(these)
            size = lu_at[at[0] + 1] - lu_at[at[0]]
            out[these] = give(lu_values[lu_at[at][:, None] + np.arange(size)])
    order[dense] = perm_values[perm_at[lo] : perm_at[hi]].reshape(-1, n)
    return out, order


class Factorization:
    """Stored factors of a ``Hodlr`` system; make one with ``Hodlr.factor``.

    Keys may repeat where right-hand sides are columns kept with the factors; a frame needs unique ones.
    """

    def __init__(self, system: DataFrame, keys: Sequence[str], rank: int, leaf: int, keep: Sequence[str] = (), layout: Layout | None = None):
        if leaf <= rank:
            raise ValueError(f"leaf size {leaf} must exceed the rank {rank}")
        self.keys, self.keep, self.rank = list(keys), list(keep), rank
        self.folder = RunFolder(system.sparkSession)
        self._system = system.select(*self.keys)
        self._factor_leaves(system, leaf, layout)
        self._factor_nodes()

    def clear(self) -> None:
        """Delete the stored factors."""
        self.folder.release()

    # -- factors -------------------------------------------------------------

    def _factor_leaves(self, system: DataFrame, leaf: int, layout: Layout | None) -> None:
        carried = [*self.keys, *self.keep]
        names = [f"_c{k}" for k in range(len(carried))]
        inputs = [*[F.col(c).alias(n) for c, n in zip(carried, names, strict=True)], "u", "v", "d"]
        fields = ", ".join(f"{n}: {system.schema[c].dataType.simpleString()}" for c, n in zip(carried, names, strict=True))
        schema = f"grp bigint, seq bigint, n int, rows array<struct<{fields}>>, lu array<double>, perm array<int>, u array<double>, s array<double>, g array<double>"

        def stack(table: pa.Table, grp: int, seq: int, n: int) -> pa.Table:
            """The factors of neighbouring leaves of ``n`` rows each."""
            m = table.num_rows // n
            u, v, d = (dense_rows(table.column(c), m * n).reshape(m, n, -1) for c in ("u", "v", "d"))
            k = low_rank_block(u, v, d[:, :, 0])
            try:
                lu, perm = lu_factor(k, f"leaf ({grp}, {seq})")
            except ValueError:
                for at in range(m if m > 1 else 0):
                    lu_factor(k[at : at + 1], f"leaf ({grp}, {seq + at})")
                raise
            solved = lu_solve(lu, perm, u)
            s = solve(np.swapaxes(k, 1, 2), v, f"leaf ({grp}, {seq})")
            rows = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in names], names=names)
            ends = pa.array(np.arange(0, (m + 1) * n, n, dtype=np.int32))
            return pa.Table.from_arrays(
                [
                    pa.array(np.full(m, grp, np.int64)),
                    pa.array(np.arange(seq, seq + m, dtype=np.int64)),
                    pa.array(np.full(m, n, np.int32)),
                    pa.ListArray.from_arrays(ends, rows),
                    *_kept_factors(u, v, d[:, :, 0], lu, perm),
                    *(list_column(x.reshape(m, -1)) for x in (solved, s)),
                    list_column((np.swapaxes(v, 1, 2) @ solved).reshape(m, -1)),
                ],
                ["grp", "seq", "n", "rows", "lu", "perm", "u", "s", "g"],
            )

        many = max(1, STACK_BYTES // (8 * leaf * leaf))

        if layout is None:

            def by_input(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                grp = TaskContext.get().partitionId()
                for k, table in enumerate(_chunks(batches, leaf * many)):
                    whole, seq = table.num_rows // leaf, k * many
                    if whole:
                        yield from stack(table.slice(0, whole * leaf), grp, seq, leaf).to_batches()
                    if table.num_rows > whole * leaf:
                        rest = table.slice(whole * leaf)
                        yield from stack(rest, grp, seq + whole, rest.num_rows).to_batches()

            leaves = system.select(*inputs).mapInArrow(by_input, schema)
        else:
            placed = system.select(
                *inputs,
                layout.part.cast("bigint").alias("_grp"),
                F.floor(layout.pos / layout.leaf).alias("_cut"),
                layout.pos.cast("bigint").alias("_pos"),
            )

            def by_position(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
                return stack(table.sort_by("_pos"), *(value.as_py() for value in group), table.num_rows)

            leaves = placed.groupBy("_grp", "_cut").applyInArrow(by_position, schema)

        seen = Observation()
        leaves = leaves.observe(seen, F.max("grp").alias("grp"), F.max("seq").alias("seq"), F.count("*").alias("n"))
        target = f"{self.folder.path}/leaves"
        leaves.write.option("parquet.block.size", LEAF_GROUP_BYTES).option("compression", "zstd").parquet(target)
        top = seen.get
        if top["grp"] is None:
            raise ValueError("the system has no rows")
        seq_bits = int(top["seq"]).bit_length()
        self.bits, self.count = int(top["grp"]).bit_length() + seq_bits, top["n"]
        stored = leaves.sparkSession.read.schema(schema).parquet(target)
        self.leaves = stored.withColumn("id", F.expr(f"shiftleft(grp, {seq_bits}) | seq"))

    def _factor_nodes(self) -> None:
        """One table per shuffle, bottom first: a row per node with its children and their merge steps."""
        r, bits, self.stages = self.rank, self.bits, []
        levels = min(FAN_IN, max(1, (NODE_BYTES // (8 * 8 * r * r)).bit_length() - 1))
        nodes = self.leaves.select("id", "g")
        parts = ", ".join(f"{c} array<array<double>>" for c in _STEPS)

        def merge(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            (node,) = (value.as_py() for value in group)
            table = table.sort_by("id")
            steps, gram = factor_sweep(dense_rows(table.column("g"), table.num_rows).reshape(-1, r, r), f"node {node}")
            kind = pa.list_(pa.list_(pa.float64()))
            ids = pa.array([table.column("id").to_pylist()], pa.list_(pa.int64()))
            columns = [pa.array([[step[i].ravel().astype(np.float64) for step in steps]], kind) for i in range(len(_STEPS))]
            return pa.Table.from_arrays([pa.array([node], pa.int64()), ids, *columns, list_column(gram.reshape(1, -1))], ["node", "ids", *_STEPS, "g"])

        while bits > 0:
            step = min(levels, bits)
            stage = nodes.withColumn("node", F.shiftright("id", step)).groupBy("node")
            stage = stage.applyInArrow(merge, f"node bigint, ids array<bigint>, {parts}, g array<double>")
            stage = self.folder.cut(stage, f"nodes-{len(self.stages)}")
            self.stages.append((step, stage))
            nodes, bits = stage.select(F.col("node").alias("id"), "g"), bits - step

    # -- right-hand sides ----------------------------------------------------

    def solve(self, b: DataFrame | Sequence[str] | str) -> DataFrame:
        """The keys and ``x``, an array with one value per right-hand side.

        ``b`` names columns that were kept with the factors (numbers), or is a frame of unique keys with one
        column per right-hand side, whose absent rows and nulls are zero.
        """
        if isinstance(b, DataFrame):
            leaves, nrhs = self._with_frame(b), len(b.columns) - len(self.keys)
        else:
            names = [b] if isinstance(b, str) else list(b)
            at = [f"_c{len(self.keys) + self.keep.index(c)}" for c in names]
            values = lambda row: F.array(*[F.coalesce(row[c].cast("double"), F.lit(0.0)) for c in at])
            leaves, nrhs = self.leaves.withColumn("b", F.flatten(F.transform("rows", values))), len(at)
        coefficients = self._down(self._up(leaves, nrhs), nrhs)
        return self._applied(leaves, coefficients, nrhs)

    def _with_frame(self, b: DataFrame) -> DataFrame:
        """The leaves with ``b``: their rows' values, found by key; only keys and numbers move."""
        if not b.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("the right-hand side has several rows for one key")
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in b.columns if c not in self.keys])
        nrhs = len(b.columns) - len(self.keys)
        places = self.leaves.select("id", F.posexplode("rows").alias("pos", "row"))
        places = places.select("id", "pos", *[F.col("row")[f"_c{k}"].alias(c) for k, c in enumerate(self.keys)])
        if not b.join(places, self.keys, "left_anti").isEmpty():
            raise ValueError("the right-hand side has keys that the system lacks")
        found = places.join(b.select(*self.keys, values.alias("b")), self.keys, "left")
        found = found.select("id", "pos", F.coalesce("b", F.array_repeat(F.lit(0.0), nrhs)).alias("b"))
        # a leaf's rows are bounded, so its list is
        lists = found.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda e: e["b"])).alias("b"))
        return self.leaves.join(lists, "id")

    def _up(self, leaves: DataFrame, nrhs: int) -> list[DataFrame]:
        """Per stage ``(id, node, y)``: each child's coefficients relative to its node."""
        r = self.rank

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (s_at, s), (b_at, b) = _flat(batch.column("s")), _flat(batch.column("b"))
                out = np.zeros((batch.num_rows, r * nrhs))
                for n, lo, hi in _stacks(batch.column("n").to_numpy()):
                    left = s[s_at[lo] : s_at[hi]].reshape(-1, n, r)
                    out[lo:hi] = (np.swapaxes(left, 1, 2) @ b[b_at[lo] : b_at[hi]].reshape(-1, n, nrhs)).reshape(hi - lo, -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), list_column(out)], ["id", "y"])

        def replay(group: tuple[pa.Scalar, ...], given: pa.Table, table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            steps, left = [], table.num_rows
            for lu, perm, g0, g1, eta in zip(*(given.column(c)[0].as_py() for c in _STEPS), strict=True):
                half = left // 2
                shape = lambda x, a, c: np.array(x).reshape(half, a, c)  # noqa: B023, E731
                order = np.array(perm).astype(np.int64).reshape(half, 2 * r)
                steps.append((shape(lu, 2 * r, 2 * r), order, shape(g0, r, r), shape(g1, r, r), shape(eta, 2 * r, r)))
                left = half + left % 2
            merged, x = replay_sweep(steps, dense_rows(table.column("y"), table.num_rows).reshape(-1, r, nrhs))
            n = len(x)
            top = pa.array([merged.ravel().tolist()] + [None] * (n - 1), pa.list_(pa.float64()))
            node = pa.array(np.full(n, group[0].as_py(), np.int64))
            return pa.Table.from_arrays([table.column("id").combine_chunks(), node, list_column(x.reshape(n, -1)), top], ["id", "node", "y", "top"])

        below = leaves.select("id", "n", "s", "b").mapInArrow(sums, "id bigint, y array<double>")
        out: list[DataFrame] = []
        for step, factors in self.stages:
            below = below.withColumn("node", F.shiftright("id", step))
            merged = factors.groupBy("node").cogroup(below.groupBy("node"))
            stage = merged.applyInArrow(replay, "id bigint, node bigint, y array<double>, top array<double>")
            if len(out) + 1 < len(self.stages):
                stage = self.folder.cut(stage, f"y-{id(leaves)}-{len(out)}")
            out.append(stage.select("id", "node", "y"))
            below = stage.where("top is not null").select(F.col("node").alias("id"), F.col("top").alias("y"))
        return out

    def _down(self, stages: list[DataFrame], nrhs: int) -> DataFrame | None:
        """``(id, c)`` of every leaf, root first."""
        r, above = self.rank, None
        for (step, factors), stage in zip(reversed(self.stages), reversed(stages), strict=True):
            if above is None:
                above = stage.select("id", F.col("y").alias("c"))
                continue
            # a child's own share, and its node's as the child's u passes it on
            children = stage.join(above.select(F.col("id").alias("node"), "c"), "node")

            def passed(group: tuple[pa.Scalar, ...], given: pa.Table, table: pa.Table) -> pa.Table:
                table = table.sort_by("id")
                n = table.num_rows
                y, c = (dense_rows(table.column(x), n).reshape(n, r, nrhs) for x in ("y", "c"))
                steps, left = [], n
                for (eta,) in zip(given.column("eta")[0].as_py(), strict=True):
                    steps.append(np.array(eta).reshape(left // 2, 2 * r, r))
                    left = left // 2 + left % 2
                own = c[:1]
                for eta in reversed(steps):
                    parent = own[: len(eta)]
                    both = [parent - eta[:, s] @ parent for s in (slice(0, r), slice(r, 2 * r))]
                    own = np.concatenate([np.stack(both, axis=1).reshape(-1, r, nrhs), own[len(eta) :]])
                return pa.Table.from_arrays([table.column("id").combine_chunks(), list_column((y + own).reshape(n, -1))], ["id", "c"])

            above = factors.select("node", "eta").groupBy("node").cogroup(children.groupBy("node")).applyInArrow(passed, "id bigint, c array<double>")
        return above

    def _applied(self, leaves: DataFrame, coefficients: DataFrame | None, nrhs: int) -> DataFrame:
        """``x = K^-1 b - u c``; the factors stay where they are stored, also where coefficients come by shuffle."""
        r, names = self.rank, [f"_c{k}" for k in range(len(self.keys))]
        kinds = [self._system.schema[k].dataType.simpleString() for k in self.keys]
        fields = ", ".join(f"{n}: {kind}" for n, kind in zip(names, kinds, strict=True))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """``y = K^-1 b`` of each leaf."""
            for batch in batches:
                lu, perm, (b_at, b) = (_flat(batch.column(c)) for c in ("lu", "perm", "b"))
                kept = [batch.column(c) for c in ("id", "n", "rows", "u")]
                y = np.empty(len(b) if batch.num_rows else 0)
                for n, lo, hi in _stacks(batch.column("n").to_numpy()):
                    if hi > lo:
                        here = b[b_at[lo] : b_at[hi]].reshape(hi - lo, n, nrhs)
                        y[b_at[lo] - b_at[0] : b_at[hi] - b_at[0]] = lu_solve(*_factors(lu, perm, n, lo, hi), here).ravel()
                ends = pa.array(b_at - b_at[0], pa.int32())
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, pa.array(y[: b_at[-1] - b_at[0]]))], ["id", "n", "rows", "u", "y"])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                (u_at, u), (y_at, y) = (_flat(batch.column(c)) for c in ("u", "y"))
                c = dense_rows(batch.column("c"), batch.num_rows).reshape(-1, r, nrhs) if "c" in batch.schema.names else None
                for n, lo, hi in _stacks(batch.column("n").to_numpy()):
                    m = hi - lo
                    x = y[y_at[lo] : y_at[hi]].reshape(m, n, nrhs)
                    if c is not None:
                        x = x - u[u_at[lo] : u_at[hi]].reshape(m, n, r) @ c[lo:hi]
                    kept = batch.column("rows").slice(lo, m).flatten().flatten()
                    yield pa.RecordBatch.from_arrays([*kept, list_column(x.reshape(m * n, nrhs))], [*self_keys, "x"])

        self_keys = list(self.keys)
        keyed = F.transform("rows", lambda row: F.struct(*[row[c].alias(c) for c in names])).alias("rows")
        solved = leaves.select("id", "n", keyed, "lu", "perm", "u", "b")
        solved = solved.mapInArrow(own, f"id bigint, n int, rows array<struct<{fields}>>, u array<double>, y array<double>")
        if coefficients is not None:
            small = self.count * 8 * (r * nrhs + 2) <= BROADCAST_BYTES
            # else hashed, so that the rows are not sorted
            solved = solved.join(F.broadcast(coefficients) if small else coefficients.hint("shuffle_hash"), "id")
        schema = ", ".join(f"`{k}` {kind}" for k, kind in zip(self.keys, kinds, strict=True)) + ", x array<double>"
        return solved.mapInArrow(rows, schema)
