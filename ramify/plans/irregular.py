"""Two sides with their own ranks, coupled at the top of the tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.operators.kernels import coupling, solve
from ramify.plans.tree import apply_coefficients, merge_tree, push_down, solve_parts
from ramify.session import RunFolder


def solve_two_ranks(
    sides: tuple[DataFrame, DataFrame],
    ranks: tuple[int, int],
    nrhs: int = 1,
    keys: tuple[str, ...] = ("i",),
    leaf: int | None = None,
    part_rows: int | None = None,
    folder: RunFolder | None = None,
) -> DataFrame:
    """Solve ``[[U0 V0' + D0, U0 W1'], [U1 W0', U1 V1' + D1]] x = b``.

    Side s holds its keys, ``u`` and ``v`` of its own rank, ``w`` of the other
    side's rank, ``d`` and ``b`` (array).  Each side is its own tree; W rides along
    as extra gram rows, so the two roots alone decide the coupling.  Pass a ``folder``
    to release the written tables afterwards.
    """
    keys = list(keys)
    folder = folder or RunFolder(sides[0].sparkSession)
    trees = []
    for s, rows in enumerate(sides):
        size = leaf or max(64, 2 * ranks[s])
        if size <= ranks[s]:
            raise ValueError(f"leaf size {size} must exceed the rank {ranks[s]}")
        rows = rows.withColumn("v", F.concat("v", "w"))
        parts = solve_parts(
            rows, keys, ranks[s], sum(ranks), nrhs, size, folder, f"side{s}-parts", part_rows
        )
        trees.append((parts, merge_tree(parts, folder, f"side{s}-tree", keep_root=True)))

    roots = [
        stages[-1].where("g is not null").select(F.lit(s).alias("side"), "node", "g")
        for s, (_, stages) in enumerate(trees)
    ]

    def couple(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        r, grams = list(ranks), []
        for s in range(2):
            gram = np.asarray(table.column("g")[s].as_py()).reshape(sum(ranks), r[s] + nrhs)
            grams.append(gram[r[s] :])
        vtu0, vtu1 = grams[0][:, nrhs:], grams[1][:, nrhs:]
        rhs = np.concatenate([grams[1][:, :nrhs], grams[0][:, :nrhs]])
        eta = solve(coupling(vtu0, vtu1), rhs, "the top node")
        c = pa.array([eta[: r[0]].T.ravel().tolist(), eta[r[0] :].T.ravel().tolist()], pa.list_(pa.float64()))
        return pa.table({"side": table.column("side"), "node": table.column("node"), "c": c})

    top = (
        roots[0]
        .unionByName(roots[1])
        .groupBy("node")
        .applyInArrow(couple, "side int, node bigint, c array<double>")
    )
    solved = [
        apply_coefficients(
            parts, push_down(stages, parts, top.where(F.col("side") == s).select("node", "c"))
        )
        for s, (parts, stages) in enumerate(trees)
    ]
    return solved[0].unionByName(solved[1])
