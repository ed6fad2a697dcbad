"""The solve spelled out level by level with the block operators.

``Hodlr.solve`` computes the same x with two passes over the rows.  This form spells out
every intermediate matrix: the storage ``[rhs | u_0 | ... | u_{L-1}]``, its
windows per level, the reductions, the node solves and the updates.
"""

from __future__ import annotations

from dataclasses import dataclass

from ramify.functions.algebra import Matrix, Vector
from ramify.operators.blocks import Partition, RowBlocks
from ramify.session import RunFolder


@dataclass(frozen=True)
class LevelStorage:
    """``[rhs | u_0 | ... | u_{L-1}]`` with the windows of each level (0 is the root)."""

    blocks: RowBlocks
    nrhs: int
    rank: int
    level: int

    @classmethod
    def init(cls, u: Matrix, rhs: Matrix, level: int, launch_level: int | None = None) -> LevelStorage:
        """Right-hand side in front, then one copy of U per level."""
        width = rhs.cols + level * u.cols
        launch_level = level if launch_level is None else launch_level
        blocks = RowBlocks.zeros(u.df.sparkSession, u.rows, width, launch_level)
        blocks = blocks.init_data(rhs)
        if level:
            blocks = blocks.init_data(u, rhs.cols, width)
        return cls(blocks, rhs.cols, u.cols, level)

    def _first(self, level: int) -> int:
        if not 0 <= level < self.level:
            raise ValueError(f"level {level} is outside 0..{self.level - 1}")
        return self.nrhs + self.rank * level

    def u(self, level: int) -> RowBlocks:
        return self.blocks.window(self._first(level), self.rank)

    def d(self, level: int) -> RowBlocks:
        """Everything left of the level's own u: the right-hand side and coarser u."""
        return self.blocks.window(0, self._first(level))

    def solution(self) -> Matrix:
        return self.blocks.to_matrix(col1=self.nrhs)


def solve_by_levels(
    u: Matrix,
    v: Matrix,
    diag: Vector,
    b: Matrix,
    level: int,
    launch_level: int | None = None,
    folder: RunFolder | None = None,
    cut: Partition | None = None,
) -> LevelStorage:
    """Leaf solves, then one reduction, node solve and update per level up to the root.

    U, V, D and b are assembled in one shuffle and stay side by side, so the levels need no join:
    each reads ``[rhs | u_0 | ... | u_at | V]`` and writes only what the next one reads.
    Parts are ``2**launch_level`` equal ones, or those of ``cut``, which may be unequal or empty; a
    part's leaves have about ``rows / 2**level`` rows.
    """
    top = level if launch_level is None else launch_level
    if not 0 <= top <= level:
        raise ValueError(f"launch level {top} is outside 0..{level}")
    if cut is not None and cut.parts != 1 << top:
        raise ValueError(f"{cut.parts} parts for {1 << top} of the tree")
    # a single leaf may have fewer rows than the rank
    leaf = -(-u.rows // (1 << level)) if level else max(u.rows, u.cols + 1)
    cut = cut or Partition.equal(u.rows, 1 << top)
    diagonal = Matrix(diag.df.selectExpr("i", "0 as j", "v"), diag.rows, 1)
    blocks = RowBlocks.together([u, v, diagonal, b], block_rows=cut.part_rows, cut=cut)
    folder, r, nrhs = folder or RunFolder(u.df.sparkSession), u.cols, b.cols
    w = RowBlocks.part_solve(*blocks, leaf, copies=top, with_v=True).cut(folder, f"w{top}")
    for at in range(top - 1, -1, -1):
        left = nrhs + r * at
        d, u_at, v_at = w.window(0, left), w.window(left, r), w.window(left + r, r)
        # d and u lie next to each other, so one reduction gives V'd and V'u.
        vtw = RowBlocks.gemm_red("t", "n", 1.0, v_at, w.window(0, left + r), 2 << at, levels=2)
        eta = RowBlocks.node_solve(vtw.window(left, r), vtw.window(0, left)).window(0, left)
        w = RowBlocks.gemm_bro("n", "n", -1.0, u_at, eta, 1.0, d)
        w = w.columns((0, left), (left + r, r)).cut(folder, f"w{at}")
    return LevelStorage(w, nrhs, r, 0)
