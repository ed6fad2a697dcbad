"""Hierarchical dense linear algebra on Spark DataFrames.

``Vector`` and ``Matrix`` are relational (one row per entry), ``RowBlocks`` is
the block-partitioned form used by the distributed products, and ``Hodlr``
solves ``(U V' + diag(D)) x = b`` by recursive halving of the rows.
"""

from ramify.functions.algebra import Matrix, Vector
from ramify.operators.blocks import RowBlocks
from ramify.plans.hodlr import Hodlr
from ramify.session import get_spark

__all__ = ["Hodlr", "Matrix", "RowBlocks", "Vector", "get_spark"]
