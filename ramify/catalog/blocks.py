"""Queries for the block-partitioned operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ramify.catalog.base import (
    BASE,
    Known,
    column_matrix,
    entries,
    leaves,
    quarters,
    query,
    rounded,
)
from ramify.functions.algebra import Matrix, Vector
from ramify.operators.blocks import RowBlocks, node_sides, node_solve_ragged
from ramify.plans.hodlr import heavy_layout
from ramify.plans.levels import LevelStorage
from ramify.sources.tables import read_table


def shown(blocks: RowBlocks, digits: int = 6):
    return entries(blocks.to_matrix(), digits)


def by_part(blocks: RowBlocks, part: str = "part", digits: int = 6, of: RowBlocks | None = None):
    """Entries numbered within their part; sums over no rows of ``of`` are left out, as SQL does."""
    size, cells = blocks.part_rows, blocks.entries()
    if of is not None:
        cells = cells.where(F.expr(f"i div {size}") < of.partition_of.empty_groups(of.parts // blocks.parts).start)
    return cells.select(
        F.expr(f"i div {size}").alias(part),
        F.expr(f"i % {size}").alias("i"),
        "j",
        rounded("v", digits).alias("v"),
    )


# -- in, out, partitions ------------------------------------------------------


@query("blocks_to_matrix", BASE + "SELECT i, j, v FROM E")
def blocks_to_matrix(spark, folder):
    return quarters(Known(spark, folder).u).to_matrix().df


@query("blocks_to_columns", BASE + "SELECT i, j - 8 AS j, v FROM E WHERE j BETWEEN 8 AND 23")
def blocks_to_columns(spark, folder):
    return quarters(Known(spark, folder).u).to_matrix(col0=8, col1=24).df


@query(
    "blocks_to_range",
    BASE + "SELECT i - n // 3 AS i, j - 8 AS j, v FROM E, N WHERE i >= n // 3 AND i < n // 2 AND j BETWEEN 8 AND 23",
)
def blocks_to_range(spark, folder):
    e = Known(spark, folder).u
    return quarters(e).entries(e.rows // 3, e.rows // 2, 8, 24)


@query("blocks_to_vector", BASE + "SELECT i, v FROM E WHERE j = 5")
def blocks_to_vector(spark, folder):
    return quarters(Known(spark, folder).u).window(5, 1).to_vector().df


@query("column_window", BASE + "SELECT i, j - 16 AS j, v FROM E WHERE j BETWEEN 16 AND 31")
def column_window(spark, folder):
    return quarters(Known(spark, folder).u).window(16, 16).to_matrix().df


@query(
    "matrix_shape",
    "SELECT count(*) AS rows, max(len(embedding)) AS width, 4::BIGINT AS parts, (count(*) + 3) // 4 AS part_rows FROM embeddings",
)
def matrix_shape(spark, folder):
    return quarters(Known(spark, folder).u).measure()


@query(
    "partition_rows",
    BASE + "SELECT i // ((n + 3) // 4) AS part, min(i) AS row0, count(*) AS nrow FROM X, N GROUP BY 1",
)
def partition_rows(spark, folder):
    return quarters(Known(spark, folder).u).colors()


@query(
    "two_level_partition",
    BASE + "SELECT i // ((n + 3) // 4) // 2 AS node, i // ((n + 3) // 4) % 2 AS side, min(i) AS row0, count(*) AS nrow FROM X, N GROUP BY 1, 2",
)
def two_level_partition(spark, folder):
    halves = RowBlocks.from_matrix(Known(spark, folder).u, 1, block_rows=25)
    return halves.two_level_partition().colors()


@query(
    "irregular_parts",
    """SELECT CASE WHEN o_orderkey < 3 * 640 THEN o_orderkey // 640 ELSE 3 + (o_orderkey - 1920) // 64 END AS part,
count(*) AS nrow, min(o_orderkey) AS row0 FROM orders GROUP BY 1""",
)
def irregular_parts(spark, folder):
    """Three heavy parts with ten times the rows, the rest regular."""
    orders = read_table(spark, folder, "orders")
    layout = heavy_layout("o_orderkey", 64, 64, heavy=3)
    return orders.groupBy(layout.part.alias("part")).agg(
        F.count("*").alias("nrow"), F.min("o_orderkey").alias("row0")
    )


@query(
    "utree_tile_columns",
    BASE + "SELECT i, 0::BIGINT AS j, x AS v FROM X UNION ALL SELECT i, 1 + j + 64 * l, v FROM E, range(3) t(l)",
)
def utree_tile_columns(spark, folder):
    """``[rhs | u | u | u]`` for three levels."""
    known = Known(spark, folder)
    rhs = column_matrix(known.x)
    return LevelStorage.init(known.u, rhs, 3, 2).blocks.to_matrix().df


@query(
    "utree_level_windows",
    BASE
    + """SELECT 'u' AS side, i, j, v FROM E UNION ALL SELECT 'd', i, 0, x FROM X
UNION ALL SELECT 'd', i, 1 + j, v FROM E""",
)
def utree_level_windows(spark, folder):
    """The windows of level 1: its own u, and d with the right-hand side and the root's u."""
    known = Known(spark, folder)
    rhs = column_matrix(known.x)
    storage = LevelStorage.init(known.u, rhs, 3, 2)
    u, d = storage.u(1).to_matrix().df, storage.d(1).to_matrix().df
    return u.select(F.lit("u").alias("side"), "*").unionByName(d.select(F.lit("d").alias("side"), "*"))


# -- element-wise -------------------------------------------------------------


@query("blocks_scale", BASE + "SELECT i, j, round(CASE WHEN j BETWEEN 8 AND 23 THEN 3.0 * v ELSE v END, 6) + 0.0 AS v FROM E")
def blocks_scale(spark, folder):
    """Scale a column window; the other columns of the storage stay."""
    b = quarters(Known(spark, folder).u).window(8, 16).scale(3.0)
    return shown(b.window(0, 64))


@query("mat_clear", BASE + "SELECT i, j, CASE WHEN j BETWEEN 8 AND 23 THEN 1.5 ELSE v END::DOUBLE AS v FROM E")
def mat_clear(spark, folder):
    return quarters(Known(spark, folder).u).window(8, 16).clear(1.5).window(0, 64).to_matrix().df


@query(
    "mat_axpby",
    BASE + "SELECT i, j, round(2.0::DOUBLE * E.v - 0.5::DOUBLE * V.v, 6) + 0.0 AS v FROM E JOIN V USING (i, j)",
)
def mat_axpby(spark, folder):
    known = Known(spark, folder)
    u, v = quarters(known.u, known.v)
    return shown(RowBlocks.add(2.0, u, -0.5, v))


# -- products -----------------------------------------------------------------


@query(
    "dense_blocks",
    BASE
    + """SELECT E.i // 125 AS p, E.i, V.i % 125 AS k,
round(sum(E.v * V.v) + CASE WHEN E.i = V.i THEN any_value(X.d) ELSE 0.0 END, 6) + 0.0 AS v
FROM E JOIN V ON E.j = V.j AND E.i // 125 = V.i // 125 JOIN X ON X.i = E.i GROUP BY E.i, V.i""",
)
def dense_blocks(spark, folder):
    known = Known(spark, folder)
    u, v, d = known.u, known.v, column_matrix(known.d)
    size = known.leaf
    k = RowBlocks.dense_blocks(*leaves(u, v, d, rows=size))
    own = F.least(F.lit(size), F.lit(known.n) - F.expr(f"i div {size}") * size)  # the last leaf may be shorter
    return k.entries().where(F.col("j") < own).select(
        F.expr(f"i div {size}").alias("p"), "i", F.col("j").alias("k"), rounded("v").alias("v")
    )


GEMM_RED = BASE + """SELECT (V.i // ((n + 3) // 4)) // {color} AS node, V.j AS i, E.j AS j, round(sum(V.v * E.v), 6) + 0.0 AS v
FROM V JOIN E USING (i), N GROUP BY 1, 2, 3"""


@query("gemm_reduce", GEMM_RED.format(color=2))
def gemm_reduce(spark, folder):
    known = Known(spark, folder)
    v, u = quarters(known.v, known.u)
    return by_part(RowBlocks.gemm_red("t", "n", 1.0, v, u, parts=2), "node", of=u)


@query(
    "gemm_reduce_two_level",
    BASE
    + """SELECT (V.i // ((n + 3) // 4)) // 2 AS node, (V.i // ((n + 3) // 4)) % 2 AS side, V.j AS i, E.j AS j,
round(sum(V.v * E.v), 6) + 0.0 AS v FROM V JOIN E USING (i), N GROUP BY 1, 2, 3, 4""",
)
def gemm_reduce_two_level(spark, folder):
    known = Known(spark, folder)
    v, u = quarters(known.v, known.u)
    w = by_part(RowBlocks.gemm_red("t", "n", 1.0, v, u, parts=4, levels=2), of=u)
    return w.select(F.expr("part div 2").alias("node"), F.expr("part % 2").alias("side"), "i", "j", "v")


@query(
    "spmd_level_sum",
    BASE
    + """, P AS (SELECT V.i // ((n + 3) // 4) AS part, V.j AS i, E.j AS j, sum(V.v * E.v) AS v FROM V JOIN E USING (i), N GROUP BY 1, 2, 3)
SELECT l AS level, part >> (2 - l) AS node, i, j, round(sum(v), 6) + 0.0 AS v FROM P, range(2) t(l) GROUP BY 1, 2, 3, 4""",
)
def spmd_level_sum(spark, folder):
    """Part sums combined into the nodes of each coarser level."""
    known = Known(spark, folder)
    v, u = quarters(known.v, known.u)
    part = by_part(RowBlocks.gemm_red("t", "n", 1.0, v, u, parts=4), digits=15, of=u)
    level = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    sums = part.withColumn("level", level).groupBy(
        "level", F.expr("shiftright(part, cast(2 - level as int))").alias("node"), "i", "j"
    )
    return sums.agg(rounded(F.sum("v")).alias("v"))


@query("gemm_single", GEMM_RED.format(color=4).replace("AS node", "AS part").replace("// 4 AS", "* 0 AS"))
def gemm_single(spark, folder):
    known = Known(spark, folder)
    v, u = quarters(known.v, known.u)
    return by_part(RowBlocks.gemm("t", "n", 1.0, v, u))


@query(
    "gemm_alpha_beta",
    BASE
    + """, P AS (SELECT V.j AS i, E.j AS j, sum(V.v * E.v) AS v FROM V JOIN E USING (i) GROUP BY 1, 2),
C AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM E a JOIN E b USING (i) GROUP BY 1, 2)
SELECT i, j, round(2.0::DOUBLE * P.v - 0.5::DOUBLE * C.v, 6) + 0.0 AS v FROM P JOIN C USING (i, j)""",
)
def gemm_alpha_beta(spark, folder):
    """``2 V'U - 0.5 C`` with ``C = U'U``, all three from all rows."""
    known = Known(spark, folder)
    u, v = quarters(known.u, known.v)
    c = RowBlocks.gemm("t", "n", 1.0, u, u)
    return shown(RowBlocks.gemm("t", "n", 2.0, v, u, -0.5, c))


@query(
    "gemm_transposed",
    BASE
    + """, P AS (SELECT i // 125 AS p, i % 125 AS k, j, v FROM E)
SELECT a.k AS i, b.k AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM P a JOIN P b ON a.p = b.p AND a.j = b.j GROUP BY 1, 2""",
)
def gemm_transposed(spark, folder):
    """Sum over the leaves of ``E_p E_p'``."""
    known = Known(spark, folder)
    (b,) = leaves(known.u, rows=known.leaf)
    return shown(RowBlocks.gemm_red("n", "t", 1.0, b, b))


GROUPED = """, W AS (SELECT (V.i // ((n + 3) // 4)) // {color} AS node, V.j AS k, E.j AS j, sum(V.v * E.v) AS w
FROM V JOIN E USING (i), N WHERE V.j < {half} AND E.j >= 64 - {half} GROUP BY 1, 2, 3),
P AS (SELECT E.i, W.j AS j, sum(E.v * W.w) AS p FROM E JOIN N ON true JOIN W ON W.node = (E.i // ((n + 3) // 4)) // {color} AND W.k = E.j
GROUP BY 1, 2)
"""


@query("gemm_broadcast", BASE + GROUPED.format(color=2, half=64) + "SELECT i, j, round(p, 6) + 0.0 AS v FROM P")
def gemm_broadcast(spark, folder):
    """``W_p = U_p B_node(p)`` into separate storage, over all columns."""
    known = Known(spark, folder)
    u, v = quarters(known.u, known.v)
    b = RowBlocks.gemm_red("t", "n", 1.0, v, u, parts=2)
    w = RowBlocks.zeros(spark, u.rows, 64, 2, u.block_rows)
    return shown(RowBlocks.gemm_bro("n", "n", 1.0, u, b, 0.0, w))


@query(
    "gemm_inplace",
    BASE
    + GROUPED.format(color=4, half=32)
    + "SELECT i, j, round(E.v - coalesce(p, 0), 6) + 0.0 AS v FROM E LEFT JOIN P USING (i, j)",
)
def gemm_inplace(spark, folder):
    """``C -= A B`` with A and C the two halves of one storage."""
    known = Known(spark, folder)
    u, v = quarters(known.u, known.v)
    b = RowBlocks.gemm("t", "n", 1.0, v.window(v.col0, 32), u.window(u.col0 + 32, 32))
    c = RowBlocks.gemm_inplace(-1.0, u.window(u.col0, 32), b, u.window(u.col0 + 32, 32))
    return shown(c.window(u.col0, 64))


# -- small solves -------------------------------------------------------------


@query("dense_lu_solve", BASE + "SELECT i, x FROM X")
def dense_lu_solve(spark, folder):
    """One dense solve per leaf; b is made from the known x leaf by leaf."""
    known = Known(spark, folder)
    u, v, d = known.u, known.v, column_matrix(known.d)
    x = column_matrix(known.x)
    ub, vb, db, xb = leaves(u, v, d, x, rows=known.leaf)
    k = RowBlocks.dense_blocks(ub, vb, db)
    b = RowBlocks.gemm_red("n", "n", 1.0, k, xb, parts=k.parts)
    return k.leaf_solve(b).to_vector().df.select("i", rounded("v").alias("x"))


@query(
    "part_solve",
    BASE + "SELECT i, x FROM X",
)
def part_solve(spark, folder):
    """Two leaves merged inside each part, with b made from the known x per part."""
    known = Known(spark, folder)
    u, v, d = known.u, known.v, column_matrix(known.d)
    x = column_matrix(known.x)
    size = 2 * known.leaf
    dx = Matrix(known.d.multiply(known.x).diagonal().df.selectExpr("i", "0 as j", "v"), u.rows, 1)
    ub, vb, db, xb, dxb = leaves(u, v, d, x, dx, rows=size)
    vtx = RowBlocks.gemm_red("t", "n", 1.0, vb, xb, parts=vb.parts)
    # b takes the place of d x in the storage of the rest
    b = RowBlocks.gemm_bro("n", "n", 1.0, ub, vtx, 1.0, dxb)
    ub, vb, db = (replace(b, col0=m.col0, ncols=m.cols) for m in (ub, vb, db))
    w = RowBlocks.part_solve(ub, vb, db, b, leaf=known.leaf)
    return w.window(0, 1).to_vector().df.select("i", rounded("v").alias("x"))


RANK_ONE = BASE + """, U1 AS (SELECT i, v / 1000 AS u FROM E WHERE j = 0), V1 AS (SELECT i, v AS w FROM V WHERE j = 0),
m AS (SELECT U1.i // ((n + 3) // 4) // 2 AS node, U1.i // ((n + 3) // 4) % 2 AS side, sum(w * u) AS vtu, sum(w * x) AS vtd
FROM U1 JOIN V1 USING (i) JOIN X USING (i), N GROUP BY 1, 2)
SELECT a.node, round((b.vtd - b.vtu * a.vtd) / (1 - a.vtu * b.vtu), 6) + 0.0 AS eta0,
round((a.vtd - a.vtu * b.vtd) / (1 - a.vtu * b.vtu), 6) + 0.0 AS eta1
FROM m a JOIN m b ON a.node = b.node AND a.side = 0 AND b.side = 1"""


@query("node_solve_2x2", RANK_ONE)
def node_solve_rank_one(spark, folder):
    """Rank one, where Cramer's rule gives the answer in SQL."""
    known = Known(spark, folder)
    u = quarters((1 / 1000) * known.u.block(0, known.u.rows, 0, 1))
    v, x = quarters(known.v.block(0, u.rows, 0, 1), column_matrix(known.x))
    vtu = RowBlocks.gemm_red("t", "n", 1.0, v, u, parts=4, levels=2)
    vtd = RowBlocks.gemm_red("t", "n", 1.0, v, x, parts=4, levels=2)
    eta = RowBlocks.node_solve(vtu, vtd).to_vector().df
    pick = [F.max(F.when(F.col("i") % 2 == s, F.col("v"))).alias(f"eta{s}") for s in (0, 1)]
    sides = eta.groupBy(F.expr("i div 2").alias("node")).agg(*pick)
    sides = sides.where(F.col("node") < u.partition_of.empty_groups(1).start // 2)  # both sides have rows
    return sides.select("node", rounded("eta0").alias("eta0"), rounded("eta1").alias("eta1"))


KNOWN_ETA = "SELECT node, side, k, (1 + node * 2 + side + k % 5)::DOUBLE AS eta FROM range(2) a(node), range(2) b(side), range(64) c(k)"


@query("node_solve", KNOWN_ETA)
def node_solve_known(spark, folder):
    """Full rank with a known eta: V'd is put together from V'u and eta, then solved back."""
    known = Known(spark, folder)
    u, v = known.u, known.v
    r = u.cols
    vb, ub = quarters(v, u)
    vtu = RowBlocks.gemm_red("t", "n", 0.001, vb, ub, parts=4, levels=2)
    eta = spark.range(4 * r).select(
        F.col("id").alias("i"), F.expr(f"cast(1 + id div {r} + id % {r} % 5 as double)").alias("v")
    )
    swapped = eta.withColumn("i", F.expr(f"i + if(i div {r} % 2 = 0, {r}, -{r})"))
    one = RowBlocks.from_matrix(column_matrix(Vector(eta, 4 * r)), 2, r)
    other = RowBlocks.from_matrix(column_matrix(Vector(swapped, 4 * r)), 2, r)
    vtd = RowBlocks.gemm_bro("n", "n", 1.0, vtu, one, 1.0, other)
    solved = RowBlocks.node_solve(vtu, RowBlocks(vtd.df, vtd.rows, 1, 4, r, levels=2))
    return solved.to_vector().df.select(
        F.expr(f"i div {r} div 2").alias("node"),
        F.expr(f"i div {r} % 2").alias("side"),
        F.expr(f"i % {r}").alias("k"),
        rounded("v").alias("eta"),
    )


@query(
    "node_solve_region_ragged",
    """SELECT node, side, k, (1 + node * 2 + side + k % 5)::DOUBLE AS eta FROM range(4) a(node), range(2) b(side), range(64) c(k)
WHERE k < CASE side WHEN 0 THEN 16 + 8 * node ELSE 48 - 8 * node END""",
)
def node_solve_two_ranks(spark, folder):
    """Four nodes whose sides share all columns in four ways, with a known eta."""
    known = Known(spark, folder)
    u, v = RowBlocks.together([known.u, known.v], 3)
    grams = RowBlocks.gemm_red("t", "n", 0.001, v, u, parts=8, levels=2)
    ranks = spark.range(4).selectExpr("id as node", "cast(16 + 8 * id as int) as rank0", "cast(48 - 8 * id as int) as rank1")
    sides = node_sides(grams, ranks)
    eta = "transform(sequence(0, {n} - 1), k -> cast(1 + node * 2 + {side} + k % 5 as double))"
    sides = sides.withColumn("other", F.expr(f"{64} - rank"))
    sides = sides.withColumns({"own": F.expr(eta.format(n="rank", side="side")), "met": F.expr(eta.format(n="other", side="(1 - side)"))})
    product = F.expr(
        "transform(sequence(0, other - 1), k -> met[k] + "
        "aggregate(zip_with(slice(vtu, k * rank + 1, rank), own, (a, b) -> a * b), 0D, (s, p) -> s + p))"
    )
    solved = node_solve_ragged(sides.withColumn("vtd", product), nrhs=1)
    return solved.select("node", F.col("side").cast("bigint").alias("side"), F.posexplode("eta").alias("k", "eta")).select(
        "node", "side", F.col("k").cast("bigint").alias("k"), rounded("eta").alias("eta")
    )
