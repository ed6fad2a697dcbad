"""Queries for the tree solver.  Every right-hand side is made from a known x."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.catalog.base import BASE, Known, column_matrix, query, rounded
from ramify.functions.algebra import array_sums, dot
from ramify.plans.hodlr import Hodlr, blocked_layout, heavy_layout
from ramify.plans.irregular import solve_two_ranks
from ramify.plans.levels import solve_by_levels
from ramify.sources.tables import read_table, spread

KNOWN = BASE + "SELECT i, x FROM X"


def embedding_system(spark: SparkSession, folder: str, rank: int = 64) -> Hodlr:
    """``U = E``, ``V = E`` rolled by one row, ``D = 1000 + i % 7``, with ``b = A x``."""
    table = read_table(spark, folder, "embeddings")
    n = table.count()
    table = spread(table, "vec_id", "embedding", "label")
    rows = table.select(
        F.col("vec_id").alias("i"),
        F.slice("embedding", 1, rank).alias("u"),
        (F.lit(1000) + F.col("vec_id") % 7).alias("d"),
        (F.col("label") + 1.0).alias("x"),
    )
    moved = table.select(((F.col("vec_id") + 1) % n).alias("i"), F.slice("embedding", 1, rank).alias("v"))
    return with_rhs(Hodlr(rows.join(moved, "i"), rank=rank), "x")


def with_rhs(h: Hodlr, *known: str) -> Hodlr:
    """The system with ``b array`` computed from known columns."""
    return Hodlr(h.products(*known).withColumnRenamed("ax", "b"), h.keys, h.rank)


def first_x(solved: DataFrame, *keys: str) -> DataFrame:
    return solved.select(*keys, rounded(F.col("x")[0]).alias("x"))


@query("hodlr_solve", KNOWN)
def hodlr_solve(spark, folder):
    """Tree order taken from the input, no shuffle of the rows."""
    h = embedding_system(spark, folder)
    return first_x(h.solve("b", leaf=125, nrhs=1), "i")


def _part_levels(levels: int):
    """Parts by row number with ``2**levels`` leaves each: that many levels are merged in the task."""

    def run(spark, folder):
        h, known = embedding_system(spark, folder), Known(spark, folder)
        layout = blocked_layout("i", known.leaf << levels, known.leaf)
        return first_x(h.solve("b", leaf=known.leaf, layout=layout, nrhs=1), "i")

    return run


query("hodlr_solve_L0", KNOWN)(_part_levels(0))
query("hodlr_solve_L1", KNOWN)(_part_levels(1))
query("hodlr_solve_L2", KNOWN)(_part_levels(2))


@query("hodlr_solve_regular", KNOWN)
def hodlr_solve_regular(spark, folder):
    """Equal halves down to leaves just above the rank, the lowest level inside the parts."""
    h, known = embedding_system(spark, folder), Known(spark, folder)
    return first_x(h.solve_levels("b", known.n, known.level, max(0, known.level - 1), nrhs=1), "i")


@query("hodlr_by_levels", KNOWN)
def hodlr_by_levels(spark, folder):
    """The same solve written out with reductions, node solves and updates."""
    known = Known(spark, folder)
    u, v, d, x = known.u, known.v, known.d, known.x
    b = u * (v.T * x) + d.multiply(x)
    solved = solve_by_levels(u, v, d, column_matrix(b), known.level).solution()
    return solved.df.select("i", rounded("v").alias("x"))


@query("hodlr_from_matrices", KNOWN)
def hodlr_from_matrices(spark, folder):
    known = Known(spark, folder)
    u, v, d, x = known.u, known.v, known.d, known.x
    b = u * (v.T * x) + d.multiply(x)
    solved = Hodlr.from_matrices(u, v, d).solve(b.df.withColumnRenamed("v", "b"), leaf=125)
    return first_x(solved, "i")


@query("hodlr_multi_rhs", BASE + "SELECT i, x AS x0, (1 + i % 11)::DOUBLE AS x1, -x AS x2 FROM X")
def hodlr_multi_rhs(spark, folder):
    h = embedding_system(spark, folder)
    rows = h.system.withColumn("x1", 1.0 + F.col("i") % 11).withColumn("x2", -F.col("x")).drop("b")
    h = with_rhs(Hodlr(rows, rank=h.rank), "x", "x1", "x2")
    solved = h.solve("b", leaf=125, nrhs=3)
    return solved.select("i", *[rounded(F.col("x")[k]).alias(f"x{k}") for k in range(3)])


@query(
    "hodlr_factor_once",
    BASE + "SELECT 0 AS step, i, x FROM X UNION ALL SELECT 1, i, (1 + i % 11)::DOUBLE FROM X UNION ALL SELECT 2, i, -2 * x FROM X",
)
def hodlr_factor_once(spark, folder):
    """Factored once; then a right-hand side kept with the factors, and two that come later as frames."""
    h = embedding_system(spark, folder)
    factors = Hodlr(h.system.withColumn("rhs", F.col("b")[0]), rank=h.rank).factor(leaf=125, keep=["rhs"])
    other = h.system.withColumn("x1", 1.0 + F.col("i") % 11)
    later = Hodlr(other, rank=h.rank).products("x1").select("i", F.col("ax")[0].alias("b1"))
    twice = h.system.select("i", (-2 * F.col("b")[0]).alias("b2"))
    solved = [factors.solve("rhs"), factors.solve(later), factors.solve(twice)]
    shown = [first_x(x, "i").select(F.lit(k).alias("step"), "i", "x") for k, x in enumerate(solved)]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query(
    "hodlr_factor_lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (1 + l_partkey % 9)::DOUBLE AS x, (1 + l_suppkey % 5)::DOUBLE AS x1 FROM lineitem",
)
def hodlr_factor_lineitem(spark, folder):
    """Two kept right-hand sides solved together, over all line items."""
    h = lineitem_system(spark, folder)
    rows = h.system.withColumn("x1", 1.0 + F.col("l_suppkey") % 5)
    h = Hodlr(Hodlr(rows, LINE_KEYS, h.rank).products("x", "x1"), LINE_KEYS, h.rank)
    rows = h.system.select("*", F.col("ax")[0].alias("b0"), F.col("ax")[1].alias("b1"))
    solved = Hodlr(rows, LINE_KEYS, h.rank).factor(leaf=64, keep=["b0", "b1"]).solve(["b0", "b1"])
    return solved.select(*LINE_KEYS, rounded(F.col("x")[0]).alias("x"), rounded(F.col("x")[1]).alias("x1"))


@query("hodlr_irregular_leaves", KNOWN)
def hodlr_irregular_leaves(spark, folder):
    """The first part has twice the rows and twice the leaf; every part holds two leaves."""
    h = embedding_system(spark, folder)
    return first_x(h.solve("b", leaf=70, layout=heavy_layout("i", 140, 70, heavy=1, factor=2), nrhs=1), "i")


@query("hodlr_irregular_ranks", KNOWN)
def hodlr_irregular_ranks(spark, folder):
    """Two halves with ranks 24 and 40, the columns of one each, and their own coupling factors."""
    table = read_table(spark, folder, "embeddings")
    n = table.count()
    wide = table.withColumn("embedding", F.col("embedding").cast("array<double>"))
    moved = wide.select(((F.col("vec_id") + 1) % n).alias("i"), F.col("embedding").alias("e2"))
    rows = wide.select(
        F.col("vec_id").alias("i"),
        F.col("embedding").alias("e1"),
        (F.lit(1000.0) + F.col("vec_id") % 7).alias("d"),
        (F.col("label") + 1.0).alias("x"),
    ).join(moved, "i")
    ranks, first = (24, 40), (1, 25)
    sides = []
    for s in (0, 1):
        inside = F.col("i") < n // 2 if s == 0 else F.col("i") >= n // 2
        sides.append(
            rows.where(inside).select(
                "i",
                "d",
                "x",
                F.slice("e1", first[s], ranks[s]).alias("u"),
                F.slice("e2", first[s], ranks[s]).alias("v"),
                F.slice("e2", first[1 - s], ranks[1 - s]).alias("w"),
            )
        )
    vtx = [array_sums(side, F.col("v"), [F.col("x")], ranks[s]) for s, side in enumerate(sides)]
    wtx = [array_sums(side, F.col("w"), [F.col("x")], ranks[1 - s]) for s, side in enumerate(sides)]
    systems = []
    for s, side in enumerate(sides):
        rows = side.select("*", vtx[s].scalar().alias("own"), wtx[1 - s].scalar().alias("across"))
        met = [dot(F.col("u"), F.col(y)[0], ranks[s]) for y in ("own", "across")]
        b = met[0] + met[1] + F.col("d") * F.col("x")
        systems.append(rows.select("i", "u", "v", "w", "d", F.array(b).alias("b")))
    return first_x(solve_two_ranks(tuple(systems), ranks, leaf=50), "i")


@query("hodlr_relative_residual", "SELECT true AS ok, count(*) AS n FROM embeddings")
def hodlr_relative_residual(spark, folder):
    """The solution put back into the system."""
    return put_back(embedding_system(spark, folder), F.col("b")[0], nrhs=1, leaf=125)


def put_back(h: Hodlr, b, **how) -> DataFrame:
    """Whether ``b - A x`` is small, with x on the system's own rows, and their number."""
    columns = [c for c in h.system.columns if c not in h.keys]
    kept = [c for c in columns if c != "x"]
    solved = h.solve("b" if "b" in columns else b, keep=kept, **how)
    back = Hodlr(solved.withColumn("z", F.col("x")[0]), h.keys, h.rank)
    n = solved.agg(F.count("*").alias("n")).scalar()
    return back.residual("z", b).select((F.col("relative") < 1e-12).alias("ok"), n.alias("n"))


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lineitem_system(spark: SparkSession, folder: str, *extra: str) -> Hodlr:
    """One matrix row per line item; rank four from its numeric columns."""
    numbers = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    table = spread(read_table(spark, folder, "lineitem"), *LINE_KEYS, *numbers)
    q, e, d, t = F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10
    rows = table.select(
        *LINE_KEYS,
        F.array(q, e, d, t).alias("u"),
        F.array(t, q, e, d).alias("v"),
        (F.lit(1000.0) + F.col("l_linenumber")).alias("d"),
        (F.lit(1.0) + F.col("l_partkey") % 9).alias("x"),
        *extra,
    )
    return Hodlr(rows, LINE_KEYS, rank=4)


@query(
    "hodlr_lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (1 + l_partkey % 9)::DOUBLE AS x FROM lineitem",
)
def hodlr_lineitem(spark, folder):
    """The large case: as many matrix rows as line items."""
    h = with_rhs(lineitem_system(spark, folder), "x")
    return first_x(h.solve("b", leaf=32, nrhs=1), *LINE_KEYS)


@query("hodlr_lineitem_residual", "SELECT true AS ok, count(*) AS n FROM lineitem")
def hodlr_lineitem_residual(spark, folder):
    """A right-hand side taken from the table, so the answer is not known beforehand."""
    return put_back(lineitem_system(spark, folder, "l_quantity"), "l_quantity", leaf=32)


@query("hodlr_sparse_rhs", "SELECT true AS ok, count(*) AS n FROM customer")
def hodlr_sparse_rhs(spark, folder):
    """Order totals per customer on the right; customers without orders are zero there, and stay."""
    customers = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("i"),
        F.array(F.lit(1.0), F.col("c_acctbal") / 1e4).alias("u"),
        F.array(F.col("c_acctbal") / 1e4, F.lit(0.5)).alias("v"),
        (F.lit(1000.0) + F.col("c_custkey") % 5).alias("d"),
    )
    orders = read_table(spark, folder, "orders")
    totals = orders.groupBy(F.col("o_custkey").alias("i")).agg(F.sum("o_totalprice").alias("b"))
    totals = totals.join(customers.select("i"), "i", "left_semi")
    full = customers.join(totals, "i", "left").fillna(0.0, ["b"])
    system = Hodlr(customers, rank=2)
    solved = system.solve(totals, leaf=32, keep=["u", "v", "d"])
    back = Hodlr(solved.withColumn("z", F.col("x")[0]).join(full.select("i", "b"), "i"), rank=2)
    n = solved.agg(F.count("*").alias("n")).scalar()
    return back.residual("z", "b").select((F.col("relative") < 1e-12).alias("ok"), n.alias("n"))
