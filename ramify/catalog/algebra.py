"""Queries for the entry-wise algebra: generators, slices, sums, products, norms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramify.catalog.base import (
    BASE,
    Known,
    balances,
    entries,
    query,
    rounded,
    spending,
    supply,
    values,
)
from ramify.functions.algebra import Matrix, Vector
from ramify.plans.hodlr import Hodlr
from ramify.sources.generators import map_seeds, part_seeds, random_matrix, random_vector, seeded_rows
from ramify.sources.tables import read_table, spread

SPEND = "SELECT o_custkey AS i, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey"
SUPPLY = (
    "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v, sum(l_linenumber)::DOUBLE AS w "
    "FROM lineitem GROUP BY ALL"
)

# -- constants and random entries ---------------------------------------------


@query("vec_constant", "SELECT c_custkey AS i, 3.0::DOUBLE AS v FROM customer")
def vec_constant(spark, folder):
    return Vector.constant(spark, 3, read_table(spark, folder, "customer").count()).df


@query("mat_constant", "SELECT p_partkey AS i, unnest(range(4)) AS j, 17.0::DOUBLE AS v FROM part")
def mat_constant(spark, folder):
    return Matrix.constant(spark, 17, read_table(spark, folder, "part").count(), 4).df


@query("mat_identity", "SELECT p_partkey AS i, p_partkey AS j, 1.0::DOUBLE AS v FROM part")
def mat_identity(spark, folder):
    return Matrix.identity(spark, read_table(spark, folder, "part").count()).df


#: Generator steps in SQL: the first state of a seed, the next state.
FIRST = "((({seed})::HUGEINT * 65536 + 13070) * 25214903917 + 11) % 281474976710656"
NEXT = "({x} * 25214903917 + 11) % 281474976710656"


def seed_rows(name: str, seed: str, parts: str) -> str:
    """Recursive SQL for the part seeds drawn from one seed."""
    return f"""{name}_x(part, x) AS (SELECT 0::BIGINT, {FIRST.format(seed=seed)}
  UNION ALL SELECT part + 1, {NEXT.format(x="x")} FROM {name}_x WHERE part + 1 < {parts}),
{name} AS (SELECT part, (x // 131072)::BIGINT AS seed FROM {name}_x)"""


def draw_rows(seeds: str, count: str) -> str:
    """Recursive SQL for the first ``count`` draws of every seed."""
    return f"""draws(part, k, x) AS (SELECT part, 0::BIGINT, {FIRST.format(seed="seed")} FROM {seeds}
  UNION ALL SELECT part, k + 1, {NEXT.format(x="x")} FROM draws WHERE k + 1 < {count})"""


@query(
    "rand_seeds",
    f"WITH RECURSIVE {seed_rows('s', '42', '(SELECT count(*) FROM supplier)')} SELECT part, seed FROM s",
)
def rand_seeds(spark, folder):
    return part_seeds(spark, read_table(spark, folder, "supplier").count(), seed=42)


@query(
    "vec_rand",
    f"""WITH RECURSIVE {seed_rows("s", "42", "4")},
{draw_rows("s", "(SELECT (count(*) + 3) // 4 FROM customer)")}
SELECT part * (SELECT (count(*) + 3) // 4 FROM customer) + k AS i, x::DOUBLE / 281474976710656.0 + 100 AS v FROM draws
WHERE part * (SELECT (count(*) + 3) // 4 FROM customer) + k < (SELECT count(*) FROM customer)""",
)
def vec_rand(spark, folder):
    return random_vector(spark, read_table(spark, folder, "customer").count(), 4, seed=42, offset=100).df


@query(
    "mat_rand",
    f"""WITH RECURSIVE {seed_rows("s", "7", "(SELECT count(*) FROM supplier)")}, {draw_rows("s", "24")}
SELECT part * 8 + k // 3 AS i, k % 3 AS j, x::DOUBLE / 281474976710656.0 AS v FROM draws""",
)
def mat_rand(spark, folder):
    parts = read_table(spark, folder, "supplier").count()
    return random_matrix(spark, parts * 8, 3, parts, seed=7).df


@query(
    "block_rand",
    f"""WITH RECURSIVE s AS (SELECT c_custkey AS part, c_custkey + 1 AS seed FROM customer), {draw_rows("s", "6")}
SELECT part * 2 + k // 3 AS i, k % 3 AS j, x::DOUBLE / 281474976710656.0 AS v FROM draws""",
)
def block_rand(spark, folder):
    """A 2-by-3 block per customer, seeded by the customer's key."""
    customer = spread(read_table(spark, folder, "customer"), "c_custkey")
    seeds = customer.select(F.col("c_custkey").alias("part"), (F.col("c_custkey") + 1).alias("seed"))
    rows = seeded_rows(seeds, 2, 3)
    return Matrix.from_rows(rows, "i", "row", 3, customer.count() * 2).df


@query(
    "map_seeds",
    f"""WITH RECURSIVE {seed_rows("u", "1", "(SELECT count(*) FROM supplier)")},
{seed_rows("v", "2", "(SELECT count(*) FROM supplier)")}, {seed_rows("d", "3", "(SELECT count(*) FROM supplier)")}
SELECT part // 4 AS part, (part % 4)::INT AS blk, u.seed AS u_seed, v.seed AS v_seed, d.seed AS d_seed
FROM u JOIN v USING (part) JOIN d USING (part)""",
)
def seeds_per_part(spark, folder):
    n = read_table(spark, folder, "supplier").count()
    return map_seeds(part_seeds(spark, n, u_seed=1, v_seed=2, d_seed=3), 4)


# -- entries and slices -------------------------------------------------------


@query("vec_entry", "SELECT c_custkey AS i, c_acctbal AS v FROM customer WHERE c_custkey = 7")
def vec_entry(spark, folder):
    return balances(spark, folder).entry(7)


@query("mat_entry", BASE + "SELECT i, j, v FROM E WHERE i = 11 AND j = 5")
def mat_entry(spark, folder):
    return Known(spark, folder).u.entry(11, 5)


@query(
    "mat_block",
    BASE + "SELECT i - n // 4 AS i, j - 8 AS j, v FROM E, N WHERE i >= n // 4 AND i < n // 2 AND j BETWEEN 8 AND 23",
)
def mat_block(spark, folder):
    e = Known(spark, folder).u
    return e.block(e.rows // 4, e.rows // 2, 8, 24).df


@query("mat_row_block", BASE + "SELECT i - n // 2 AS i, j, v FROM E, N WHERE i >= n // 2")
def mat_row_block(spark, folder):
    e = Known(spark, folder).u
    return e.row_block(e.rows // 2, e.rows).df


@query("mat_transpose", BASE + "SELECT j AS i, i AS j, v FROM E")
def mat_transpose(spark, folder):
    return Known(spark, folder).u.T.df


@query("vec_to_diag", "SELECT c_custkey AS i, c_custkey AS j, c_acctbal AS v FROM customer")
def vec_to_diag(spark, folder):
    return balances(spark, folder).diagonal().df


# -- element-wise -------------------------------------------------------------


@query("vec_scale", "SELECT c_custkey AS i, round(2.5::DOUBLE * c_acctbal, 6) + 0.0 AS v FROM customer")
def vec_scale(spark, folder):
    return values(2.5 * balances(spark, folder))


@query("mat_scale", BASE + "SELECT i, j, round(-0.5::DOUBLE * v, 6) + 0.0 AS v FROM E")
def mat_scale(spark, folder):
    return entries(-0.5 * Known(spark, folder).u)


@query(
    "vec_add",
    f"""SELECT c_custkey AS i, round(c_acctbal + coalesce(s.v, 0), 2) + 0.0 AS v
FROM customer LEFT JOIN ({SPEND}) s ON s.i = c_custkey""",
)
def vec_add(spark, folder):
    return values(balances(spark, folder) + spending(spark, folder), 2)


@query(
    "vec_sub",
    f"""SELECT c_custkey AS i, round(c_acctbal - coalesce(s.v, 0), 2) + 0.0 AS v
FROM customer LEFT JOIN ({SPEND}) s ON s.i = c_custkey""",
)
def vec_sub(spark, folder):
    return values(balances(spark, folder) - spending(spark, folder), 2)


@query("mat_add", BASE + "SELECT i, j, round(E.v + V.v, 6) + 0.0 AS v FROM E JOIN V USING (i, j)")
def mat_add(spark, folder):
    known = Known(spark, folder)
    return entries(known.u + known.v)


@query("mat_sub", BASE + "SELECT i, j, round(E.v - V.v, 6) + 0.0 AS v FROM E JOIN V USING (i, j)")
def mat_sub(spark, folder):
    known = Known(spark, folder)
    return entries(known.u - known.v)


@query("sparse_mat_axpby", f"SELECT i, j, round(2.0::DOUBLE * v - 0.5::DOUBLE * w, 6) + 0.0 AS v FROM ({SUPPLY})")
def sparse_mat_axpby(spark, folder):
    return entries(supply(spark, folder).combine(2.0, supply(spark, folder, "l_linenumber"), -0.5))


@query(
    "vec_hadamard",
    """SELECT c_custkey AS i, round(c_acctbal * s.v, 2) + 0.0 AS v
FROM customer JOIN (SELECT o_custkey AS i, count(*)::DOUBLE AS v FROM orders GROUP BY o_custkey) s ON s.i = c_custkey""",
)
def vec_hadamard(spark, folder):
    """Balance times number of orders; an exact count keeps the product free of summation order."""
    counts = read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("v"))
    balance = balances(spark, folder)
    return values(balance.multiply(Vector.from_column(counts, "o_custkey", "v", balance.rows)), 2)


@query("diag_times_matrix", BASE + "SELECT i, j, round(d * v, 6) + 0.0 AS v FROM E JOIN X USING (i)")
def diag_times_matrix(spark, folder):
    known = Known(spark, folder)
    return entries(known.d.multiply(known.u))


@query(
    "diag_times_sparse",
    f"SELECT i, j, round(s_acctbal * v, 2) + 0.0 AS v FROM ({SUPPLY}) JOIN supplier ON s_suppkey = i",
)
def diag_times_sparse(spark, folder):
    scale = Vector.from_column(read_table(spark, folder, "supplier"), "s_suppkey", "s_acctbal")
    return entries(scale.multiply(supply(spark, folder)), 2)


@query(
    "vec_equal_tol",
    f"""SELECT max(abs(coalesce(s.v, 0) - c_acctbal)) <= 1e-10 AS equal
FROM customer LEFT JOIN ({SPEND}) s ON s.i = c_custkey""",
)
def vec_equal_tol(spark, folder):
    return spending(spark, folder).equals(balances(spark, folder))


@query("mat_equal_tol", BASE + "SELECT max(abs(a.v - (2 * a.v - b.v))) <= 1e-10 AS equal FROM E a JOIN E b USING (i, j)")
def mat_equal_tol(spark, folder):
    e = Known(spark, folder).u
    return e.equals(2 * e - e)


# -- products and norms -------------------------------------------------------


@query("vec_norm2", "SELECT round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS norm FROM customer")
def vec_norm2(spark, folder):
    return balances(spark, folder).norm().select(F.round("norm", 4).alias("norm"))


@query("mat_frobenius", BASE + "SELECT round(sqrt(sum(v * v)), 6) AS norm FROM E")
def mat_frobenius(spark, folder):
    return Known(spark, folder).u.norm().select(F.round("norm", 6).alias("norm"))


@query("mat_vec", BASE + "SELECT E.i, round(sum(v * (1 + j)), 6) + 0.0 AS v FROM E GROUP BY E.i")
def mat_vec(spark, folder):
    e = Known(spark, folder).u
    steps = spark.range(e.cols).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v"))
    return values(e * Vector(steps, e.cols))


@query("mat_t_vec", BASE + "SELECT j AS i, round(sum(v * x), 6) + 0.0 AS v FROM E JOIN X USING (i) GROUP BY j")
def mat_t_vec(spark, folder):
    known = Known(spark, folder)
    return values(known.u.T * known.x)


@query(
    "sparse_mat_vec",
    f"SELECT i, round(sum(v * p_retailprice), 2) + 0.0 AS v FROM ({SUPPLY}) JOIN part ON p_partkey = j GROUP BY i",
)
def sparse_mat_vec(spark, folder):
    price = Vector.from_column(read_table(spark, folder, "part"), "p_partkey", "p_retailprice")
    return values(supply(spark, folder) * price, 2)


@query(
    "mat_mat_gram",
    BASE + "SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM E a JOIN E b USING (i) GROUP BY ALL",
)
def mat_mat_gram(spark, folder):
    e = Known(spark, folder).u
    return entries(e.T * e)


@query(
    "mat_mat_tall",
    BASE
    + """, P AS (SELECT E.j AS k, V.j, sum(E.v * V.v) AS v FROM E JOIN V USING (i) GROUP BY 1, 2)
SELECT E.i, P.j, round(sum(E.v * P.v), 6) + 0.0 AS v FROM E JOIN P ON E.j = P.k GROUP BY 1, 2""",
)
def mat_mat_tall(spark, folder):
    """All embedding rows times the 64-by-64 matrix ``E'V`` made of all rows."""
    known = Known(spark, folder)
    return entries(known.u * (known.u.T * known.v))


@query(
    "sparse_mat_mat",
    f"""WITH S AS ({SUPPLY})
SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM S a JOIN S b ON a.j = b.j GROUP BY a.i, b.i""",
)
def sparse_mat_mat(spark, folder):
    s = supply(spark, folder)
    return (s * s.T).df


LOW_RANK = """, y AS (SELECT V.j, sum(V.v * X.x) AS y FROM V JOIN X USING (i) GROUP BY V.j),
b AS (SELECT E.i, sum(E.v * y.y) + any_value(X.d * X.x) AS v FROM E JOIN y USING (j) JOIN X ON X.i = E.i GROUP BY E.i)
"""


@query("low_rank_matvec", BASE + LOW_RANK + "SELECT i, round(v, 6) + 0.0 AS v FROM b")
def low_rank_matvec(spark, folder):
    """``U (V' x) + D x`` entry-wise, always from the right."""
    known = Known(spark, folder)
    u, v, d, x = known.u, known.v, known.d, known.x
    return values(u * (v.T * x) + d.multiply(x))


@query("system_matvec", BASE + LOW_RANK + "SELECT i, round(v, 6) + 0.0 AS v FROM b")
def system_matvec(spark, folder):
    """The same product on row frames: one scan for ``V' x``, one for the rows."""
    known = Known(spark, folder)
    u, v, d, x = known.u, known.v, known.d, known.x
    system = Hodlr.from_matrices(u, v, d)
    system.system = system.system.join(x.df.withColumnRenamed("v", "x"), "i")
    return system.matvec("x").select("i", rounded("v").alias("v"))
