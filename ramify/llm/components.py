"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.session import RunFolder


#: Edges of a task, where the number of tasks is fitted to them.
TASK_EDGES = 20_000


def components(edges: DataFrame, folder: RunFolder | None = None, fitted: bool = False) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node it reaches.

    Each round links neighbours to the least node around them, first those above a node and
    then those below it, so a component becomes a star around its least node in a logarithmic
    number of rounds.  Every round is written to the shared folder; only counts
    reach the driver.  Neighbours are never listed, only their minimum is taken, so a node with
    very many edges is a skewed join, which Spark splits.

    The tables are written to ``folder``, which may be released once the result is stored.  ``fitted``
    writes them in as many parts as their edges need, for calls with few edges.
    """
    folder = folder or RunFolder(edges.sparkSession)
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, step, before = folder.cut(pairs, "edges0"), 0, None
    # the number of edges never grows
    parts = 1 + pairs.count() // TASK_EDGES if fitted else 0
    few = lambda df: df.coalesce(parts) if fitted else df
    while True:
        # large star: the neighbours of a node that lie above it meet its least neighbour
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = folder.cut(few(large.where(F.col("a") != F.col("b")).distinct()), f"large{step}")
        # small star: a node and its lower neighbours meet the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = folder.cut(few(small.where(F.col("a") != F.col("b")).distinct()), f"small{step}")
        step += 1
        now = pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if now == before and now[0] == now[2] or not now[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
