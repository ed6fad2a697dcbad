"""Seeded random matrices: only seeds are kept, entries are made where they are used.

The stream is the 48-bit generator of the rand48 family.  A part's entries are drawn
row by row from its own seed; part seeds are 31-bit draws from one given seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.functions.algebra import Matrix, Vector
from ramify.operators.kernels import lcg_states, list_column, uniform, uniform_many

#: Entries drawn per emitted batch.
DRAWS = 1 << 17


def part_seeds(spark: SparkSession, parts: int, **masters: int) -> DataFrame:
    """``(part, <name> ...)``: one 31-bit seed per part and master seed.

    Every task jumps to its place in the masters' streams.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            columns = [batch.column("id")]
            for master in masters.values():
                states = lcg_states(master, int(ids[0]), len(ids))
                columns.append(pa.array((states >> np.uint64(17)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["part", *masters])

    schema = ", ".join(["part bigint", *[f"{name} bigint" for name in masters]])
    return spark.range(parts).mapInArrow(draw, schema)


def seeded_rows(seeds: DataFrame, part_rows: int, cols: int, offset: int = 0, rows: int | None = None) -> DataFrame:
    """``(i, row)`` of the parts in ``(part, seed)``: uniform [0, 1) draws plus ``offset``.

    ``rows`` ends the last part early.
    """
    step = max(1, DRAWS // cols)
    together = step // part_rows

    def draw_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of few rows, many at once."""
        for batch in batches:
            parts, seeds = batch.column("part").to_numpy(), batch.column("seed").to_numpy()
            for at in range(0, len(parts), together):
                own = slice(at, at + together)
                values = uniform_many(seeds[own], part_rows * cols).reshape(-1, cols) + offset
                ids = (parts[own][:, None] * part_rows + np.arange(part_rows)).ravel()
                if rows is not None:
                    values, ids = values[ids < rows], ids[ids < rows]
                yield pa.RecordBatch.from_arrays([pa.array(ids), list_column(values)], ["i", "row"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seed in zip(batch.column("part").to_pylist(), batch.column("seed").to_pylist()):
                own = part_rows if rows is None else max(0, min(part_rows, rows - part * part_rows))
                for at in range(0, own, step):
                    n = min(step, own - at)
                    values = uniform(seed, at * cols, n * cols).reshape(n, cols) + offset
                    first = part * part_rows + at
                    ids = pa.array(np.arange(first, first + n, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([ids, list_column(values)], ["i", "row"])

    seeds = seeds.select(F.col("part").cast("bigint"), F.col("seed").cast("bigint"))
    return seeds.mapInArrow(draw_parts if together > 1 else draw, "i bigint, row array<double>")


def random_matrix(spark: SparkSession, rows: int, cols: int, parts: int, seed: int, offset: int = 0) -> Matrix:
    frame = seeded_rows(part_seeds(spark, parts, seed=seed), -(-rows // parts), cols, offset, rows)
    m = Matrix.from_rows(frame, "i", "row", cols, rows)
    m.parts = parts
    return m


def random_vector(spark: SparkSession, rows: int, parts: int, seed: int, offset: int = 0) -> Vector:
    m = random_matrix(spark, rows, 1, parts, seed, offset)
    return Vector(m.by_row.select("i", F.col("row")[0].alias("v")), rows, parts, offset)


def map_seeds(seeds: DataFrame, per_part: int) -> DataFrame:
    """Seeds of several matrices grouped ``per_part`` to a coarser part: ``(part, blk, <name> ...)``."""
    names = [c for c in seeds.columns if c != "part"]
    return seeds.select(
        F.expr(f"part div {per_part}").alias("part"), F.expr(f"cast(part % {per_part} as int)").alias("blk"), *names
    )


def seeded_system(spark: SparkSession, leaf: int, level: int, rank: int, seed: int, offset: int = 1000) -> DataFrame:
    """Rows ``(i, u, v, d, b)`` of a random system with one seed per leaf and matrix.

    The four seeds of a leaf sit in one row, so the leaf's rows are made together and
    nothing is joined or shuffled.
    """
    masters = {name: seed + k for k, name in enumerate(("u", "v", "d", "b"))}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["part"] * leaf
                columns = [pa.array(np.arange(first, first + leaf, dtype=np.int64))]
                for name in ("u", "v"):
                    columns.append(list_column(uniform(row[name], 0, leaf * rank).reshape(leaf, rank)))
                columns.append(pa.array(uniform(row["d"], 0, leaf) + offset))
                columns.append(pa.array(uniform(row["b"], 0, leaf)))
                yield pa.RecordBatch.from_arrays(columns, ["i", "u", "v", "d", "b"])

    schema = "i bigint, u array<double>, v array<double>, d double, b double"
    return part_seeds(spark, 1 << level, **masters).mapInArrow(draw, schema)
