"""Exact top-k inner products through a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it.  Each pivot's
vectors, in the order of distance, are cut into rings (annuli), and a ring is stored
as chunks of bounded size.  The triangle inequality bounds the score of everything
in a ring from the distances query-pivot and pivot-ring alone:

    q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2,   |q-x| >= max(0, d(q,p) - far, near - d(q,p))

A query first opens the rings with the best bounds, which gives the score that its
k-th best must reach; then it opens every further ring whose bound reaches that
score, and stops.  Results are exact, whatever the pivots.

Pivots come from a bounded sample; every vector is indexed.  Rings are at most
``PIVOTS * RINGS`` whatever the size of the table, so their list is the only thing
sent to all tasks.  A ring with many vectors (a vector that repeats, say) is many chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ramify.session import RunFolder

PIVOTS = 32
RINGS = 16
#: Rows from which pivots are chosen and ring limits are estimated.
SAMPLE = 8192
CHUNK_ROWS = 2048
QUERY_ROWS = 512
#: Rings that a query opens before it has a score to reach.
FIRST_RINGS = 4


def scaled(table: DataFrame, key: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(id, v): components as floor(scale * x); vectors that are null or hold a null or
    non-finite component are left out, as are those without a key."""
    x = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("double"))
    return table.where(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    if len(values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, at] = values
    return out


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each the sampled vector farthest from those before it."""
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if nearest.max() <= 0:
            break
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    pivot = square.argmin(1)
    return pivot, np.sqrt(((x - pivots[pivot]) ** 2).sum(1))


def _bounds(q: np.ndarray, pivots: np.ndarray, rings: dict[str, np.ndarray]) -> np.ndarray:
    """Largest score that each ring can hold for each query, a little rounded up."""
    norm = np.sqrt((q * q).sum(1))[:, None]
    to = np.sqrt(((q[:, None, :] - pivots[None]) ** 2).sum(2))[:, rings["pivot"]]
    gap = np.maximum(0, np.maximum(to - rings["far"], rings["near"] - to))
    by_ring = (norm**2 + rings["norm"] ** 2 - gap**2) / 2
    by_pivot = (q @ pivots.T)[:, rings["pivot"]] + norm * rings["far"]
    bound = np.minimum(np.minimum(by_ring, by_pivot), norm * rings["norm"])
    return bound + 1e-9 * (1 + np.abs(bound) + norm * rings["norm"])


class PivotIndex:
    """The index over (id, v) rows, written to the shared folder."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS):
        self.spark: SparkSession = vectors.sparkSession
        self.folder = RunFolder(self.spark)
        sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow().column("v")
        width = vectors.agg(F.max(F.size("v"))).first()[0]
        self.width = max(1, int(width or 0))
        sampled = _matrix(sample, self.width)
        self.pivots = _farthest_first(sampled, pivots) if len(sampled) else np.zeros((1, self.width))
        home, far = _nearest(sampled, self.pivots) if len(sampled) else (np.zeros(0, int), np.zeros(0))
        levels = np.linspace(0, 1, rings + 1)[1:-1]
        self.limits = [np.quantile(far[home == p], levels) if (home == p).any() else np.zeros(0) for p in range(len(self.pivots))]
        self.chunks = self.folder.cut(self._chunks(vectors), "chunks")
        self.rings = self._measure()

    def _chunks(self, vectors: DataFrame) -> DataFrame:
        """One row per chunk: ring, near and far distance, largest norm, ids, components."""
        pivots, limits, width = self.pivots, self.limits, self.width

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"), width)
                pivot, far = _nearest(x, pivots)
                ring = np.zeros(len(x), np.int32)
                for p in np.unique(pivot):
                    ring[pivot == p] = np.searchsorted(limits[p], far[pivot == p], "left")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot.astype(np.int32)), pa.array(ring), pa.array(far), batch.column("id"), batch.column("v")],
                    names=["pivot", "ring", "far", "id", "v"],
                )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"), width)
                if width * (np.abs(x).max(initial=0.0) ** 2) >= 2**53:
                    raise ValueError("inner products of these vectors are not exact in double precision")
                pivot, ring, far, ids = (batch.column(i).to_numpy() for i in range(4))
                edges = np.flatnonzero(np.diff(pivot) | np.diff(ring)) + 1
                rows = []
                for a, b in zip([0, *edges], [*edges, len(x)], strict=True):
                    for lo in range(a, b, CHUNK_ROWS):
                        hi = min(b, lo + CHUNK_ROWS)
                        norm = np.sqrt((x[lo:hi] ** 2).sum(1).max())
                        rows.append((int(pivot[lo]), int(ring[lo]), float(far[lo:hi].min()), float(far[lo:hi].max()), float(norm), ids[lo:hi].tobytes(), x[lo:hi].tobytes()))
                if rows:
                    yield _batch(rows, pivot=pa.int32(), ring=pa.int32(), near=pa.float64(), far=pa.float64(), norm=pa.float64(), ids=pa.binary(), xs=pa.binary())

        keyed = vectors.mapInArrow(key, "pivot int, ring int, far double, id long, v array<double>")
        ordered = keyed.repartitionByRange("pivot", "ring", "far", "id").sortWithinPartitions("pivot", "ring", "far", "id")
        return ordered.mapInArrow(cut, "pivot int, ring int, near double, far double, norm double, ids binary, xs binary")

    def _measure(self) -> dict[str, np.ndarray]:
        """Each ring's limits: at most pivots * rings rows."""
        rows = self.chunks.groupBy("pivot", "ring").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
        names = ("pivot", "ring", "near", "far", "norm")
        return {n: np.array([r[n] for r in rows], float if i > 1 else int) for i, n in enumerate(names)}

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best rows of each query, without the query itself.

        Ties go to the smaller id; fewer than k candidates give fewer rows; no candidates none.
        ``queries`` has (id, v) rows in the same scale; an id that repeats is one query (its
        smallest vector), while as candidates repeated rows all count.
        """
        queries = queries.groupBy("id").agg(F.min("v").alias("v"))
        if not len(self.rings["ring"]):
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        first = self.folder.cut(self._score(queries.select("id", "v", F.lit(None).cast("long").alias("least")), k), "first")
        best = _best(first, k)
        reach = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        again = self._score(queries.join(reach, "id", "left").select("id", "v", F.coalesce("least", F.lit(-(2**62))).alias("least")), k)
        return _best(first.unionByName(again), k)

    def _score(self, queries: DataFrame, k: int) -> DataFrame:
        """Scores in the first rings (``least`` null), or in all later rings that reach ``least``."""
        width, rings, pivots = self.width, self.rings, self.pivots

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("v"), width)
                ids, least = batch.column("id").to_numpy(), batch.column("least")
                for lo in range(0, len(q), QUERY_ROWS):
                    part = slice(lo, lo + QUERY_ROWS)
                    bound = _bounds(q[part], pivots, rings)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    leading = np.zeros(bound.shape, bool)
                    np.put_along_axis(leading, order[:, :FIRST_RINGS], True, 1)
                    if least[lo].as_py() is None:
                        wanted = leading
                    else:
                        wanted = ~leading & (bound >= least.to_numpy()[part][:, None])
                    cols = np.flatnonzero(wanted.any(0))
                    if len(cols):
                        rows = [(int(rings["pivot"][c]), int(rings["ring"][c]), ids[part][wanted[:, c]].tobytes(), q[part][wanted[:, c]].tobytes()) for c in cols]
                        yield _batch(rows, pivot=pa.int32(), ring=pa.int32(), qids=pa.binary(), qs=pa.binary())

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, xs, qids, qs = (batch.column(n)[i].as_buffer() for n in ("ids", "xs", "qids", "qs"))
                    ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                    got = np.frombuffer(qs).reshape(len(qids), width) @ np.frombuffer(xs).reshape(len(ids), width).T
                    got[qids[:, None] == ids[None]] = -np.inf
                    if len(ids) > k:
                        edge = np.partition(got, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
                        keep = (got >= edge) & (got > -np.inf)
                    else:
                        keep = got > -np.inf
                    a, b = np.nonzero(keep)
                    order = np.lexsort((ids[b], -got[a, b], a))
                    a, b = a[order], b[order]
                    place = np.arange(len(a)) - np.searchsorted(a, a, "left")
                    a, b = a[place < k], b[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(ids[b]), pa.array(got[a, b].astype(np.int64))], names=["query_id", "vec_id", "score"])

        wanted = queries.mapInArrow(opened, "pivot int, ring int, qids binary, qs binary")
        pairs = self.chunks.select("pivot", "ring", "ids", "xs").join(wanted, ["pivot", "ring"])
        return pairs.select("ids", "xs", "qids", "qs").mapInArrow(score, "query_id long, vec_id long, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
