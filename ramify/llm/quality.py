"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: ``target`` from the rows labelled
good (at most ``LABELS`` of them), ``raw`` from all rows.  N-grams are pairs of bytes, and pairs of words told apart only by
whether both words are equal; both kinds are shared by all texts, so a text that the labels
missed is judged like one that they hold.  Every document counts once in a model, whatever
its length, else a few long ones would shift the mix of languages in one of them.

A text's weight is its mean log(target / raw) times ``LENGTH``: neighbouring n-grams are far from
independent, and the plain sum would make any small shift between the models certain.  A few
n-grams (``SHORT``) of neutral weight are added to the mean, so very short texts are not
rejected for one odd word.

The sample is Gumbel top-k: the k rows with the largest ``weight + noise``, which draws k rows
without replacement in proportion to exp(weight).  k is the number of rows whose mean is at
least ``FLOOR``.  Noise is a hash of the row, so a lost task draws the same numbers again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.texts import mixed, pieces, tidy, word_hashes
from ramify.session import RunFolder

BINS = 1 << 12
#: Effective number of n-grams of a text, neutral n-grams added, least mean of an accepted row.
LENGTH, SHORT, FLOOR = 64.0, 64, -0.06
#: Good labels that the target model is made from, at most.
LABELS = 1 << 16
#: Every bin gets this share of the mean bin, so none is empty.
SMOOTH = 1e-4
#: A document's whole count; counts are whole numbers, so sums do not depend on their order.
UNIT = 1 << 30

#: Bin of each pair of bytes; 0 is no n-gram, 1 a repeated word, 2 a changed one.
_PAIRS = (mixed(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BINS - 3)).astype(np.int64) + 3


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins of byte pairs, row of each), (bins of word pairs, row of each)."""
    bins = np.zeros(len(data), np.int64)
    bins[:-1] = _PAIRS[data[:-1].astype(np.int64) << 8 | data[1:]]
    filled = offsets[1:] > offsets[:-1]
    bins[offsets[1:][filled] - 1] = 0
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hashes, of = word_hashes(data, offsets)
    same = of[1:] == of[:-1]
    return bins, row, np.where(hashes[1:] == hashes[:-1], 1, 2)[same], of[1:][same]


def fit(docs: DataFrame, text: str, good: Column) -> np.ndarray:
    """log(target / raw) per bin, from every row; ``good`` marks the rows of the target.

    Without a good row that has text, all weights are 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BINS), np.int64)
        for batch in batches:
            target = batch.column("g").to_numpy(zero_copy_only=False).astype(bool)
            for first, last, data, offsets in pieces(batch.column("t")):
                bins, row, more, of = _grams(data, offsets)
                n = last - first
                sizes = np.bincount(row, bins > 0, n) + np.bincount(of, minlength=n)
                each = (UNIT / np.maximum(sizes, 1)).astype(np.int64).astype(float)
                for side, taken in ((0, np.ones(n)), (1, target[first:last].astype(float))):
                    share = each * taken
                    sums[side] += (np.bincount(bins, share[row], BINS) + np.bincount(more, share[of], BINS)).astype(np.int64)
        sums[:, 0] = 0
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bin", "raw", "target"])

    rows = docs.select(F.col(text).alias("t"), F.coalesce(good, F.lit(False)).alias("g"))
    sums = rows.mapInArrow(tidy(count), "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BINS), np.zeros(BINS)
    for r in sums.collect():  # at most BINS rows
        raw[r["bin"]], target[r["bin"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BINS)
    share = lambda x: np.log(x + SMOOTH * x.mean()) - np.log((x + SMOOTH * x.mean()).sum())
    weights = share(target) - share(raw)
    weights[0] = 0
    return weights


def _plain(docs: DataFrame) -> list[str]:
    return [c for c, k in docs.dtypes if k in ("string", "bigint", "int")]


def weigh(docs: DataFrame, text: str, weights: np.ndarray) -> DataFrame:
    """``docs`` with __mean (mean log ratio) and __key (LENGTH * mean + Gumbel noise).

    A null or empty text has mean 0.  The noise hashes the row's strings and whole numbers, so
    rows that repeat have equal keys.
    """
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean = np.zeros(batch.num_rows)
            for first, last, data, offsets in pieces(batch.column(at)):
                bins, row, more, of = _grams(data, offsets)
                n = last - first
                size = np.bincount(row, bins > 0, n) + np.bincount(of, minlength=n)
                mean[first:last] = (np.bincount(row, weights[bins], n) + np.bincount(of, weights[more], n)) / (size + SHORT)
            u = (batch.column(batch.num_columns - 1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) + 0.5
            noise = -np.log(-np.log(u / 2.0**53))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(mean), pa.array(LENGTH * mean + noise)], names=[*batch.schema.names[:-1], "__mean", "__key"])

    hashed = docs.withColumn("__noise", F.xxhash64(F.lit("gumbel"), *_plain(docs)))
    kept = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return hashed.mapInArrow(tidy(score), f"{kept}, __mean double, __key double")


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a column of finite doubles (k from 1), by counting in ever smaller bins.

    Each pass counts 4,096 equal bins of the range that holds it, and goes on with the least and
    the greatest value in its bin, until these are equal.  No rows are sorted or gathered.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / 4096
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(4095)) if width > 1e-300 else (F.col(column) > low).cast("long")
        within = values.where(F.col(column).between(low, high)).groupBy(place.alias("bin"))
        rows = sorted(within.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["bin"])
        for r in rows:
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
    return low


def labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """``docs`` with column __good: labelled 1 (labels that disagree: their mean is 1/2 or more).

    Of more than ``limit`` good labels those with the least hashes are used, so what is sent to
    all tasks is bounded and the texts are not shuffled.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    votes = known.groupBy(F.col("doc_id").alias("__id")).agg(F.avg("quality").alias("q")).where(F.col("q") >= 0.5)
    votes = votes.orderBy(F.xxhash64("__id"), "__id").limit(limit).select("__id", F.lit(True).alias("__good"))
    return docs.join(F.broadcast(votes), docs["doc_id"] == votes["__id"], "left").drop("__id")


class Sampler:
    """The models and the limit of one table; ``decide`` tells which rows the sample takes.

    Without a good label nothing can be told apart, and every row is kept.  An empty
    table keeps nothing.  Rows with equal keys are taken or left together.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, text: str = "text"):
        self.text = text
        plain = docs.select(*_plain(docs))
        self.weights = fit(labelled(docs.select("doc_id", text), labels), text, F.col("__good"))
        self.scores = RunFolder(docs.sparkSession).cut(weigh(plain, text, self.weights).select("doc_id", "__mean", "__key"), "scores")
        self.size = self.scores.agg(F.sum((F.col("__mean") >= FLOOR).cast("long"))).first()[0] or 0
        self.limit = kth_largest(self.scores, "__key", self.size) if self.size else float("inf")

    def taken(self) -> Column:
        return F.lit(True) if not self.weights.any() else F.col("__key") >= F.lit(self.limit)

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` (the same table) that the sample takes."""
        return weigh(docs, self.text, self.weights).where(self.taken()).select(*docs.columns)
