"""SimHash near-duplicates: segment popcounts, a grid range join, exact verification.

A fingerprint is one or more 64-bit words.  It is mapped to the bit counts of its two-bit
segments; the Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints.  Grid cells are exact counts on some of the segments:

* ``complete_grid``: the segments form bands, and a cell fixes all but ``radius`` of them.  Vectors
  within Manhattan distance ``radius`` differ in at most ``radius`` bands, so they meet in
  at least one cell: no pair within the radius is lost.
* ``sparse_grid``: each cell fixes one band of one word, for distances too large for that.  A pair is
  found where at least one of many bands agrees.

Inside a cell, rows are ordered by their total bit count, and a row is compared with those whose
count is at most ``radius`` away: a lower bound again.  Hamming distances decide.
Cells are cut into blocks of bounded size, and blocks meet in pairs, so no cell
is gathered in one task.  A task joins what it links with union-find and hands on a
forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.components import components
from ramify.llm.texts import mixed
from ramify.session import RunFolder

SEED = 42
#: Rows of a block of a cell.
BLOCK_ROWS = 1024
_LOW = 0x5555555555555555


def fingerprint(text: bytes, words: int, length: int = 1) -> np.ndarray:
    """``length`` 64-bit words of a text: the majority of each bit over its shingles' hashes.

    Shingles are runs of ``words`` words (A-Z lower-cased, ASCII blanks between), repeats included;
    a text with fewer words is one shingle, and one without words is all zero bits.  The
    first word uses XXH64 with seed 42; further ones use bijections of it.
    """
    parts = text.lower().split()
    if not parts:
        return np.zeros(length, np.uint64)
    count = max(1, len(parts) - words + 1)
    total = np.zeros(64 * length, np.int64)
    for lo in range(0, count, 8192):
        joined = (b" ".join(parts[i : i + words]) for i in range(lo, min(count, lo + 8192)))
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64)
        wide = h[:, None] if length == 1 else np.stack([h, *(mixed(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, length))], 1)
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32) if length == 1 else np.add.reduce(bits, 0, dtype=np.int32)
    return np.packbits((2 * total > count).astype(np.uint8), bitorder="little").view(np.uint64)


def with_fingerprints(docs: DataFrame, text: str, words: int, length: int = 1) -> DataFrame:
    """``docs`` with __fp: the fingerprint's words as array<long>; null is an empty text."""
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = pc.fill_null(part.column(at).cast(pa.binary()), b"")
                prints = np.concatenate([fingerprint(t.as_py(), words, length) for t in texts]).view(np.int64)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(prints) + 1, length, dtype=np.int32)), pa.array(prints))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*batch.schema.names, "__fp"])

    kept = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(add, f"{kept}, __fp array<bigint>")


# --- grids: lists of (word, mask) ------------------------------------------------------------------


def _mask(segments: list[int]) -> int:
    mask = 0
    for s in segments:
        mask |= 3 << (2 * s)
    return mask


def complete_grid(radius: int, spare: int = 3) -> list[tuple[int, int]]:
    """Cells over the first word that keep ``spare`` of ``radius + spare`` bands: complete up to ``radius``."""
    bands = radius + spare
    return [(0, _mask([s for s in range(32) if s * bands // 32 in kept])) for kept in combinations(range(bands), spare)]


def sparse_grid(length: int, segments: int = 8) -> list[tuple[int, int]]:
    """One cell per word and band of ``segments`` segments."""
    return [(w, _mask(list(range(lo, lo + segments)))) for w in range(length) for lo in range(0, 32, segments)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _counts(word: Column) -> Column:
    """The bit counts of all two-bit segments of a word, each in its own two bits."""
    half = F.shiftrightunsigned(word, 1)
    one, two = word.bitwiseXOR(half).bitwiseAND(F.lit(_LOW)), word.bitwiseAND(half).bitwiseAND(F.lit(_LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def cells(prints: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """(cell, id, fp) for each row of (id, fp) and each cell of the grid."""
    keys = [F.xxhash64(F.lit(i), _counts(F.col("fp")[w]).bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, (w, m) in enumerate(grid)]
    return prints.select("id", "fp", F.explode(F.array(*keys)).alias("cell"))


# --- links within cells ----------------------------------------------------------------------------


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row linked to each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, lower row) of a forest of the pairs within ``radius``, rows sorted by group and bit count."""
    n = len(group)
    total = np.bitwise_count(fp).sum(1, dtype=np.int64)
    at = np.arange(n)
    root, a, b, held = np.arange(n), [], [], 0
    shift = 1
    while len(at):
        at = at[at + shift < n]
        # rows beyond this shift have ever larger counts, so a row that is out stays out
        at = at[(group[at] == group[at + shift]) & (total[at + shift] - total[at] <= radius)]
        if len(at):
            away = np.bitwise_count(fp[at, 0] ^ fp[at + shift, 0]).astype(np.int32)
            near = at
            for w in range(1, fp.shape[1]):
                if w in (1, 2, 4):
                    inside = away <= radius
                    near, away = near[inside], away[inside]
                away += np.bitwise_count(fp[near, w] ^ fp[near + shift, w])
            near = near[away <= radius]
            if len(near):
                a.append(near)
                b.append(near + shift)
                held += len(near)
                if held > 1 << 20:
                    root = _roots(n, np.concatenate([*a, at0 := np.flatnonzero(root != np.arange(n))]), np.concatenate([*b, root[at0]]))
                    a, b, held = [], [], 0
        shift += 1
    moved = np.flatnonzero(root != np.arange(n))
    root = _roots(n, np.concatenate([*a, moved]).astype(np.int64), np.concatenate([*b, root[moved]]).astype(np.int64))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links(prints: DataFrame, grid: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b): a forest in every cell of the pairs of distinct rows of (id, fp) within ``radius``."""
    placed = RunFolder(prints.sparkSession).cut(cells(prints, grid), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    placed = placed.join(sizes, "cell")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    spread = placed.select("cell", F.explode(pair).alias("pair"), "id", "fp").select(F.xxhash64("cell", "pair").alias("group"), "id", "fp")
    ordered = spread.repartition("group").sortWithinPartitions("group", F.aggregate("fp", F.lit(0), lambda s, x: s + F.bit_count(x)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def done(group: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            # one id may stand in a group twice when two cells share a hash; that links it to itself only
            above, below = _linked(group, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(ids[above]), pa.array(ids[below])], names=["a", "b"])

        for batch in batches:
            group, ids = batch.column("group").to_numpy(), batch.column("id").to_numpy()
            fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            if held is not None:
                group, ids, fp = (np.concatenate([x, y]) for x, y in zip(held, (group, ids, fp), strict=True))
            if not len(group):
                continue
            last = int(np.searchsorted(group, group[-1], "left"))
            if last:
                yield from done(group[:last], ids[:last], fp[:last])
            held = group[last:], ids[last:], fp[last:]
        if held is not None and len(held[0]):
            yield from done(*held)

    return ordered.mapInArrow(search, "a long, b long").where(F.col("a") != F.col("b")).distinct()


def near_duplicates(prints: DataFrame, grid: list[tuple[int, int]], radius: int) -> DataFrame:
    """(fp, component): the least id reachable from each distinct fingerprint, itself included.

    ``prints`` has (id, fp) rows; rows with one fingerprint count once, whatever their number.
    """
    folder = RunFolder(prints.sparkSession)
    distinct = folder.cut(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    roots = components(links(distinct, grid, radius))
    return distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component"))


def radius_for(similarity: float, bits: int, slack: float = 1.0) -> int:
    """Differing bits expected of two shingle sets with a Jaccard similarity, and ``slack`` standard errors more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))
