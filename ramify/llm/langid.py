"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent 1- to 3-grams of letters (with word edges) by rank.
A text's own profile is compared to each language's: an n-gram costs the distance of
its two ranks, or ``TOP`` where the language lacks it; the language with the smallest sum wins.
N-grams are counted in ``BINS`` hashed bins, so a profile has one size whatever the script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ramify.llm.texts import mixed

BINS = 1 << 14
TOP = 400
#: Characters worked on at once; a longer text is counted in several steps.
STEP = 1 << 20
UNKNOWN = "und"


class _Letters:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        """For every code point whether it is a letter, made once per process."""
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return cls.table


def _bins(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the 1-, 2- and 3-grams that begin at each place; -1 where none does. 0 is an edge."""
    c = codes.astype(np.uint64)
    bins = np.uint64(BINS - 1)
    one = np.where(codes > 0, (mixed(c) & bins).astype(np.int32), np.int32(-1))
    pair = c[:-1] << np.uint64(21) | c[1:]
    two = np.where((codes[:-1] > 0) | (codes[1:] > 0), (mixed(pair | np.uint64(1 << 62)) & bins).astype(np.int32), np.int32(-1))
    triple = pair[:-1] << np.uint64(21) | c[2:]
    three = np.where(codes[1:-1] > 0, (mixed(triple | np.uint64(1 << 63)) & bins).astype(np.int32), np.int32(-1))
    return one, two, three


def _counted(texts: list[str]) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, counts by bin) of each text; None without a letter."""
    letters, row = _Letters.get(), 0
    while row < len(texts):
        group, size = [], 0
        while row + len(group) < len(texts) and (not group or size + len(texts[row + len(group)]) < STEP):
            group.append(texts[row + len(group)])
            size += len(group[-1]) + 1
        if len(group) == 1 and len(group[0]) > STEP:
            yield row, _long(group[0])
        else:
            codes = np.frombuffer((" " + " ".join(group) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(letters[codes], codes, 0)
            grams, at = _bins(codes), 0
            for i, text in enumerate(group):
                spans = [g[at : at + len(text) + 2 - n] for n, g in enumerate(grams, 0)]
                got = np.concatenate([s[s >= 0] for s in spans])
                yield row + i, np.bincount(got, minlength=BINS) if codes[at + 1 : at + 1 + len(text)].any() else None
                at += len(text) + 1
        row += len(group)


def _long(text: str) -> np.ndarray | None:
    """Counts of a text of any length, step by step."""
    total, any_letter, letters = np.zeros(BINS, np.int64), False, _Letters.get()
    for lo in range(0, len(text), STEP):
        # a step sees one character before it and two after it, and counts what begins in it
        part = (text[lo - 1] if lo else " ") + text[lo : lo + STEP + 1] + "  "
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters[codes], codes, 0)
        size = min(STEP, len(text) - lo) + (lo + STEP >= len(text))
        for n, g in enumerate(_bins(codes)):
            s = g[: size + (n == 0)] if n else g[1 : 1 + min(STEP, len(text) - lo)]
            total += np.bincount(s[s >= 0], minlength=BINS)
        any_letter |= bool(codes[1:-2].any())
    return total if any_letter else None


def ranked(counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent bins, best first; ties by bin."""
    found = np.flatnonzero(counts)
    return found[np.lexsort((found, -counts[found]))[:top]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """Ranked bins of each language; rows with null text or lang teach nothing.

    Counts are summed inside tasks and then over them by (language, bin), so a language or
    source with most of the rows is no hot key.  The result has ``top`` numbers per language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column("t").to_pylist()
            langs = batch.column("l").to_pylist()
            for row, counts in _counted([t.lower() for t in texts]):
                if counts is not None:
                    sums[langs[row]] = sums.get(langs[row], 0) + counts
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bin", "n"])

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sums = known.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "bin")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        profiles.setdefault(r["lang"], []).append((r["rank"], r["bin"]))
    return {name: np.array([b for _, b in sorted(profiles[name])]) for name in sorted(profiles)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keys: list[Column], text: str = "text", top: int = TOP) -> DataFrame:
    """``keys`` with lang_pred and score for every row.

    score is 1 minus the winner's share of the largest possible distance.  A text that
    is null or has no letter, and any text when nothing was learned, is ``und`` with score 0.
    Equal distances go to the first language by name.
    """
    names = list(profiles)
    ranks = np.full((len(names), BINS), 1 << 20, np.int32)
    for i, name in enumerate(names):
        ranks[i, profiles[name]] = np.arange(len(profiles[name]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("__text"), "").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for row, counts in _counted([t.lower() for t in texts]):
                if counts is not None and names:
                    own = ranked(counts, top)
                    away = np.minimum(np.abs(ranks[:, own] - np.arange(len(own), dtype=np.int32)), top).sum(1)
                    best = int(away.argmin())
                    langs[row], scores[row] = names[best], 1 - away[best] / (top * len(own))
            rest = [batch.column(n) for n in batch.schema.names if n != "__text"]
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    wanted = docs.select(*keys, F.col(text).alias("__text"))
    kept = ", ".join(f"`{n}` {k}" for n, k in wanted.dtypes if n != "__text")
    return wanted.mapInArrow(judge, f"{kept}, lang_pred string, score double")
