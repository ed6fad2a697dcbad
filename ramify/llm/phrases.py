"""Phrase collocations, mined by Toivonen's method.

A phrase is frequent where it occurs ``least`` times.  A sample of the documents proposes words and
pairs of words; a phrase belongs to the proposals or their negative border where all its shorter
parts are proposed.  One full pass counts all of these, so whatever of the border turns out
frequent is known: it joins the proposals, and a further pass counts what its joining admits, until
a pass finds nothing new.  As every part of a frequent phrase is frequent, no frequent phrase is
missed, whatever the sample was.

These passes count hashes, packed by bucket; proposals reach the tasks as bit maps of hashes of bounded size.
Both err on one side: phrases whose hashes agree are counted together, and a bit set by chance
only has a phrase counted that need not be.  A last pass counts what was found frequent by its text, so the
counts are exact.  Tasks count within runs of text before anything is shuffled, so a very common
phrase is one row a run.  Inside one run of about ``RUN_BYTES`` phrases are told apart by 64-bit hashes.

A candidate is scored by its weakest cut.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ramify.llm.hashcounts import PACKED, bucket_bits, merged, packed
from ramify.llm.texts import lowered, mixed, ragged, run_hashes, runs, words
from ramify.session import RunFolder

#: One document in so many proposes, with at least so many occurrences there.
SAMPLE_PART, SAMPLE_LEAST = 4, 3
#: Text counted at once, in bytes.
RUN_BYTES = 1 << 20
#: Bits of a map of proposals, as a power of two.
LEAST_BITS, MOST_BITS = 20, 28
#: Rows that one task ranks.
RANK_ROWS = 1 << 16

_BREAK, _BLANK = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_IS_BREAK, _IS_SPACE = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(_BREAK)] = True
_IS_SPACE[list(_BREAK + _BLANK)] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = h >> np.uint64(64 - (len(bits) * 64 - 1).bit_length())
    return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0


class Run:
    """Words and phrases of a run of texts; only phrases that start in the first ``own`` words count."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, own: int | None = None):
        start, end, row = words(data, offsets, _IS_SPACE)
        low = lowered(data)
        low[_IS_SPACE[data]] = 0x20
        # the words with one blank after each, so that a phrase is one stretch
        keep = low != 0x20
        keep[end[end < len(data)]] = True
        place = np.cumsum(keep) - 1
        self.text = low[keep]
        self.start, self.end = place[start], place[end - 1] + 1
        self.row, self.own = row, len(start) if own is None else own
        breaks = np.cumsum(_IS_BREAK[data], dtype=np.int32)
        next_ = (row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[end[:-1] - 1])
        tag = mixed(langs)[row]
        self.hashes = [mixed(run_hashes(data, start, end) * _FACTORS[0] + tag)]
        self.together = [np.ones(len(start), bool)]
        word = self.hashes[0]
        for k in (1, 2):
            n = max(0, len(word) - k)
            self.together.append(self.together[-1][:n] & next_[k - 1 :][:n])
            self.hashes.append(mixed(sum((word[i : i + n] * _FACTORS[(i + k) % 3] + np.uint64(i + k) for i in range(k + 1)), np.zeros(n, np.uint64))))

    def admitted(self, k: int, now: np.ndarray | None = None, old: np.ndarray | None = None) -> np.ndarray:
        """First words of phrases of k words whose two parts are in the map ``now``, but not both in ``old``."""
        good = self.together[k - 1].copy()
        good[self.own :] = False
        for bits, wanted in ((now, True), (old, False)):
            if k > 1 and bits is not None:
                part = has(bits, self.hashes[k - 2])
                good &= (part[: len(good)] & part[1 : len(good) + 1]) == wanted
        return np.flatnonzero(good)

    def proposed(self, k: int, bits: np.ndarray) -> np.ndarray:
        """First words of phrases of k words that are in the map."""
        at = self.admitted(k)
        return at[has(bits, self.hashes[k - 1][at])]

    def counted(self, k: int, at: np.ndarray, names: pa.Array) -> pa.RecordBatch:
        """(lang, k, phrase, c) of the distinct phrases of k words that start at ``at``."""
        _, first, count = np.unique(self.hashes[k - 1][at], return_index=True, return_counts=True)
        at = at[first]
        lo, hi = self.start[at], self.end[at + k - 1]
        edges = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)
        body = self.text[ragged(lo, hi - lo)]
        phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(body)))
        return _batch(names.take(pa.array(self.row[at])), k, phrase, count)


def _batch(lang: pa.Array, k: int, phrase: pa.Array, c: np.ndarray) -> pa.RecordBatch:
    columns = [lang, pa.array(np.full(len(c), k, np.int32)), phrase, pa.array(c.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "c"])


def _runs(texts: pa.Array, langs: np.ndarray) -> Iterator[tuple[int, int, Run]]:
    """(first row, after last, run); a text longer than a run is cut between words, with two words beyond each cut."""
    for first, last, data, offsets, own in runs(texts, _IS_SPACE, RUN_BYTES, 2):
        yield first, last, Run(data, offsets, langs[first:last], own)


def _frequent_hashes(docs: DataFrame, least: int, bits: int, power: int, now: list[np.ndarray] | None, old: list[np.ndarray] | None) -> list[np.ndarray]:
    """Maps by number of words: hashes with ``least`` occurrences among what ``now`` admits and ``old`` did not.

    Without ``now`` words and pairs of any kind are counted; with ``old`` words are not, as they were before.
    """
    # only the maps of words and pairs admit anything
    given = docs.sparkSession.sparkContext.broadcast((now and now[:2], old and old[:2]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = given.value
        for batch in batches:
            for _, _, run in _runs(batch.column("text"), _codes(batch.column("lang"))):
                for k in (1, 2, 3) if now else (1, 2):
                    if k == 1 and old:
                        continue
                    at = run.admitted(k, now[k - 2] if now and k > 1 else None, old[k - 2] if old else None)
                    bucket, codes, counts = packed(run.hashes[k - 1][at], bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), k, np.int32)), bucket, codes, counts], names=["k", "bucket", "codes", "counts"])

    def count(table: pa.Table) -> pa.Table:
        codes, counts = merged(table)
        set_ = np.zeros(1 << (power - bits), bool)
        set_[codes[counts >= least].astype(np.int64) >> (32 - (power - bits))] = True
        one = table.slice(0, 1).select(["k", "bucket"])
        return one.append_column("bits", pa.array([np.packbits(set_, bitorder="little").tobytes()], pa.binary()))

    found = docs.mapInArrow(send, f"k int, {PACKED}").groupBy("k", "bucket").applyInArrow(count, "k int, bucket long, bits binary")
    maps, size = [np.zeros(1 << (power - 6), np.uint64) for _ in range(3)], 1 << (power - bits - 3)
    found = found.toArrow()
    given.destroy()
    for batch in found.to_batches():
        for k, bucket, cells in zip(*(batch.column(c).to_pylist() for c in ("k", "bucket", "bits")), strict=True):
            maps[k - 1].view(np.uint8)[bucket * size : (bucket + 1) * size] = np.frombuffer(cells, np.uint8)
    return maps


def _codes(langs: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.as_py()) for x in langs), np.uint64, len(langs))


def _counted(docs: DataFrame, given: Broadcast) -> DataFrame:
    """Counts (lang, k, phrase, c) of the phrases in the maps sent; k = 0 has the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = given.value
        for batch in batches:
            names = batch.column("lang")
            for first, last, run in _runs(batch.column("text"), _codes(names)):
                own = names.slice(first, last - first)
                row, n = np.unique(run.row[: run.own], return_counts=True)
                each = pa.table({"lang": own.take(pa.array(row)), "n": n}).group_by("lang").aggregate([("n", "sum")])
                yield _batch(each.column("lang").combine_chunks(), 0, pa.array([""] * len(each), pa.string()), each.column("n_sum").to_numpy())
                for k in (1, 2, 3):
                    yield run.counted(k, run.proposed(k, maps[k - 1]), own)

    rows = docs.mapInArrow(count, "lang string, k int, phrase string, c long")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c"))


def frequent(docs: DataFrame, text: str, lang: str, key: list[Column], least: int) -> DataFrame:
    """(lang, k, phrase, c): every phrase of up to three words with ``least`` occurrences in its language; k = 0 counts words.

    ``key`` decides which documents are in the sample.  A null text is empty, a null language ``und``.
    """
    wanted = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.xxhash64(*key, text).alias("key"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    every, some = wanted.select("text", "lang"), wanted.where(F.pmod("key", F.lit(SAMPLE_PART)) == 0).select("text", "lang")
    bits = bucket_bits(size // 6)
    # frequent phrases are far fewer than the text has room for
    power = max(bits + 6, min(MOST_BITS, max(LEAST_BITS, (size // (4 * least)).bit_length())))
    now, old, found = _frequent_hashes(some, SAMPLE_LEAST, bits, power, None, None), None, None
    while True:
        new = _frequent_hashes(every, least, bits, power, now, old)
        found = new if found is None else [x | y for x, y in zip(found, new, strict=True)]
        more = [x | y for x, y in zip(now, new, strict=True)]
        # longer phrases admit nothing
        if all(np.array_equal(x, y) for x, y in zip(now[:2], more[:2], strict=True)):
            break
        now, old = more, now
    given = docs.sparkSession.sparkContext.broadcast(found)
    counts = _counted(every, given)
    counts = RunFolder(docs.sparkSession).cut(counts.where((F.col("c") >= least) | (F.col("k") == 0)), "phrases")
    given.destroy()
    return counts


def collocations(phrases: DataFrame, weight: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among ``frequent`` phrases.

    Left out are candidates that lie in a longer one with ``weight`` hundredths of their count.
    """
    counts = phrases.where(F.col("k") > 0).select("lang", "phrase", "c")
    first, rest = F.substring_index("phrase", " ", 1), F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    last, start = F.substring_index("phrase", " ", -1), F.substring_index("phrase", " ", 2)
    one = F.struct(F.lit(1).alias("cut"), first.alias("left"), rest.alias("right"))
    two = F.struct(F.lit(2).alias("cut"), start.alias("left"), last.alias("right"))
    longer = phrases.where(F.col("k") > 1)
    cuts = longer.select("lang", "k", "phrase", F.col("c").alias("a"), F.explode(F.when(F.col("k") == 2, F.array(one)).otherwise(F.array(one, two))).alias("x"))
    cuts = cuts.select("lang", "k", "phrase", "a", "x.*")
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"top": F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(30,0)"), "low": wide("l") * wide("r")})
    worst = F.min(F.struct(F.expr("top div low").alias("score"), "cut", "l", "r")).alias("x")
    scored = cuts.groupBy("lang", "k", "phrase").agg(worst, F.first("a").alias("a"))
    triples = phrases.where(F.col("k") == 3)
    inside = triples.select("lang", F.explode(F.array(start, rest)).alias("phrase"), "c").groupBy("lang", "phrase").agg(F.max("c").alias("over"))
    scored = scored.join(inside, ["lang", "phrase"], "left").where((F.col("k") == 3) | F.col("over").isNull() | (100 * F.col("over") < weight * F.col("a")))
    n = phrases.where(F.col("k") == 0).groupBy("lang").agg(F.sum("c").alias("n"))
    return scored.join(n, "lang").select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of every language with ``rank``, by score, a (both descending) and phrase.

    A language is ranked in shares first, so no task gets more than a bounded number of rows.
    """
    spark: SparkSession = scored.sparkSession
    scored = RunFolder(spark).cut(scored, "scored")
    most = scored.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    order, fan = [F.desc("score"), F.desc("a"), F.asc("phrase")], max(2, RANK_ROWS // limit)
    share = -(-most // RANK_ROWS)
    while share > 1:
        within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(share))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= limit).drop("rank")
        share = share // fan
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return scored.where(F.col("rank") <= limit)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: int = 10, limit: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): every language's first collocations of two and three words.

    A null text is empty, a null language ``und``; nulls in ``key`` do no harm, repeated rows count
    as often as they stand there, ties in score and count go by the phrase's bytes, and an empty
    table, or one without a frequent phrase, gives an empty result.  Texts of any length are
    counted whole, in runs.  Other columns are not read.
    """
    found = ranked(collocations(frequent(docs, text, lang, [F.col(key)], least)), limit)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The contract's result from plain counts of all phrases.
PLAIN_SQL = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
d AS (SELECT *, str_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
x AS (SELECT d.lang, d.k, d.phrase, d.c AS a, j, array_to_string(d.w[1:j], ' ') AS lp, array_to_string(d.w[j + 1:], ' ') AS rp FROM d, range(1, 3) r(j) WHERE j < d.k),
y AS (SELECT x.*, l.c AS l, r.c AS r, (1000000 * x.a::HUGEINT * x.a // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM y),
o AS (SELECT lang, phrase, max(c) AS over FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, c FROM d WHERE k = 3) GROUP BY 1, 2),
e AS (SELECT z.lang, z.phrase, z.a, z.l, z.r, z.score FROM z LEFT JOIN o ON z.lang = o.lang AND z.phrase = o.phrase
  WHERE q = 1 AND (k = 3 OR o.over IS NULL OR 100 * o.over < 50 * z.a)),
s AS (SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score FROM e JOIN n ON e.lang = n.lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM s WHERE rank <= 2000
"""
