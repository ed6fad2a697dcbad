"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A mask keeps some of ``SPAN`` neighbouring token positions and ignores the others, so
a seed still hits when the token at an ignored position was replaced.  Seeds of all test
items are hashed once per mask; every document position is hashed with the same masks
and joined to them.  A hit fixes an alignment (document, item, offset); along it, windows
of ``window`` tokens are compared and the item counts as contained where a window has at
least ``similarity`` equal tokens.  Chance hits on common words die there.

Items too short for a seed are looked for word by word: all their tokens are hashed as one, and so is
every run of as many tokens in the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.session import BROADCAST_BYTES, RunFolder

#: Kept positions of each mask. Every position is left out by one of them, so an item of a single span
#: is found with any one token replaced.
MASKS = ((0, 1, 3, 4, 7), (2, 3, 5, 6, 7), (0, 1, 2, 4, 6))
SPAN = 8
#: Tokens of the shortest items that are looked for; shorter ones say too little.
SHORTEST = 4
WINDOW = 16
SIMILARITY = 0.75


#: Scripts without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han), by ranges, which cost far less
#: than names of scripts: every letter is a token, with the marks on it.
LETTERWISE = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
#: A range that holds all of them, to tell quickly that a text has none.
_BEYOND = r"[\u0E00-\x{3FFFF}]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, their marks, and digits, or single letters of ``LETTERWISE`` scripts; null or blank text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(text.rlike(_BEYOND), F.regexp_replace(low, rf"({LETTERWISE}\p{{M}}*)", " $1 ")).otherwise(low)
    return F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def _seeds(table: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, at, seed) of every position and mask of an array<string> column."""
    hashed = table.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h") - F.lit(SPAN - 1)
    shifted = [F.slice("h", F.lit(i + 1), F.greatest(n, F.lit(0))).alias(f"h{i}") for i in range(SPAN)]
    rows = hashed.where(n > 0).select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    per_mask = F.array(*[F.xxhash64(F.lit(m), *[F.col(f"w.h{i}") for i in mask]) for m, mask in enumerate(MASKS)])
    return rows.select(*keys, "at", F.explode(per_mask).alias("seed"))


def _verbatim(named: DataFrame, tests: DataFrame) -> DataFrame | None:
    """The rows of the result for items shorter than a span, or None without such items."""
    short = tests.where(F.size("item") < SPAN).select("item_id", "item", F.size("item").alias("n"), F.xxhash64("item").alias("seed"))
    lengths = [r.n for r in short.select("n").distinct().collect()]  # a few numbers below the span
    if not lengths:
        return None
    words, found = named.select("__key", "text_hash", tokens(F.col("__text")).alias("words")), []
    for n in sorted(lengths):
        runs = F.expr(f"transform(sequence(1, size(words) - {n - 1}), i -> xxhash64(slice(words, i, {n})))")
        runs = words.where(F.size("words") >= n).select("__key", "text_hash", F.explode(F.array_distinct(runs)).alias("seed"))
        found.append(runs.withColumn("n", F.lit(n)))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    bytes_ = short.agg(F.sum(F.aggregate("item", F.lit(64), lambda s, w: s + F.octet_length(w)))).first()[0]
    hit = every.join(F.broadcast(short) if bytes_ <= BROADCAST_BYTES else short, ["seed", "n"])
    one = F.lit(1).cast("long").alias("seeds")
    return hit.groupBy("__key", "text_hash", "item_id").agg(F.max("n").alias("n")).select("__key", "text_hash", "item_id", one, F.col("n").alias("matched"), F.col("n").alias("compared"))


def item_windows(equal: Column, window: int) -> Column:
    """Most equal tokens in any run of ``window`` aligned tokens (of the whole, where it is shorter)."""
    last = F.greatest(F.size(equal) - F.lit(window), F.lit(0))
    count = F.transform(F.sequence(F.lit(0), last), lambda k: F.size(F.filter(F.slice(equal, k + 1, F.lit(window)), lambda e: e)))
    return F.array_max(count)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, text_hash, item_id, seeds, matched, compared) of each item found in each document.

    seeds: hits on the best alignment; matched of compared: equal tokens in its best window.
    A document is named by its key and the hash of its text, so rows that repeat a key with
    another text are told apart, and rows that repeat both are one.  Null or empty texts and
    items of fewer than ``SHORTEST`` tokens match nothing; items of fewer than ``SPAN`` tokens match where
    they stand word by word; other items shorter than ``window`` are
    compared whole.  An alignment that hangs over the start or end of a document is
    compared where both exist, if that leaves at least ``SPAN`` tokens.
    """
    folder = RunFolder(docs.sparkSession)
    tests = items.select(F.col(item_key).alias("item_id"), tokens(F.col(item_text)).alias("item")).distinct()
    tests = folder.cut(tests.where(F.size("item") >= SHORTEST), "items")
    named = docs.select(F.col(key).alias("__key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("__text"))
    verbatim = _verbatim(named, tests)
    wanted = _seeds(tests, ["item_id"], "item").withColumnRenamed("at", "item_at")
    found = _seeds(named.withColumn("words", tokens(F.col("__text"))), ["__key", "text_hash"], "words")

    size = tests.agg(F.sum(F.size("item")).alias("n")).first()["n"] or 0
    if size * len(MASKS) * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    hits = found.join(wanted, "seed").groupBy("__key", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("offset"))
    hits = folder.cut(hits.agg(F.count("*").alias("seeds")), "hits")

    aligned = named.join(hits, named["__key"].eqNullSafe(hits["__key"]) & (named["text_hash"] == hits["text_hash"])).drop(hits["__key"]).drop(hits["text_hash"])
    aligned = aligned.join(F.broadcast(tests) if size * 64 <= BROADCAST_BYTES else tests, "item_id")
    words = tokens(F.col("__text"))
    low = F.greatest(F.col("offset"), F.lit(0))
    high = F.least(F.size("words"), F.col("offset") + F.size("item"))
    aligned = aligned.withColumn("words", words).withColumn("n", high - low).where(F.col("n") >= SPAN)
    equal = F.zip_with(F.slice("words", low + 1, F.col("n")), F.slice("item", low - F.col("offset") + 1, F.col("n")), lambda a, b: a == b)
    judged = aligned.select("__key", "text_hash", "item_id", "seeds", equal.alias("equal"))
    judged = judged.select("__key", "text_hash", "item_id", "seeds", item_windows(F.col("equal"), window).alias("matched"), F.least(F.size("equal"), F.lit(window)).alias("compared"))
    judged = judged.where(F.col("matched") >= F.lit(similarity) * F.col("compared"))
    best = F.max(F.struct(F.col("matched") / F.col("compared"), "compared", "matched", "seeds")).alias("best")
    judged = judged.groupBy("__key", "text_hash", "item_id").agg(best).select("__key", "text_hash", "item_id", "best.seeds", "best.matched", "best.compared")
    judged = judged if verbatim is None else judged.unionByName(verbatim)
    return judged.withColumnRenamed("__key", key)
