"""Hidden Markov language model over word classes.

The ``HEAD`` most frequent words (fewer where the last ones tie with others) are classes of their own,
the end of a text is one, and all other words fall into ``TAIL`` classes by their last letters.  A hidden Markov model with
``STATES`` states emits classes; a word of a tail class follows from its count there, less a
discount that goes to the class's unseen words as one event (the base model, too, treats an
unseen word as one event).  So a text's probability is

    P(classes | states, transitions, emissions) * product of P(word | tail class)

Training is Baum-Welch.  Word counts, expected transitions and expected emissions are summed
over all training rows in every pass: each task adds up its own, and the sums meet by key.  The
first guess is random emissions around the shares of all rows.  Sequences are worked on side by side, those of
like length together, and scaled every few steps; the longest, which few others last as long as, are cut into
segments.  What enters a segment and what follows it comes from the products of the segments' matrices, so
the counts are those of whole texts.  A text is scored whole, with the scaled forward recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.quality import kth_largest
from ramify.llm.texts import bounds, lowered, mixed, pieces, ragged, run_hashes, words
from ramify.session import RunFolder

HEAD, TAIL, STATES = 16384, 1024, 8
#: Passes over all training rows.
PASSES = 10
#: Tokens of a training segment, and tokens worked on at once.
SEGMENT, STEP_TOKENS = 512, 400_000
#: Sequences side by side that need no segments, and steps between two scalings.
ABREAST, EVERY = 64, 4
#: Tokens whose posteriors are added up at once, few enough for a core's cache.
CHUNK = 1 << 14
DISCOUNT = 0.7
#: Weight of the class's share in all states when emissions are estimated, and of even transitions.
PULL, EVEN = 50.0, 1.0
#: Expected counts are summed as whole numbers of this fraction, so their order does not matter.
FRACTION = 1 << 20
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 2_000_000


def _tail_class(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of each word by its last three bytes (A-Z as a-z)."""
    key = np.zeros(len(start), np.uint64)
    for k in range(1, 4):
        at = end - k
        key = key << np.uint64(8) | np.where(at >= start, lowered(data[np.maximum(at, 0)]), np.uint8(0))
    return (mixed(key) % np.uint64(TAIL)).astype(np.int32)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n) over all rows of (t): word hash, tail class, count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, of = np.unique(word, return_index=True, return_inverse=True)
            return word, c[first], np.bincount(of, n, len(word)).astype(np.int64)

        def out() -> pa.RecordBatch:
            word, c, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c), pa.array(n)], names=["word", "c", "n"])

        size = 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("t")):
                start, end, _ = words(data, offsets)
                if len(start):
                    word, first, n = np.unique(run_hashes(data, start, end), return_index=True, return_counts=True)
                    held.append((word, _tail_class(data, start[first], end[first]), n))
                    size += len(word)
                if size > 2 * HELD_WORDS:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD_WORDS:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            held[:] = [merged()]
            yield out()

    sums = rows.mapInArrow(count, "word long, c int, n long")
    return sums.groupBy("word").agg(F.min("c").alias("c"), F.sum("n").alias("n"))


# --- the model on one machine ----------------------------------------------------------------------


def random_model(share: np.ndarray, states: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First guess: (start, transitions, emissions by class and state); states tend to stay."""
    rng = np.random.default_rng(seed)
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    emit = share[:, None] * rng.gamma(2.0, 0.5, (len(share), states))
    return np.full(states, 1 / states), moves, emit / emit.sum(0)


def updated(start: np.ndarray, moves: np.ndarray, emit: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of expected counts: first states, transitions, emissions."""
    start = start + EVEN
    moves = moves + EVEN
    emit = emit + PULL * share[:, None]
    return start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0)


def matrices(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each segment the weight of going from a state at its first token to one at its last, emitting it all; each scaled."""
    _, moves, emit = model
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")
    through = np.eye(len(moves)) * emit[flat[begin]][:, None, :]
    for t, n in enumerate(live):
        if t:
            through[:n] = (through[:n].reshape(-1, len(moves)) @ moves).reshape(n, *moves.shape) * emit.take(flat[begin[:n] + t], axis=0)[:, None, :]
        if t % EVERY == 0:
            through[:n] /= through[:n].reshape(n, -1).max(1)[:, None, None]
    out = np.empty_like(through)
    out[order] = through
    return out


class Expected:
    """Expected counts of many sequences, added up segment by segment."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.start, self.moves, self.emit = model
        # a token's likeliest state emits it with weight 1, so few steps shrink no weight to zero
        self.weight = self.emit / self.emit.max(1, keepdims=True)
        states = len(self.start)
        self.first, self.moved, self.emitted = np.zeros(states), np.zeros((states, states)), np.zeros(self.emit.shape[::-1])
        self.room = np.empty((2, 0, states))  # of the last step, used again

    def edges(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment, the states of the token before it (a distribution) and the weight of all that follows, by the state at its end.

        An opening segment's first row is not used.
        """
        before, after = np.zeros((len(begin), len(self.start))), np.ones((len(begin), len(self.start)))
        last = np.append(opening[1:], True)
        cut = np.flatnonzero(~(opening & last))
        if not len(cut):
            return before, after
        through = matrices(flat, begin[cut], size[cut], (self.start, self.moves, self.weight))
        heads = np.flatnonzero(opening[cut])
        parts = np.diff(np.append(heads, len(cut)))
        order = np.argsort(-parts, kind="stable")
        heads, parts = heads[order], parts[order]
        live = np.searchsorted(-parts, -np.arange(parts[0]), "left")  # texts with more than p segments
        for p in range(1, len(live)):
            at = heads[: live[p]] + p - 1
            enter = before[cut[at]] @ self.moves if p > 1 else np.tile(self.start, (len(at), 1))
            end = (enter[:, None, :] @ through[at])[:, 0]
            before[cut[at + 1]] = end / end.sum(1, keepdims=True)
        for p in range(len(live) - 1, 0, -1):
            at = heads[: live[p]] + p
            rest = (through[at] @ after[cut[at]][:, :, None])[:, :, 0] @ self.moves.T
            after[cut[at - 1]] = rest / rest.sum(1, keepdims=True)
        return before, after

    def add(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, opening: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """Segments ``flat[begin : begin + size]`` with their edges; ``opening``: it is the start of its text."""
        order = np.argsort(-size, kind="stable")
        begin, size, opening, before, after = begin[order], size[order], opening[order], before[order], after[order]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # segments longer than t
        rows = np.concatenate([[0], np.cumsum(live)])
        seen = flat[np.concatenate([begin[:n] + t for t, n in enumerate(live)])]
        states = len(self.start)
        sums = np.ones((states, states))  # a product with it puts a row's sum in each of its places
        if self.room.shape[1] < len(seen):
            self.room = np.empty((2, len(seen), states))
        emit, ahead = self.room[:, : len(seen)]
        self.weight.take(seen, axis=0, out=emit, mode="clip")
        a, scales = np.where(opening[:, None], self.start, before @ self.moves), []
        for t, n in enumerate(live):
            at = ahead[rows[t] : rows[t + 1]]
            if t:
                np.matmul(a[:n], self.moves, out=at)
            else:
                at[:] = a
            at *= emit[rows[t] : rows[t + 1]]
            if t % EVERY == 0:
                scales.append(at @ sums)
                at /= scales[-1]
            a = at
        turned = np.ascontiguousarray(self.moves.T)
        w = np.empty((0, states))
        for t in range(len(live) - 1, -1, -1):
            at, n = slice(rows[t], rows[t + 1]), len(w)
            back = np.empty((live[t], states))
            np.matmul(w, turned, out=back[:n])
            both = ahead[at]  # overwritten by the posteriors
            if n < live[t]:
                back[n:] = after[n : live[t]] / ((both[n:] * after[n : live[t]]) @ sums)
            # scaled as on the way there, so a row of both * back adds up to 1 from its end on
            self.moved += both[:n].T @ w
            both *= back
            w = back
            w *= emit[at]
            if t % EVERY == 0:
                w /= scales.pop()
        self.first += ahead[: live[0]][opening].sum(0)
        inner = ~opening
        if inner.any():
            prior, w = before[inner], w[inner]
            self.moved += (prior / ((prior * (w @ turned)) @ sums)).T @ w
        for lo in range(0, len(seen), CHUNK):
            here = seen[lo : lo + CHUNK]
            for k, x in enumerate(np.ascontiguousarray(ahead[lo : lo + CHUNK].T)):
                self.emitted[k] += np.bincount(here, x, len(self.emit))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.first, self.moved * self.moves, self.emitted.T


def segments(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, opening) of the segments of texts that lie one after another.

    A text that ``ABREAST`` texts last as long as, in one step, is one segment.
    """
    begin = np.cumsum(size) - size
    whole = min(np.partition(size, -ABREAST)[-ABREAST], STEP_TOKENS // ABREAST) if len(size) > ABREAST else 0
    parts = np.where(size <= whole, 1, -(-size // SEGMENT))
    of = np.repeat(np.arange(len(size)), parts)
    part = ragged(np.zeros(len(size), np.int64), parts)
    length = np.where(parts[of] == 1, size[of], np.minimum(SEGMENT, size[of] - part * SEGMENT))
    return begin[of] + part * SEGMENT, length, part == 0


def _expect(total: Expected, flat: np.ndarray, size: np.ndarray) -> None:
    if not len(size):
        return
    begin, length, opening = segments(size)
    before, after = total.edges(flat, begin, length, opening)
    order = np.argsort(-length, kind="stable")
    step = np.cumsum(length[order]) // STEP_TOKENS
    for took in np.split(order, np.flatnonzero(np.diff(step)) + 1):
        total.add(flat, begin[took], length[took], opening[took], before[took], after[took])


def forward(flat: np.ndarray, size: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 likelihood of whole sequences of at least one token, all stepped together."""
    start, moves, emit = model
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    begin, longest = begin[order], size[order]
    live = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), "left")
    total, a = np.zeros(len(size)), np.tile(start, (len(size), 1))
    left = np.append(live[1:], 0)  # sequences that go on after t
    for t, n in enumerate(live):
        a = (a if t == 0 else a[:n] @ moves) * emit.take(flat[begin[:n] + t], axis=0)
        ends = left[t] if t % EVERY else 0
        if ends < n:
            s = a[ends:].sum(1)
            total[ends:n] += np.log10(s)
            a[ends:] /= s[:, None]
    out = np.empty(len(size))
    out[order] = total
    return out


# --- the model over a table ------------------------------------------------------------------------


class LanguageModel:
    """Counts and states learned from the rows where ``train`` holds."""

    def __init__(self, docs: DataFrame, train: Column, keys: list[Column], text: str = "text", passes: int = PASSES):
        self.folder = RunFolder(docs.sparkSession)
        learn = F.coalesce(train, F.lit(False))
        rows = docs.select(*keys, learn.alias("__train"), F.col(text).alias("t"))
        self.counts = self.folder.cut(word_counts(rows.where("__train").select("t")), "counts")
        self.texts = rows.where("__train").count()
        n, v = self.counts.agg(F.sum("n"), F.count("*")).first()
        self.n, self.v = (n or 0) + self.texts, v + (self.texts > 0)
        # words that tie at the limit stay in the tail, so there are at most HEAD
        least = kth_largest(self.counts.select(F.col("n").cast("double").alias("n")), "n", HEAD + 1) if v > HEAD else 0.0
        in_head = F.col("n") > F.lit(least)
        head = self.counts.where(in_head).toArrow()
        words_, times = head.column("word").to_numpy(), head.column("n").to_numpy()
        by_word = np.argsort(words_.view(np.uint64))
        self.head, self.times = words_[by_word].view(np.uint64), times[by_word]
        tail = self.counts.where(~in_head).groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
        self.tail_n, self.tail_v = np.zeros(TAIL), np.zeros(TAIL)
        self.tail_n[tail.column("c").to_numpy()] = tail.column("n").to_numpy()
        self.tail_v[tail.column("c").to_numpy()] = tail.column("v").to_numpy()
        # the classes' shares: head words, the end, tail classes
        share = np.concatenate([self.times, np.zeros(HEAD - len(self.times)), [self.texts], self.tail_n]) + 0.5
        self.share = share / share.sum()
        self.sequences = self.folder.cut(self._sequences(rows), "sequences")
        self.model = random_model(self.share, STATES)
        for _ in range(passes if self.n else 0):
            self.model = self._pass()

    def _sequences(self, rows: DataFrame) -> DataFrame:
        """Keys, __train, row, classes (u16 of each token and the end), and the tail words with their counts."""
        head = self.head
        names = [c for c in rows.columns if c != "t"]
        wanted = rows.select(*names, F.monotonically_increasing_id().alias("row"), "t")

        def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, data, offsets in pieces(batch.column("t")):
                    start, end, row = words(data, offsets)
                    word, n = run_hashes(data, start, end), last - first
                    at = np.searchsorted(head, word) if len(head) else np.zeros(len(word), np.int64)
                    known = head[np.minimum(at, len(head) - 1)] == word if len(head) else np.zeros(len(word), bool)
                    rest = ~known
                    c = _tail_class(data, start[rest], end[rest])
                    cls = at.astype(np.uint16)
                    cls[rest] = HEAD + 1 + c
                    begin = bounds(row, n)
                    seq = np.insert(cls, begin[1:], np.uint16(HEAD))
                    cuts = (begin + np.arange(n + 1)) * 2
                    raw = seq.tobytes()
                    classes = pa.array([raw[cuts[i] : cuts[i + 1]] for i in range(n)], pa.binary())
                    # the tail words of each row, once with their number there
                    order = np.lexsort((word[rest], row[rest]))
                    w, r, k = word[rest][order], row[rest][order], c[order]
                    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])) if len(w) else np.zeros(0, np.int64)
                    times = np.diff(np.append(new, len(w))).astype(np.int32)
                    records = pa.StructArray.from_arrays([pa.array(w[new].view(np.int64)), pa.array(k[new]), pa.array(times)], names=["word", "c", "times"])
                    tail = pa.ListArray.from_arrays(pa.array(bounds(r[new], n).astype(np.int32)), records)
                    kept = [x.slice(first, n) for x in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, classes, tail], names=[*batch.schema.names[:-1], "classes", "tail"])

        kept = ", ".join(f"`{n}` {k}" for n, k in wanted.dtypes if n != "t")
        return wanted.mapInArrow(classify, f"{kept}, classes binary, tail array<struct<word:bigint,c:int,times:int>>")

    def _pass(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One Baum-Welch step over all training rows."""
        model = self.model

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = Expected(model)
            for batch in batches:
                for flat, size, _, _ in _sequences_of(batch.column(0)):
                    _expect(total, flat, size)
            first, moved, emitted = total.counts()
            sums = np.concatenate([first, moved.ravel(), emitted.ravel()])
            sums = np.round(sums * FRACTION).astype(np.int64)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["at", "x"])

        # the number of sums is that of the model's parameters, whatever the table's size
        sums = self.sequences.where("__train").select("classes").mapInArrow(expect, "at int, x long")
        sums = sums.groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(STATES + STATES * STATES + model[2].size)
        flat[sums.column("at").to_numpy()] = sums.column("x").to_numpy() / FRACTION
        first, moved, emitted = np.split(flat, [STATES, STATES + STATES * STATES])
        return updated(first, moved.reshape(STATES, STATES), emitted.reshape(model[2].shape), self.share)

    def score(self) -> DataFrame:
        """Keys, n_tokens, n_known, train_tokens, base_score and score of every row.

        A null or empty text is its end alone.  Rows that repeat are scored one by one.  Without
        a training row every token is the one unseen event, with probability 1.
        """
        model, size_n = self.model, float(self.n + self.v + 1)
        points = np.zeros(HEAD + 1 + TAIL)
        points[: len(self.times)] = np.log10(self.times + 1.0)
        points[HEAD] = np.log10(self.texts + 1.0)
        known = np.zeros(HEAD + 1 + TAIL)
        known[: len(self.times)] = 1
        known[HEAD] = self.texts > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for flat, size, first, last in _sequences_of(batch.column(batch.num_columns - 1)):
                    of = np.repeat(np.arange(len(size)), size)
                    made = [size, np.bincount(of, known[flat], len(size)).astype(np.int64), np.bincount(of, points[flat], len(size)), forward(flat, size, model)]
                    kept = [x.slice(first, last - first) for x in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, made)], names=[*batch.schema.names[:-1], "n_tokens", "__known", "__points", "__log"])

        keys = [c for c in self.sequences.columns if c not in ("__train", "classes", "tail")]
        wanted = self.sequences.select(*keys, "classes")
        kept = ", ".join(f"`{n}` {k}" for n, k in wanted.dtypes if n != "classes")
        scored = wanted.mapInArrow(run, f"{kept}, n_tokens long, __known long, __points double, __log double")

        tail = self.sequences.select("row", F.explode("tail").alias("w")).select("row", "w.word", "w.c", "w.times")
        seen = tail.join(self.counts.select("word", "n"), "word", "left")
        # at most TAIL rows
        spark = self.sequences.sparkSession
        classes = spark.createDataFrame([(i, float(n), float(v)) for i, (n, v) in enumerate(zip(self.tail_n, self.tail_v, strict=True))], "c int, class_n double, class_v double")
        seen = seen.join(F.broadcast(classes), "c")
        fresh = F.when(F.col("class_n") > 0, F.log10(F.lit(DISCOUNT) * F.col("class_v") / F.col("class_n"))).otherwise(F.lit(0.0))
        inside = F.when(F.col("n").isNull(), fresh).otherwise(F.log10((F.col("n") - F.lit(DISCOUNT)) / F.col("class_n")))
        sums = seen.groupBy("row").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("tail_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("tail_points"),
            F.sum(F.col("times") * inside).alias("tail_log"),
        )
        both = scored.join(sums, "row", "left")
        add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
        whole = F.lit(float(np.log10(size_n))) * F.col("n_tokens")
        score = add("__log", "tail_log") if self.n else F.lit(0.0)
        return both.select(
            *[k for k in keys if k != "row"],
            "n_tokens",
            add("__known", "tail_known").cast("long").alias("n_known"),
            F.lit(self.n).cast("long").alias("train_tokens"),
            (add("__points", "tail_points") - whole).alias("base_score"),
            score.alias("score"),
        )


def _sequences_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(classes one after another, sizes, first row, after last row), a bounded number of bytes at once."""
    for first, last, data, offsets in pieces(column, 16 << 20):
        yield np.frombuffer(data.tobytes(), np.uint16), np.diff(offsets) // 2, first, last
