"""Token packing by best-fit decreasing.

Documents are tokenized whole; an overlong one is first cut into full windows.  What is left of
each, and every shorter document, is a piece.  Pieces are dealt over shards of bounded size by
a hash of their row, and each shard is packed by itself, longest piece first, into the
tightest window that still has room.  A segment tree over remaining capacities finds that
window: each node holds the number of open windows below it, and the search goes to the
least capacity that is large enough.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.texts import _SPACE, bounds, flat, give_back, lowered, pieces, ragged, tidy, words
from ramify.session import RunFolder

WINDOW = 4096
#: Pieces of a shard, on average. Padding is below one window per shard and that of best fit.
SHARD_PIECES = 8192
#: Odd words whose ids a task remembers.
CACHE_WORDS = 200_000
#: Text worked on at once, in bytes.
TEXT_BYTES = 1 << 20
#: Pieces handed on at once.
BATCH = 4096
#: Bytes of the longest word that is split beside others; each step handles all of them.
LONG = 64

#: Letters whose lower case and normal form are the same in every Unicode version.
_LETTERS = [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x180)]
_LETTER, _MARK, _OTHER = range(3)


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary; a blank stays one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = np.zeros(256, "<u2")
    letters[shown] = shown
    hidden = letters == 0
    letters[hidden] = 256 + np.arange(np.count_nonzero(hidden))
    letters[32] = 32
    return letters


def _byte_kinds() -> np.ndarray:
    """Kind of each byte below 128; marks are what the tokenizer keeps together after letters."""
    kinds = np.full(256, _OTHER, np.uint8)
    for c in range(33, 127):
        kinds[c] = _LETTER if chr(c).isalpha() else _OTHER if chr(c) in "0123456789'" else _MARK
    return kinds


def _two_bytes() -> np.ndarray:
    """The lower case of two-byte letters from U+00C0 to U+017F, by the bits of their code; 0 for all else."""
    lower = np.zeros((192, 2), np.uint8)
    for c in _LETTERS:
        lower[c - 0xC0] = list(chr(c).lower().encode())
    return lower


_BYTE_LETTERS = _byte_letters()
_KINDS = _byte_kinds()
_TWO = _two_bytes()


def _plain_parts(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``data[cut[i] : cut[i + 1]]`` of letters and then marks as one part of each, in lower case; other words whole.

    (bytes, where each part begins and the last ends, its word, whether it is such another word)
    """
    kind, low = _KINDS[data], lowered(data)
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    code = (data[lead].astype(np.int64) - 0xC3) * 64 + (data[lead + 1] & 63)
    lead, code = lead[_TWO[code, 0] > 0], code[_TWO[code, 0] > 0]
    for k in range(2):
        kind[lead + k], low[lead + k] = _LETTER, _TWO[code, k]
    bad = kind == _OTHER
    bad[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK)
    bad[cut[:-1]] = kind[cut[:-1]] == _OTHER
    begin, size = cut[:-1], np.diff(cut)
    odd = size > LONG
    odd[np.searchsorted(cut, np.flatnonzero(bad), "right") - 1] = True
    counted = np.concatenate([[0], np.cumsum(kind == _LETTER)])
    core = np.where(odd, size, counted[cut[1:]] - counted[begin])
    if odd.any():
        at = ragged(begin[odd], size[odd])
        low[at] = data[at]
    edges = np.column_stack([begin, begin + core]).ravel()
    some = np.diff(np.append(edges, len(data))) > 0
    word = np.repeat(np.arange(len(begin)), 2)[some]
    return low, np.append(edges[some], len(data)), word, odd[word]


class Merges:
    """Byte-pair merges of many words at once.

    In each step every word merges the pair that comes first in the list, wherever it stands.  That is
    the usual order, one pair after another, since a token is made by one merge, after those of its parts.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = {a + b: r for r, (a, b) in enumerate(pairs)}
        if len(made) < len(pairs) or any(made.get(x, -1) >= r for r, pair in enumerate(pairs) for x in pair) or max(vocabulary.values()) >= 1 << 16:
            raise ValueError("this tokenizer's merges can't be done side by side")
        letters = [chr(c) for c in _BYTE_LETTERS]
        self.inner = np.array([vocabulary.get(c, 0) for c in letters], np.uint32)
        self.final = np.array([vocabulary.get(c + "</w>", 0) for c in letters], np.uint32)
        self.none = len(pairs)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.uint32)
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint32)
        # open addressing; the key of a free slot is no pair's: nothing follows the end of a word
        self.bits = len(pairs).bit_length() + 2
        self.free = np.uint32(int(self.final[ord("a")]) << 16)
        self.keys = np.full(1 << self.bits, self.free, np.uint32)
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            taken = self.keys[slot] != self.free
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & ~taken
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], left[put]
            left, slot = left[~put], (slot[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the list; ``none`` if it is not there."""
        key = a << np.uint32(16) | b
        slot = self._slot(key)
        found, out = self.keys.take(slot), self.ranks.take(slot)
        wrong = np.flatnonzero(found != key)
        out[wrong] = self.none
        on = wrong[found[wrong] != self.free]
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[on]]
            hit = there == key[on]
            out[on[hit]] = self.ranks[slot[on[hit]]]
            on = on[~hit & (there != self.free)]
        return out

    def ids(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words ``data[cut[i] : cut[i + 1]]`` in turn, their number in each word); none is empty."""
        out, many = np.full(len(data), 1 << 31, np.uint32), np.diff(cut)
        token = np.append(self.inner[data], np.uint32(0))  # with one more behind the last word
        token[cut[1:] - 1] = self.final[data[cut[1:] - 1]]
        # nothing follows the end of a word, so no pair joins two words
        rank = self.rank(token[:-1], token[1:])
        word, size = np.arange(len(many)), many.copy()
        while len(word):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            over = least == self.none
            if over.any():
                gone = np.repeat(over, size)
                many[word[over]] = size[over]
                out[ragged(cut[word[over]], size[over])] = token[:-1][gone]
                stay = ~gone
                token, rank = token[np.append(stay, True)], rank[stay]
                word, size, least = word[~over], size[~over], least[~over]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            close = np.diff(at, prepend=-2) == 1
            if close.any():  # of a pair that overlaps itself every second one, from the left
                run = np.maximum.accumulate(np.where(close, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            token[at] = self.made[rank[at]]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            size = size - np.bincount(np.searchsorted(np.cumsum(size), at, "right"), minlength=len(size))
            token, rank = token[stay], rank[stay[:-1]]
            at -= np.arange(len(at))
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = self.rank(token[at], token[at + 1])
        return out[out < 1 << 31], many


class WordIds(dict):
    """Ids of a text's blank-separated words, as little-endian bytes.

    The tokenizer drops white space and case, and splits letters from marks before anything else,
    so a text's ids are those of its words in turn, and a word of letters and then marks has those of
    both parts.  The parts of a run of texts are split together, each distinct one once.  All other
    words go through the whole tokenizer, and are kept by word.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.limit = limit
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core's work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.merges = Merges(model["vocab"], model["merges"])

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        """Keep these words, split together."""
        new = sorted(words)
        data, offsets = flat(pa.array(new, pa.string()))
        pool, first, count, part, word = self._parts(data, offsets)
        for w in new:
            self[w] = b""
        for p, i in zip(part, word, strict=True):
            self[new[i]] += pool[first[p] : first[p] + count[p]].tobytes()

    def _parts(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each distinct part begin, their number, the parts of all words in turn, the word of each)."""
        low, edges, word, odd = _plain_parts(data, cut)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(low)]).dictionary_encode()
        part = coded.indices.to_numpy().astype(np.int64)
        whole = np.zeros(len(coded.dictionary), bool)
        whole[part[odd]] = True
        ids, many = self.merges.ids(*flat(coded.dictionary.filter(pa.array(~whole))))
        others = [np.frombuffer(self[w.decode()], "<u4") for w in coded.dictionary.filter(pa.array(whole)).to_pylist()]
        count = np.zeros(len(whole), np.int64)
        count[~whole], count[whole] = many, [len(x) for x in others]
        order = np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)])
        first = np.empty(len(whole), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate([ids, *others]).astype("<u4"), first, count, part, word

    def texts(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts one after another, where each begins and the last ends); ``end`` is the last id of each."""
        start, stop, row = words(data, offsets)
        size = stop - start
        inside = ~_SPACE[data]
        pool, first, count, part, word = self._parts(data[inside], np.concatenate([[0], np.cumsum(size)]))
        # the end is one more part
        pool, first, count = np.append(pool, np.array([end], "<u4")), np.append(first, len(pool)), np.append(count, 1)
        n = len(offsets) - 1
        begin = bounds(row[word], n)
        part = np.insert(part, begin[1:], len(first) - 1)
        many = count[part]
        ends = np.concatenate([[0], np.cumsum(many)])[begin + np.arange(n + 1)]
        return pool[ragged(first[part], many)], ends


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words this process knows; tasks that follow one another share them."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
        give_back()  # what reading the vocabulary took
    return _KNOWN[path]


def _split(text: str) -> list[str]:
    """Words between white space; Python also splits at four characters that the tokenizer keeps."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return re.split(r"[\t-\r ]+", text.strip("\t\n\x0b\x0c\r "))
    return text.split()


class Windows:
    """Open windows by remaining capacity: a segment tree of counts, and the windows of each capacity."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, name: int) -> None:
        self.open.setdefault(capacity, []).append(name)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of at least ``need``."""
        counts, node = self.counts, need + self.leaves
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece, in the order given; pieces are 1 to ``window`` long."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, made = Windows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = windows.tightest(need)
        if found is None:
            found, made = (window, made), made + 1
        capacity, name = found
        place[i], offset[i] = name, window - capacity
        if capacity > need:
            windows.add(capacity - need, name)
    return place, offset


def tokenized(docs: DataFrame, path: str, keys: list[Column], text: str = "text", end: int = 2, window: int = WINDOW, remember: int = CACHE_WORDS) -> DataFrame:
    """Pieces of every row: ``keys``, row, start, length, ids_crc32, doc_tokens and ids (little-endian u32).

    A null text is empty: its only id is ``end``.  A Python worker remembers about ``remember`` odd words.
    """
    wanted = docs.select(*keys, F.monotonically_increasing_id().alias("row"), F.col(text).alias("__text"))
    names = [n for n in wanted.columns if n != "__text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        known.limit = remember
        for batch in batches:
            for row, _, data, offsets in pieces(batch.column("__text"), TEXT_BYTES):
                ids, at = known.texts(data, offsets, end)
                total = np.diff(at)
                parts = -(-total // window)
                of = np.repeat(np.arange(len(total)), parts)
                start = ragged(np.zeros(len(total), np.int64), parts) * window
                length = np.minimum(window, total[of] - start)
                cut, raw = 4 * np.append(at[of] + start, at[-1]), memoryview(ids).cast("B")
                for lo in range(0, len(of), BATCH):
                    here = slice(lo, lo + BATCH)
                    own = [raw[a:b] for a, b in zip(cut[:-1][here].tolist(), cut[1:][here].tolist(), strict=True)]
                    rest = [batch.column(n).take(pa.array(row + of[here])) for n in names]
                    made = [pa.array(x, pa.int64()) for x in (start[here], length[here], list(map(zlib.crc32, own)), total[of[here]])]
                    yield pa.RecordBatch.from_arrays([*rest, *made, pa.array(own, pa.binary())], names=[*names, "start", "length", "ids_crc32", "doc_tokens", "ids"])

    kept = ", ".join(f"`{n}` {k}" for n, k in wanted.dtypes if n != "__text")
    return wanted.mapInArrow(tidy(cut), f"{kept}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (with row, start and length) with sequence_id and offset.

    Every piece is in one sequence; offsets of a sequence leave no gap.  Sequence numbers are
    unique, not consecutive.  Rows that repeat are pieces of their own.  The pieces are written to
    the shared folder first, so that all tasks see the same row numbers.
    """
    cut = RunFolder(pieces.sparkSession).cut(pieces, "pieces")
    shards = max(1, -(-cut.count() // SHARD_PIECES))
    names = cut.columns

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        place, offset = best_fit(table.column("length").to_numpy(), window)
        base = table.column("__shard")[0].as_py() << 32
        return table.select(names).append_column("sequence_id", pa.array(place + base)).append_column("offset", pa.array(offset))

    kept = ", ".join(f"`{n}` {k}" for n, k in cut.dtypes)
    sharded = cut.withColumn("__shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    return sharded.groupBy("__shard").applyInArrow(fill, f"{kept}, sequence_id long, offset long")
