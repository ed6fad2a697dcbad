"""Ranked lexical search over document FP-trees, with depth-first branch and bound.

Documents are reduced to the terms that the items ask for.  Each task files its documents in
FP-trees: a document's terms stand in one order, the most frequent first, and documents whose
vectors begin alike share the path.  Chains without a fork are one node, and small neighbouring
branches share a leaf.  Every node knows the largest tf of each term below it and the smallest m,
and the score grows with tf and falls with m, so both give a bound for all documents below.  An item goes
down the tree, the best child first, and leaves out what cannot reach its k-th score so far.  A
bound equal to that score is followed, as a smaller id wins a tie.

The items' terms are sent to the tasks in blocks of bounded size; one block is the rule.  Terms are compared
by 64-bit hashes of their bytes.  Document statistics cover all documents.  All scores are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ramify.llm.texts import ragged, run_hashes, runs, words
from ramify.session import RunFolder

#: Terms of items (counted once an item) that are searched for together.
BLOCK_TERMS = 1 << 16
#: Documents of a leaf, and of a tree; terms of a tree.
LEAF_DOCS, TREE_DOCS, TREE_TERMS = 32, 1 << 13, 1 << 21
#: Shares in which an item's results from all tasks are ranked first.
SHARES = 32

#: What is no part of a term: ASCII but digits and letters.
_OTHER = np.zeros(256, bool)
_OTHER[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every term of runs of rows, A-Z as a-z."""
    for first, _, data, offsets, _ in runs(column, _OTHER):
        start, end, row = words(data, offsets, _OTHER)
        yield row + first, run_hashes(data, start, end)


# --- trees -------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """The FP-tree of some documents; ``m`` by document, ``edges`` its part of ``term`` (rank of frequency) and ``tf``."""

    ids: np.ndarray
    m: np.ndarray
    edges: np.ndarray
    term: np.ndarray
    tf: np.ndarray

    def __post_init__(self) -> None:
        size = np.diff(self.edges)
        by = np.lexsort((self.term, np.repeat(np.arange(len(size)), size)))
        path = [p.tobytes() for p in np.split(self.term[by].astype(">u4"), self.edges[1:-1])]
        order = sorted(range(len(size)), key=lambda d: (path[d], self.m[d]))
        take = by[ragged(self.edges[order], size[order])]
        self.ids, self.m, self.term, self.tf = self.ids[order], self.m[order], self.term[take], self.tf[take]
        self.edges = np.concatenate([[0], np.cumsum(size[order])])
        self._grow([path[d] for d in order])
        self._bound()

    def _grow(self, path: list[bytes]) -> None:
        """Nodes as ranges of documents: first, end, parent and whether a leaf."""
        first, end, parent, leaf, todo = [], [], [], [], [(0, len(path), -1, 0)]
        while todo:
            lo, hi, up, depth = todo.pop()
            node = len(first)
            first.append(lo)
            end.append(hi)
            parent.append(up)
            leaf.append(hi - lo <= LEAF_DOCS)
            if leaf[-1]:
                continue
            a, b = path[lo], path[hi - 1]
            # the documents are sorted, so what the first and the last share all share
            x, y = (np.frombuffer(p, ">u4", min(len(a), len(b)) // 4) for p in (a, b))
            apart = np.flatnonzero(x[depth:] != y[depth:])
            depth = depth + int(apart[0]) if len(apart) else len(x)
            at = self.edges[lo:hi] + depth
            next_ = np.where(at < self.edges[lo + 1 : hi + 1], self.term[np.minimum(at, len(self.term) - 1)], -1)
            cuts = np.concatenate([[0], np.flatnonzero(next_[1:] != next_[:-1]) + 1, [hi - lo]]) + lo
            start = lo
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y - x > LEAF_DOCS:
                    if start < x:
                        todo.append((start, x, node, depth))
                    if next_[x - lo] < 0 or x == lo and y == hi:  # equal vectors, in order of m
                        todo += [(i, min(i + LEAF_DOCS, y), node, depth) for i in range(x, y, LEAF_DOCS)]
                    else:
                        todo.append((x, y, node, depth + 1))
                    start = y
                elif y - start > LEAF_DOCS:
                    todo.append((start, x, node, depth))
                    start = x
            if start < hi:
                todo.append((start, hi, node, depth))
        self.first, self.end, self.parent, self.leaf = map(np.array, (first, end, parent, leaf))
        self.children: list[list[int]] = [[] for _ in first]
        for node, up in enumerate(parent[1:], 1):
            self.children[up].append(node)

    def _bound(self) -> None:
        """Smallest m of every node, and the largest tf below it of every term that stands there."""
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(self.first, self.end, strict=True)])
        leaves = np.flatnonzero(self.leaf)
        leaves = leaves[np.argsort(self.first[leaves])]
        of = np.repeat(np.repeat(leaves, (self.end - self.first)[leaves]), np.diff(self.edges))
        nodes = len(self.first)
        key, most = _largest(self.term.astype(np.int64) * nodes + of, self.tf)
        keys, tfs = [key], [most]
        while len(key):
            up = self.parent[key % nodes]
            key, most = key // nodes * nodes + up, most
            key, most = key[up >= 0], most[up >= 0]
            key, most = _largest(key, most)
            keys.append(key)
            tfs.append(most)
        key, self.most = _largest(np.concatenate(keys), np.concatenate(tfs))
        self.at_node, self.of_term = key % nodes, key // nodes

    def search(self, asked: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Add to ``best`` what this tree has for an item with terms ``asked``; the number of leaves opened."""
        most = np.zeros((len(asked), len(self.first)), np.int64)
        for i, (a, b) in enumerate(zip(np.searchsorted(self.of_term, asked), np.searchsorted(self.of_term, asked, "right"), strict=True)):
            most[i, self.at_node[a:b]] = self.most[a:b]
        bound = (weight[:, None] * gain(most, self.least_m)).sum(0)
        opened, todo = 0, [0]
        while todo:
            node = todo.pop()
            if not best.wants(bound[node]):
                continue
            if not self.leaf[node]:
                below = self.children[node]
                todo += sorted(below, key=bound.__getitem__)
                continue
            opened += 1
            lo, hi = self.first[node], self.end[node]
            part = slice(self.edges[lo], self.edges[hi])
            at = np.minimum(np.searchsorted(asked, self.term[part]), len(asked) - 1)
            hit = np.flatnonzero(asked[at] == self.term[part])
            doc = np.repeat(np.arange(hi - lo), np.diff(self.edges[lo : hi + 1]))[hit]
            score = np.zeros(hi - lo, np.int64)
            np.add.at(score, doc, weight[at[hit]] * gain(self.tf[part][hit], self.m[lo:hi][doc]))
            best.add(score, self.ids[lo:hi])
        return opened


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each unit of weight."""
    return 1000000000 * tf // (1000 * tf + 8 * m)


def _largest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the largest value of each."""
    by = np.argsort(key, kind="stable")
    key, value = key[by], value[by]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.maximum.reduceat(value, begin) if len(begin) else value


class Best:
    """The k best (score, id) of one item; ids by ascending order, the largest number stands for a null."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def wants(self, bound: int) -> bool:
        return bound > 0 and (len(self.score) < self.k or bound >= self.score[-1])

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score > 0
        if len(self.score) == self.k:
            good &= score >= self.score[-1]
        if good.any():
            score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.ids, ids[good]])
            by = np.lexsort((ids, -score))[: self.k]
            self.score, self.ids = score[by], ids[by]


# --- the plan ----------------------------------------------------------------------------------------

_NULL = np.iinfo(np.int64).max


def _vectors(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, n, term, tf) of every document with a term: numbers and occurrences of its ``known`` ones."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(known)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            rows, n, found = batch.num_rows, np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.int64)]
            for row, h in terms(batch.column("text")):
                n += np.bincount(row, minlength=rows)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                found.append(row[hit] * len(known) + at[hit])
            key, tf = np.unique(np.concatenate(found), return_counts=True)
            edges = np.searchsorted(key, np.arange(rows + 1) * len(known)).astype(np.int32)
            term = pa.ListArray.from_arrays(pa.array(edges), pa.array((key % len(known)).astype(np.int32)))
            often = pa.ListArray.from_arrays(pa.array(edges), pa.array(tf.astype(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), term, often], names=["id", "n", "term", "tf"])
            yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(restrict, "id long, n long, term array<int>, tf array<bigint>")


def _asked(items: DataFrame) -> DataFrame:
    """Distinct (item, h) of items with terms."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h in terms(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(h.view(np.int64))], names=["item", "h"])

    return items.mapInArrow(explode, f"item {items.schema['item'].dataType.simpleString()}, h long").distinct()


def _block(vectors: DataFrame, pairs: list, known: np.ndarray, kind: pa.DataType, item_type: str, k: int) -> DataFrame:
    """(item, id, score): every task's k best of every item."""
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    docs, length = total.docs, total.terms or 1
    counted = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(known), np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    # the most frequent first
    order = np.lexsort((known, -df))
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    by_item: dict = {}
    for item, h in pairs:
        by_item.setdefault(item, []).append(h)
    names = list(by_item)
    asked = [np.sort(rank[np.searchsorted(known, np.array(h, np.int64).view(np.uint64))]) for h in by_item.values()]
    given = vectors.sparkSession.sparkContext.broadcast((rank, weight[order], names, asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weight, names, asked = given.value
        best = [Best(k) for _ in names]
        for batch in batches:
            ids = batch.column("id").fill_null(_NULL).to_numpy()
            m = 100 - 90 + 90 * batch.column("n").to_numpy() * docs // length
            edges = batch.column("term").offsets.to_numpy().astype(np.int64)
            term, tf = (batch.column(c).values.to_numpy() for c in ("term", "tf"))
            lo = 0
            while lo < len(ids):
                hi = min(lo + TREE_DOCS, max(lo + 1, int(np.searchsorted(edges, edges[lo] + TREE_TERMS)) - 1), len(ids))
                own = slice(edges[lo], edges[hi])
                tree = Tree(ids[lo:hi], m[lo:hi], edges[lo : hi + 1] - edges[lo], rank[term[own]], tf[own])
                for a, b in zip(asked, best, strict=True):
                    tree.search(a, weight[a], b)
                lo = hi
        size = [len(b.score) for b in best]
        score = np.concatenate([np.zeros(0, np.int64), *(b.score for b in best)])
        ids = np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])
        item = pa.array(names, kind).take(pa.array(np.repeat(np.arange(len(names)), size)))
        yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=ids == _NULL), pa.array(score)], names=["item", "id", "score"])

    return vectors.where(F.size("term") > 0).mapInArrow(search, f"item {item_type}, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", item: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): every item's k best documents with a score above 0, equal scores by ascending id.

    Rows with one item id are one item with the terms of all; a null id is one such item.  Documents are judged
    row by row: repeated rows stand there as often, and a null id comes last among equal scores.  A null text
    has no terms; an item without terms has no result, nor has any item if no document has a term.  Texts of any length are read
    whole, in runs.  Other columns are not read.
    """
    folder = RunFolder(docs.sparkSession)
    wanted = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    asked = folder.cut(_asked(items.select(F.col(item).alias("item"), F.col(text).alias("text"))), "asked")
    field = asked.schema["item"].dataType
    blocks = max(1, -(-asked.count() // block_terms))
    found = None
    for b in range(blocks):
        pairs = [(r.item, r.h) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "h").collect()]
        if not pairs and (found is not None or b < blocks - 1):
            continue
        known = np.unique(np.array([h for _, h in pairs] or [0], np.int64).view(np.uint64))
        vectors = folder.cut(_vectors(wanted, known), f"vectors{b}")
        part = _block(vectors, pairs, known, to_arrow_type(field), field.simpleString(), k)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    share = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(SHARES))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item", "rank", "id", "score")


#: The contract's result from all scores.
PLAIN_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS row_, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
z AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len_ FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
e AS (SELECT row_, doc_id, n, term, count(*) AS tf FROM (SELECT row_, doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM e, z WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT q.item_id, e.row_, e.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len_))))::BIGINT AS score
  FROM q JOIN v ON q.term = v.term JOIN e ON e.term = q.term, z GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
