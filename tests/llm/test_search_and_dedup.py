"""Top-k search, suffix-array deduplication, SimHash, components."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ramify.llm import simhash, suffixes, topk
from ramify.llm.components import components


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 420)]  # ties and repeated vectors
    rows += [(500, None), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [0.5]), (20, [2.0] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    vectors = topk.scaled(frame, "vec_id", "embedding")
    got = topk.PivotIndex(vectors, pivots=4, rings=3).search(vectors.where("id % 20 = 0"), 20).collect()
    kept = [(i, [float(np.floor(64 * np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, v + [0.0] * (6 - len(v))) for i, v in kept]
    queries = {}
    for i, v in kept:
        if i % 20 == 0:
            queries[i] = min(v, queries.get(i, v))
    expected = []
    for q, v in queries.items():
        scores = sorted((-int(np.dot(v, w)), i) for i, w in kept if i != q)[:20]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_topk_of_nothing(spark):
    none = topk.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.PivotIndex(none).search(none).count() == 0


def test_ring_bounds_hold():
    rng = np.random.default_rng(1)
    x, q, pivots = rng.normal(size=(200, 8)) * 20, rng.normal(size=(30, 8)) * 20, rng.normal(size=(5, 8)) * 20
    home, far = topk._nearest(x, pivots)
    names = np.unique(home)
    norm = np.sqrt((x**2).sum(1))
    rings = {"pivot": names, "near": np.array([far[home == p].min() for p in names]), "far": np.array([far[home == p].max() for p in names]), "norm": np.array([norm[home == p].max() for p in names])}
    bound = topk._bounds(q, pivots, rings)
    for k, p in enumerate(names):
        assert (bound[:, k] >= (q @ x[home == p].T).max(1)).all()


def test_suffix_arrays_equal_sorting():
    rng = random.Random(1)
    for _ in range(150):
        text, edges = [], [0]
        for _ in range(rng.randint(1, 6)):
            for _ in range(rng.randint(1, 4)):
                text += [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 12))] + [0]
            edges.append(len(text))
        order = suffixes.suffix_arrays(np.array(text, np.int32), np.array(edges))
        for a, b in zip(edges, edges[1:], strict=False):
            part = order[a:b].tolist()
            assert sorted(part) == list(range(a, b))
            keys = [text[i : text.index(0, i)] for i in part]
            assert keys == sorted(keys)


def removed(docs):
    last = 1 << 63
    texts = [(last if d is None else d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in texts:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], last + 1), d)
    out = []
    for d, b in texts:
        mask = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                mask[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((None if d == last else d, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeating():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, long, docs = [say(12) for _ in range(5)], say(30), []
    for i in range(90):
        kind = rng.random()
        if kind < 0.1:
            text = ""
        elif kind < 0.2 and docs:
            text = rng.choice(docs)[1]
        elif kind < 0.3:
            text = "ab" * rng.randint(10, 80)
        elif kind < 0.4:
            text = "x" * rng.randint(40, 120)
        else:
            text = say(rng.randint(3, 30)) + rng.choice(passages) + say(3) + ("é" if rng.random() < 0.3 else "") + (long if rng.random() < 0.3 else "")
        docs.append((i * 3, text))
    return [*docs, (30, docs[10][1]), (30, "zz" + docs[40][1]), (None, docs[50][1]), (7, None), (8, "\0" * 60), (9, "\0" * 60)]


@pytest.mark.parametrize("how", [{}, {"slice_rows": 10, "hot": 1}, {"slice_rows": 7, "hot": 3}])
def test_repeats_are_removed_exactly(spark, repeating, how):
    frame = spark.createDataFrame([(d, t, "x") for d, t in repeating], "doc_id long, text string, spans string")
    found = suffixes.remove_repeats(frame, [F.col("doc_id")], **how)
    cells = [F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.size("spans"), F.sha2("kept", 256)]
    got = sorted((tuple(r) for r in found.select("doc_id", "n_bytes", *cells).collect()), key=str)
    assert got == removed(repeating)


def test_a_cold_anchor_that_ends_a_text_is_no_single_string(spark):
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hot, docs, tails = say(120), [], 0
    while tails < 30:
        passage = say(50)
        data = (say(60) + passage).encode()
        _, at, _ = suffixes.anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        inside = at[at >= 60]
        if len(inside) == 1 and inside[0] == 60 + 50 - suffixes.GRAM:  # the only anchor is the last gram
            docs += [say(80) + passage + say(80), hot + say(60) + passage]
            tails += 1
    docs += [hot + say(30) for _ in range(30)]
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = suffixes.remove_repeats(frame, [F.col("doc_id")], hot=2, slice_rows=8)
    cells = [F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.size("spans"), F.sha2("kept", 256)]
    assert sorted((tuple(r) for r in found.select("doc_id", "n_bytes", *cells).collect()), key=str) == removed(docs)


def test_repeats_of_an_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), [F.col("doc_id")]).count() == 0


def test_large_blocks_are_halved(monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.integers(97, 99, (300, suffixes.PIECE)).astype(np.uint8)
    rows[:, 20:70] = 97
    owner, block, valid = rng.permutation(300), np.zeros(300, np.int64), rng.random((300, suffixes.STARTS)) < 0.9
    monkeypatch.setattr(suffixes, "BLOCK_PIECES", 4)
    got = suffixes._halves(rows, owner, block, valid)
    # a piece's strings at the same start must meet; at another start they may
    anywhere, aligned = {}, {}
    for r, o, ok in zip(rows, owner, valid, strict=True):
        for at in np.flatnonzero(ok):
            text = r[at : at + 50].tobytes()
            anywhere[text] = min(anywhere.get(text, 10**9), o)
            aligned[text, at] = min(aligned.get((text, at), 10**9), o)
    for i in range(300):
        for at in np.flatnonzero(valid[i]):
            text = rows[i, at : at + 50].tobytes()
            assert anywhere[text] <= got[i, at] <= aligned[text, at]


def test_blocks_of_a_whole_step_are_built_together(monkeypatch):
    rng = np.random.default_rng(15)
    count = 16_000  # pairs, 1.3 MB
    rows = rng.integers(97, 123, (count, suffixes.PIECE)).astype(np.uint8)
    copied = rng.random(count // 2) < 0.5
    rows[1::2][copied, 10:75] = rows[::2][copied, 10:75]
    rows[:, 9] = rows[:, 75] = 65 + np.arange(count) % 2  # no copy is longer by chance
    owner, valid = rng.permutation(count), np.ones((count, suffixes.STARTS), bool)
    calls, plain = [], suffixes.suffix_arrays
    monkeypatch.setattr(suffixes, "suffix_arrays", lambda text, block: calls.append(len(block) - 1) or plain(text, block))
    got = suffixes.least_of_strings(rows, owner, np.repeat(np.arange(count // 2), 2), valid)
    assert calls == [count // 2]
    want = np.repeat(owner[:, None], suffixes.STARTS, 1)
    least = np.minimum(owner[::2], owner[1::2])[copied]
    for side in (0, 1):
        part = want[side::2]
        part[np.ix_(copied, np.arange(10, 75 - suffixes.SPAN + 1))] = least[:, None]
    assert (got == want).all()


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(ids))}


def test_fingerprints_and_links_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    texts = [" ".join(rng.choice("ABCDEFGHIJ") + str(rng.randint(0, 30)) for _ in range(60)) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(texts)]
    for i in range(30, 120):  # near copies
        parts = rng.choice(texts).split()
        parts[rng.randrange(60)] = "new" + str(rng.randint(0, 3))
        docs.append((i, "\t ".join(parts)))
    docs += [(200, ""), (201, None), (202, " one"), (203, "a b"), (204, "A  b"), (205, " \n")]
    frame = spark.createDataFrame(docs, "id long, text string").repartition(4)
    prints = simhash.with_fingerprints(frame, "text", 3).select("id", F.col("__fp").alias("fp"))
    got = {r.id: (r.fp[0] & (2**64 - 1), r.component) for r in prints.join(simhash.near_duplicates(prints, simhash.complete_grid(3), 3), "fp").collect()}
    plain = {i: plain_fingerprint(t, 3) for i, t in docs}
    assert {i: fp for i, (fp, _) in got.items()} == plain
    assert {i: c for i, (_, c) in got.items()} == plain_components(list(plain), list(plain.values()), 3)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_grid_is_complete(radius):
    rng = random.Random(radius)
    for _ in range(100):
        a = rng.getrandbits(64)
        b = a
        for _ in range(radius):
            b ^= 1 << rng.randrange(64)
        per = lambda x: [bin(x >> s & 3).count("1") for s in range(0, 64, 2)]
        ca, cb = per(a), per(b)
        assert any(all(ca[s] == cb[s] for s in range(32) if m >> 2 * s & 3) for _, m in simhash.complete_grid(radius))


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(301, 300), (300, 301), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 60)} | {301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wide_fingerprints_find_similar_texts(spark):
    rng = random.Random(8)
    say = lambda: [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    docs = []
    for i in range(30):
        base = say()
        docs.append((2 * i, " ".join(base)))
        near = list(base)
        near[rng.randrange(200)] = "changed"
        docs.append((2 * i + 1, " ".join(near)))
    prints = simhash.with_fingerprints(spark.createDataFrame(docs, "id long, text string"), "text", 5, 8).select("id", F.col("__fp").alias("fp"))
    groups = simhash.near_duplicates(prints, simhash.sparse_grid(8), simhash.radius_for(0.8, 512, 0.0))
    got = {r.id: r.component for r in prints.join(groups, "fp").collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def five_words(text):
    parts = text.lower().split()
    return {" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


@pytest.mark.parametrize("block_rows", [1024, 6])
def test_near_duplicate_stage_equals_brute_force(spark, monkeypatch, block_rows):
    from ramify.llm import shingles

    monkeypatch.setattr(shingles, "BLOCK_ROWS", block_rows)  # the second: groups of several blocks
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    common, docs = say(40), []
    for i in range(120):  # pairs around 0.8, on both sides
        base = say(rng.choice([60, 150, 200])) + (common if i % 3 == 0 else [])
        near = list(base)
        for _ in range(rng.randint(2, 4) * len(base) // 150 + 1):
            near[rng.randrange(len(base))] = rng.choice(["Changed", "other"])
        docs += [" ".join(base), " ".join(near)]
    whole = say(150)
    for _ in range(40):  # one group of near copies
        near = list(whole)
        near[rng.randrange(150)] = say(1)[0]
        docs.append(" ".join(near))
    for k in range(10, 21):  # planted at and just below 0.8: n shared shingles of n + k
        docs += [" ".join(x := say(84)), " ".join([*x, *say(k)])]
    docs += ["", None, "  ", "a b", "A  b", "a b c", docs[0], docs[5].upper()]
    sets = [five_words(t or "") for t in docs]
    edges, values = [], []
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s == sets[j] or 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                edges.append((i, j))
            values.append(both / max(1, len(s | sets[j])))
    assert sum(0.8 <= v <= 0.85 for v in values) > 20 and sum(0.74 <= v < 0.8 for v in values) > 20
    root = list(range(len(docs)))
    for _ in range(len(docs)):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect())
    assert got == sorted(set(root))


def test_a_passage_in_many_rows_makes_few_pairs(spark, monkeypatch):
    from ramify.llm import shingles

    rng = random.Random(13)
    say = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = say(60)
    docs = [say(60) + (passage if i % 3 == 0 else []) + say(60) for i in range(600)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    seen, real = [], shingles._judged
    monkeypatch.setattr(shingles, "_judged", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    assert corpus_pipeline.near_duplicate_stage(spark, frame, "").count() == 600
    assert sum(seen) < 60
    assert corpus_pipeline.near_duplicate_stage(spark, frame.limit(0), "").count() == 0
