"""Lexical search, URL rules, collocations: against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ramify.llm import hashcounts, phrases, ranking, urlfilter

# --- lexical search


def plain_search(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    bags = [(d, Counter(term.findall(lower(t)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    count, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term.findall(lower(t)))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * count // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort()
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "ÀB"]
    say = lambda n: " ".join(rng.choice(words[: rng.choice([5, 20, 63])]) for _ in range(n))
    docs = [(i, say(rng.choice([1, 5, 30, 200]))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(3, docs[3][1]), (None, docs[3][1]), (400, None), (401, ""), (402, "- ; _"), (403, "w1 " * 60000), (404, "W1-w2_w3")]
    items = [(i, say(rng.choice([1, 3, 12]))) for i in range(15)] + [(1, "w7 w8"), (50, None), (51, "!"), (52, "nowhere"), (None, "w5"), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block_terms": 8}])
def test_search_equals_all_scores(spark, library, monkeypatch, how):
    docs, items = library
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, id int, item string").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranking.search(frame, asked, 5, **how).collect()]
    assert sorted(got, key=str) == plain_search(docs, items, 5)


def test_search_of_empty_tables(spark, library):
    docs = spark.createDataFrame(library[0], "doc_id long, text string")
    items = spark.createDataFrame(library[1], "item_id long, text string")
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0


def test_trees_leave_branches_shut():
    rng = np.random.default_rng(2)
    size, groups = 4000, 40
    edges, term, tf = [0], [], []
    for i in range(size):  # documents about one of many matters
        own = 10 + 20 * (i % groups) + rng.choice(20, 6, replace=False)
        ts = np.sort(np.concatenate([rng.choice(10, 4, replace=False), own]))
        term.append(ts)
        tf.append(rng.integers(1, 9, len(ts)))
        edges.append(edges[-1] + len(ts))
    m, ids = rng.integers(50, 200, size), rng.permutation(size)
    tree = ranking.Tree(ids, m, np.array(edges), np.concatenate(term), np.concatenate(tf))
    assert sorted(np.concatenate([np.arange(a, b) for a, b, leaf in zip(tree.first, tree.end, tree.leaf, strict=True) if leaf])) == list(range(size))
    weight = np.concatenate([np.full(10, 10), np.full(20 * groups, 4000)]).astype(np.int64)
    asked = np.array([3, 10 + 20 * 7, 10 + 20 * 7 + 3, 10 + 20 * 7 + 5])
    best = ranking.Best(10)
    opened = tree.search(asked, weight[asked], best)
    score = np.zeros(size, np.int64)
    for d in range(size):
        for t, f in zip(term[d], tf[d], strict=True):
            if t in asked:
                score[d] += weight[t] * ranking.gain(np.int64(f), m[d])
    order = np.lexsort((ids, -score))[:10]
    assert best.ids.tolist() == ids[order].tolist() and best.score.tolist() == score[order].tolist()
    assert opened < 0.2 * tree.leaf.sum()


# --- URL rules


def plain_verdict(url, rules, default):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", after)[0]
    path = re.match("[^?#]*", after[len(host) :])[0]
    host_low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    place = host_low + after[len(host) :]
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in place)
    fits = [r for r in rules if place and re.search(r.regex, folded if r.folded else place)]
    best = min(fits, key=lambda r: (r.folded, -len(r.rule), r.action, r.rule), default=None)
    return host_low, path, best.rule if best and not best.folded else None, best.rule if best and best.folded else None, best.action if best else default


URLS = [
    None, "", "no scheme", "://", "http://", "http://net/", "http://NET", "http://a.NET/x", "http://anet/x", "http://net/?q", "http://net?x=/", "https://www.example.net/en/1", "https://example.net/EN/1",
    "https://example.net/en", "ftp://x.example.com/de/", "http://example.com/de", "http://example.org/fr/1#net/", "http://q.test/?u=http://net/", "http://ads.test/", "http://bads.test/", "http://x.ads.test/A",
    "http://a.test/dir/setup.EXE", "http://a.test/setup.exe?x", "http://a.test/Viagra1", "http://a.test/p?sessionid=4", "http://a.test/p?mysessionid=4", "http://a.test/banners/", "http://a.test/cgi-bin/x",
    "http://a.test/license", "http://a.test/license/x.exe", "http://a.test/xlicense", "http://é.test/banners/ü", "http://docs.test/viagra", "http://a:80/net/", "http://user@net/x", "http://net./x",
]


def test_verdicts_equal_all_rules(spark):
    rules = urlfilter.production_rules() + [urlfilter.pattern_rule(*r) for r in [("|q.*u=", "block"), ("a.b*c^d|", "allow"), ("^X_y+(z)", "block"), ("||é.test^", "block")]]
    urls = [*URLS, *URLS[5:9], "http://a.b/c/d", "http://z/?x_y+(Z)"] + ["http://hot.net/1"] * 50
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(4)
    got = urlfilter.judge(frame, "url", urlfilter.rule_table(spark, rules))
    rows = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__pattern"], r["__verdict"]) for r in got.collect()}
    assert rows == {i: plain_verdict(u, rules, "allow") for i, u in enumerate(urls)}
    assert got.columns[:4] == frame.columns and len({v[3] for v in rows.values()}) > 8
    assert urlfilter.judge(frame.limit(0), "url", urlfilter.rule_table(spark, rules)).count() == 0


def test_rules_are_filed_under_their_rarest_literal(spark):
    rules = [urlfilter.host_rule("example.com/rare/", "block"), urlfilter.pattern_rule("common", "block"), urlfilter.pattern_rule("^common^other^", "block")]
    assert rules[0].tokens == ("example", "com", "rare") and rules[1].tokens == () and rules[2].tokens == ("common", "other")
    places = spark.createDataFrame([("example.com/common/",), ("example.com/common/other/",)], "folded string")
    filed = {r.rule: r.token for r in urlfilter.index(urlfilter.rule_table(spark, rules), places).collect()}
    assert filed == {"example.com/rare/": "rare", "common": "", "^common^other^": "other"}
    for bad in ("net", "/x", "Net/", "a/?b"):
        with pytest.raises(ValueError, match="not a rule"):
            urlfilter.host_rule(bad, "block")
    with pytest.raises(ValueError, match="literal"):
        urlfilter.pattern_rule("||*", "block")


# --- collocations


def plain_mine(docs, least, limit):
    f = defaultdict(Counter)
    for _, text, lang in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n, rows = sum(v for p, v in c.items() if len(p) == 1), []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and v >= least and 100 * v >= 50 * a and p in (q[:-1], q[1:]) for q, v in c.items()):
                continue
            s, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(rows[:limit])]
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    words = ["the", "of", "A", "é", "New", "York", "city", "x1"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", " ! "]) for _ in range(n))
    docs = [(i, say(rng.choice([0, 1, 40])), rng.choice(["en", "fr", None, "und"])) for i in range(120)]
    return docs + [(3, "new york city " * 30, "en"), (None, "only once here", "xx"), (500, None, "en"), (501, "", None), (502, "a b", "yy")]


@pytest.mark.parametrize("run_bytes, least, limit", [(1 << 20, 10, 2000), (64, 3, 7)])
def test_collocations_equal_plain_counts(spark, talk, monkeypatch, run_bytes, least, limit):
    monkeypatch.setattr(phrases, "RUN_BYTES", run_bytes)  # the second: texts longer than a run, cut between words
    frame = spark.createDataFrame([(*d, "p", 1) for d in talk], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    got = [tuple(r) for r in phrases.mine(frame, least=least, limit=limit).collect()]
    assert sorted(got) == plain_mine(talk, least, limit)


def test_border_failures_are_counted_in_further_passes(spark, talk, monkeypatch):
    monkeypatch.setattr(phrases, "SAMPLE_LEAST", 10**6)  # the sample proposes nothing: words, pairs and triples follow pass by pass
    frame = spark.createDataFrame(talk, "doc_id long, text string, lang string")
    passes, real = [], phrases._frequent_hashes
    monkeypatch.setattr(phrases, "_frequent_hashes", lambda *a: passes.append(a) or real(*a))
    assert sorted(tuple(r) for r in phrases.mine(frame).collect()) == plain_mine(talk, 10, 2000)
    assert len(passes) == 4


def test_ranking_in_shares(spark, talk, monkeypatch):
    monkeypatch.setattr(phrases, "RANK_ROWS", 6)
    frame = spark.createDataFrame(talk, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in phrases.mine(frame, least=3, limit=3).collect()) == plain_mine(talk, 3, 3)


def test_collocations_of_an_empty_table(spark, talk):
    frame = spark.createDataFrame(talk, "doc_id long, text string, lang string")
    assert phrases.mine(frame.limit(0)).count() == 0 and phrases.mine(frame, least=10**6).count() == 0


def test_packed_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)
    h = np.concatenate([h, np.repeat(h[0], 150000), h[:100]])
    for bits in (0, 3):
        bucket, codes, counts = hashcounts.packed(h, bits)
        assert bucket.to_pylist() == list(range(1 << bits))
        import pyarrow as pa

        total = 0
        for k in range(1 << bits):
            code, count = hashcounts.merged(pa.table({"codes": codes.slice(k, 1), "counts": counts.slice(k, 1)}))
            total += count.sum()
            mine = h[h >> np.uint64(64 - bits) == k] if bits else h
            expected = Counter((mine >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).tolist())
            assert dict(zip(code.tolist(), count.tolist(), strict=True)) == expected
        assert total == len(h)
    assert [len(x) for x in hashcounts.packed(h[:0], 2)] == [0, 0, 0]
