"""Packing, WARC archives, and the pipeline."""

import gzip
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ramify.llm import packing, warc
from ramify.llm.queries import tokenizer_path
from ramify.llm.texts import flat

ODD = ["", None, "It's we'll I'D don't, Ñandú! ÉÀ ß İstanbul ŉa ſecret", "foo### %%% | x--y *** a_b_ [b] <|x x<| a'b' ''", "a\x1cb c\x1d", "x <|endoftext|>y", " \t\n ", "日本語 テキスト, 123 4.5 éa é", "\x85b ​ c d\x7f\x00a"]


def plain_ids(text):
    tokenizer = packing.word_ids(tokenizer_path()).tokenizer
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_hold_every_id_once(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta.", "Gamma!!", "δelta", "x9"]) for _ in range(rng.choice([3, 200, 6000])))) for i in range(40)]
    docs += [(100 + i, t) for i, t in enumerate(ODD)] + [(3, docs[3][1]), (None, "no key")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int").repartition(3)
    made = packing.tokenized(frame, tokenizer_path(), [F.col("doc_id")])
    packed = packing.pack(made).collect()
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(np.array(plain_ids(t), "<u4"))
    rows = {}
    for r in packed:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 1 <= r.length <= 4096
        rows.setdefault(r.row, []).append(r)
    whole = sorted((str(p[0].doc_id), b"".join(r.ids for r in sorted(p, key=lambda r: r.start))) for p in rows.values())
    assert whole == sorted((str(d), x.tobytes()) for d, many in ids.items() for x in many)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_words_learned_together_have_the_ids_of_the_whole_tokenizer():
    from tokenizers import pre_tokenizers

    # the letters of bytes are those of the tokenizer's library
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    every = "".join(chr(c) for c in [*range(33, 0x2000), *range(0x4E00, 0x4F00), *range(0x1F300, 0x1F400)])
    assert packing._BYTE_LETTERS[np.frombuffer(every.encode(), np.uint8)].tobytes().decode("utf-16-le") == level.pre_tokenize_str(every)[0][0]
    rng = random.Random(12)
    kinds = "aAbZzéÉßÿŸİıſ\u212a\u212b\u1e9eΣσ\u0301'\"!.,;:-_|()[]019日🙂\xad\x85\xa0\x1c\x1f\n\t "
    known = packing.WordIds(tokenizer_path())
    for _ in range(60):
        texts = ["".join(rng.choice(kinds if rng.random() < 0.5 else "abc DE.") for _ in range(rng.randint(0, 60))) for _ in range(10)]
        split = [packing._split(t) for t in texts]
        known.learn({w for own in split for w in own})
        for text, own in zip(texts, split, strict=True):
            got = np.frombuffer(b"".join(known[w] for w in own), "<u4").tolist()
            assert [*got, 2] == plain_ids(text)


def test_texts_split_together_have_the_ids_of_the_whole_tokenizer():
    rng = random.Random(13)
    known = packing.WordIds(tokenizer_path())
    letters = [*"aaaabeinorst", "th", "an", "É", "ñ", "Ÿ", "ß"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    words += [c * n for c in ("a", "ha", "z", "é", "!", "..-") for n in range(1, 40)]
    plain = [" ".join(w + rng.choice(["", "", ",", "!!", "..."]) for w in rng.sample(words, 300)) for _ in range(20)]
    for texts in (plain, ["", " ", ""], [t or "" for t in ODD]):
        data, offsets = flat(pa.array(texts))
        ids, at = known.texts(data, offsets, 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain_ids(t) for t in texts]
        if texts is plain:  # such words are not kept, so the work does not hang on how many return
            assert all(len(w.encode()) > packing.LONG for w in known)


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 300)
    place, offset = packing.best_fit(lengths, 64)
    room, plain = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        left = min(fits) if fits else 64
        if fits:
            room.remove(left)
        plain[i] = left
        room.append(left - lengths[i])
    assert {i: 64 - offset[i] for i in range(300)} == plain
    assert np.bincount(place, lengths).max() <= 64


def test_packing_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenized(frame, tokenizer_path(), [F.col("doc_id")])).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    members = [("a.txt", b"hello"), ("dir/b.bin", bytes(range(256)) * 50), ("empty", b"")]
    content = warc.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(content)) as plain:
        assert plain.testzip() is None and [(n, plain.read(n)) for n in plain.namelist()] == members
    view = warc.ZipView(memoryview(content))
    assert [(n, bytes(view.member(n))) for n in view.members] == members


def test_zip_of_others_can_be_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"stored")
        z.writestr(zipfile.ZipInfo("y"), b"more", zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    view = warc.ZipView(memoryview(out.getvalue()))
    assert bytes(view.member("x")) == b"stored"
    with pytest.raises(ValueError, match="compressed"):
        view.member("y")


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    long = "é<p>" * 400
    pages = [(i, f"http://x/{i}\r\nevil: 1", long if i % 3 == 0 else f"page {i} " * 200 if i % 3 == 1 else "short") for i in range(40)]
    pages += [(70, None, None), (71, "u", ""), (39, "again", long), (None, "no key", long)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write(frame).cache()
    got = warc.read(archives).collect()
    assert len(got) == len(pages)
    last = {}
    for p, _, h in pages:
        last[h] = max(last.get(h, -1), -1 if p is None else p)
    for r in got:
        originals = [h for p, _, h in pages if p == r.page_id and hashlib.sha1((h or "").encode()).hexdigest() == r.payload_digest]
        assert originals and r.payload_bytes == len((originals[0] or "").encode())
        revisit = r.payload_bytes >= 1000 and last[originals[0]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", last[originals[0]]) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == (originals[0] or "").encode()
    name, content = archives.first()
    with zipfile.ZipFile(io.BytesIO(content)) as plain:
        assert gzip.decompress(plain.read(warc.DATA)).startswith(b"WARC/1.1\r\n") and warc.INDEX in plain.namelist()
    assert warc.read(warc.write(frame.limit(0))).count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted copies, benchmark passages, secrets, junk, nulls and further columns."""
    rng = random.Random(3)
    folder = str(tmp_path_factory.mktemp("pipeline"))
    syllables = ["the", "re", "on", "an", "er", "st", "in"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(30))) for i in range(5)]
    docs = [(i, " ".join(say(150))) for i in range(200)]
    clean = {i for i, _ in docs}
    docs += [(300 + i, docs[i][1]) for i in range(10)]  # exact copies
    near = [docs[20 + i][1].split() for i in range(10)]
    for parts in near:
        parts[75] = "changed"
    docs += [(320 + i, " ".join(p)) for i, p in enumerate(near)]
    docs += [(340 + i, " ".join([*say(80), items[i][1], *say(80)])) for i in range(5)]
    docs += [(360 + i, " ".join(w + "###$$$" for w in say(100))) for i in range(30)]
    docs += [(400, " ".join(say(80)) + ' token = "abcdefgh12345" ' + " ".join(say(80))), (401, None), (402, ""), (None, " ".join(say(100)))]
    frame = spark.createDataFrame([(d, t, "en", "src0", len(t or ""), 1, [2]) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, row int, words array<int>")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 360), 0) for i in [*range(0, 200, 2), *range(360, 390, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, clean


def test_stages_take_effect(spark, tables, tmp_path):
    folder, clean = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert clean <= set(seen["packing"])
    assert not {i for i in seen["quality"] if i and 360 <= i < 390}
    assert not {i for i in seen["near_duplicates"] if i and 300 <= i < 330}
    assert not {i for i in seen["decontamination"] if i and 340 <= i < 345} and None in seen["decontamination"]
    assert sum(i in (401, 402) for i in seen["near_duplicates"]) == 1  # no words: one group
    text = spark.read.parquet(f"{tmp_path}/secrets").where("doc_id = 400").first().text
    assert "[SECRET]" in text and "abcdefgh12345" not in text
    final = corpus_pipeline.run(spark, folder).select("doc_id", "start", "ids_crc32").collect()
    again = spark.read.parquet(f"{tmp_path}/packing").select("doc_id", "start", "ids_crc32").collect()
    assert sorted(map(str, final)) == sorted(map(str, again))


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
