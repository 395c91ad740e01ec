"""The operators of the llm subpackage against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, embeddings, html, media, mixing, ngrams, overlap, quality, secrets, tokenfiles, toxicity
from graphloom.llm.common import binary, bytes_of, components
from graphloom.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int"
ODD = [None, "", " ", "one", "two words here", "Ä é 日本 🙂", "a " * 3000, "x" * 5000, "same text as another row for sure", "same text as another row for sure", "tail   ", "\n\n", "a\x00b", "<|endoftext|> inside <|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, ties, repeated rows, null ids and sources, and columns whose names clash with ours."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "clash", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[8], (None, "no id", "en", "s1", 5, "clash", 7)], SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(14)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def ids_of(texts):
    return [e.ids for e in bpe.library(vocabulary_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


# secrets


def spans_model(text):
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_key", "apikey", "PassWd", ":", "=", '"', "'", " ", "é", "AKIA", "0123456789abcdef", "Zz9/", "secret", "abcdefghijkl", "\n"]), max_size=25).map("".join))
def test_base_spans(text):
    assert secrets.joined(secrets.base_spans(text)) == spans_model(text)
    if secrets.base_spans(text):
        assert secrets.may_hold(text.encode())


def test_secret_ownership(spark):
    live, shared = "Zq8sKd93LmPw02XcVb71", "Ab3dEf6hIj9kLm2nOp5q"
    rows = [(1, f"see {live} end", "en", "s1"), (2, f"{shared}", "en", "s1"), (3, f"x {shared}", "en", "s2"), (4, shared, "en", "s3"), (5, f"token={live}", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: [(s["kind"], s["copied"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert found == {1: [("owned", False)], 2: [], 3: [], 4: [], 5: [("assign", False)]}
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert out[1] == "see [SECRET] end" and out[5] == "[SECRET]" and out[3] == f"x {shared}"


def test_secret_edge_cases(spark, odd, empty):
    rows = secrets.scan(odd).collect()
    assert len(rows) == odd.count() and all(r["base"] == "" and r["spans"] == [] for r in rows)
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0
    clash = odd.withColumn("_key", F.lit("mine")).withColumn("_spans", F.lit(1)).withColumn("rid", F.lit(2))
    out = secrets.redact(clash)
    assert out.columns == clash.columns and {tuple(r) for r in out.select("_key", "_spans", "rid").collect()} == {("mine", 1, 2)} and out.count() == odd.count()


def ownership_model(rows):
    """(doc_id, kind, start, copied, live) of all spans that stay, by plain loops."""
    owners, every = {}, []
    for i, text, lang, source in rows:
        base = secrets.base_spans(text or "")
        for s, k, e, v in base + secrets.further_spans(text or "", base):
            owners.setdefault(v, set()).add(source)
            every.append((i, k, s, v))
    return sorted((i, secrets.KINDS[k], s, len(owners[v]) >= 3, secrets.looks_live(v)) for i, k, s, v in every if k < 3 or secrets.looks_live(v) and len(owners[v]) < 3)


def test_ownership_equals_plain_counts(spark, monkeypatch):
    rnd = random.Random(6)
    token = lambda: "".join(rnd.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(24)) + "aA1"
    values = [token() for _ in range(12)]
    rows = [(i, " and ".join(rnd.choice(["token = ", "see ", ""]) + rnd.choice(values[:1] * 9 + values + [token()]) for _ in range(rnd.randint(0, 4))), "en", rnd.choice(["s1", "s2", "s3", "s4", None])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    monkeypatch.setattr(common, "HOT_ROWS", 2)  # the first value is hot and split
    got = sorted((r["doc_id"], s["kind"], s["start"], s["copied"], s["live"]) for r in secrets.scan(docs).collect() for s in r["spans"])
    assert got == ownership_model(rows) and any(x[1] == "owned" for x in got)


# BPE and token files


def test_pieces_give_the_library_ids():
    rnd = random.Random(1)
    alphabet = list("ab Z09.'!\n\té日🙂  ") + [" ", " ", "\x85", "<|endoftext|>", "'s", "\x1c"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    data, offsets = bytes_of(binary(pa.array(texts)))
    ids, counts = bpe.encode_texts(vocabulary_path(), data, offsets)
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == ids_of(texts)


def test_plain_texts_are_encoded_in_whole_runs(monkeypatch):
    """Only disputed characters go piece by piece: plain texts in whole runs, whatever white space they have."""
    path = vocabulary_path()
    rnd = random.Random(11)
    plain = [*"ab ZÉß09.'|!", "\n", "\t", "  ", " \n ", "   ", "'s", "'ll", " the", "\n\n", "token"]
    texts = ["", " ", "  ", "\n", "a ", "a  ", " a", "  a", "\ta", "a\n\nb", "a \n", "x" * 900, " " * 300 + "x", "É" * 70]
    texts += ["".join(rnd.choice(plain) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    mixed = [t + rnd.choice([" 日本 ", "\u2019s", "<|endoftext|>", "\x00", "\x01 \x00", " \u0250", "\u00d7 \u00bf", " <", "<|"]) + u for t, u in zip(texts, texts[1:], strict=False)]

    def encoded(rows):
        ids, counts = bpe.encode_texts(path, *bytes_of(binary(pa.array(rows))))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    assert encoded(mixed) == ids_of(mixed)

    def by_piece(*_):
        raise AssertionError("a plain text was encoded by pieces")

    monkeypatch.setattr(bpe.Pieces, "numbers", by_piece)
    assert encoded(texts) == ids_of(texts)


def rows_of(texts, least):
    data, offsets = bytes_of(binary(pa.array(texts)))
    return [x.tolist() for x in bpe.encode_rows(vocabulary_path(), data, offsets, least)]


@pytest.mark.parametrize("least", [1, 3, 50, 400])
def test_joined_halves_give_the_library_ids(least):
    rnd = random.Random(least)
    texts = ["x" * 3000, "aaab" * 700, "日本語テスト" * 200, "日本。語、テ" * 200, "1234567890" * 300, " " * 900 + "end", "".join(rnd.choice("abc '1.\n") for _ in range(4000)), "don't" * 400, "<|endoftext|>" * 90, "🙂é" * 500]
    texts += ["'" * 700, "''s" * 300, "a'll" * 300, "'re've" * 200, "   \n  " * 200, "\u3000\xa0 " * 200, "x\u0301" * 400, "<|endof" * 100, "", "z"]
    assert rows_of(texts, least) == ids_of(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["'", "'s", "'ll", "s", "t", "re", " ", "  ", "\n", "9", ".", "-", "é", "日", "。", "<|", "<|endoftext|>", "the", " of", "\u0301"]), max_size=60).map("".join), st.integers(1, 12))
def test_joins_at_contractions_and_runs(text, least):
    assert rows_of([text], least) == ids_of([text])


def test_encoded_rows(odd, empty):
    path = vocabulary_path()
    got = bpe.encoded(odd, path, row_bytes=1000, leaf_bytes=100, finish=bpe.IDS_AND_DIGESTS).collect()
    want = Counter((i, h([x for x in w])) for i, w in ((r["doc_id"], ids_of([r["text"]])[0]) for r in odd.collect()))
    assert Counter((r["doc_id"], h(bpe.unpacked(r["ids"]).tolist())) for r in got) == want
    for r in got:
        ids = bpe.unpacked(r["ids"]).tolist()
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = bpe.library(path).decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(odd, path), path).collect()}
    assert texts[5] == ODD[5] and texts[0] == ""
    assert bpe.encoded(empty, path).count() == 0


def h(ids):
    return hashlib.md5(str(ids).encode()).hexdigest()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), max_size=120), max_size=12))
def test_grammar_round_trip(docs):
    ids = [np.array([*d * 8, 0]) for d in docs]
    f = tokenfiles.Frame(tokenfiles.frame(list(range(len(ids))), ids, 50_257))
    assert all(np.array_equal(f.ids(i), x) for i, x in enumerate(ids))
    assert np.array_equal(f.all_ids(), np.concatenate(ids) if ids else [])


def test_grammar_goes_on_until_no_pair_repeats():
    ids = [np.append(np.arange(1, 300), 0)] * 3000
    f = tokenfiles.Frame(tokenfiles.frame(list(range(len(ids))), ids, 50_257))
    assert len(f.sequence) <= 2 * len(ids) and np.array_equal(f.all_ids(), np.concatenate(ids))
    own = np.random.default_rng(1).integers(1, 400, 400_000)
    f = tokenfiles.Frame(tokenfiles.frame([0], [own], 1 << 16))  # symbols above 16 bits
    pairs, times = np.unique((f.sequence[:-1] << 32) | f.sequence[1:], return_counts=True)
    assert (times[pairs >> 32 != pairs & 0xFFFFFFFF] < 2).all() and np.array_equal(f.all_ids(), own)
    assert len(tokenfiles.Frame(tokenfiles.frame([0], [np.full(200_000, 7)], 50_257)).sequence) < 40


def test_passes_cost_what_they_count():
    """300 passes over a few documents cost no more because a million ids without any pair stand beside them."""
    chain = np.concatenate([np.append(np.arange(1, k), 0) for k in range(3, 300) for _ in range(2)])
    alone = 1000 + np.random.default_rng(3).permutation(1 << 20)

    def seconds(ids):
        ends = ids == 0
        ends[-1] = True
        begin = time.process_time()
        seq, rules = tokenfiles.compress(ids, ends, 1 << 21)
        took = time.process_time() - begin
        lengths = tokenfiles.expansion_lengths(rules, 1 << 21)
        assert np.array_equal(tokenfiles.expand(seq, rules, lengths, 1 << 21), ids)
        return took

    few, many, both = (min(seconds(x) for _ in range(3)) for x in (chain, alone, np.append(chain, alone)))
    assert both < 2 * (few + many)


def test_all_ids_of_frames_with_short_and_with_nested_rules():
    rnd = np.random.default_rng(5)
    for ids in ([np.append(rnd.integers(1, 90, 4000), 0)], [np.append(np.arange(1, 200), 0)] * 200, [np.zeros(0, np.int64)], []):
        f = tokenfiles.Frame(tokenfiles.frame(list(range(len(ids))), ids, 50_257))
        assert np.array_equal(f.all_ids(), np.concatenate(ids) if ids else [])


def test_random_access_into_frames():
    rnd = random.Random(8)
    words = [[rnd.randint(1, 500) for _ in range(rnd.randint(2, 9))] for _ in range(60)]
    ids = [np.array([*(i for _ in range(rnd.randint(0, 80)) for i in rnd.choice(words)), 0]) for _ in range(40)]
    f = tokenfiles.Frame(tokenfiles.frame(list(range(40)), ids, 50_257))
    assert len(f.rules) and f.lengths.tolist() == [len(f.ids_of_rule(r)) for r in range(len(f.rules))]
    for i, x in enumerate(ids):
        low, high = sorted(rnd.randint(0, len(x)) for _ in range(2))
        assert np.array_equal(f.ids(i, low, high), x[low:high]) and np.array_equal(f.ids(i), x)


def test_many_rows_of_one_id_are_cut_into_shards(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text number {i} of many") for i in range(60)] + [(1, "first"), (9, "last")], "doc_id long, text string")
    path = str(tmp_path / "hot")
    tokenfiles.write(docs, vocabulary_path(), path, shard_docs=8)
    frames = spark.read.parquet(path)
    got = sorted(tokenfiles.read(frames).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1] + [7] * 60 + [9] and frames.select("shard").distinct().count() > 4
    assert all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(got, got[1:]))


def test_token_files(spark, odd, empty, tmp_path):
    path = str(tmp_path / "frames")
    tokenfiles.write(odd, vocabulary_path(), path, shard_docs=4, frame_ids=500)
    frames = spark.read.parquet(path)
    assert frames.count() > 3
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read(frames).collect())
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start, want = 0, []
    for r in rows:
        ids = [*ids_of([r["text"]])[0], 0]
        want.append((start, r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokenfiles.stored(empty, vocabulary_path()).count() == 0


# media


def test_media(odd, empty):
    rows = media.probe(media.mux(odd)).collect()
    assert len(rows) == odd.count() and media.probe(media.mux(empty)).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        full = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r["codec"] == "raw " and r["media_bytes"] > len(full)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=40_000))
def test_container_round_trip(raw):
    box = media.muxed(raw)
    found = media.probed(box)
    assert media.payload_of(box, found) == raw and found["duration"] == len(raw)
    assert [box[a:b] for a, b in found["keys"].tolist()] == [raw[i : i + media.SAMPLE] for i in range(0, len(raw), media.SAMPLE * media.KEY_EVERY)]
    assert media.probed(box[: len(box) // 2])["codec"] in (None, "raw ")


def boxes_of(raw, kind):
    at = raw.find(kind)
    return at - 4, int.from_bytes(raw[at - 4 : at], "big")


def patched(raw, kind, offset, form, *values):
    at, _ = boxes_of(raw, kind)
    out = bytearray(raw)
    struct.pack_into(form, out, at + 8 + offset, *values)
    return bytes(out)


WHOLE = media.muxed(bytes(range(256)) * 200)


def test_containers_of_other_makers():
    assert media.probed(WHOLE)["whole"] and media.probed(WHOLE)["handler"] == "soun"
    v1 = media.full(b"mdhd", bytes(16), struct.pack(">IQ", 90_000, 180_000), bytes(4), flags=1 << 24)
    at, size = boxes_of(WHOLE, b"mdhd")
    assert media._header(memoryview(v1), (8, len(v1))) == (90_000, 180_000)
    found = media.probed(patched(WHOLE, b"stsz", 8, ">I", 10_000))  # more samples told than there are
    assert not found["whole"] and len(found["sizes"]) == 50
    found = media.probed(patched(WHOLE, b"stss", 8, ">I", 9_999))  # a key frame beyond the last sample
    assert not found["whole"] and len(found["keys"]) == 3
    cut = media.probed(WHOLE[:-30_000])
    assert not cut["whole"] and len(media.payload_of(WHOLE[:-30_000], cut)) < 256 * 200 - 30_000 + 1
    assert media.probed(b"")["codec"] is None and media.tracks(b"abc") == []


def trak(number, tables, handler=b"soun", entry=b"mp4a"):
    stsd = media.full(b"stsd", struct.pack(">I", 1), media.box(entry, bytes(8)))
    mdhd = media.full(b"mdhd", bytes(8), struct.pack(">II", 1000, 0), bytes(4))
    tkhd = media.full(b"tkhd", bytes(8), struct.pack(">II", number, 0), bytes(60))
    hdlr = media.full(b"hdlr", bytes(4), handler, bytes(13))
    return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, hdlr, media.box(b"minf", media.box(b"stbl", stsd, *tables))))


def test_tables_of_one_track_do_not_count_for_another():
    many = lambda kind, *rows, width: media.full(kind, struct.pack(">I", len(rows)), *(struct.pack(f">{width}I", *r) for r in rows))
    table = lambda *keys: [many(b"stts", (4, 10), width=2), many(b"stsc", (1, 4, 1), width=3), media.full(b"stsz", struct.pack(">II", 5, 4)), many(b"stco", (0,), width=1), *([many(b"stss", *((k,) for k in keys), width=1)] if keys else [])]
    found = media.tracks(media.box(b"moov", trak(1, table()), trak(2, table(2), b"vide", b"avc1")))
    assert [(t["codec"], t["handler"], len(t["keys"]), t["duration"]) for t in found] == [("mp4a", "soun", 4, 40), ("avc1", "vide", 1, 40)]
    assert found[1]["keys"].tolist() == [[5, 10]]


def test_movie_fragments():
    empty = [media.full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")] + [media.full(b"stsz", struct.pack(">II", 0, 0))]
    head = media.box(b"moov", trak(1, empty), media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 1, 1, 20, 0, 0x10000))))
    tfhd = media.full(b"tfhd", struct.pack(">I", 1), struct.pack(">I", 0x10000), flags=0x20020)
    moof = lambda base: media.box(b"moof", media.box(b"traf", tfhd, media.full(b"trun", struct.pack(">Ii", 3, base), struct.pack(">I", 0x2000000), struct.pack(">III", 4, 5, 6), flags=0x205)))
    size = len(moof(0))
    raw = head + moof(size + 8) + media.box(b"mdat", b"aaaabbbbbcccccc")
    found = media.probed(raw)
    assert media.payload_of(raw, found) == b"aaaabbbbbcccccc" and found["duration"] == 60 and found["whole"]
    assert [raw[a:b] for a, b in found["keys"].tolist()] == [b"aaaa"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1400), st.integers(0, 255)), min_size=1, max_size=6), st.integers(0, len(WHOLE)))
def test_broken_containers_are_never_an_error(changes, length):
    raw = bytearray(WHOLE)
    for at, value in changes:
        raw[at] = value
    raw = bytes(raw[:length])
    for track in media.tracks(raw):
        assert len(media.payload_of(raw, track)) == track["sizes"].sum() and (track["keys"] <= len(raw)).all()
    media.feature_of(media.probed(raw))


def test_key_ranges(spark):
    rows = spark.createDataFrame([(1, bytearray(WHOLE), 5), (1, bytearray(WHOLE), 5), (2, None, 5), (3, bytearray(b"junk"), 5), (None, bytearray(WHOLE[:2000]), 5)], "doc_id long, media binary, codec long")
    got = media.key_ranges(rows).collect()
    assert Counter(r["doc_id"] for r in got)[1] == 8 and not any(r["doc_id"] in (2, 3) for r in got)
    assert {WHOLE[r["start"] : r["end"]] for r in got if r["doc_id"] == 1} == {(bytes(range(256)) * 200)[i : i + 1024] for i in range(0, 51_200, 16_384)}
    out = media.probe(rows).collect()
    assert [r["whole"] for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [True, True, False, False, False]
    assert media.key_ranges(rows.limit(0)).count() == 0 and media.probe(rows.limit(0)).count() == 0


# n-gram join


def shingles_model(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_model(rows):
    sets = [(i, frozenset(shingles_model(t))) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return Counter((i, len(s), low.get(find(a))) for a, (i, s) in enumerate(sets))


def near_copies(seed, n=140):
    rnd = random.Random(seed)
    common = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(30)) for _ in range(3)]
    bases = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 1, 2, 6])):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 9999)}"
        text = " ".join(words).upper() if rnd.random() < 0.2 else " ".join(words)
        rows.append((i, text + (" " + rnd.choice(common) if rnd.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 4])
def test_join_finds_all_links(spark, seed, monkeypatch):
    rows = near_copies(seed)
    if seed < 4:  # families in blocks, lists that name no guests
        monkeypatch.setattr(ngrams, "FAMILY_SETS", 6)
        monkeypatch.setattr(ngrams, "BLOCK_SETS", 3)
        monkeypatch.setattr(ngrams, "CENTRES", seed)
        monkeypatch.setattr(ngrams, "GUEST_FAMILIES", 1)
        monkeypatch.setattr(ngrams, "BROADCAST_ROWS", 10)
        monkeypatch.setattr(ngrams, "LAST_SHINGLES", 5)
        monkeypatch.setattr(ngrams, "REPEATED", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in ngrams.join(docs).collect())
    assert got == components_model(rows)
    kept = [r["doc_id"] for r in ngrams.keep_one(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in got})


def test_join_edge_cases(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = Counter(tuple(r) for r in ngrams.join(odd).collect())
    want = Counter({(i, n, i if c is None else c): k for (i, n, c), k in components_model(rows).items()})
    assert got == want
    assert ngrams.join(empty).count() == 0 and ngrams.keep_one(empty).count() == 0
    kept = ngrams.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id IN (8, 9)").count() == 1


def test_lists_across_batches(monkeypatch):
    """Lists cut anywhere into batches give what whole lists give."""
    rnd = random.Random(3)
    rows = sorted((rnd.randint(1, 9), rnd.randint(1, 30), 2, rnd.randint(1, 5)) for _ in range(150))
    batch = lambda part, c: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in c], [("shingle", "node", "least", "home", "low")[i] for i in c])

    def cuts(own):
        places = sorted(rnd.sample(range(1, len(own)), 40))
        return [own[a:b] for a, b in zip([0, *places], [*places, len(own)])]

    got = Counter(tuple(r.values()) for part in ngrams._shared(batch(p, (0, 1, 2)) for p in cuts(rows)) for r in part.to_pylist())
    lists = {}
    for s, n, _, _ in rows:
        lists.setdefault(s, set()).add(n)
    assert got == Counter((s, n, 2, min(own)) for s, own in lists.items() if len(own) > 1 for n in own)
    for crowd in (100, 3, 1):
        monkeypatch.setattr(ngrams, "GUEST_FAMILIES", crowd)
        beside = sorted((s, n, 2, n % 4, min(own)) for s, own in lists.items() for n in own)
        want = Counter()
        for s, n, _, home, low in beside:
            families = {r[3] for r in beside if r[0] == s}
            want.update([(1, n, low)] if len(families) > crowd else [(0, n, f) for f in families if f < home])
        got = Counter()
        for part in ngrams._guests(batch(p, (0, 1, 2, 3, 4)) for p in cuts(beside)):
            for r in part.to_pylist():
                got[(r["crowded"], r["node"], r["family"])] += r["times"]
        assert got == want


def test_short_lists_cost_a_few_sorts():
    """Lists of two sets are taken many at once: a step for each of them cost over a hundred times the sort of their rows."""
    rnd = np.random.default_rng(4)
    shingle = np.repeat(np.sort(rnd.integers(-(1 << 62), 1 << 62, 100_000)), 2)
    node = rnd.integers(-(1 << 62), 1 << 62, len(shingle))
    columns = {"shingle": shingle, "node": node, "least": np.full(len(node), 2), "home": node, "low": np.repeat(node.reshape(-1, 2).min(1), 2)}
    batches = pa.table(columns).to_batches(max_chunksize=10_000)
    began = time.process_time()
    for batch in batches:
        np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
    sort = time.process_time() - began
    began = time.process_time()
    got = [r for part in ngrams._guests(iter(batches)) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
    took = time.process_time() - began
    pairs = np.sort(node.reshape(-1, 2), 1).tolist()
    assert sorted(got) == sorted((0, high, low, 2, 1) for low, high in pairs)
    assert took < 60 * sort


def test_sets_and_prefixes_by_text():
    """Sets and prefixes of many texts at once are those of each text by itself."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("ab") + str(rnd.randint(0, 2)) for _ in range(rnd.choice([0, 1, 4, 5, 9, 60]))) for _ in range(80)]
    texts = [None, "", " ", *texts, "a b c d e " * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    ((_, data, offsets),) = common.slices(iter([batch]), "text")
    found, counts = ngrams.shingle_sets(data, offsets)
    each = np.split(found, np.cumsum(counts)[:-1])
    alone = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        alone.append(ngrams.shingle_sets(raw, np.array([0, len(raw)]))[0])
    words = [(t or "").split() for t in texts]
    assert counts.tolist() == [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0 for w in words]
    assert all(np.array_equal(a, b) and np.array_equal(a, np.unique(a)) for a, b in zip(each, alone, strict=True))
    every, often = np.unique(found, return_counts=True)
    late = rnd.sample(range(len(every)), 100)
    last = np.sort(every[late])
    times = dict(zip(every.tolist(), often.tolist(), strict=True))
    often = np.array([times[x] for x in last.tolist()])
    want = set()
    standing = dict(zip(last.tolist(), often.tolist(), strict=True))
    for own, n in zip(each, counts, strict=True):
        if n:
            ordered = sorted(own.tolist(), key=lambda x: (standing.get(x, 0), x))
            name = ngrams.names(own, np.array([n]))[0].view(np.int64)[0]
            want |= {(x, int(name)) for x in np.array(ordered[: ngrams._prefix(np.array([n]))[0]], np.uint64).view(np.int64).tolist()}
    run = ngrams._postings(SimpleNamespace(value=(last, often)))
    got = [(r["shingle"], r["node"]) for part in run(iter([batch])) for r in part.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_many_near_copies():
    rnd = np.random.default_rng(5)
    base = [rnd.integers(0, 1 << 60, 80).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.append(base[i % 3][rnd.permutation(80)[:74]], rnd.integers(0, 1 << 60, 4).astype(np.uint64))) for i in range(240)]
    got = overlap.components(sets, 75, 100)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[a] = b
    top = lambda x: x if root[x] == x else top(root[x])
    assert len({(got[i], top(i)) for i in range(len(sets))}) == len(set(got)) == len({top(i) for i in range(len(sets))})


def test_divide_skip():
    rnd = random.Random(4)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 30))) for _ in range(rnd.randint(1, 25))]
        least = rnd.randint(1, 12)
        times = Counter(x for own in lists for x in own)
        assert dict(overlap.divide_skip(lists, least)) == {x: k for x, k in times.items() if k >= least}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# html


def test_html(spark):
    page = "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><article class='post'><h1>A &amp; B</h1><p>One,\n two&nbsp;three, with <b>bo</b>ld and more words here.<p>Short.<div class='share'>Share it</div><aside>Side</aside></article><div id='comments'><p>I really, really, really like this, thank you.</p></div><footer>&copy;</footer><script>if (a < b) { x('<p>no</p>') }</script></body></html>"
    assert html.main_text(page) == "A & B One, two three, with bold and more words here. Short."
    bare = "<body><div class='menu'><a href='a'>x</a></div><div id='content'><p>First paragraph, long enough to count, certainly.</p><p>Second one, also long enough to count here.</p></div><form><p>Give your name, please, and your address, too.</p></form></body>"
    assert html.main_text(bare) == "First paragraph, long enough to count, certainly. Second one, also long enough to count here."
    assert [html.main_text(x) for x in (None, "", "<<>", "<script>x", "<!-- a", "plain")] == ["", "", "<<>", "", "", "plain"]
    rows = html.extract(spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")).collect()
    assert {(r["page_id"], r["n_chars"]) for r in rows} == {(1, 59), (2, 0)}


ARTICLE = "<article><h1>T</h1><p>One, two, three paragraphs that are long enough to count here.</p><p>More text of the article follows in this place.</p></article>"
SAID = "T One, two, three paragraphs that are long enough to count here. More text of the article follows in this place."


@pytest.mark.parametrize("name", ["page with-sidebar", "layout has-menu", "share-price", "cookie-recipe", "related-work", "site-content has-sidebar", "no-sidebar", "comments-closed", "sidebar", "menu"])
def test_html_wrappers_keep_their_article(name):
    assert html.main_text(f"<body><nav>x</nav><div class='{name}'>{ARTICLE}</div><footer>f</footer></body>") == SAID


def test_html_parts():
    long = "<p>" + "Some words of prose, and others. " * 6 + "</p>"
    said = ("Some words of prose, and others. " * 6).strip()
    assert html.main_text(f"<body><form id=aspnetForm><div>{ARTICLE}</div></form></body>") == SAID
    assert html.main_text(f"<body><div>{ARTICLE}</div><div>{ARTICLE}</div></body>") == f"{SAID} {SAID}"
    inner = ARTICLE.replace("</article>", f"<section class='related-work'>{long}</section><section class=search-methods>{long}</section></article>")
    assert html.main_text(f"<body>{inner}</body>") == f"{SAID} {said} {said}"
    part = "<div class='newsletter-box'><p>Give us your address, please, for news.</p></div><footer>By someone</footer></article>"
    assert html.main_text(f"<body>{ARTICLE.replace('</article>', part)}</body>") == SAID
    comments = f"<div id='comments'>{'<article class=comment>' + long + '</article>'}{long * 3}</div>"
    assert html.main_text(f"<body>{ARTICLE}{comments}<aside>{long}</aside></body>") == SAID
    assert html.main_text(f"<body><div class='sidebar'>{long}</div><div>{long}{long}</div></body>") == f"{said} {said}"


def test_html_keeps_whole_articles():
    prose = "<p>" + "Some words of prose, and others. " * 4 + "</p>"
    said = ("Some words of prose, and others. " * 4).strip()
    assert html.main_text(f"<body><div><section><h2>A</h2>{prose}</section><section><h2>BB</h2><p>tiny part.</p></section></div></body>") == f"A {said} BB tiny part."
    assert html.main_text(f"<body><h1>T</h1><section><h2>A</h2>{prose}</section><section><p>tiny part.</p></section><footer>f</footer></body>") == f"T A {said} tiny part."
    assert html.main_text(f"<body><div><div><section>{prose}</section><section><b>x</b></section></div><section>end</section></div></body>") == f"{said} x"
    # adverts of any size, with and without links
    ad = "<div class='ad'><p>" + "Buy this now, it is the best of all things. " * 9 + "</p></div>"
    assert html.main_text(f"<body><article><h1>T</h1>{prose}{ad}</article></body>") == f"T {said}"
    assert html.main_text(f"<body><article><p>Short.</p>{ad}</article></body>") == "Short."
    assert html.main_text(f"<body><div class='newsletter'><article>{prose}</article></div></body>") == said
    # pages without paragraphs that count
    assert html.main_text("<div><h1>Hi</h1><p>Short.</p></div><footer>foot</footer>") == "Hi Short."
    assert html.main_text("<nav><a href=x>a</a></nav><div><p>Short.</p></div><footer>Copyright of the company, and all rights reserved for it.</footer>") == "Short."
    assert html.main_text("<form><p>Short.</p></form>") == "Short."
    assert html.main_text("<footer>only foot</footer>") in ("", "only foot")
    # teasers
    teaser = "<article><h3>Read on</h3><p>One more line that counts as a paragraph.</p></article>"
    assert html.main_text(f"<body><article><h1>T</h1>{prose * 3}</article><div>{teaser * 2}</div></body>") == f"T {said} {said} {said}"
    assert html.main_text(f"<body><article>{prose}</article><article>{prose}</article></body>") == f"{said} {said}"


@pytest.mark.parametrize("piece", ["<div>word,", "<i>a</b>", '<a b="', "<ul><li>x", "<p>word, word", "<a b='x\" ", "<table><tr><td>x", "<!-- x", "<script>x", "<"])
def test_html_takes_time_in_proportion(piece):
    began = time.process_time()
    html.main_text(piece * 10_000)
    once = time.process_time() - began
    html.main_text(piece * 40_000)
    assert time.process_time() - began - once < 8 * max(once, 0.1)


class Element:
    """A plain model of tree scoring: every figure from the whole subtree, by its definition."""

    def __init__(self, rnd, tag, depth=0):
        self.tag, self.children, self.text, self.link = tag, [], "", ""
        self.name = rnd.choice(["", "", "", "content", "story"]) if tag in ("div", "section") else ""
        if tag in ("p", "h2"):
            self.text, self.link = (" ".join(rnd.choice(["word", "prose,", "text", "more."]) for _ in range(rnd.randint(0, n))) for n in (40, rnd.choice([0, 0, 9])))
        else:
            kinds = ["p", "p", "h2", "div", "section", "blockquote"] + (["article", "main"] if depth == 1 else [])
            self.children = [Element(rnd, rnd.choice(kinds if depth < 4 else ["p"]), depth + 1) for _ in range(rnd.randint(1, 4))]
        for c in self.children:
            c.up = self

    def html(self):
        link = f" <a href=x>{self.link}</a>" if self.link else ""
        return f"<{self.tag} class='{self.name}'>{self.text}{link}{''.join(c.html() for c in self.children)}</{self.tag}>"

    def all(self):
        return [self, *(x for c in self.children for x in c.all())]

    def said(self):
        return " ".join((self.text + " " + self.link).split())

    def chars(self):
        return sum(len(x.said()) for x in self.all())

    def prose(self):
        return sum(len(x.said()) for x in self.all() if len(x.said()) >= 25 and 2 * len(x.link) < len(x.said()))

    def line(self):
        return [self, *(self.up.line() if self.tag != "body" else [])]

    def density(self):
        return sum(min(len(x.link), len(x.said())) for x in self.all()) / self.chars() if self.chars() else 0.0

    def score(self):
        gain = lambda x: 1 + x.said().count(",") + min(len(x.said()) // 100, 3)
        own = [c for c in self.children if len(c.said()) >= 25]
        below = [c for k in self.children for c in k.children if len(c.said()) >= 25]
        if not own and not below and not (self.tag in ("article", "main") and self.chars()):
            return None
        weight = {"article": 25, "main": 25, "section": 8, "div": 5, "blockquote": 3}.get(self.tag, 0) + 25 * (self.name != "")
        return (sum(map(gain, own)) + 0.5 * sum(map(gain, below)) + weight) * (1 - self.density())


def scored_model(body):
    every = body.all()
    score = {i: s for i, x in enumerate(every) if (s := x.score()) is not None}
    if not score:
        return " ".join(x.said() for x in every if x.said())
    best = every[max(score, key=lambda i: (round(score[i], 9), -i))]
    x = best
    while x is not body:
        if x.tag in ("article", "main"):
            best = x
            break
        x = x.up
    # sections of one container belong together
    sections = lambda x: [y for y in x.up.children if y.tag == "section" and y.chars()] if x.tag == "section" else []
    above = lambda x: next((y for y in x.line() if y.tag in ("article", "main")), x)
    while len(sections(best)) > 1 and best.up is not body:
        best = above(best.up)
    roots = [best] + [x for x in every if x.tag == "article" and x.chars() and x.density() < 0.5 and x.prose() >= 0.2 * best.prose()]
    if best is not body:
        if len(sections(best)) > 1:
            roots += sections(best) + [y for y in best.up.children if y.tag == "h2" and y.chars()]
        least = max(10, 0.2 * (best.score() or 0))
        for y in best.up.children:
            plain = y.tag == "p" and (y.chars() > 80 and y.density() < 0.25 or y.chars() <= 80 and not y.link)
            if y.tag != "article" and (y.score() or 0) >= least or plain:
                roots.append(y)
    kept = {id(x) for r in roots for x in r.all()}
    return " ".join(x.said() for x in every if id(x) in kept and x.said())


def test_html_scores_as_a_plain_model():
    rnd = random.Random(12)
    for _ in range(400):
        body = Element(rnd, "body")
        assert html.main_text(f"<html>{body.html()}</html>") == scored_model(body)


def test_html_tables(spark):
    shape = "page_id long, url string, html string, text string"
    rows = html.extract(spark.createDataFrame([(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, "", None)], shape)).collect()
    assert sorted((r["n_chars"], r["text"]) for r in rows) == [(0, ""), (len(SAID), SAID), (len(SAID), SAID)]
    assert html.extract(spark.createDataFrame([], shape)).count() == 0


# classifiers


def test_toxicity(spark, odd, empty, labels):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = ["".join(rnd.choice(["ba", "do", "ki", "lu", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(40)]
        if bad:
            words[rnd.randrange(40)] = words[rnd.randrange(40)] = "grox" + rnd.choice(["a", "ol", "im", "us"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score(docs, known).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    out = toxicity.score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_counts_all_rows(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    rows = [(i, " ".join(word() for _ in range(12)) + " same Same") for i in range(600)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    counted, fitted = toxicity.split(known, 60)
    fit = {r["doc_id"] for r in fitted.collect()}
    assert 0 < len(fit) < 25
    want = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and i not in fit:
            for w in text.lower().split():
                symbols = [257] * 5 + [*w.encode(), 256]
                want.update((tuple(symbols[end - 6 : end]), i % 2) for end in range(6, len(symbols) + 1))
    got = Counter()
    for r in toxicity.counted_places(docs, counted).collect():
        symbols = tuple(r["key"] >> (9 * i) & 511 for i in reversed(range(6)))
        got.update({(symbols, 0): r["ordinary"], (symbols, 1): r["toxic"]})
    assert +got == want
    scores = {r["doc_id"]: tuple(r) for r in toxicity.score(docs, known).collect()}
    monkeypatch.setattr(toxicity, "HOT_KEYS", 50)  # all other sequences come by the join
    assert {r["doc_id"]: tuple(r) for r in toxicity.score(docs, known).collect()} == scores


def test_ratios_equal_plain_kneser_ney():
    """The log-ratios against probabilities that are computed by their definitions from dictionaries."""
    rnd = random.Random(11)
    words = {k: ["".join(rnd.choice("abc" if k else "abd") for _ in range(rnd.randint(1, 8))) for _ in range(40)] for k in (0, 1)}
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    grams = [Counter(), Counter()]
    for k, own in words.items():
        for w in own:
            symbols = [257] * (n - 1) + [*w.encode(), 256]
            grams[k].update(tuple(symbols[i - n : i]) for i in range(n, len(symbols) + 1))

    def times(k, g):  # of the longest their number, else how many different symbols precede them
        if len(g) == n:
            return grams[k][g]
        longer = {x[-len(g) - 1 :] for c in ((0, 1) if len(g) <= toxicity.SHARED else (k,)) for x in grams[c] if x[-len(g) :] == g}
        return len(longer)

    everything = {x[-length:] for c in grams for x in c for length in range(1, n + 1)}

    def p(k, g):
        if not g:
            return 1.0 / 300
        beside = [times(k, x) for x in everything if len(x) == len(g) and x[:-1] == g[:-1]]
        total, kinds = sum(beside), sum(b > 0 for b in beside)
        lower = p(k, g[1:])
        return (max(times(k, g) - d, 0) + d * kinds * lower) / total if total else lower

    asked = sorted({x for c in grams for x in c})[::5] + [tuple([257] * (n - 1) + [ord("z")]), tuple(b"abcabz"[-n:])]
    keys = np.array([sum(s << (9 * i) for i, s in enumerate(reversed(g))) for g in sorted({*asked, *grams[0], *grams[1]})])
    order = np.argsort(keys)
    counts = [np.array([c[g] for g in sorted({*asked, *grams[0], *grams[1]})])[order] for c in grams]
    keys = keys[order]
    three = np.unique(toxicity.last(keys[counts[0] + counts[1] > 0], 3))
    shared = toxicity.shared_model(*np.unique(toxicity.last(three, 2), return_counts=True))
    got = dict(zip(keys.tolist(), (toxicity.ratios(keys, counts, shared) * toxicity.UNIT).tolist()))
    for g in asked:
        key = sum(s << (9 * i) for i, s in enumerate(reversed(g)))
        assert abs(got[key] - math.log(p(1, g) / p(0, g))) < 1e-6


def test_quality(spark, odd, empty, labels):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["the", "river", "runs", "under", "old", "bridges", "and", "stones"]) for _ in range(60)) + ".\nMore."
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "%%% ")) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, upper string")
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = quality.score(docs, known).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got)
    kept = quality.keep(docs, known)
    assert kept.columns == docs.columns and kept.count() == 200
    out = quality.score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(empty, labels).count() == 0


# embeddings


def test_embeddings(spark):
    rnd = np.random.default_rng(2)
    vectors = [rnd.normal(size=16) for _ in range(60)]
    vectors += [vectors[i % 5] + rnd.normal(size=16) * 0.05 for i in range(60)] + [vectors[0]] * 3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, 2.0]), (204, []), (205, [None] * 16), (206, [2.0, 4.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("clash"))
    result = embeddings.near_duplicates(table)
    got = {r["vec_id"]: r for r in result.collect()}
    links_model(got, np.array([np.float32(v) for v in vectors], float))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (200, 201, 202, 204, 205))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (203, 206)] == [(1, 203), (1, 203)]
    assert embeddings.audit(table, result, 5) == 1.0
    assert embeddings.near_duplicates(table.where("vec_id < 0")).count() == 0


def links_model(got, x, least=1.0):
    """Links and components of all vectors by comparing all; at least such a share of the links is found, and none besides."""
    x = x / np.sqrt((x**2).sum(1))[:, None]
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    true, found = links.sum(1), np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= least * true.sum()
    low = np.arange(len(x))
    while True:
        new = np.array([min(low[i], low[links[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    if least == 1.0:
        assert (found == true).all() and [got[i]["component_id"] for i in range(len(x))] == low.tolist()
    else:
        assert np.mean([got[i]["component_id"] == low[i] for i in range(len(x))]) >= least
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))


def planted(seed, dims=32):
    """Noise, a tight cluster, a wide cluster that no ball holds, pairs, and copies."""
    rnd = np.random.default_rng(seed)
    unit = lambda v: v / np.sqrt((v**2).sum(-1, keepdims=True))
    around = lambda n, wide: unit(unit(rnd.normal(size=dims)) + wide * unit(rnd.normal(size=(n, dims))))
    noise = unit(rnd.normal(size=(900, dims)))
    pairs = unit(noise[:200] + 0.3 * unit(rnd.normal(size=(200, dims))))
    x = np.concatenate([noise, around(900, 0.12), around(300, 0.33), pairs, noise[:50]])
    return x[rnd.permutation(len(x))]


@pytest.mark.parametrize("limits", [{}, {"SHARD_NODES": 64, "SAMPLE_ROWS": 400, "BUNDLE_NODES": 300, "BLOCK": 100}, {"SHARD_NODES": 100, "SHARD_MOST": 200, "BLOCK": 60, "BUNDLE_NODES": 200}])
def test_embeddings_with_large_clusters(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(embeddings, name, value)
    x = planted(4)
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    result = embeddings.near_duplicates(table)
    links_model({r["vec_id"]: r for r in result.collect()}, x, 0.98)
    assert embeddings.audit(table, result, 7) >= 0.98


# mixing


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (i % 37), ["a", "b", "c", None][min(3, i % 11)]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(docs, keep=("doc_id", "source")).collect()
    by = {}
    for r in plan:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in plan)
    assert abs(sum(own[0]["target"] for own in by.values()) - total) < 1e-6
    for own in by.values():
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5)
    level = min(own[0]["target"] / w for own, w in ((by[s], w) for s, w in (("a", 5), ("b", 2), ("c", 1), (None, 5))) if own[0]["target"] < 3 * own[0]["source_size"] - 1e-6)
    for s, w in (("a", 5), ("b", 2), ("c", 1), (None, 5)):
        assert abs(by[s][0]["target"] - min(3 * by[s][0]["source_size"], level * w)) < 1e-6
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.plan(docs.repartition(7)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in plan)
    mixed = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in mixed for _ in WORD.findall(r["text"])) == +Counter({r["doc_id"]: r["taken"] for r in plan})
    assert mixing.plan(odd).count() == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
