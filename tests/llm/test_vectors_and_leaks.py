"""Centroid clustering, vector codes and decontamination against plain versions, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import clusters, codes, integers, winnowing
from graphloom.llm import queries as catalogue
from graphloom.llm.wordspans import LOWER, piece_hashes, spans

NAN, INF = float("nan"), float("inf")
SHAPE = "vec_id long, embedding array<double>, label int, cluster string, size int, code string"


@pytest.fixture(scope="module")
def vectors():
    """Vectors around a few places with ties, repeated rows, and rows that are no vectors."""
    rng = np.random.default_rng(5)
    places = rng.normal(size=(6, 64))
    rows = [(i, (places[i % 6] + rng.normal(size=64) * 0.2).round(2).tolist(), i % 3 if i % 7 else None) for i in range(150)]
    rows += [rows[3], rows[3], (151, rows[4][1], 2), (None, rows[5][1], 1)]
    odd = [None, [], [None] * 64, [NAN] * 64, [INF] + [0.0] * 63, [-INF] * 64, [0.5] * 63 + [None]]
    return rows, [(200 + i, v, 0) for i, v in enumerate(odd)], [(300, [0.5] * 63, 1), (301, [0.25] * 72, None)]


def tied(rows):
    return [(*r, "clash", 7, "clash") for r in rows]


def floors(v, scale):
    return [int(np.floor(scale * x)) for x in v]


def cluster_model(rows, k=40, rounds=5):
    x = [floors(r[1], 256) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), x[i]))
    c = [list(x[i]) for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        c = [[sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [v for v, o in zip(x, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    got = [near(v) for v in x]
    return [(r[0], j, d) for r, (d, j) in zip(rows, got, strict=True)], c


def test_clusters_equal_a_plain_model(spark, vectors):
    rows, odd, other = vectors
    found, centroids = clusters.clustered(spark.createDataFrame(tied(rows + odd + other), SHAPE).repartition(3))
    want, c = cluster_model(rows)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert centroids.tolist() == c
    told = clusters.report(found, centroids).collect()
    assert {r["inertia"] for r in told} == {sum(w[2] for w in want)} and len(told) == len(want)
    for r in told:
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_few_vectors_and_none(spark, vectors):
    rows, odd, other = vectors
    found, centroids = clusters.clustered(spark.createDataFrame(tied(rows[:3] + odd), SHAPE))
    assert len(centroids) == 3 and sorted(r["distance"] for r in found.collect()) == [0, 0, 0]
    for given_rows in ([], tied(odd + other)):
        found, centroids = clusters.clustered(spark.createDataFrame(given_rows, SHAPE))
        assert clusters.report(found, centroids).collect() == [] and len(centroids) == 0
    huge, _ = clusters.clustered(spark.createDataFrame(tied([(1, [1e300] * 64, 0), (2, [-1e300] * 64, 0), (3, [0.0] * 64, 0)]), SHAPE), k=1, rounds=0)
    assert max(r["distance"] for r in huge.collect()) == 64 * (2 * integers.MOST) ** 2


@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(1, 6), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_the_walk_finds_the_nearest_and_compares_less(seed, k, dims, spread):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-spread, spread + 1, (20, dims)), rng.integers(-spread, spread + 1, (k, dims))
    who, best, compared = clusters.nearest(x, c)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (who == d.argmin(1)).all() and (best == d.min(1)).all() and (compared <= k).all()


def test_the_walk_stops_at_the_frontier():
    c = np.arange(0, 40_000, 1000)[:, None] * np.ones((1, 4), np.int64)
    _, _, compared = clusters.nearest(c + 3, c)
    assert compared.max() <= 3


def code_model(rows, parts=8, entries=16, rounds=6):
    rows = [(r[0], r[2], floors(r[1], 4096)) for r in rows]
    w = len(rows[0][2]) // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    near = lambda v, b: min((sum((a - e) ** 2 for a, e in zip(v, x, strict=True)), j) for j, x in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(r[2], p), books[p])[1] for r in rows]
            books[p] = [[sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [cut(r[2], p) for r, o in zip(rows, own, strict=True) if o == j]) else books[p][j] for j in range(len(books[p]))]
    out = []
    for i, label, v in rows:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got)))
    return out, books


def test_codes_equal_a_plain_model(spark, vectors):
    rows, odd, other = vectors
    found, books = codes.compressed(spark.createDataFrame(tied(rows + odd + other), SHAPE).repartition(3))
    want, model = code_model(rows)
    assert books.tolist() == model
    told = codes.report(found, books).collect()
    by_label = lambda label: sum(w[3] for w in want if w[1] == label)
    digest = hashlib.sha256(",".join(str(x) for p in model for e in p for x in e).encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in told if r["vec_id"] is None or r["vec_id"] < 200), key=key) == sorted(((w[0], w[2], w[3], by_label(w[1])) for w in want), key=key)
    assert {r["codebooks_sha256"] for r in told} == {digest}
    # vectors of another length stay, without a code
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in told if (r["vec_id"] or 0) >= 200} == {(201, None, None, by_label(0)), (300, None, None, by_label(1)), (301, None, None, by_label(None))}


def test_codes_of_few_vectors_and_none(spark, vectors):
    rows, odd, _ = vectors
    found, books = codes.compressed(spark.createDataFrame(tied(rows[:2]), SHAPE))
    assert books.shape == (8, 2, 8) and [r["error"] for r in found.collect()] == [0, 0]
    for given_rows in ([], tied(odd[:1] + odd[2:])):
        assert codes.report(*codes.compressed(spark.createDataFrame(given_rows, SHAPE))).collect() == []
    only_empty = codes.report(*codes.compressed(spark.createDataFrame(tied([(1, [], 0)]), SHAPE))).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in only_empty] == [(1, None, None)]
    x = np.random.default_rng(1).normal(size=(400, 64))
    got, books = codes.compressed(spark.createDataFrame([(i, v.tolist(), 0, "", 0, "") for i, v in enumerate(x)], SHAPE))
    back = codes.restored(np.array([r["code"] for r in got.orderBy("vec_id").collect()]), books)
    assert ((back - x) ** 2).sum() < 0.75 * ((x - x.mean(0)) ** 2).sum()


@given(st.integers(0, 2**32), st.integers(1, 16), st.integers(1, 8), st.sampled_from([1, 3, 200, 1 << 27]))
@settings(max_examples=60, deadline=None)
def test_pivots_prune_and_lose_nothing(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-spread, spread + 1, (30, dims)), rng.integers(-spread, spread + 1, (n, dims))
    pivots = codes.choose_pivots(e)
    who, best, taken = codes.nearest(x, e, codes.lengths(x, pivots), pivots)
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (who == d.argmin(1)).all() and (best == d.min(1)).all() and taken <= 30 * n


def test_pivots_save_evaluations():
    rng = np.random.default_rng(2)
    e = rng.normal(size=(16, 8)) * 4000
    x, e = (e[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 8)) * 400).astype(np.int64), e.astype(np.int64)
    pivots = codes.choose_pivots(e)
    assert codes.nearest(x, e, codes.lengths(x, pivots), pivots)[2] < 2000 * 5


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leak_model(docs, items):
    windows = {}
    for name, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, named = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    named |= got
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), sorted(named), bool(hit)))
    return out


def run(spark, docs, items):
    found, hits = winnowing.contaminated(
        spark.createDataFrame([(d, t, "clash", 1, "clash") for d, t in docs], "doc_id long, text string, words string, row int, hash string").repartition(3),
        spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id int, text string, item string"),
    )
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect()], hits.collect()


by_doc = lambda r: (r[0] is None, r[0] or 0, r[1:3], str(r[3]))


def test_leaks_equal_a_plain_model(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Ähre", "日本", "x1", "42", "Ünder", "a", "b", "c"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 5, 7, 9, 10, 11, 15, 40]))) for i in range(25)] + [(None, say(30)), (2, say(20)), (7, None), (8, ""), (9, " . ! "), (10, say(12))]
    shared = say(14)
    items += [(50 + i, f"{shared} {say(12)}") for i in range(10)] + [(70, "a a a a a a a a a a a a")]
    docs = [(i, " ".join([say(rng.randrange(0, 120)), rng.choice(items)[1] or "", say(30)]).upper() if i % 3 else say(60)) for i in range(40)]
    docs += [(100 + i, f"before, {shared.upper()}; after") for i in range(30)]
    docs += [(1, None), (None, "no id " + shared), (2, ""), (3, "..."), (4, "a " * 5000), docs[5], docs[5], (5, shared[:-1]), (6, "a\x00b c|d~e")]
    got, hits = run(spark, docs, items)
    assert sorted(got, key=by_doc) == sorted(leak_model(docs, items), key=by_doc)
    text = {d: t for d, t in docs if d is not None and d >= 100}
    for h in hits:
        if h["doc_id"] in text:
            assert " ".join(words_of(text[h["doc_id"]])[h["start"] : h["start"] + h["length"]]) == h["words"]


def test_leaks_of_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == ([], [])
    assert run(spark, [(1, "a b c"), (2, None)], [])[0] in ([(1, 3, 0, [], False), (2, 0, 0, [], False)], [(2, 0, 0, [], False), (1, 3, 0, [], False)])
    got, _ = run(spark, [(1, "say A-b c now")], [(1, "a b c")])
    assert got == [(1, 5, 3, ["1"], True)]


def test_cleaned_drops_what_leaks(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (None, "five six"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three")], "item_id int, text string")
    assert sorted(str(r["doc_id"]) for r in winnowing.cleaned(docs, items).collect()) == ["2", "3", "None"]
    assert winnowing.cleaned(docs, items, share=0.5).count() == 4


@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_equal_runs_have_equal_fingerprints(texts, size):
    data = np.frombuffer("\n".join(" ".join("abcd"[w] for w in t) for t in texts).encode(), np.uint8)
    lengths = [len(" ".join("abcd"[w] for w in t)) + 1 for t in texts]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    offsets[-1] = len(data)
    starts, ends, counts = spans(LOWER[data], offsets, winnowing.APART)
    assert counts.tolist() == [len(t) for t in texts]
    first, at, hashes = winnowing.fingerprints(piece_hashes(data, starts, ends), counts, size)
    flat, seen = [w for t in texts for w in t], {}
    assert len(first) == sum(max(0, len(t) - size + 1) for t in texts)
    for f, a, h in zip(first, at, hashes, strict=True):
        assert f <= a <= f + size - winnowing.gram_size(size)
        assert seen.setdefault(tuple(flat[f : f + size]), (a - f, h)) == (a - f, h)


def test_bitmap_lets_all_fingerprints_through(spark):
    values = [0, 1, -1, 63, 64, -(2**63), 2**63 - 1, 123456789012345]
    bits = winnowing.bitmap(spark.createDataFrame([(v,) for v in values], "hash long"))
    assert all(bits[np.int64(v) & np.int64(winnowing.BITS - 1)] for v in values) and bits.sum() == len({v % winnowing.BITS for v in values})


def test_queries_are_registered():
    assert {"op11_centroid_clustering", "op12_vector_codes", "op13_decontamination"} <= set(catalogue.QUERIES) & set(catalogue.SQL)
