"""Families of documents whose common part is just below or just above a link, against all pairs of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.llm import ngrams


def texts(rnd, n):
    """A common passage with parts of one's own: most pairs are near a link, some link by the passage alone, some by a rare
    part that two of them share, some by neither."""
    common = [f"c{i}" for i in range(254)]
    out = []
    for i in range(n):
        kind = rnd.random()
        own = [f"w{i}x{j}" for j in range(rnd.choice([50, 50, 50, 30, 70, 100]))]
        if kind < 0.25 and out:  # a rare part of another one
            other = rnd.choice(out).split()[254:]
            own[: min(len(own), k)] = other[: (k := rnd.choice([5, 12, 20, 30]))]
        base = common if kind < 0.85 else common[rnd.randrange(40) :]
        out.append(" ".join([*base, *own]))
    return out


def components(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_lose_no_link_near_the_threshold(spark, seed, monkeypatch):
    monkeypatch.setattr(ngrams, "FAMILY_SETS", 24)
    monkeypatch.setattr(ngrams, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngrams, "CENTRES", 1)
    monkeypatch.setattr(ngrams, "CORE_SETS", 6)
    rows = list(enumerate(texts(random.Random(seed), 160)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in ngrams.join(docs).collect()}
    want = components(rows)
    assert got == want and 1 < len(set(want.values())) < 160


def test_time_grows_with_the_documents(spark):
    """250 shared and 50 own shingles link with nothing; four times the documents take less than eight times as long."""
    common = " ".join(f"c{i}" for i in range(254))
    took = []
    for n in (200, 1000, 4000):
        body = F.concat(F.lit(common + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), j.cast("string"))), " "))
        docs = spark.range(n).select(F.col("id").alias("doc_id"), body.alias("text"))
        began = time.perf_counter()
        assert ngrams.join(docs).select(F.countDistinct("component_id")).first()[0] == n
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1]
