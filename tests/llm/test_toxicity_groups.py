"""Groups of the toxicity model: a pair of symbols that most sequences share is spread, and nothing depends on groups."""

import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import toxicity


def counts_of(words, n=toxicity.ORDER):
    found = [Counter(), Counter()]
    for i, w in enumerate(words):
        symbols = [257] * (n - 1) + [*w.encode(), 256]
        for at in range(n, len(symbols) + 1):
            found[i % 2][sum(s << (9 * j) for j, s in enumerate(reversed(symbols[at - n : at])))] += i % 3 > 0  # some in no class
    keys = np.array(sorted({*found[0], *found[1]}))
    return keys, [np.array([c[k] for k in keys.tolist()]) for c in found]


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_groups_give_the_ratios_of_one_group(spark, monkeypatch, broadcast):
    rnd = random.Random(17)
    letters = "abcdefgh"
    words = ["".join(rnd.choice(letters) for _ in range(3)) + "th" + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 2))) for _ in range(400)]
    words += ["".join(rnd.choice(letters + "t") for _ in range(rnd.randint(1, 6))) for _ in range(100)]
    keys, counts = counts_of(words)
    three = np.unique(toxicity.last(keys[counts[0] + counts[1] > 0], toxicity.SHARED + 1))
    shared = toxicity.shared_model(*np.unique(toxicity.last(three, toxicity.SHARED), return_counts=True))
    want = dict(zip(keys.tolist(), toxicity.ratios(keys, counts, shared).tolist()))
    monkeypatch.setattr(toxicity, "BUCKET_ROWS", 100)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", broadcast)
    rows = [(int(k), int(a + b), int(a), int(b)) for k, a, b in zip(keys, *counts)]
    got = toxicity.place_ratios(spark.createDataFrame(rows, "key long, times long, ordinary long, toxic long")).collect()
    assert {r["key"]: r["ratio"] for r in got} == want and len(got) == len(keys)


def test_no_sequences(spark):
    assert toxicity.place_ratios(spark.createDataFrame([], "key long, times long, ordinary long, toxic long")).count() == 0
