"""The quality classifier against plain versions of its statistics and of its densities."""

import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import quality
from graphloom.llm.common import binary, bytes_of

TEXTS = ["", " \n\t ", "one", "One two, two!\nThree\n\nthree | three", "ÄÖ é 日本 🙂 mixed 123 $%&\r\nline", "a | b | c\na | b | c\n", "word " * 300, "x\x00y @@ ##"]


def plain(text):
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(quality.NAMES)
    low = [w.lower() for w in words]
    n = len(words)
    of = lambda test: sum(1 for c in raw if test(c))
    upper, digit = lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57
    lower = lambda c: 97 <= c <= 122 or c >= 128
    stop = lambda c: chr(c) in ".,;:?'\"-()"
    symbol = lambda c: 33 <= c < 127 and not (upper(c) or digit(c) or lower(c) or stop(c))
    solid = max(1, of(lambda c: c != 32 and not 9 <= c <= 13))
    letters = max(1, of(lambda c: upper(c) or lower(c)))
    lines = raw.split(b"\n")
    kept = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    pairs = list(zip(low, low[1:], strict=False))
    root = lambda x: math.sqrt(min(max(x, 0.0), 1.0))
    return [
        math.log1p(n), math.log1p(solid / n), root(of(upper) / letters), root(of(digit) / solid), root(of(stop) / solid), root(of(symbol) / solid), root(sum(any(map(symbol, w)) for w in words) / n), root(sum(w == b"|" for w in words) / n),
        root(len(set(low)) / n), root(max(map(low.count, set(low))) / n), root(sum(len(w) <= 3 for w in words) / n), root(len(set(kept)) / len(kept)), math.log1p(n / len(kept)), root(len(set(pairs)) / max(n - 1, 1)),
    ]


def of(texts):
    return quality.statistics(*bytes_of(binary(pa.array(texts, pa.string()))))


def test_statistics_equal_their_definitions():
    assert np.allclose(of(TEXTS), [plain(t) for t in TEXTS])


@given(st.lists(st.text(alphabet=st.sampled_from("aB1 .|$\n\té"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_statistics_of_any_texts(texts):
    assert np.allclose(of(texts), [plain(t) for t in texts])


def test_scores_are_differences_of_normal_densities():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.4).astype(int)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + y[:, None] * np.array([1.0, 0, -1, 0.5, 0])
    x[:, 4] = 2.5  # a statistic that never changes
    model = quality.Discriminant(x, y)
    scale = x.std(0)
    z = (x - x.mean(0)) / np.where(scale > 1e-6, scale, 1)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (y == 0).mean() * own[0] + (y == 1).mean() * own[1]
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(5)
    logs = []
    for k in (0, 1):
        c, m = 0.8 * own[k] + 0.2 * pooled, z[y == k].mean(0)
        far = np.einsum("ij,ij->i", z - m, np.linalg.solve(c, (z - m).T).T)
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * far)
    d = logs[1] - logs[0]
    assert np.allclose(model.difference(x), np.sign(d) * np.log1p(np.abs(d)))
