"""Quality classifier: regularised quadratic discriminant.

Each class of labelled texts is a normal distribution over transformed statistics of a document, its covariance shrunk
towards the pooled one and that towards its diagonal. Scores are differences of Mahalanobis log-densities, with the
Cholesky factors computed once and sent to the executors, brought to probabilities by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, slices
from .toxicity import FIT_ROWS, fit_rows, held_out, logistic
from .wordspans import LOWER, SPACE, piece_hashes, spans

#: Shares of the pooled covariance in a class's, and of the pooled diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
NAMES = ("log_words", "word_length", "upper", "digits", "stops", "symbols", "odd_words", "bars", "distinct_words", "top_word", "short_words", "distinct_lines", "line_words", "distinct_pairs")
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[[i for i in range(0x21, 0x7F) if not _CLASS[i]]] = 5
_CLASS[SPACE] = 6


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])[offsets])


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, how many different keys it has and how often the most common one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
    most = np.zeros(n)
    np.maximum.at(most, t[first], np.diff(np.append(first, len(k))))
    return np.bincount(t[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics of each text, in the order of NAMES; shares go through a square root, counts through a
    logarithm. Texts without words are all 0."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, len(NAMES)))
    kinds = _CLASS[data]
    starts, ends, counts = spans(data, offsets)
    text = np.repeat(np.arange(n), counts)
    solid = np.maximum(_sums(kinds != 6, offsets), 1)
    letters = np.maximum(_sums((kinds == 1) | (kinds == 2), offsets), 1)
    words = np.maximum(counts, 1).astype(float)
    per = lambda flags: np.bincount(text, flags, n) / words
    symbol_sums = np.concatenate([[0], np.cumsum(kinds == 5)])
    odd = symbol_sums[ends] > symbol_sums[starts]
    hashes = piece_hashes(LOWER[data], starts, ends)
    different, most = _distinct(hashes, text, n)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
    inside = text[1:] == text[:-1]
    pair_kinds, _ = _distinct(pairs[inside], text[1:][inside], n)
    line_end = data == 10
    line_first = np.append(True, line_end[:-1])
    line_first[offsets[1:-1][offsets[1:-1] < len(data)]] = True
    line_starts = np.flatnonzero(line_first)
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    line_keys = piece_hashes(data, line_starts, np.append(line_starts[1:], len(data)))
    line_kinds, _ = _distinct(line_keys, line_text, n)
    lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    root = lambda share: np.sqrt(np.clip(share, 0, 1))
    out = np.column_stack(
        [
            np.log1p(counts), np.log1p(solid / words), root(_sums(kinds == 2, offsets) / letters), root(_sums(kinds == 3, offsets) / solid), root(_sums(kinds == 4, offsets) / solid), root(_sums(kinds == 5, offsets) / solid),
            root(per(odd)), root(per((ends - starts == 1) & (data[starts] == ord("|")))), root(different / words), root(most / words), root(per(ends - starts <= 3)), root(line_kinds / lines), np.log1p(counts / lines), root(pair_kinds / np.maximum(counts - 1, 1)),
        ]
    )
    out[counts == 0] = 0
    return out


class Discriminant:
    """Class means and the inverse Cholesky factors of their shrunk covariances."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        scale = x.std(0)
        self.middle, self.scale = x.mean(0), np.where(scale > 1e-6, scale, 1.0)
        z = (x - self.middle) / self.scale
        own = [np.cov(z[y == k].T, bias=True) if (y == k).sum() > 1 else np.eye(x.shape[1]) for k in (0, 1)]
        share = np.array([(y == k).mean() for k in (0, 1)])
        pooled = sum(s * c for s, c in zip(share, own, strict=True))
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(x.shape[1])
        self.means = [z[y == k].mean(0) for k in (0, 1)]
        factors = [np.linalg.cholesky((1 - TO_POOLED) * c + TO_POOLED * pooled) for c in own]
        self.inverse = [np.linalg.inv(f) for f in factors]
        self.constant = [np.log(s) - np.log(np.diag(f)).sum() for s, f in zip(share, factors, strict=True)]
        self.curve = np.array([1.0, 0.0])

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log(share * density) of class 1 less that of class 0, compressed beyond 1 so that outliers stay comparable."""
        z = (x - self.middle) / self.scale
        logs = [c - 0.5 * (((z - m) @ i.T) ** 2).sum(1) for c, m, i in zip(self.constant, self.means, self.inverse, strict=True)]
        d = logs[1] - logs[0]
        return np.sign(d) * np.log1p(np.abs(d))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(x) * self.curve[0] + self.curve[1], -30, 30)))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        x = statistics(data, offsets)
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(pa.array(x[:, i], pa.float64()) for i in range(x.shape[1]))], [*(n for n, _ in kept), *NAMES])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Discriminant | float:
    """The discriminant of at most `limit` labelled rows that are not held out; the share of class 1 where only one class
    has labels."""
    sample = F.broadcast(fit_rows(labels, "quality", limit))  # at most `limit` narrow rows
    chosen = docs.select("doc_id", "text").join(sample, "doc_id").select("quality", "part", "text")
    rows = chosen.mapInArrow(_statistics, "quality int, part int, " + ", ".join(f"{n} double" for n in NAMES)).collect()
    y = np.array([r["quality"] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return float((y.sum() + 0.5) / (len(y) + 1))
    x = np.array([[r[n] for n in NAMES] for r in rows], float)
    part = np.array([r["part"] for r in rows])
    main = part != 3 if len(set(y[part != 3])) == 2 and len(set(y[part == 3])) == 2 else np.ones(len(y), bool)
    model = Discriminant(x[main], y[main])
    rest = ~main if (~main).any() else main
    model.curve = logistic(model.difference(x[rest])[:, None], y[rest].astype(float), 1e-3)
    return model


def _scores(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            p = np.full(len(batch), model.value) if isinstance(model.value, float) else model.value.probability(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return run


def scored(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, name: str = "quality_score") -> DataFrame:
    """`docs` with the probability of quality 1 of every row, from its whole text alone, in the new column `name`.

    Null and empty texts score as texts whose statistics are all 0. Rows with equal texts score equally. Labels that are
    null or neither 0 nor 1 are not used. An empty table gives an empty result. A column `name` must not be there.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {name}")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    schema = docs.select("*").schema.add(name, "double")
    return docs.mapInArrow(_scores(model, name), schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) by `scored`."""
    found = scored(docs.select("doc_id", "text"), labels, limit, "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with the columns of `docs` alone, whatever their names. Rows
    without a text score as in `scored`; repeated rows stay or go together; an empty table gives an empty result."""
    [name] = free(docs.columns, "quality_score")
    return scored(docs, labels, limit, name).where(F.col(name) >= threshold).select(*docs.columns)
