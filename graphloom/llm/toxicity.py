"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the bytes of words, one of toxic and one of ordinary labelled texts. The longest
sequences have their counts, every shorter one the number of different bytes that precede it (continuation counts): in
its class, and for the shortest, which both models back off to, in either class. Rare expressions then get nearly equal
likelihoods, and a word speaks for a class only where that class has seen it or words like it. The score of a text comes
from length-normalised differences of its log-likelihoods: of all words, of the three most toxic ones (what one word says
may be chance, so the least of the three counts by itself) and from how many words are evident.

Sequences are counted under exact keys in a table that grows with the documents and their labels, and what each says is
computed in groups of that table. Only the calibration sees a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, share_of, slices
from .wordspans import LOWER, piece_hashes, spans

#: Longest sequence of bytes, bits of a byte in a key (the last one is lowest; a word's end and start are symbols of their
#: own), discount.
ORDER, SYMBOL_BITS, DISCOUNT = 6, 9, 0.95
#: Sequences up to this length have counts that both classes share.
SHARED = 2
#: Labelled rows that a classifier is fitted on, about so many at most (by a hash); a quarter is the share of the
#: calibration here.
FIT_ROWS = 24_000
#: Words whose log-likelihood ratio is above this count as evidence.
EVIDENT = 3.0
#: What one word can say for either class at most.
CLIP = (-2.0, 14.0)
#: Log-likelihood ratios are whole numbers of this unit, so that their sums do not depend on the order of rows.
UNIT = 2.0**-32
#: Most frequent sequences whose ratios are broadcast (speed only: all others are joined), sequences of a group.
HOT_KEYS, BUCKET_ROWS = 1 << 18, 100_000
#: Rows (labelled documents, short sequences) up to which they are sent to the others instead of both being shuffled (speed
#: only).
BROADCAST_ROWS = 500_000
#: Sequences that a task holds before it adds up equal ones.
HELD_KEYS = 1 << 21



def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """The distinct lower-case words of some texts one after the other (bytes, start of each), for every word the number
    of its distinct one, and words per text."""
    data = LOWER[data]
    starts, ends, counts = spans(data, offsets)
    _, first, back = np.unique(piece_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = ends[first] - starts[first]
    at = np.cumsum(lengths) - lengths
    take = np.arange(lengths.sum()) - np.repeat(at - starts[first], lengths)
    return data[take], np.append(at, lengths.sum()), back, counts


def places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER symbols up to each place of some words (a word's end is a symbol of its own, and its start fills what is
    missing); and the word of each place."""
    lengths = np.diff(at) + 1
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text = np.full(len(word), 256, np.int64)
    text[place < lengths[word] - 1] = data
    key = np.zeros(len(word), np.int64)
    for i in range(ORDER):
        key |= np.where(place >= i, text[np.maximum(np.arange(len(word)) - i, 0)], 257) << (SYMBOL_BITS * i)
    return key, word


def last(key: np.ndarray, length: int) -> np.ndarray:
    """The last `length` symbols of the keys."""
    return key & ((1 << (SYMBOL_BITS * length)) - 1)


def added(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of keys and counts with equal keys added up."""
    rows = np.concatenate(parts, 1)
    key, back = np.unique(rows[0], return_inverse=True)
    return np.stack([key, *(np.rint(np.bincount(back, x, len(key))).astype(np.int64) for x in rows[1:])])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each sequence of ORDER symbols ends somewhere in the texts, and in labelled texts of either class."""
    held, n = [np.zeros((4, 0), np.int64)], 0
    for batch, data, offsets in slices(batches, "text"):
        words, at, back, counts = distinct_words(data, offsets)
        key, word = places(words, at)
        sums = [np.bincount(back, minlength=len(at) - 1)]
        for c in ("ordinary", "toxic"):
            rows = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            sums.append(np.rint(np.bincount(back, np.repeat(rows, counts), len(at) - 1)).astype(np.int64))
        held.append(added([np.stack([key, *(x[word] for x in sums)])]))
        n += held[-1].shape[1]
        if n > HELD_KEYS:
            held = [added(held)]
            n = held[0].shape[1]
            if n > HELD_KEYS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "times", "ordinary", "toxic"])
                held, n = [np.zeros((4, 0), np.int64)], 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(held)], ["key", "times", "ordinary", "toxic"])


def smoothed(seen: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    p = np.maximum(seen - DISCOUNT, 0.0) + DISCOUNT * kinds * lower
    return np.where(total > 0, p / np.maximum(total, 1), lower)


def shared_model(pairs: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The probability of the last of every two symbols, by both of them, from how many different symbols precede each
    pair in either class."""
    side = 1 << SYMBOL_BITS
    two = np.bincount(pairs, seen, side * side).reshape(side, side)
    one = (two > 0).sum(0).astype(float)
    p = smoothed(one, np.full(side, one.sum()), np.full(side, (one > 0).sum()), np.full(side, 1.0 / 300))
    return smoothed(two, two.sum(1)[:, None], (two > 0).sum(1)[:, None], p[None]).ravel()


def interpolated(wanted: np.ndarray, sequences: np.ndarray, times: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(last symbol | those before) of the wanted sequences, from distinct sequences in order and how often each counts."""
    if not len(sequences):
        return lower
    context, start = np.unique(sequences >> SYMBOL_BITS, return_index=True)
    at = np.minimum(np.searchsorted(sequences, wanted), len(sequences) - 1)
    in_ = np.minimum(np.searchsorted(context, wanted >> SYMBOL_BITS), len(context) - 1)
    total, kinds = np.add.reduceat(times, start), np.diff(np.append(start, len(sequences)))
    there, known = sequences[at] == wanted, context[in_] == wanted >> SYMBOL_BITS
    return smoothed(np.where(there, times[at], 0), np.where(known, total[in_], 0), kinds[in_], lower)


def ratios(keys: np.ndarray, counts: list[np.ndarray], shared: np.ndarray | None = None, lower: list[np.ndarray] | None = None) -> np.ndarray:
    """log P(toxic) - log P(ordinary) of the last symbol of each key, in UNITs. The keys are all those whose SHARED symbols
    before the last are the same as in one of them, so that every context, and all that precedes it, is whole. With
    `lower`, the probabilities in either class by those SHARED symbols, they need only be all with the same SHARED + 1."""
    both = []
    for i, own in enumerate(counts):
        p = shared[last(keys, SHARED)] if lower is None else lower[i]
        seen = keys[own > 0]
        for length in range(SHARED + (1 if lower is None else 2), ORDER):
            sequences, times = np.unique(last(np.unique(last(seen, length + 1)), length), return_counts=True)
            p = interpolated(last(keys, length), sequences, times, p)
        order = np.argsort(seen)
        both.append(interpolated(keys, seen[order], own[own > 0][order], p))
    return np.rint((np.log(both[1]) - np.log(both[0])) / UNIT).astype(np.int64)


def _ratios(group: pd.DataFrame) -> pd.DataFrame:
    keys = group["key"].to_numpy(np.int64)
    found = ratios(keys, [group[c].to_numpy(np.int64) for c in ("ordinary", "toxic")], lower=[group[c].to_numpy() for c in ("p_ordinary", "p_toxic")])
    return pd.DataFrame({"key": keys, "times": group["times"], "ratio": found})


def _short(shared):
    """The probabilities of the last symbol of sequences of SHARED + 1, all of a context together."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tail")
        tails, out = group["tail"].to_numpy(np.int64), {}
        for c in ("ordinary", "toxic"):
            times = group[c].to_numpy(np.int64)
            out[f"p_{c}"] = interpolated(tails, tails[times > 0], times[times > 0], shared.value[last(tails, SHARED)])
        return pd.DataFrame({"tail": tails, **out})

    return run


def _measured(hot):
    """Of each text: its words, the sum of what they say, the three highest, how many are evident; without the words that
    have sequences which are not hot. Of those how often they are there, the sum of their hot sequences, and the others."""
    low, high = (int(x / UNIT) for x in CLIP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = hot.value
        for batch, data, offsets in slices(batches, "text"):
            words, at, back, counts = distinct_words(data, offsets)
            key, word = places(words, at)
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            sums = np.zeros(len(at) - 1, np.int64)
            if len(key):
                sums = np.add.reduceat(np.where(hit, values[place], 0) if len(keys) else np.zeros(len(key), np.int64), at[:-1] + np.arange(len(at) - 1))
            lack = np.bincount(word[~hit], minlength=len(at) - 1)
            text = np.repeat(np.arange(len(counts)), counts)
            known = lack[back] == 0
            own, each = text[known], np.clip(sums, low, high)[back[known]]
            total = np.zeros(len(counts), np.int64)
            np.add.at(total, own, each)
            order = np.lexsort((-each, own))
            have = np.bincount(own, minlength=len(counts))
            first = np.arange(len(each)) - np.repeat(np.cumsum(have) - have, have) < 3
            top = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(have, 3))), pa.int32()), pa.array(each[order][first]))
            evident = np.bincount(own, each > EVIDENT / UNIT, len(counts)).astype(np.int64)
            pair, times = np.unique(text[~known] * len(at) + back[~known], return_counts=True)
            owner, w = pair // len(at), pair % len(at)
            gaps, begin = key[~hit], np.cumsum(lack) - lack
            take = np.repeat(begin[w] - (np.cumsum(lack[w]) - lack[w]), lack[w]) + np.arange(lack[w].sum())
            open_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lack[w])), pa.int32()), pa.array(gaps[take]))
            rest = pa.StructArray.from_arrays([pa.array(times.astype(np.int64)), pa.array(sums[w]), open_], ["times", "partial", "keys"])
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(counts)))), pa.int32()), rest)
            columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()), pa.array(total), top, pa.array(evident), rest]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "total", "top", "evident", "rest"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rows(labels: DataFrame, label: str, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label, part): the labelled rows that fitting may see, about `limit` at most by a hash of their ids; part 3 of
    0 to 3 is for calibration."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    chosen = known.where(share_of(F.col("doc_id"), limit / max(1, known.count())))
    return chosen.select("doc_id", F.col(label).cast("int").alias(label), F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int").alias("part"))


def split(labels: DataFrame, limit: int = FIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, ordinary, toxic), how often each document counts for the models, and (doc_id, toxic) for the calibration:
    a quarter of the labelled rows that are not held out, about `limit` / 4 at most by a hash. All others count."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("quarter"))
    n = known.where("quarter").count()
    fitted = F.col("quarter") & share_of(F.col("doc_id"), limit / 4 / max(1, n))
    counted = known.where(~fitted).groupBy("doc_id").agg(F.count_if(F.col("toxic") == 0).alias("ordinary"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return counted, known.where(fitted).select("doc_id", "toxic")


def hot_keys(known: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys and ratios of the most frequent sequences, HOT_KEYS at most: whole levels of frequency, found by a histogram, so
    that nothing is ranked; and whether these are all."""
    level = F.floor(F.log2("times") * 4).cast("int")
    room, least, all_ = HOT_KEYS, None, True
    for row in sorted(known.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a few dozen rows
        if row["count"] > room:
            all_ = False
            break
        room, least = room - row["count"], row["level"]
    kept = known.where(level >= least) if least is not None else known.limit(0)
    rows = kept.select("key", "ratio").toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["ratio"].to_numpy(np.int64), all_


def counted_places(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """(key, times, ordinary, toxic): all sequences of ORDER symbols of the documents. Counts of shorter ones are sums."""
    if counted.count() <= BROADCAST_ROWS:
        counted = F.broadcast(counted)
    marked = docs.select("doc_id", "text").join(counted, "doc_id", "left").select("text", F.coalesce("ordinary", F.lit(0)).alias("ordinary"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    found = marked.mapInArrow(_places, "key long, times long, ordinary long, toxic long")
    path = scratch(docs.sparkSession, "sequences")
    found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("times", "ordinary", "toxic"))).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def place_ratios(counts: DataFrame) -> DataFrame:
    """(key, times, ratio): of every sequence what its last symbol says for the toxic class, in UNITs.

    The probabilities by the SHARED symbols before are computed first, from aggregates with one row for each sequence of
    SHARED + 1. Groups are then by one symbol more, so that a frequent pair of symbols is spread over many of them."""
    spark = counts.sparkSession
    ending = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << (n * SYMBOL_BITS)) - 1))
    before = lambda c, n: F.xxhash64(F.shiftright(c, SYMBOL_BITS).bitwiseAND(F.lit((1 << (n * SYMBOL_BITS)) - 1)))
    # how many different symbols precede each sequence of SHARED + 1, in either class
    longer = counts.groupBy(ending("key", SHARED + 2).alias("key")).agg(*(F.max(F.when(F.col(c) > 0, 1).otherwise(0)).alias(c) for c in ("ordinary", "toxic")))
    tails = cut(longer.groupBy(ending("key", SHARED + 1).alias("tail")).agg(*(F.sum(c).alias(c) for c in ("ordinary", "toxic"))))
    # pairs of symbols: 258 x 258 rows at most at any size of the corpus
    pairs = tails.where("ordinary + toxic > 0").groupBy(ending("tail", SHARED).alias("pair")).agg(F.count(F.lit(1)).alias("seen")).toPandas()
    shared = spark.sparkContext.broadcast(shared_model(pairs["pair"].to_numpy(np.int64), pairs["seen"].to_numpy(np.int64)))
    many = tails.count()
    bucket = F.pmod(before("tail", SHARED), F.lit(max(1, -(-many // BUCKET_ROWS))))
    short = tails.groupBy(bucket.alias("bucket")).applyInPandas(_short(shared), "tail long, p_ordinary double, p_toxic double")
    known = counts.withColumn("tail", ending("key", SHARED + 1)).join(F.broadcast(short) if many <= BROADCAST_ROWS else short, "tail")
    bucket = F.pmod(before("key", SHARED + 1), F.lit(max(1, -(-counts.count() // BUCKET_ROWS))))
    path = scratch(spark, "ratios")
    known.groupBy(bucket.alias("bucket")).applyInPandas(_ratios, "key long, times long, ratio long").write.parquet(path)
    return spark.read.parquet(path)


#: What a text is measured by.
MEASURES = ("by_word", "top", "third", "share", "evidence", "length")


def measures(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, MEASURES) of each document: the difference of the log-likelihoods by word, the same of its three most toxic
    words, of the third of them, the share of evident words and the logarithms of their number and of all words, 0 without
    words; and the rows of the calibration."""
    counted, fitted = split(labels, limit)
    known = place_ratios(counted_places(docs, counted))
    keys, values, all_ = hot_keys(known)
    hot = docs.sparkSession.sparkContext.broadcast((keys, values))
    kind = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {kind}, n long, total long, top array<long>, evident long, rest array<struct<times: long, partial: long, keys: array<long>>>"
    parts = docs.select("doc_id", "text").mapInArrow(_measured(hot), shape)
    if not all_:
        parts = cut(parts.withColumn("row", F.monotonically_increasing_id()))
        open_ = parts.select("row", F.posexplode("rest").alias("word", "w")).select("row", "word", "w.times", "w.partial", F.explode("w.keys").alias("key"))
        low, high = (F.lit(int(x / UNIT)) for x in CLIP)
        words = open_.join(known.select("key", "ratio"), "key").groupBy("row", "word").agg(F.first("times").alias("times"), (F.first("partial") + F.sum("ratio")).alias("ratio")).withColumn("ratio", F.greatest(low, F.least(high, "ratio")))
        copies = F.flatten(F.collect_list(F.array_repeat("ratio", F.least("times", F.lit(3)).cast("int"))))
        further = F.sum(F.when(F.col("ratio") > EVIDENT / UNIT, F.col("times")).otherwise(0))
        rest = words.groupBy("row").agg(F.sum(F.col("ratio") * F.col("times")).alias("more"), F.slice(F.sort_array(copies, False), 1, 3).alias("also"), further.alias("further"))
        parts = parts.join(rest, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0))).withColumn("evident", F.col("evident") + F.coalesce("further", F.lit(0)))
        parts = parts.withColumn("top", F.when(F.col("also").isNull(), F.col("top")).otherwise(F.slice(F.sort_array(F.concat("top", "also"), False), 1, 3)))
    n = F.greatest("n", F.lit(1))
    top = F.aggregate("top", F.lit(0).cast("long"), lambda a, b: a + b) / F.greatest(F.size("top"), F.lit(1))
    third = F.coalesce(F.get("top", F.lit(2)), F.lit(0))  # they come from the highest down
    return cut(parts.select("doc_id", (F.col("total") / n * UNIT).alias("by_word"), (top * UNIT).alias("top"), (third * UNIT).alias("third"), (F.col("evident") / n).alias("share"), F.log1p(F.col("evident").cast("double")).alias("evidence"), F.log1p(parts["n"].cast("double")).alias("length"))), fitted


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, by_word): one row per row of `docs`, from its whole text alone.

    The models count all labelled rows that are neither held out nor of the calibration. Null and empty texts are scored
    as texts without a difference. Rows with equal texts score equally. Labels that are null or neither 0 nor 1 are not
    used. Without calibration rows of both classes every text scores their share of toxic rows. An empty table gives an
    empty result.
    """
    measured, fitted = measures(docs, labels, limit)
    rows = sorted(measured.join(fitted, "doc_id").select("toxic", *MEASURES).collect())  # as many as the calibration sees
    y = np.array([r["toxic"] for r in rows], float)
    x = np.array([[r[c] for c in MEASURES] for r in rows], float).reshape(-1, len(MEASURES))
    if len(set(y)) < 2:
        base = (y.sum() + 0.1) / (len(y) + 1)
        w = np.array([0.0] * len(MEASURES) + [np.log(base / (1 - base))])
    else:
        middle, scale = x.mean(0), x.std(0) + 1e-9
        w = logistic((x - middle) / scale, y, 0.1)
        w = np.append(w[:-1] / scale, w[-1] - (w[:-1] * middle / scale).sum())
    z = sum((F.col(c) * F.lit(float(w[i])) for i, c in enumerate(MEASURES)), F.lit(float(w[-1])))
    p = 1 / (1 + F.exp(-z))
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"), (p >= threshold).cast("int").alias("predicted"), "by_word")
