"""Benchmark decontamination by winnowing.

A window is `size` words of a benchmark item in a row, or all words of a shorter item. Texts are fingerprinted: of the k-gram
hashes inside each run of t words the least one is kept (the last of equal ones), and since neighbouring runs mostly share it,
few k-grams stay. A window of t words that stands in a document has the same least k-gram there as in its item, so every
shared span of t words or more shares a fingerprint: nothing is missed. Windows of `size` words take k = size // 2; items of L
< `size` words are windows of their own and take t = L, for just those lengths that occur.

1. Items give distinct windows with their fingerprints. A bitmap of fixed size tells which fingerprints may be among them.
2. One pass over the documents keeps, of the fingerprints that pass the bitmap, the words around them.
3. Fingerprints of documents and items are joined. Hits are extended: every window that holds the k-gram is looked up among
   the windows of the items, by its words.
4. Documents with the same set of windows share one list of items, so that passages which many documents and many items have
   are never multiplied out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import scratch
from .common import cut, slices, spread_join
from .wordspans import LOWER, mixed, piece_hashes, powers, spans

#: Words of a window; the bytes that are no part of a word once A-Z are lower case.
WINDOW = 10
APART = np.zeros(256, bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bits of the bitmap (a megabyte), whatever the size of the benchmark; a larger benchmark lets more through to the join.
BITS = 1 << 23


def gram_size(size: int) -> int:
    return max(1, size // 2)


def fingerprints(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of `size` words inside a text, in order: the index of its first word, the index of its least k-gram (the
    last of equal ones), and that k-gram's hash. `words` are the hashes of all texts' words, `counts` their numbers."""
    k = gram_size(size)
    ends = np.cumsum(counts)
    have = np.maximum(counts - size + 1, 0)
    first = np.repeat(ends - counts, have) + (np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have))
    if not len(first):
        return first, first, np.zeros(0, np.uint64)
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for i, step in enumerate(powers(k + 1)[1:]):
        grams += mixed(words[i : i + len(grams)] + np.uint64(i + 1)) * step
    grams = mixed(grams + np.uint64(size))
    runs = np.lib.stride_tricks.sliding_window_view(grams, size - k + 1)[:, ::-1]
    least = size - k - runs[first].argmin(1)
    return first, first + least, grams[first + least]


def bit(hashes):
    return F.pmod(hashes, F.lit(BITS))


def bitmap(prints: DataFrame) -> np.ndarray:
    """BITS bits, of which those of the column hash are set; the driver gets BITS / 64 numbers at most."""
    each = prints.select(bit(F.col("hash")).alias("b")).groupBy((F.col("b") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for r in each.collect():
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _clean(data: np.ndarray, low: int, high: int) -> bytes:
    return BETWEEN.sub(b" ", data[low:high].tobytes())


def item_windows(items: DataFrame, size: int = WINDOW, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, size, hash, words): each window of each item with its fingerprint and its words, lower case, one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            low = LOWER[data]
            starts, ends, counts = spans(low, offsets, APART)
            words, names = piece_hashes(low, starts, ends), batch.column(0).to_pylist()
            owner = np.repeat(np.arange(len(counts)), counts)
            for t in range(1, size + 1):
                own = counts if t == size else np.where(counts == t, counts, 0)  # shorter items are one window of their length
                mine = own[owner] > 0
                first, _, hashes = fingerprints(words[mine], own, t)
                at = np.flatnonzero(mine)[first]
                texts = [_clean(low, starts[a], ends[a + t - 1]).decode() for a in at]
                yield pa.RecordBatch.from_arrays([pa.array([names[owner[a]] for a in at], pa.string()), pa.array(np.full(len(at), t), pa.int32()), pa.array(hashes.view(np.int64)), pa.array(texts, pa.string())], ["item", "size", "hash", "words"])

    named = items.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(run, "item string, size int, hash long, words string")


def _seen(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(row, id, n_words, size, first, gram, hash, words): a row for each document, with nulls from `size` on, and one for
    each of its fingerprints that the bitmap lets through, with the words from `first` on among which windows can hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            low = LOWER[data]
            starts, ends, counts = spans(low, offsets, APART)
            words = piece_hashes(low, starts, ends)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            n = len(batch)
            found = [(np.arange(n), None, None, None, None, None)]
            for t in sizes:
                _, at, hashes = fingerprints(words, counts, t)
                once = np.flatnonzero(np.diff(at, prepend=-1))  # neighbouring runs share theirs
                at, hashes = at[once], hashes[once]
                near = bits[hashes.view(np.int64) & np.int64(BITS - 1)]
                at, hashes = at[near], hashes[near]
                owner = np.searchsorted(bounds, at, "right") - 1
                k = gram_size(t)
                first, last = np.maximum(at - (t - k), bounds[owner]), np.minimum(at + t, bounds[owner + 1]) - 1
                texts = [_clean(low, starts[a], ends[b]).decode() for a, b in zip(first, last, strict=True)]
                found.append((owner, t, first - bounds[owner], at - bounds[owner], hashes.view(np.int64), texts))
            for owner, t, first, at, hashes, texts in found:
                if not len(owner):
                    continue
                same = pa.array(owner)
                none = lambda kind, m=len(owner): pa.nulls(m, kind)
                made = [none(k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())] if t is None else [pa.array(np.full(len(owner), t), pa.int32()), pa.array(first, pa.int32()), pa.array(at, pa.int32()), pa.array(hashes), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(counts[owner], pa.int64()), *made], ["row", "id", "n_words", "size", "first", "gram", "hash", "words"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, id {kind}, n_words long, size int, first int, gram int, hash long, words string")


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: (`id`, n_words, n_hit, items array<string>, contaminated), a row for each row of `docs`, with
    the ids of the items of which a window occurs, in the order of strings. Hits: (row, `id`, start, length, words), the
    windows that occur, by the number of their first word.

    Null and empty texts have no words and no hits; items without words have no windows. Repeated documents are rows of
    their own; rows of one item id count as one item; a null item id counts as an empty one. Empty tables give empty
    results. Other columns are not read."""
    spark = docs.sparkSession
    path = scratch(spark, "winnow")
    item_windows(items, size, item_id, item_text).distinct().write.parquet(f"{path}/windows")
    windows = spark.read.parquet(f"{path}/windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # `size` numbers at most
    prints = windows.select("hash").distinct()
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    _seen(named, sizes, bitmap(prints)).write.parquet(f"{path}/seen")  # the numbers of rows are settled here
    seen = spark.read.parquet(f"{path}/seen")

    # the join of fingerprints, then every window around a k-gram by its words
    met = spread_join(seen.where("size IS NOT NULL").select("row", "id", "size", "first", "hash", "words"), prints, "hash", "row")
    own = F.split("words", " ")
    starts = F.sequence(F.lit(0), F.size("own") - F.col("size"))
    around = met.withColumn("own", own).select("row", "id", "size", "first", "own", F.explode(starts).alias("at"))
    asked = around.select("row", "id", (F.col("first") + F.col("at")).alias("start"), F.col("size").alias("length"), F.array_join(F.slice("own", F.col("at") + 1, F.col("size")), " ").alias("words")).distinct()
    hits = cut(spread_join(cut(asked), windows.select("words").distinct(), "words", "row"))

    # words that any window covers, each once
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest(F.coalesce(before, F.lit(0)), F.col("start"))))
    told = fresh.groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"), F.collect_set(F.md5("words")).alias("set"))
    told = cut(told.select("row", "n_hit", F.sort_array("set").alias("set"), F.md5(F.array_join(F.sort_array("set"), "")).alias("key")))

    # one list of items for each set of windows
    sets = told.groupBy("key").agg(F.first("set").alias("set")).select("key", F.explode("set").alias("window"))
    named_items = windows.select(F.md5("words").alias("window"), "item").distinct()
    lists = sets.join(named_items, "window").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = spread_join(told.select("row", "n_hit", "key"), lists, "key", "row").select("row", "n_hit", "items")
    all_docs = seen.where("size IS NULL").select("row", "id", "n_words").join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    documents = all_docs.select(F.col("id").alias(id), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
    return documents, hits.select("row", F.col("id").alias(id), "start", "length", "words")


def cleaned(docs: DataFrame, items: DataFrame, size: int = WINDOW, id: str = "doc_id", text: str = "text", share: float = 0.0) -> DataFrame:
    """`docs` without the documents of which more than `share` of the words are hit. Documents are known by their id; of
    several with one id the worst counts, and those without an id stay."""
    found, _ = contaminated(docs, items, size, id, text)
    bad = found.where(F.col("n_hit") > F.col("n_words") * share).select(F.col(id)).distinct()
    return docs.join(bad, id, "left_anti")
