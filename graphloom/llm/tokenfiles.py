"""Token ids in binary files with Re-Pair grammar compression.

Documents in ascending order of their ids are cut into shards, shards into frames of about a million token ids. In each
frame the most frequent pairs of neighbouring ids are replaced by nonterminals, again and again, until no pair stands
twice; a frame holds the rules with the lengths that they expand to, the remaining sequence, and where each document
begins in it, so that any part of a document can be decoded alone. Frames are rows of a Parquet table in the shared
folder; reading needs only those files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import scratch

#: Documents of a shard, shards at most (beyond them shards grow; a task streams its shards), ids of a frame.
SHARD_DOCS, MOST_SHARDS, FRAME_IDS = 4096, 1 << 17, 1 << 20
#: Sampled rows for each bound between shards.
SAMPLED = 32
#: Pairs of so many occurrences are replaced before those of fewer; it ends with pairs that stand twice.
LEVELS = (16, 2)
#: Fixed value: begins every frame.
MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIIIIBI3x")


def _grouped(left: np.ndarray, right: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of which there are `least` or more, ascending, how often each stands, and where, pair by pair."""
    bits, digits = symbols.bit_length(), len(left).bit_length()
    pair = (left << bits) | right
    if 2 * bits + digits < 64:  # pair and place are one number
        pair <<= digits
        pair |= np.arange(len(left))
        pair.sort()
        order = pair & ((1 << digits) - 1)
        pair >>= digits
    else:
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    count = np.diff(np.append(first, len(pair)))
    often = count >= least
    order = order[np.repeat(often, count)]
    pair = pair[first[often]]
    return np.stack([pair >> bits, pair & ((1 << bits) - 1)]), count[often], order


def _distinct(places: np.ndarray, n: int) -> np.ndarray:
    """Different places among n, ascending, without -1; where they are few, without a look at all n."""
    if len(places) * 32 < n:
        places = np.sort(places)
        return places[np.append(places[:1] >= 0, places[1:] != places[:-1])]
    there = np.zeros(n + 1, bool)
    there[places] = True
    return np.flatnonzero(there[:n])


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules) of the ids of a frame; ends marks the last ids of documents, behind which no rule reaches. A rule
    is its two symbols; rule r is symbol vocabulary + r and holds only symbols before it.

    Where two pairs overlap, the one that stands more often in the frame wins (ties go by a hash), so the most frequent
    pair is always replaced everywhere, and many others with it. Within a level only places next to a replacement, and
    those that lost to another pair, can hold a pair that has become frequent; only they are counted again. Symbols stay
    where they are and know their neighbours, so that a pass costs as much as the places that it counts."""
    n = len(ids)
    seq, end, live = ids.astype(np.int64), ends.copy(), np.ones(n, bool)
    end[n - 1 :] = True
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    rules, made = [np.zeros((0, 2), np.int64)], 0
    for least in levels:
        at = np.flatnonzero(live & ~end)
        while len(at):
            right = after.take(at)
            pair, times, order = _grouped(seq.take(at), seq.take(right), vocabulary + made, least)
            slot, even = np.repeat(np.arange(len(times)), times), np.ones(len(at), bool)
            if len(twin := np.flatnonzero((pair[0] == pair[1])[slot])):  # of x x x x every second pair
                own, of = at[order[twin]], slot[twin]
                run = np.flatnonzero(np.append(True, (after[own[:-1]] != own[1:]) | (np.diff(of) != 0)))
                odd = (np.arange(len(own)) - np.repeat(run, np.diff(np.append(run, len(own))))) % 2 == 1
                even[order[twin[odd]]] = False
                times = times - np.bincount(of[odd], minlength=len(times))
                few = (times < least)[slot]
                order, slot = order[~few], slot[~few]
            spot = np.full(len(at), -1)
            spot[order] = slot
            often = np.flatnonzero(spot >= 0)
            at, right, slot, wins = at.take(often), right.take(often), spot.take(often), even.take(often)
            code = ((pair[0] << 32) | pair[1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            own = ((times << 32) | (code >> np.uint64(32)).astype(np.int64)).take(slot)
            overlap, more = (right[:-1] == at[1:]) & (slot[1:] != slot[:-1]), own[:-1] >= own[1:]
            wins[1:] &= ~(overlap & more)
            wins[:-1] &= ~overlap | more
            enough = np.bincount(slot[wins], minlength=len(times)) >= max(2, least // 2)
            if not enough.any():
                break
            chosen = np.flatnonzero(enough)
            symbol = np.zeros(len(times), np.int64)
            symbol[chosen] = vocabulary + made + np.arange(len(chosen))
            used = wins & enough.take(slot)
            place, lost, gone = at[used], at[~used], right[used]
            beyond = after.take(gone)
            seq[place], end[place], live[gone] = symbol.take(slot[used]), end.take(gone), False
            after[place], before[beyond] = beyond, place
            at = _distinct(np.concatenate([lost[live.take(lost)], place, before.take(place)]), n)
            at = at[~end.take(at)]
            made += len(chosen)
            rules.append(pair[:, chosen].T)
    return seq[live], np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule stands for; a rule is reckoned once both of its symbols are."""
    length = np.append(np.ones(vocabulary, np.int64), np.zeros(len(rules), np.int64))
    open_ = np.arange(len(rules))
    while len(open_):
        both = length[rules[open_]]
        ready = (both > 0).all(1)
        length[vocabulary + open_[ready]] = both[ready].sum(1)
        open_ = open_[~ready]
    return length[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """The ids from `low` to `high` of what some symbols stand for. The lengths tell where each part of a rule stands, so
    rules outside of the range are not expanded."""
    symbol = symbols.astype(np.int64)
    size = np.ones(len(symbol), np.int64)
    size[symbol >= vocabulary] = lengths[symbol[symbol >= vocabulary] - vocabulary]
    at = np.cumsum(size) - size
    high = int(size.sum()) if high is None else high
    out = np.zeros(max(high - low, 0), np.int64)
    while len(symbol):
        inside = (at < high) & (at + size > low)
        symbol, at, size = symbol[inside], at[inside], size[inside]
        plain = symbol < vocabulary
        out[at[plain] - low] = symbol[plain]
        left, right = rules[symbol[~plain] - vocabulary].T
        first = np.ones(len(left), np.int64)
        first[left >= vocabulary] = lengths[left[left >= vocabulary] - vocabulary]
        at, size = np.concatenate([at[~plain], at[~plain] + first]), np.concatenate([first, size[~plain] - first])
        symbol = np.concatenate([left, right])
    return out


def _planes(values: np.ndarray) -> bytes:
    """Numbers of 32 bits as four runs of bytes, which compress better."""
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def frame(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary: int) -> bytes:
    """The bytes of a frame: header, documents (id, whether null, symbols and ids before each), rules (steps from one left
    symbol to the next, right symbols) and their expansion lengths, sequence (16 bits of each symbol, then the bits above
    them where there are any)."""
    sizes = np.array([len(x) for x in ids], np.int64)
    ends = np.zeros(int(sizes.sum()), bool)
    ends[np.cumsum(sizes)[sizes > 0] - 1] = True
    seq, rules = compress(np.concatenate(ids) if ids else np.zeros(0, np.int64), ends, vocabulary)
    lengths = expansion_lengths(rules, vocabulary)
    token_ends = np.cumsum(sizes)
    each = np.where(seq >= vocabulary, lengths[np.maximum(seq - vocabulary, 0)] if len(lengths) else 1, 1)
    symbol_ends = np.searchsorted(np.cumsum(each), token_ends)
    symbol_ends = np.where(token_ends > 0, symbol_ends + 1, 0)
    width = max(16, int(vocabulary + len(rules) - 1).bit_length())
    packed = zlib.compress(_planes(np.concatenate([np.diff(rules[:, 0], prepend=0) & 0xFFFFFFFF, rules[:, 1], lengths])), 1)
    parts = [_HEAD.pack(MAGIC, len(ids), len(seq), len(rules), vocabulary, width, len(packed))]
    parts += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes()]
    parts += [symbol_ends.astype("<u4").tobytes(), token_ends.astype("<u4").tobytes(), packed]
    return b"".join([*parts, (seq & 0xFFFF).astype("<u2").tobytes(), *(np.packbits((seq >> i & 1).astype(bool)).tobytes() for i in range(16, width))])


class Frame:
    """A frame read back; `ids(i)` decodes one document or a part of it, `all_ids()` all of them."""

    def __init__(self, raw: bytes):
        magic, docs, symbols, rules, self.vocabulary, width, packed = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a frame")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.symbol_ends, self.token_ends = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        steps, right, self.lengths = _from_planes(zlib.decompress(take("u1", packed)), 3 * rules).reshape(3, rules)
        self.rules = np.stack([np.cumsum(steps) & 0xFFFFFFFF, right], 1)
        self.sequence = take("<u2", symbols).astype(np.int64)
        for i in range(16, width):
            self.sequence |= np.unpackbits(take("u1", -(-symbols // 8)), count=symbols).astype(np.int64) << i

    def ids(self, i: int, low: int = 0, high: int | None = None) -> np.ndarray:
        begin = self.symbol_ends[i - 1] if i else 0
        size = int(self.token_ends[i] - (self.token_ends[i - 1] if i else 0))
        low, high, _ = slice(low, high).indices(size)
        return expand(self.sequence[begin : self.symbol_ends[i]], self.rules, self.lengths, self.vocabulary, low, high)

    def ids_of_rule(self, rule: int) -> np.ndarray:
        return expand(np.array([self.vocabulary + rule]), self.rules, self.lengths, self.vocabulary)

    def all_ids(self) -> np.ndarray:
        if self.lengths.sum() > self.token_ends.max(initial=0):  # rules within rules: each place by itself is less work
            return expand(self.sequence, self.rules, self.lengths, self.vocabulary)
        known = np.arange(self.vocabulary + len(self.rules))
        ids = np.append(known[: self.vocabulary], expand(known[self.vocabulary :], self.rules, self.lengths, self.vocabulary))
        size = np.append(np.ones(self.vocabulary, np.int64), self.lengths)
        each = size.take(self.sequence)
        return ids.take(np.arange(each.sum()) + np.repeat((np.cumsum(size) - size).take(self.sequence) - (np.cumsum(each) - each), each))


def _shards(docs: np.ndarray, ties: np.ndarray, bound_docs: np.ndarray, bound_ties: np.ndarray) -> np.ndarray:
    """How many bounds (an id and a tie) are not above each row."""
    low, high = np.searchsorted(bound_docs, docs, "left"), np.searchsorted(bound_docs, docs, "right")
    for i in np.flatnonzero(high > low).tolist():
        low[i] += np.searchsorted(bound_ties[low[i] : high[i]], ties[i], "right")
    return low.astype(np.int32)


def _prepared(bounds: tuple[np.ndarray, np.ndarray], end_id: int):
    """With the end id: the shard of a document, the number of its ids, their checksum, and the ids (16 bits if they fit)."""

    def make(path: str, ids: list[np.ndarray], batch: pa.RecordBatch) -> list[pa.Array]:
        docs, ties = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        ids = [np.append(x, np.uint32(end_id)) for x in ids]
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        small = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids]
        return [pa.array(_shards(docs, ties, *bounds)), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(small, pa.binary())]

    return make, "shard int, n long, crc long, ids binary"


def shard_bounds(rows: DataFrame, shard_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and ties at which shards begin, from a sample of SAMPLED rows for each shard (MOST_SHARDS at most)."""
    n = rows.count()
    shards = min(MOST_SHARDS, max(1, -(-n // shard_docs)))
    if shards == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sample = rows.sample(min(1.0, SAMPLED * shards / n), 7).toPandas()
    docs, ties = sample["doc_id"].to_numpy(np.int64), sample["tie"].to_numpy(np.int64)
    order = np.lexsort((ties, docs))[np.arange(1, shards) * len(sample) // shards]
    return docs[order], ties[order]


def _framed(vocabulary: int, frame_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, docs, ids, held = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([frame(docs, ids, vocabulary)], pa.binary())], ["shard", "frame", "n_ids", "bytes"])

        for batch in batches:
            for s, doc, n, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
                if docs and (s != shard or held >= frame_ids):
                    yield done()
                    number = number + 1 if s == shard else 0
                    docs, ids, held = [], [], 0
                shard = s
                docs.append(doc)
                ids.append(np.frombuffer(raw, f"<u{len(raw) // n}"))
                held += n
        if docs:
            yield done()

    return run


def write(docs: DataFrame, vocabulary_path: str, path: str, end_id: int = 0, shard_docs: int = SHARD_DOCS, frame_ids: int = FRAME_IDS) -> None:
    """Encode the whole text of every row, append `end_id`, and write the frames to `path` (shard, frame, n_ids, bytes).

    Order is ascending by doc_id, nulls first; rows of one id go by a hash of their text, so that an id which many rows
    have is cut into shards too. Null texts count as empty and have only the end id. An empty table gives an empty
    table of frames.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    bounds = shard_bounds(keyed.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "tie"), shard_docs)
    vocabulary = len(bpe.token_bytes(vocabulary_path))
    encoded = bpe.encoded(keyed, vocabulary_path, ("doc_id", "tie"), _prepared(bounds, end_id))
    ordered = encoded.repartition("shard").sortWithinPartitions("shard", "doc_id", "tie", "n", "crc")
    ordered.mapInArrow(_framed(vocabulary, frame_ids), "shard int, frame int, n_ids long, bytes binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, number, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "frame", "bytes")), strict=True):
            f = Frame(raw)
            all_ids, ends = f.all_ids().astype("<u4"), f.token_ends
            begins = np.append(0, ends[:-1])
            crc = [zlib.crc32(all_ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            columns = [pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(f.doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "frame", "doc_id", "within", "n_tokens", "ids_crc32"])


def read(frames: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a table of frames, decoded from the frames."""
    sizes = frames.select("shard", "frame", "n_ids")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as shards, MOST_SHARDS at most, meet in one task
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("frame"))), F.lit(0))
    bases = sizes.withColumn("inside", inside).join(shards, "shard").select("shard", "frame", (F.col("ahead") + F.col("inside")).alias("base"))
    docs = frames.select("shard", "frame", "bytes").mapInArrow(_read, "shard int, frame int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["shard", "frame"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """`read` of what `write` has put into a new table of the shared folder."""
    path = scratch(docs.sparkSession, "frames")
    write(docs, vocabulary_path, path)
    return read(docs.sparkSession.read.parquet(path))
