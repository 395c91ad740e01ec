"""BPE encoding and decoding with a public vocabulary, exactly as the tokenizers library does it.

Texts of more than a few thousand bytes are taken as one unsplit run: they are halved until the parts (leaves) are short,
the leaves are encoded side by side, and neighbours are joined pairwise, level by level; very long texts spread their
halves over tasks first. Around each join a window of tokens is encoded anew and grown until both of its ends agree with
what either side has.

Why agreeing ends make a join exact: ids are the encoding of a run that the pre-tokenizer does not split if and only if
each two neighbours are the encoding of their own bytes (merges go by rank, so nothing else can bring a pair together).
Hence ids outside of the window stay valid wherever the text is split there as before. It is: where a letter meets
something else, a number meets something else, or anything meets white space, the pre-tokenizer always splits, and from
there on its splits depend on nothing before. So the agreeing end has to hold such a place (`settled`), or be all of one
kind without an apostrophe (only contractions begin inside a run); else the window grows, to the ends of the texts if need
be. Special tokens are shorter than the first window, so one that a cut went through lies inside it.

A leaf is cut at single spaces between solid characters. No merge and no rule of the pre-tokenizer reaches across such a
place. So pieces of undisputed characters go through a second library with the same vocabulary, all that stand in a row as
one run, and all others through the first, once per distinct piece.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, slices
from .wordspans import piece_hashes

#: Bytes of a leaf at most; texts of more bytes than the second number spread their halves over tasks.
LEAF_BYTES, ROW_BYTES = 4096, 32_768
#: Pieces whose ids a worker keeps at most; tokens on each side of the first window of a join.
KEPT_PIECES, FIRST_WINDOW = 300_000, 16
#: Fixed value: places in plain text where the pre-tokenizer splits whatever stands around them.
SPLIT_HERE = re.compile(rb"(?<=[A-Za-z])[\x00-@\[-`{-\x7f]|(?<=[0-9])[\x00-/:-\x7f]|(?<=[!-~])[\t-\r ]")
#: Bytes of text that are encoded at once.
SLICE = 5 << 19
#: Bytes that count as white space before or after a cut, and first bytes of characters that may be.
_UNSAFE = np.zeros(256, bool)
_UNSAFE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id: the library's byte-level alphabet undone, special tokens as they are written."""
    t = library(path)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {i for i, x in t.get_added_tokens_decoder().items()}
    out = []
    for i in range(t.get_vocab_size(with_added_tokens=True)):
        token = t.id_to_token(i) or ""
        out.append(token.encode() if i in special or any(c not in alphabet for c in token) else bytes(alphabet[c] for c in token))
    return out


@functools.cache
def _names(path: str) -> list[str]:
    """The decimal form of every id."""
    return [str(i) for i in range(len(token_bytes(path)))]


@functools.cache
def _spaced(path: str) -> np.ndarray:
    """Whether the bytes of every id begin with a space."""
    return np.array([x[:1] == b" " for x in token_bytes(path)])


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.uint32) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


#: Fixed value: how the library's byte-level pre-tokenizer splits a text in which white space is cut as `merged` does it (the
#: library looks ahead instead, to leave the last of several white spaces to what follows).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Ids and bytes (no plain text has them) that mark where a run begins and where white space is cut.
RUN, CUT = 1 << 30, (1 << 30) + 1
_RUN, _CUT = 0, 1
#: Bytes of plain characters (tab, newline, 0x20 to 0x7e, U+00C0 to U+024F), whose kind (letter, number, white
#: space, other) no version of Unicode disputes; the first bytes of those of two bytes, but for the last of them.
_PLAIN = np.zeros(256, bool)
_PLAIN[[0x09, 0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_FIRST = np.zeros(256, bool)
_FIRST[0xC3:0xC9] = True


@functools.cache
def merges(path: str):
    """The same vocabulary in a second library, which merges plain runs several times as fast: ids ascend with the ranks of
    the merges that make them. Tests hold it against the first library."""
    import tiktoken

    known, special = token_bytes(path), set(library(path).get_added_tokens_decoder())
    ranks = {x: i for i, x in enumerate(known) if i not in special}
    return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={chr(_RUN): RUN, chr(_CUT): CUT})


def disputed(data: np.ndarray) -> np.ndarray:
    """Where bytes are that only the first library may encode: those of characters that are not plain, and the beginnings
    of special tokens."""
    bad = ~_PLAIN[data]
    inner = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    if len(inner):
        first = data[inner - 1]
        bad[inner] = ~(_FIRST[first] | ((first == 0xC9) & (data[inner] < 0x90)))
    bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    return np.flatnonzero(bad)


def merged(path: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of plain runs (in order and apart), all encoded in one call, and how many each has."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    data = data[np.cumsum(inside[:-1], dtype=np.int8) > 0] if (ends - starts).sum() < len(data) else data
    size = ends - starts
    text = np.insert(data, np.cumsum(size) - size, _RUN)
    white = (text == 0x20) | (text == 0x0A) | (text == 0x09)
    cut = np.flatnonzero(white[:-2] & white[1:-1] & ~white[2:] & (text[2:] != _RUN)) + 1
    text = np.insert(text, cut, _CUT) if len(cut) else text
    ids = merges(path).encode_to_numpy(text.tobytes().decode(), allowed_special="all", disallowed_special=())
    begins = np.flatnonzero(ids == RUN)
    own = ids < RUN
    ahead = np.cumsum(own)
    return ids[own], np.diff(np.append(ahead[begins], ahead[-1]))


class Pieces:
    """Ids of distinct pieces, kept from batch to batch: the number of a piece, and where its ids are among all."""

    def __init__(self, path: str):
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])

    def _learn_all(self, pieces: list[bytes]) -> None:
        got = encode(self.path, [p.decode() for p in pieces])
        self._learn(pieces, np.concatenate(got), np.array([len(x) for x in got], np.int64))

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of different pieces, after which `at`, `size` and `flat` have their ids."""
        found = list(map(self.number.get, pieces))
        missing = [p for p, n in zip(pieces, found, strict=True) if n is None] if None in found else []
        if missing and len(self.number) + len(missing) > KEPT_PIECES:
            self._clear()
            missing = pieces
        if missing:
            plain, others = [], []
            for p in missing:
                (others if p.rfind(b" ") or len(p) == 1 else plain).append(p)
            starts = _spaced(self.path)
            for low in range(0, len(plain), 4096):  # every piece begins with the only space in it, and so do its ids
                part = plain[low : low + 4096]
                got = np.concatenate(encode(self.path, [b"".join(part[i : i + 512]).decode() for i in range(0, len(part), 512)]))
                cuts = np.flatnonzero(starts[got])
                if len(cuts) == len(part) and cuts[0] == 0:
                    self._learn(part, got, np.diff(np.append(cuts, len(got))))
                else:
                    self._learn_all(part)
            if others:
                self._learn_all(others)
            found = map(self.number.__getitem__, pieces)
        return np.fromiter(found, np.int64, len(pieces))


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces: where a text begins, and single spaces whose neighbours are plainly not white space."""
    space = data == 0x20
    cut = np.zeros(len(data), bool)
    if len(data) > 4:
        unsafe = _UNSAFE[data]
        wide = data >= 0x80
        before = unsafe[2:-1] | (wide[2:-1] & ((data[1:-2] == 0xC2) | ((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))))
        cut[3:] = space[3:] & ~before & ~np.append(unsafe[4:], True)
    begin = offsets[:-1][np.diff(offsets) > 0]
    for d in range(4):  # what stands before a text is another text
        near = begin + d
        cut[near[near < len(data)]] = False
    cut[begin] = True
    return np.flatnonzero(cut)


def _by_piece(path: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some pieces, each different one encoded once, and how many each piece has."""
    key = piece_hashes(data, starts, ends)
    _, which, back = np.unique(key, return_index=True, return_inverse=True)
    raw = data.tobytes()
    kept = pieces_of(path)
    number = kept.numbers([raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])[back]
    each = kept.size[number]
    ahead = np.cumsum(each) - each
    return kept.flat[np.arange(each.sum()) + np.repeat(kept.at[number] - ahead, each)], each


def encode_texts(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts one after the other, and how many each has."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    starts, bad = cut_places(data, offsets), disputed(data)
    other = np.zeros(len(starts), bool)
    other[np.searchsorted(starts, bad, "right") - 1] = True
    text = np.searchsorted(offsets, starts, "right") - 1
    begins = np.append(True, other[1:] | other[:-1] | (np.diff(text) > 0))  # plain pieces in a row of one text are a run
    starts, other, text = starts[begins], other[begins], text[begins]
    ends = np.append(starts[1:], len(data))
    each = np.zeros(len(starts), np.int64)
    kinds = []
    for mine, of in ((~other, merged), (other, _by_piece)):
        ids, each[mine] = of(path, data, starts[mine], ends[mine]) if mine.any() else (np.zeros(0, np.uint32), 0)
        kinds.append(ids)
    ids = kinds[0]
    if other.any():
        where = np.repeat(other, each)
        ids = np.empty(len(where), np.uint32)
        ids[~where], ids[where] = kinds
    return ids, np.bincount(text, each, len(offsets) - 1).astype(np.int64)


def halved(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the leaves of some texts (halves of halves, moved to the start of a character), and leaves of each text."""
    size = np.diff(offsets)
    leaves = 1 << np.ceil(np.log2(np.maximum(size / least, 1))).astype(np.int64)
    text = np.repeat(np.arange(len(size)), leaves)
    number = np.arange(len(text)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
    at = offsets[:-1][text] + size[text] * number // leaves[text]
    for _ in range(3):
        inner = (number > 0) & (at < len(data))
        at[inner] -= (data[at[inner]] & 0xC0) == 0x80
    return np.append(at, offsets[-1]), leaves


@functools.cache
def kind(c: str) -> str:
    """L, N, a space, O or, where versions of Unicode or of white space differ, ?"""
    category = unicodedata.ucd_3_2_0.category(c)
    if category[0] in "LN":
        return category[0]
    if category[0] == "C" or c in "\x1c\x1d\x1e\x1f\x85\u180e\u200b":
        return " " if c in "\t\n\v\f\r" else "?"
    return " " if c.isspace() else "O"


def settled(raw: bytes) -> bool:
    """Whether the agreeing end of a window says that the text is split there as before: see above."""
    if SPLIT_HERE.search(raw):
        return True
    text = raw.decode("utf-8", "ignore")
    kinds = "".join(map(kind, text))
    if kinds and kinds == kinds[0] * len(kinds) and kinds[0] in "LNO" and "'" not in text:
        return True
    return any(a in "LNO" and b == " " or a in "LN" and b in "LNO" and a != b or a == "O" and c != "'" and b in "LN" for a, b, c in zip(kinds, kinds[1:], text, strict=False))


@functools.cache
def first_window(path: str) -> int:
    """More tokens than the longest special token has bytes."""
    return max([FIRST_WINDOW, *(len(token_bytes(path)[i]) + 1 for i in library(path).get_added_tokens_decoder())])


def join_all(path: str, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The ids of each two neighbouring texts as one text, from the ids of either. Windows of all pairs are encoded at once,
    and those that do not agree again in twice the width."""
    known, width = token_bytes(path), first_window(path)
    out = [np.concatenate(p) for p in pairs]
    open_ = [i for i, (a, b) in enumerate(pairs) if len(a) and len(b)]
    while open_:
        windows, again = [], []
        for i in open_:
            a, b = pairs[i][0][-width:].tolist(), pairs[i][1][:width].tolist()
            try:
                windows.append((i, a, b, b"".join([known[t] for t in a + b]).decode()))
            except UnicodeDecodeError:  # an end stands inside a character
                again.append(i)
        half = width // 2
        for (i, a, b, _), got in zip(windows, encode(path, [w[3] for w in windows]), strict=True):
            left, right = pairs[i]
            new, ends = got.tolist(), lambda ids: settled(b"".join([known[t] for t in ids]))
            first = len(a) == len(left) or new[:half] == a[:half] and ends(a[:half])
            last = len(b) == len(right) or new[-half:] == b[-half:] and ends(b[-half:])
            if len(a) == len(left) and len(b) == len(right) or first and last and len(new) >= 2 * half:
                out[i] = np.concatenate([left[: len(left) - len(a)], got, right[len(b) :]])
            else:
                again.append(i)
        open_, width = again, 2 * width
    return out


def join_trees(path: str, trees: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The ids of some texts from those of their leaves, joined pairwise and level by level."""
    trees = [list(t) for t in trees]
    while any(len(t) > 1 for t in trees):
        joined = iter(join_all(path, [(t[j], t[j + 1]) for t in trees for j in range(0, len(t) - 1, 2)]))
        trees = [[*(next(joined) for _ in range(len(t) // 2)), *t[len(t) - len(t) % 2 :]] for t in trees]
    return [t[0] for t in trees]


def encode_rows(path: str, data: np.ndarray, offsets: np.ndarray, least: int = LEAF_BYTES) -> list[np.ndarray]:
    """The ids of each of some texts."""
    at, leaves = halved(data, offsets, least)
    ids, counts = encode_texts(path, data, at)
    ends = np.cumsum(counts)
    parts = [ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    last = np.cumsum(leaves)
    return join_trees(path, [parts[a:b] for a, b in zip((last - leaves).tolist(), last.tolist(), strict=True)])


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def decode(path: str, ids: np.ndarray) -> str:
    known = token_bytes(path)
    return b"".join([known[i] for i in ids.tolist()]).decode("utf-8", "replace")


def ids_only(path: str, ids: list[np.ndarray], batch: pa.RecordBatch) -> list[pa.Array]:
    return [pa.array([packed(x) for x in ids], pa.binary())]


def ids_digests(path: str, ids: list[np.ndarray], batch: pa.RecordBatch) -> list[pa.Array]:
    """Number of ids, digest of their decimal list, digest of the text that they decode to."""
    names, known = _names(path), token_bytes(path)
    rows = []
    for x in ids:
        x = x.tolist()
        text = b"".join([known[i] for i in x]).decode("utf-8", "replace")
        rows.append((len(x), hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]


def ids_and_digests(path: str, ids: list[np.ndarray], batch: pa.RecordBatch) -> list[pa.Array]:
    return ids_only(path, ids, batch) + ids_digests(path, ids, batch)


#: What can be made of the ids of a text where they are encoded, and the columns that it gives.
IDS = (ids_only, "ids binary")
DIGESTS = (ids_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
IDS_AND_DIGESTS = (ids_and_digests, f"{IDS[1]}, {DIGESTS[1]}")


def _encoded(path: str, kept: list[str], finish, names: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text", SLICE):
            each = encode_rows(path, data, offsets, least)
            own = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept], kept)
            yield pa.RecordBatch.from_arrays([*own.columns, *finish(path, each, own)], [*kept, *names])

    return run


def _spread(kept: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text", SLICE):
            raw = data.tobytes()
            for i in range(len(batch)):
                at, _ = halved(data, offsets[i : i + 2], least)
                parts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                row = batch.slice(i, 1)
                columns = [pa.concat_arrays([row.column(row.schema.get_field_index(c))] * len(parts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], [*kept, "_part", "text"])

    return run


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), finish=IDS, row_bytes: int = ROW_BYTES, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """The columns `keep` of every row of `docs` and what `finish` makes of the ids of its whole text (little-endian 32-bit
    integers by default); it is made where the ids are, so that they move no further than they are asked for.

    Null texts count as empty and have no ids. Texts of any length give the ids of the library: those above `leaf_bytes`
    go through halves and joins, those above `row_bytes` with their halves as rows of their own. Repeated rows give
    repeated results; an empty table gives an empty result.
    """
    kinds = dict(docs.dtypes)
    kept = list(keep)
    make, columns = finish
    names = [c.split()[0] for c in columns.split(", ")]
    plain = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    rows = docs.select(*kept, "text")
    is_long = F.coalesce(F.octet_length("text") > row_bytes, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_encoded(path, kept, make, names, leaf_bytes), f"{plain}, {columns}")
    marked = rows.where(is_long).withColumn("_row", F.monotonically_increasing_id())
    parts = marked.mapInArrow(_spread([*kept, "_row"], row_bytes), f"{plain}, _row long, _part int, text string")
    done = parts.repartition("_row", "_part").mapInArrow(_encoded(path, [*kept, "_row", "_part"], *_single(IDS), leaf_bytes), f"{plain}, _row long, _part int, ids binary")

    def joined(group: pa.Table) -> pa.Table:  # the parts of one row, which were one text before
        group = group.sort_by("_part")
        own = group.select(kept).slice(0, 1).combine_chunks().to_batches()[0]
        ids = join_trees(path, [[unpacked(x) for x in group.column("ids").to_pylist()]])
        return pa.Table.from_arrays([*own.columns, *make(path, ids, own)], [*kept, *names])

    return short.unionByName(done.groupBy("_row").applyInArrow(joined, f"{plain}, {columns}"))


def _single(finish) -> tuple:
    return finish[0], [c.split()[0] for c in finish[1].split(", ")]


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """`ids` with the column text that they decode to, special tokens included, instead of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "ids"]
            texts = [decode(path, unpacked(x)) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(texts, pa.string())], [*(n for n, _ in kept), "text"])

    return ids.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in ids.dtypes if n != "ids"] + ["text string"]))
