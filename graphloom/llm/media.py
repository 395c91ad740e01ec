"""Media columns: ISO base media containers.

`mux` stores bytes as the 8-bit samples of an uncompressed track in an ISO container, `probe` walks the nested boxes of
such containers and decodes their sample tables, per track, and those of movie fragments: codec, duration, samples and
the byte ranges of key frames, without decoding a payload. The bytes of the samples are read back through the tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary

#: Samples are so many bytes (the last may be shorter), so many make a chunk, and every so many is a key frame.
SAMPLE, PER_CHUNK, KEY_EVERY, TIMESCALE = 1024, 8, 16, 8000
#: Boxes that hold boxes, and the identity matrix of the header boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Payloads are filled up with bytes 0 to a positive multiple of this.
BLOCK = 64
#: Boxes deeper than this are not opened.
DEEPEST = 12


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(raw: bytes) -> bytes:
    return raw + bytes(BLOCK if not raw else -len(raw) % BLOCK)


def muxed(payload: bytes) -> bytes:
    """The container of a payload: ftyp, moov with one audio track of 8-bit samples ('raw '), mdat."""
    sizes = np.full(-(-len(payload) // SAMPLE), SAMPLE, ">u4")
    if len(payload) % SAMPLE:
        sizes[-1] = len(payload) % SAMPLE
    n = len(sizes)
    firsts = np.arange(0, n, PER_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    last = int(sizes[-1])
    times = [(n - 1, SAMPLE), (1, last)] if n > 1 and last != SAMPLE else [(n, last)]
    stts = full(b"stts", struct.pack(">I", len(times)), *(struct.pack(">II", *x) for x in times))
    tail = n - int(firsts[-1])
    runs = [(1, PER_CHUNK), (len(firsts), tail)] if len(firsts) > 1 and tail != PER_CHUNK else [(1, min(n, PER_CHUNK))]
    stsc = full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs))
    stsz = full(b"stsz", struct.pack(">II", 0, n), sizes.tobytes())
    stss = full(b"stss", struct.pack(">I", len(keys)), keys.tobytes())
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    stsd = full(b"stsd", struct.pack(">I", 1), entry)
    wide = len(payload) + (1 << 20) > 0xFFFFFFFF

    def moov(base: int) -> bytes:
        at = base + firsts * SAMPLE
        co = full(b"co64", struct.pack(">I", len(at)), at.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", len(at)), at.astype(">u4").tobytes())
        stbl = box(b"stbl", stsd, stts, stss, stsc, stsz, co)
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        length = struct.pack(">II", TIMESCALE, len(payload) & 0xFFFFFFFF)
        mdia = box(b"mdia", full(b"mdhd", bytes(8), length, bytes(4)), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", bytes(8), struct.pack(">III", 1, 0, len(payload) & 0xFFFFFFFF), bytes(8), bytes(8), MATRIX, bytes(8), flags=7)
        mvhd = full(b"mvhd", bytes(8), length, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    base = len(head) + len(moov(0)) + (16 if wide else 8)
    return head + moov(base) + box(b"mdat", payload)


def walk(data: memoryview, low: int = 0, high: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int, bool]]:
    """(path, start of the body, end, whether whole) of every box, depth first. A box whose size leaves its parent is cut at
    the parent's end and is not whole; nothing follows it."""
    high = len(data) if high is None else high
    while low + 8 <= high:
        size, kind = struct.unpack_from(">I4s", data, low)
        body = low + 8
        if size == 1:
            if body + 8 > high:
                return
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = high - low
        if size < body - low:
            return
        end = min(low + size, high)
        yield (*path, kind), body, end, low + size <= high
        if kind in CONTAINERS and len(path) < DEEPEST:
            yield from walk(data, body, end, (*path, kind))
        low += size


def _numbers(data: memoryview, at: int, end: int, kind: str, n: int) -> np.ndarray:
    """n big-endian numbers of a box, or as many as it holds."""
    n = max(0, min(n, (end - at) // np.dtype(kind).itemsize))
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _table(data: memoryview, box: tuple[int, int], kind: str, width: int = 1) -> np.ndarray:
    at, end = box
    if end - at < 8:
        return np.zeros((0, width), np.int64)
    found = _numbers(data, at + 8, end, kind, struct.unpack_from(">I", data, at + 4)[0] * width)
    return found[: len(found) // width * width].reshape(-1, width)


def _header(data: memoryview, box: tuple[int, int]) -> tuple[int, int]:
    """Time scale and duration of a media header of version 0 or 1."""
    at, end = box
    if end - at >= 32 and data[at] == 1:
        return struct.unpack_from(">IQ", data, at + 20)
    return struct.unpack_from(">II", data, at + 12) if end - at >= 20 else (0, 0)


def _samples(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Offsets and sizes of the samples that the tables agree on, and whether they agree on all."""
    at, end = boxes[b"stsz"]
    if end - at < 12:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    one, told = struct.unpack_from(">II", data, at + 4)
    chunks = (_table(data, boxes[b"co64"], ">i8") if b"co64" in boxes else _table(data, boxes[b"stco"], ">u4"))[:, 0]
    runs = _table(data, boxes[b"stsc"], ">u4", 3)
    if not len(runs) or not len(chunks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), not told
    firsts = np.minimum(np.maximum.accumulate(np.append(runs[:, 0] - 1, len(chunks))), len(chunks))
    ordered = bool((np.diff(runs[:, 0]) > 0).all()) and runs[0, 0] == 1
    per = np.minimum(np.repeat(runs[:, 1], np.diff(firsts)), len(data))  # a sample of a chunk takes a byte at least, or none are there
    room = int(np.minimum(np.cumsum(per.astype(float)), 1e15)[-1]) if len(per) else 0
    n = min(told, room, len(data) + 1) if one else min(told, room, (end - at - 12) // 4)
    sizes = np.full(n, one, np.int64) if one else _numbers(data, at + 12, end, ">u4", n)
    last = np.cumsum(per.astype(float))
    kept = int(np.searchsorted(last, n, "left")) + 1
    per = per[:kept]
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    before = np.cumsum(sizes) - sizes
    starts = np.minimum(np.cumsum(per) - per, max(n - 1, 0))
    offsets = chunks[np.minimum(chunk + int(firsts[0]), len(chunks) - 1)] + before - before[starts][chunk] if n else np.zeros(0, np.int64)
    return offsets, sizes, ordered and n == told


def _fragments(data: memoryview, track: int, defaults: dict[int, tuple[int, int]], parts: list[list]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], int, bool]:
    """Offsets, sizes, key flags and duration of a track's samples in movie fragments, and whether all could be read."""
    offsets, sizes, keys, duration, whole = [], [], [], 0, True
    for start, boxes in parts:
        mine, base, size, length, flags, after = False, start, 0, 0, 0, None
        for name, at, end in boxes:
            if name == b"tfhd":
                if end - at < 8:
                    whole = False
                    continue
                given, number = struct.unpack_from(">II", data, at)
                given &= 0xFFFFFF
                mine, base, after = number == track, start, None
                length, size, flags = (*defaults.get(track, (0, 0)), 0)[:3]
                place = at + 8
                for bit, form in ((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")):
                    if given & bit:
                        if place + struct.calcsize(form) > end:
                            whole = False
                            break
                        value = struct.unpack_from(form, data, place)[0]
                        place += struct.calcsize(form)
                        base, length, size, flags = (value if bit == 1 else base), (value if bit == 8 else length), (value if bit == 16 else size), (value if bit == 32 else flags)
            elif name == b"trun" and mine:
                if end - at < 8:
                    whole = False
                    continue
                given, n = struct.unpack_from(">II", data, at)
                given &= 0xFFFFFF
                place, first_flags = at + 8, None
                begin = after if after is not None else base
                if given & 1 and place + 4 <= end:
                    begin, place = base + struct.unpack_from(">i", data, place)[0], place + 4
                if given & 4 and place + 4 <= end:
                    first_flags, place = struct.unpack_from(">I", data, place)[0], place + 4
                columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if given & bit]
                room = (end - place) // (4 * len(columns)) if columns else len(data)
                whole &= n <= room
                n = min(n, room)
                rows = _numbers(data, place, end, ">u4", n * len(columns)).reshape(n, len(columns)) if columns else np.zeros((n, 0), np.int64)
                column = lambda bit, other: rows[:, columns.index(bit)] if bit in columns else np.full(n, other, np.int64)  # noqa: B023, E731
                own, marks = column(0x200, size), column(0x400, flags)
                if n and first_flags is not None:
                    marks[0] = first_flags
                duration += int(column(0x100, length).sum())
                at_ = begin + np.cumsum(own) - own
                after = int(at_[-1] + own[-1]) if n else begin
                offsets.append(at_)
                sizes.append(own)
                keys.append(marks & 0x10000 == 0)  # not marked as a sample that needs others
    return offsets, sizes, keys, duration, whole


def tracks(media: bytes) -> list[dict]:
    """One dict for each track: codec, handler, timescale, duration, offsets and sizes of the samples, (start, end) of key
    frames, whether the container holds all that its tables tell of. Samples in movie fragments follow those of the
    track's own tables. Boxes of one track never count for another; tables are read as far as their boxes reach, and
    samples outside of the container are left out, with whole false. No input is an error."""
    data = memoryview(media)
    found: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[list] = []
    defaults: dict[int, tuple[int, int]] = {}
    intact, start = True, 0
    for path, body, end, whole in walk(data):
        intact &= whole
        kind = path[-1]
        if path == (b"moof",):
            start = body - 8
        if kind == b"trak" and path[:-1] == (b"moov",):
            found.append({})
        elif kind == b"traf":
            fragments.append([start, []])
        elif path[:2] == (b"moov", b"trak") and found:
            found[-1].setdefault(kind, (body, end))
        elif kind == b"trex" and end - body >= 20:
            number, _, length, size = struct.unpack_from(">IIII", data, body + 4)
            defaults[number] = (length, size)
        elif path[:2] == (b"moof", b"traf") and kind in (b"tfhd", b"trun") and fragments:
            fragments[-1][1].append((kind, body, end))
    out = []
    for boxes in found:
        scale, told = _header(data, boxes.get(b"mdhd", (0, 0)))
        at, end = boxes.get(b"stsd", (0, 0))
        codec = bytes(data[at + 12 : at + 16]).decode("latin-1") if end - at >= 16 else None
        at, end = boxes.get(b"hdlr", (0, 0))
        handler = bytes(data[at + 8 : at + 12]).decode("latin-1") if end - at >= 12 else None
        offsets, sizes, whole = np.zeros(0, np.int64), np.zeros(0, np.int64), True
        if b"stsz" in boxes and b"stsc" in boxes and {b"stco", b"co64"} & boxes.keys():
            offsets, sizes, whole = _samples(data, boxes)
        times = _table(data, boxes.get(b"stts", (0, 0)), ">u4", 2)
        duration = int((times[:, 0].astype(object) * times[:, 1]).sum()) if len(times) else told
        key = np.ones(len(sizes), bool)
        if b"stss" in boxes:
            marked = _table(data, boxes[b"stss"], ">u4")[:, 0] - 1
            key[:] = False
            key[marked[(marked >= 0) & (marked < len(key))]] = True
            whole &= bool(((marked >= 0) & (marked < len(key))).all())
        at, end = boxes.get(b"tkhd", (0, 0))
        place = at + (20 if end > at and data[at] == 1 else 12)
        number = struct.unpack_from(">I", data, place)[0] if end - place >= 4 else 0
        more = _fragments(data, number, defaults, fragments)
        offsets, sizes, key = np.concatenate([offsets, *more[0]]), np.concatenate([sizes, *more[1]]), np.concatenate([key, *more[2]]).astype(bool)
        there = (offsets >= 0) & (offsets + sizes <= len(data))
        whole &= bool(there.all()) and more[4] and codec is not None
        out.append({"codec": codec, "handler": handler, "timescale": scale, "duration": duration + more[3] if more[0] and len(times) else more[3] or duration, "offsets": offsets[there], "sizes": sizes[there], "keys": np.stack([offsets, offsets + sizes], 1)[key & there], "whole": whole and intact})
    return out


def probed(media: bytes) -> dict:
    """The first track with samples, or the first one; codec None and no samples where there is none."""
    every = tracks(media)
    best = next((t for t in every if len(t["sizes"])), every[0] if every else None)
    return best or {"codec": None, "handler": None, "timescale": 0, "duration": 0, "offsets": np.zeros(0, np.int64), "sizes": np.zeros(0, np.int64), "keys": np.zeros((0, 2), np.int64), "whole": False}


def payload_of(media: bytes, found: dict) -> bytes:
    """The bytes of all samples in order; samples that follow each other are taken in one piece."""
    at, size = found["offsets"], found["sizes"]
    if not len(at):
        return b""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + size[:-1]))
    ends = np.append(first[1:] - 1, len(at) - 1)
    return b"".join(media[a:b] for a, b in zip(at[first].tolist(), (at[ends] + size[ends]).tolist(), strict=True))


def feature_of(found: dict) -> str:
    keys = found["keys"]
    digest = hashlib.sha256(np.ascontiguousarray(keys.astype(">i8")).tobytes()).hexdigest()[:16]
    span = f"{keys[0, 0]}-{keys[0, 1]}" if len(keys) else "-"
    return f"codec={(found['codec'] or '').strip()};whole={str(found['whole']).lower()};timescale={found['timescale']};duration={found['duration']};samples={len(found['sizes'])};keyframes={len(keys)};first_key={span};key_ranges={digest}"


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary(batch.column(batch.schema.get_field_index("text"))).to_pylist()
        low = 0
        while low < len(texts):  # a batch out is about as large as 16 MB, however long its texts are
            high, size = low, 0
            while high < len(texts) and (high == low or size < 16 << 20):
                size, high = size + len(texts[high]), high + 1
            part = texts[low:high]
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(low, high - low)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in part], pa.int64()), pa.array([muxed(padded(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])
            low = high


def mux(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 text of every row, filled up to a positive multiple of 64 bytes, as a media
    column. Null counts as empty; an empty text becomes 64 bytes 0. Equal texts give equal media; rows are independent."""
    return docs.select("doc_id", "text").mapInArrow(_mux, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


_PROBED = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_keyframes", pa.int64()), ("whole", pa.bool_())]
_PROBED_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long, whole boolean"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in binary(batch.column(batch.schema.get_field_index("media"))).to_pylist():
            found = probed(media)
            payload = payload_of(media, found)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(found), found["codec"], float(found["duration"]) / found["timescale"] if found["timescale"] else None, len(found["keys"]), found["whole"]))
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(_PROBED), _PROBED, strict=True)]
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "media"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *columns], [*(n for n, _ in kept), *(n for n, _ in _PROBED)])


def probe(media: DataFrame) -> DataFrame:
    """`media` with what its column `media` holds instead of that column: payload and container digests, codec, duration
    and key frames, and whether the container holds all that its tables tell of. Columns of the same names are replaced.

    Null containers and such without a track have no payload, a null codec and no key frames; of broken ones what can be
    read is returned, with whole false. Rows are independent; an empty table gives an empty result."""
    names = {n for n, _ in _PROBED}
    media = media.select(*(F.col(f"`{c}`") for c in media.columns if c not in names))
    kept = ", ".join(f"`{n}` {t}" for n, t in media.dtypes if n != "media")
    return media.mapInArrow(_probe, f"{kept}, {_PROBED_DDL}" if kept else _PROBED_DDL)


def key_ranges(media: DataFrame) -> DataFrame:
    """(doc_id, sample, start, end): the byte ranges of the key frames of every row's container. Null, broken and empty
    containers have none; repeated rows give theirs again; an empty table gives an empty result."""

    def ranges(batches):
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), binary(batch.column(1)).to_pylist(), strict=True):
                keys = probed(raw)["keys"]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(keys), batch.schema.field(0).type), pa.array(range(len(keys)), pa.int64()), pa.array(keys[:, 0], pa.int64()), pa.array(keys[:, 1], pa.int64())], ["doc_id", "sample", "start", "end"])

    return media.select("doc_id", "media").mapInArrow(ranges, f"doc_id {dict(media.dtypes)['doc_id']}, sample long, start long, end long")
