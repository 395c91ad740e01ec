"""Secret scans with corpus-wide ownership frequency.

Each whole text is searched for secrets of the base kinds and for further candidates (long mixed tokens). A candidate
is kept as the SHA-256 of its value, and the whole corpus tells in how many repositories and under how many owners
that value stands. Values that several owners share are copied examples; values of one owner that look live (mixed
characters, high entropy) are credentials, and further candidates of that sort become spans too. Owners alone decide: a
credential that stands in many repositories of its owner is still theirs, and the number of repositories beside it tells
how far it has spread and has to be withdrawn.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, cut, free, spread_join

#: The base kinds in their order, and the kind of the further candidates.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: Further candidates: tokens of so many characters with lower case, upper case and digits.
OWNED = re.compile(r"[A-Za-z0-9+/_-]{20,}")
OWNED_CHARS = bytes(120 if chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 32 for i in range(256))
HEX_CHARS = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
#: Bits per character from which a value looks live, and the distinct owners from which it is a copied example.
LIVE_BITS, COPIED_OWNERS = 3.0, 3


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    return entropy(value) >= LIVE_BITS and any(c.isdigit() for c in value)


def may_hold(raw: bytes) -> bool:
    """False for most texts, cheaply: no keyword, no access prefix, no long run of hexadecimal or token characters."""
    low = raw.lower()
    if any(k in low for k in KEYWORDS) or b"AKIA" in raw:
        return True
    return b"x" * LEAST["hex"] in raw.translate(HEX_CHARS) or b"x" * 20 in raw.translate(OWNED_CHARS)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def further_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long mixed tokens that touch no base span."""
    found = []
    for m in OWNED.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and not any(s < m.end() and m.start() < e for s, _, e, _ in taken):
            found.append((m.start(), 3, m.end(), v))
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw in binary(batch.column(batch.schema.get_field_index("text"))).to_pylist():
            text = raw.decode() if may_hold(raw) else ""
            base = base_spans(text)
            more = further_spans(text, base)
            kinds = Counter(k for _, k, _, _ in base)
            every = [{"kind": KINDS[k], "k": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "live": looks_live(v)} for s, k, e, v in base + more]
            rows.append({"n_assign": kinds[0], "n_access": kinds[1], "n_hex": kinds[2], "base": joined(base), "found": every})
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "text"), *(pa.array([r[n] for r in rows], t) for n, t in _FOUND)], [*(n for n in batch.schema.names if n != "text"), *(n for n, _ in _FOUND)])


_SPAN = pa.struct([("kind", pa.string()), ("k", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("live", pa.bool_())])
_FOUND = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("found", pa.list_(_SPAN))]
_FOUND_DDL = "n_assign long, n_access long, n_hex long, base string, found array<struct<kind:string,k:int,start:long,end:long,hash:string,live:boolean>>"


def scan(docs: DataFrame, doc_id: Column | None = None, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(rid, doc_id, n_assign, n_access, n_hex, base, spans): one row per row of `docs`, with the secrets of its text.

    `spans` is an array of (start, end, kind, hash, owners, repositories, live, copied), by start and then kind; base
    spans always stay, further candidates stay if they look live and fewer than COPIED_OWNERS owners have them. Null
    texts count as empty and have no spans. Null owners or repositories are an owner or repository of their own. Rows
    with equal ids or equal texts each get their own result. An empty table gives an empty result.
    """
    doc_id, repository, owner = (given if given is not None else c for given, c in ((doc_id, F.col("doc_id")), (repository, F.concat_ws("/", "source", "lang")), (owner, F.col("source"))))
    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), repository.cast("string")), F.lit("")).alias("repo"), F.coalesce(F.concat(F.lit("="), owner.cast("string")), F.lit("")).alias("owner"), F.col("text"))
    types = dict(narrow.dtypes)
    scanned = cut(narrow.mapInArrow(_scan, f"rid bigint, doc_id {types['doc_id']}, repo string, owner string, {_FOUND_DDL}"))
    some = scanned.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("s"))
    # distinct triples first: a value that a third of all rows hold is down to its owners and repositories before it meets in one task
    triples = some.select(F.col("s.hash").alias("hash"), "repo", "owner").distinct()
    often = triples.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repositories"))
    judged = spread_join(some.select("rid", F.col("s.hash").alias("hash"), "s"), often, "hash", "rid")
    copied = F.col("owners") >= COPIED_OWNERS
    judged = judged.where((F.col("s.k") < 3) | (F.col("s.live") & ~copied))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.k").alias("k"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), "hash", "owners", "repositories", F.col("s.live").alias("live"), copied.alias("copied"))
    spans = judged.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    kept = scanned.drop("found", "repo", "owner").join(spans, "rid", "left")
    return kept.withColumn("spans", F.coalesce("spans", F.array().cast(kept.schema["spans"].dataType)))


def redact(docs: DataFrame, mark: str = "[SECRET]", **columns: Column) -> DataFrame:
    """`docs` with every span of `scan` replaced by `mark` in its text (overlapping spans by one), and n_chars, if there,
    counted again. Texts without spans stay as they are, null texts stay null, and no row is dropped."""
    name, spans = free(docs.columns, "_key", "_spans")
    key = F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    found = scan(docs, doc_id=key, **columns).where(F.size("spans") > 0).select(F.col("doc_id").alias(name), F.col("spans").alias(spans)).dropDuplicates([name])
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["end"] < a["at"], a).otherwise(F.struct((s["end"] + 1).cast("int").alias("at"), F.concat(a["out"], F.when(s["start"] + 1 >= a["at"], F.concat(F.substring("text", a["at"], (s["start"] + 1 - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out")))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"], F.lit(2147483647)))))
    out = docs.withColumn(name, key).join(found, name, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
