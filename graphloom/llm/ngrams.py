"""N-gram Jaccard join: documents whose sets of word 5-grams are alike, by T-occurrence search.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes), named by 128 bits; equal sets are one class.
2. Prefixes: in an order that puts shingles last which repeat within tasks, two sets that link share at least
   p - (n - ceil(0.75 n)) of the first p shingles of either. Those prefixes are the short inverted lists; sets with too
   few shared shingles in them link with nothing and are gone.
3. Families: each remaining set goes to the family of the smallest set that shares a list with it, and as a guest to
   families of sets that share enough lists with it. Every pair that can link is in a family together. A crowded list
   names no guests; it is credited to its sets, and sets of mostly such lists meet in families of theirs.
4. In a family, DivideSkip finds the sets with the required overlap and joins them to components (overlap.py). A large
   family is cut into blocks, and a few of its sets, the centres, visit each block: near copies are one component then.
   What the blocks leave apart is looked for among the sets of the family that it shares a rare shingle with: shingles
   that many sets of the family have (its core) can bring two sets no nearer than their shares of it, and where these are
   too small for a link, a rare one must be common. Only sets that could link by the core alone meet other blocks.
5. Components of all families together, and the smallest document id of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import overlap
from .common import components, cut, free, share_of, slices, spread_join
from .wordspans import LOWER, mixed, piece_hashes, sequence_hashes, spans

#: Words of a shingle; sets link where 100 * intersection >= 75 * union.
WORDS, NUM, DEN = 5, 75, 100
#: Share of a set that its prefix takes beyond what a link needs.
LONGER = 0.125
#: Shingles that stand last in the order, at most (only speed depends on them), and how often they repeat at least.
LAST_SHINGLES, REPEATED, TASK_SHINGLES = 65_536, 32, 2 << 20
#: Rows of where sets go that may be broadcast (20 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Sets of a family that one task takes, sets of a block of a larger one, centres; lists of more families or sets are crowded.
FAMILY_SETS, BLOCK_SETS, CENTRES, GUEST_FAMILIES, LIST_SETS = 512, 256, 8, 32, 65_536
#: Sets of a family that have a shingle in common from which on it is of the family's core.
CORE_SETS = 64
#: Rounds of dropping sets with too few shared shingles.
PRUNINGS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some texts, ascending within each, and how many each has."""
    starts, ends, counts = spans(data, offsets)
    found, have = sequence_hashes(piece_hashes(LOWER[data], starts, ends), counts, WORDS)
    ends = np.cumsum(have)
    begins = ends - have
    for low, high in zip(begins.tolist(), ends.tolist(), strict=True):  # each text by itself: far cheaper than one sort by text and shingle
        found[low:high].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[begins[have > 0]] = True
    before = np.append(0, np.cumsum(new))
    return found[new], (before[ends] - before[begins]).astype(np.int64)


def names(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, as two sums over its shingles."""
    at = np.cumsum(counts) - counts
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(found ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mixed(total[at + counts] - total[at] + counts.astype(np.uint64)))
    return out[0], out[1]


def _needed(counts: np.ndarray) -> np.ndarray:
    return -(-NUM * counts // DEN)


def _prefix(counts: np.ndarray) -> np.ndarray:
    """Shingles of a prefix: one more than may be missing, and LONGER of the set besides."""
    return np.minimum(counts, counts - _needed(counts) + 1 + (LONGER * counts).astype(np.int64))


def _least(counts: np.ndarray) -> np.ndarray:
    """Lists that a set shares, in both prefixes, with each set it links with. Of o common shingles the first
    p - (n - o) stand in a prefix of p; o is at least ceil(0.75 n) for the larger n of both, so floor(LONGER * n) holds
    for either of them."""
    return np.maximum(1, (LONGER * counts).astype(np.int64))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows for shingles that several sets of the task hold."""
    held: list[np.ndarray] = []
    schema = ["kind", "doc_id", "n", "name", "shingle", "times"]

    def repeated() -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        found, times = found[times >= 3], times[times >= 3]
        none = len(found)
        return pa.RecordBatch.from_arrays([pa.array([1] * none, pa.int32()), pa.nulls(none, kind), pa.nulls(none, pa.int64()), pa.nulls(none, pa.string()), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], schema)

    kind, total = pa.int64(), 0
    for batch, data, offsets in slices(batches, "text"):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        kind = ids.type
        found, counts = shingle_sets(data, offsets)
        a, b = names(found, counts)
        name = pa.array([f"{x:016x}{y:016x}" if n else None for x, y, n in zip(a.tolist(), b.tolist(), counts.tolist(), strict=True)], pa.string())
        rows = len(counts)
        yield pa.RecordBatch.from_arrays([pa.array([0] * rows, pa.int32()), ids, pa.array(counts), name, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], schema)
        _, first = np.unique(a, return_index=True)  # a set that stands several times in the slice counts once
        once = np.zeros(rows, bool)
        once[first] = True
        held.append(found[np.repeat(once, counts)])
        total += len(held[-1])
        if total > TASK_SHINGLES:
            yield repeated()
            held, total = [], 0
    yield repeated()


def _distinct_sets(batches: Iterator[pa.RecordBatch]):
    """(shingles, counts, first name, both names) of the different sets of each slice."""
    for _, data, offsets in slices(batches, "text"):
        found, counts = shingle_sets(data, offsets)
        a, b = names(found, counts)
        _, first = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
        keep = np.zeros(len(counts), bool)
        keep[first] = True
        keep &= counts > 0
        yield found[np.repeat(keep, counts)], counts[keep], a[keep], b[keep]


def _postings(last):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, often = last.value
        for found, counts, a, _ in _distinct_sets(batches):
            text = np.repeat(np.arange(len(counts)), counts)
            at = np.minimum(np.searchsorted(late, found), max(len(late) - 1, 0))
            rank = np.where(late[at] == found, often[at], 0) if len(late) else np.zeros(len(found), np.int64)
            begins = np.cumsum(counts) - counts
            first = np.append(0, np.cumsum(rank == 0))
            place = first[:-1] - first[begins][text]  # shingles that do not stand last are in order already
            put = np.flatnonzero(rank)
            put = put[np.lexsort((rank[put], text[put]))]
            many = np.bincount(text[put], minlength=len(counts))
            place[put] = (first[begins + counts] - first[begins] - np.cumsum(many) + many)[text[put]] + np.arange(len(put))
            keep = np.flatnonzero(place < _prefix(counts)[text])
            node = text[keep]
            columns = [pa.array(found[keep].view(np.int64)), pa.array(a[node].view(np.int64)), pa.array(_least(counts)[node].astype(np.int32))]
            for low in range(0, len(keep), 1 << 18):
                yield pa.RecordBatch.from_arrays([c.slice(low, 1 << 18) for c in columns], ["shingle", "node", "least"])

    return run


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of lists of two sets or more, once each, with the smallest set of the list. Rows come by shingle and then by
    node; of the list that a batch ends in only its name, its smallest set and, while it is alone, its row are kept."""
    names = ("shingle", "node", "least")
    alone: list[np.ndarray] | None = None  # the only row so far of the last list
    last = low = None  # of the last list: (shingle, node) of its last row, its smallest set
    for batch in batches:
        rows = _arrays(batch, *names)
        if not len(rows[0]):
            continue
        new = np.append(last is None or (rows[0][0], rows[1][0]) != last, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)).astype(bool)
        rows = [c[new] for c in rows]
        if not len(rows[0]):
            continue
        more = last is not None and rows[0][0] == last[0]
        if more and alone is not None:
            rows = [np.append(a, c) for a, c in zip(alone, rows, strict=True)]
        begins = np.flatnonzero(np.append(True, np.diff(rows[0]) != 0))
        size = np.diff(np.append(begins, len(rows[0])))
        lows = rows[1][begins]
        if more:
            lows[0] = low
        several = size > 1
        several[0] |= more
        last, low, alone = (rows[0][-1], rows[1][-1]), lows[-1], None if several[-1] else [c[-1:] for c in rows]
        keep = np.repeat(several, size)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in rows), pa.array(np.repeat(lows, size)[keep])], [*names, "low"])


_GUESTS = ["crowded", "node", "family", "least", "times"]


def _guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(crowded, node, family, least, times): for every list, each set with the families of smaller sets in it; of crowded
    lists each set once, with the smallest one. Rows come by shingle; the lists that a batch holds whole are taken at once,
    of the one that it ends in at most LIST_SETS rows are held back."""
    last, crowded = None, False
    held: list[np.ndarray] = []  # rows of the last list, until it ends or is crowded
    out: list[np.ndarray] = []

    def hold(rows: np.ndarray) -> None:
        nonlocal crowded, held
        held.append(rows)
        crowded = crowded or sum(h.shape[1] for h in held) > LIST_SETS or len(np.unique(np.concatenate([h[3] for h in held]))) > GUEST_FAMILIES
        if crowded:
            every = np.concatenate(held, 1)
            out.append(np.stack([np.ones(every.shape[1], np.int64), every[1], every[4], every[2]]))
            held = []

    def close() -> None:
        if held:
            out.append(_whole(np.concatenate(held, 1)))

    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack(_arrays(batch, "shingle", "node", "least", "home", "low")).astype(np.int64)
        more = int((rows[0] == last).sum()) if last is not None else 0
        if more:
            hold(rows[:, :more])
        if more < rows.shape[1]:
            tail = int(np.flatnonzero(np.append(True, np.diff(rows[0]) != 0))[-1])
            close()
            if more < tail:
                out.append(_whole(rows[:, more:tail]))
            last, crowded, held = rows[0, -1], False, []
            hold(rows[:, tail:])
        if sum(o.shape[1] for o in out) > 1 << 18:
            yield _counted(out)
            out = []
    close()
    if out:
        yield _counted(out)


def _whole(rows: np.ndarray) -> np.ndarray:
    """(crowded, node, family, least) of whole lists, whose rows (shingle, node, least, home, low) stand together."""
    shingle, node, least, home, low = rows[:, np.lexsort((rows[3], rows[0]))]
    new = np.append(True, np.diff(shingle) != 0)
    begins, of = np.flatnonzero(new), np.cumsum(new) - 1
    first = new | np.append(True, np.diff(home) != 0)
    families, at = home[first], np.cumsum(first) - 1
    have = np.diff(np.append(at[begins], len(families)))
    crowded = ((have > GUEST_FAMILIES) | (np.diff(np.append(begins, len(node))) > LIST_SETS))[of]
    lowest = at[begins][of]  # the list's first family
    smaller = np.where(crowded, 0, at - lowest)
    who = np.repeat(np.arange(len(node)), smaller)
    which = lowest[who] + np.arange(len(who)) - np.repeat(np.cumsum(smaller) - smaller, smaller)
    guests = np.stack([np.zeros(len(who), np.int64), node[who], families[which], least[who]])
    return np.concatenate([guests, np.stack([np.ones(crowded.sum(), np.int64), node[crowded], low[crowded], least[crowded]])], 1)


def _counted(rows: list[np.ndarray]) -> pa.RecordBatch:
    found = pa.table([pa.array(r) for r in np.concatenate(rows, 1)], _GUESTS[:4]).group_by(_GUESTS[:4], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    return pa.RecordBatch.from_arrays([pa.concat_arrays(found[c].chunks) if found[c].num_chunks else pa.nulls(0, pa.int64()) for c in [*_GUESTS[:4], "count_all"]], _GUESTS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found, counts, a, b in _distinct_sets(batches):
        ends = np.cumsum(counts)
        blobs = [found[e - n : e].tobytes() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
        name = [f"{x:016x}{y:016x}" for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(name), pa.array(blobs, pa.binary())], ["node", "name", "shingles"])


_FOUND = pa.schema([("family", pa.int64()), ("node", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("shingles", pa.binary())])


def _edges(group: pa.Table) -> tuple[pa.Table, list[str], list[str]]:
    """The different sets of a group (the first of each name), and edges (a, b) from each of them to one of its component."""
    first: dict[str, int] = {}
    for i, name in enumerate(group["name"].to_pylist()):
        first.setdefault(name, i)
    names = sorted(first)
    group = group.take([first[n] for n in names])
    roots = overlap.components([np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()], NUM, DEN)
    edges = [(a, names[r]) for a, r in zip(names, roots, strict=True) if a != names[r]]
    return group, [a for a, _ in edges], [b for _, b in edges]


def _linked(group: pa.Table) -> pa.Table:
    """Edges (a, b) of a family or of a block of one; of blocks their own sets too, as rows without b."""
    group, a, b = _edges(group.take(np.argsort(group["centre"].to_numpy(), kind="stable")))
    found = pa.table([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.nulls(len(a), pa.binary())], schema=_FOUND)
    own = group.filter(pc.and_(pc.greater_equal(group["block"], 0), pc.invert(group["centre"])))
    return pa.concat_tables([found, pa.table([own["family"], own["node"], own["name"], pa.nulls(len(own), pa.string()), own["shingles"]], schema=_FOUND)])


def _met(group: pa.Table) -> pa.Table:
    _, a, b = _edges(group)
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, name) of every document, and the shingles that many sets repeat (shingle, times)."""
    kind = dict(docs.dtypes)["doc_id"]
    both = cut(docs.select("doc_id", "text").mapInArrow(_named, f"kind int, doc_id {kind}, n long, name string, shingle long, times long"))
    often = both.where("kind = 1").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= REPEATED)
    return both.where("kind = 0").select("doc_id", "n", "name"), often


def _last(often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most LAST_SHINGLES of the shingles, those that repeat most; how many is settled by a small histogram first."""
    level = F.floor(F.log2("times") * 4).cast("int")
    room = LAST_SHINGLES
    for row in sorted(often.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a few dozen rows
        if row["count"] > room:  # of the level that is too full, a share (a little less than there is room for)
            often = often.where((level > row["level"]) | (level == row["level"]) & share_of(F.col("shingle"), 0.97 * room / row["count"]))
            break
        room -= row["count"]
    rows = often.toPandas()  # about LAST_SHINGLES at most
    shingles = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows["times"].to_numpy(np.int64)[order]


def families(docs: DataFrame, often: DataFrame) -> DataFrame:
    """(node, family): which sets meet where."""
    last = docs.sparkSession.sparkContext.broadcast(_last(often))
    lists = "shingle long, node long, least int, low long"
    rows = docs.select("text").mapInArrow(_postings(last), "shingle long, node long, least int")
    by_list = lambda df, *then: df.repartition("shingle").sortWithinPartitions("shingle", *then)
    shared = cut(by_list(rows, "node").mapInArrow(_shared, lists))
    for _ in range(PRUNINGS):
        enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("times"), F.min("least").alias("enough")).where("times >= enough").select("node")
        shared = cut(by_list(shared.select("shingle", "node", "least").join(enough, "node"), "node").mapInArrow(_shared, lists))
    homes = shared.groupBy("node").agg(F.min("low").alias("home"))
    beside = shared.join(homes, "node").repartition("shingle").sortWithinPartitions("shingle")
    named = cut(beside.mapInArrow(_guests, "crowded long, node long, family long, least long, times long"))
    crowded = named.where("crowded = 1")
    credit = crowded.groupBy("node").agg(F.sum("times").alias("credit"), F.min("least").alias("least"))
    guests = named.where("crowded = 0").groupBy("node", "family").agg(F.sum("times").alias("times"), F.min("least").alias("least")).join(credit.select("node", "credit"), "node", "left")
    guests = guests.where("times + coalesce(credit, 0) >= least").select("node", "family")
    # two sets that share only crowded lists share as many of them as a link needs, so both have that credit
    among = crowded.select("node", "family").distinct().join(credit.where("credit >= least").select("node"), "node")
    return cut(homes.select("node", F.col("home").alias("family")).union(guests).union(among).distinct())


def blocks(entries: DataFrame) -> DataFrame:
    """(node, family, block, centre): where sets go. Families of a task's size are one group (block -1); the sets of others go
    to blocks by a hash, and centres, the sets of the smallest values of a few hashes, to all blocks of their family."""
    low = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(CENTRES)]
    large = entries.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.array_distinct(F.array(*low)).alias("centres")).where(F.col("sets") > FAMILY_SETS)
    large = large.withColumn("blocks", F.ceil(F.col("sets") / F.lit(BLOCK_SETS)).cast("int"))
    own = entries.join(large.select("family", "blocks"), "family", "left").select("node", "family", F.when(F.col("blocks").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int").alias("block"), F.lit(False).alias("centre"))
    visits = large.select(F.explode("centres").alias("node"), "family", F.sequence(F.lit(0), F.col("blocks") - 1).alias("b")).select("node", "family", F.explode("b").alias("block"), F.lit(True).alias("centre"))
    return cut(own.union(visits))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, name, shingle) of sets (family, name, shingles), a bounded number of rows at a time."""
    for batch in batches:
        for low in range(0, len(batch), 64):
            part = batch.slice(low, 64)
            each = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
            who = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(np.concatenate(each))], ["family", "name", "shingle"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, left, right) whose sets link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            keep.append(overlap.linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), NUM, DEN))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def strays(sets: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Edges (a, b) that join the sets of large families (family, node, name, shingles) outside of the largest component of
    their family to what they link with; None where there are no such sets.

    Sets of m and n shingles link with o common ones where o >= NUM (m + n) / (NUM + DEN). Of these at most as many are of
    the family's core as the smaller of both shares of it. So pairs of different components either have as many rare
    shingles in common as that leaves open, at least one, and meet in its list, which is short; or they could link by the
    core alone, and meet in blocks. For that a family must have a set that is small enough."""
    placed = sets.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    sizes = placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("few")).where("few > 0")
    if main.isEmpty():
        return None
    size = (F.length("shingles") / 8).cast("int")
    met = cut(placed.join(main.select("family", "main"), "family").select("family", "name", "root", (F.col("root") != F.col("main")).alias("stray"), size.alias("n"), "shingles").dropDuplicates(["family", "name"]))
    each = cut(met.select("family", "name", "shingles").mapInArrow(_unpacked, "family long, name string, shingle long"))
    core = cut(each.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > CORE_SETS).select("family", "shingle"))
    core = F.broadcast(core) if core.count() <= BROADCAST_ROWS else core
    rare = cut(each.join(core, ["family", "shingle"], "left_anti"))
    facts = met.drop("shingles").join(rare.groupBy("family", "name").agg(F.count(F.lit(1)).alias("rare")), ["family", "name"], "left")
    facts = cut(facts.withColumn("core", F.col("n") - F.coalesce("rare", F.lit(0))))
    entry = F.struct("name", "root", "stray", "n", "core")
    lists = rare.join(facts, ["family", "name"]).groupBy("family", "shingle").agg(F.sort_array(F.collect_list(entry)).alias("sets")).where("size(sets) > 1 AND exists(sets, x -> x.stray)")  # CORE_SETS at most
    pairs = lists.select("family", F.posexplode("sets").alias("at", "a"), "sets").select("family", "a", F.explode(F.filter(F.slice("sets", F.col("at") + 2, F.lit(CORE_SETS)), lambda y: (y["stray"] | F.col("a.stray")) & (y["root"] != F.col("a.root")))).alias("b"))
    least = F.ceil(F.lit(NUM) * (F.col("a.n") + F.col("b.n")) / F.lit(NUM + DEN))
    near = pairs.withColumn("open", least - F.least("a.core", "b.core")).groupBy("family", F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(F.count(F.lit(1)).alias("both"), F.first("open").alias("open")).where("both >= open")
    blobs = met.select("name", "shingles").dropDuplicates(["name"])
    side = lambda rows, key, value: spread_join(rows, blobs.select(F.col("name").alias(key), F.col("shingles").alias(value)), key, "b" if key == "a" else "a")
    candidates = cut(near.select("a", "b").distinct())
    edges = side(side(candidates, "a", "left"), "b", "right").select("a", "b", "left", "right").mapInArrow(_verified, "a string, b string")
    further = _by_core(met, facts)
    return edges if further is None else edges.union(further)


def _by_core(met: DataFrame, facts: DataFrame) -> DataFrame | None:
    """Edges of strays that could link by the core alone, with all sets of their family that could: those whose share of the
    core is enough for the smallest set, and whose size is small enough for the largest share."""
    reach = (F.floor(F.col("core") * F.lit(NUM + DEN) / F.lit(NUM)) - F.col("n")).alias("reach")  # the largest set that it can link with so
    able = facts.select("*", reach)
    ends = able.groupBy("family").agg(F.min("n").alias("smallest"), F.max("reach").alias("furthest"))
    able = able.join(ends, "family").where("smallest <= reach AND n <= furthest")
    counts = able.groupBy("family").agg(F.count_if("stray").alias("few"), F.count(F.lit(1)).alias("all")).where("few > 0")
    able = cut(able.join(counts, "family").select("family", "name", "stray", "few", "all"))
    if able.isEmpty():
        return None
    count = lambda c: F.ceil(F.col(c) / F.lit(BLOCK_SETS)).cast("int")
    rows = able.join(met.select("family", "name", "shingles"), ["family", "name"]).withColumns({"rows": count("few"), "columns": count("all")})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = rows.where("stray").select("family", F.pmod(F.xxhash64("name"), F.col("rows")).cast("int").alias("i"), each("columns").alias("j"), "name", "shingles")
    more = own.union(rows.select("family", each("rows").alias("i"), F.pmod(F.xxhash64("name"), F.col("columns")).cast("int").alias("j"), "name", "shingles"))
    return more.groupBy("family", "i", "j").applyInArrow(_met, "a string, b string")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `classes`, and (name, component_id) of every set."""
    rows, often = classes(docs)
    where = blocks(families(docs, often))
    where = F.broadcast(where) if where.count() <= BROADCAST_ROWS else where
    sets = docs.select("text").mapInArrow(_sets, "node long, name string, shingles binary")
    met = sets.join(where, "node").groupBy("family", "block")
    found = cut(met.applyInArrow(_linked, "family long, node long, a string, b string, shingles binary"))
    edges = found.where("b IS NOT NULL").select("a", "b")
    roots = cut(components(edges))
    more = strays(found.where("b IS NULL").select("family", "node", F.col("a").alias("name"), "shingles"), roots)
    if more is not None:
        roots = components(edges.union(cut(more)))
    smallest = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("low"))
    with_root = smallest.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    lowest = with_root.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, spread_join(with_root, lowest, "root", "name").select("name", "component_id")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of `docs`, from its whole text.

    component_id is the smallest doc_id that links reach (the own one included). Texts without words, and null texts,
    have no shingles and link with nothing; texts of one to four words have one, their whole sequence. Rows with equal
    texts link; rows with equal ids each have their row. A null doc_id never is a component's id unless all its members
    have none. An empty table gives an empty result.
    """
    rows, known = grouped(docs)
    return spread_join(rows, known, "name", "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the one whose doc_id is the component's, and of several with that id the
    first by text. Rows without an id stay where no row with one links to them, one for each set of shingles. The columns
    are those of `docs` alone, whatever their names; null texts link with nothing and stay; an empty table stays empty."""
    rows, known = grouped(docs)
    number, name = free(docs.columns, "_n", "_name")
    kept = spread_join(rows, known, "name", "doc_id", "left").where(F.coalesce("component_id", "doc_id") == F.col("doc_id")).select("doc_id").distinct()
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("text"))
    with_id = docs.join(kept, "doc_id", "left_semi").withColumn(number, first("doc_id")).where(F.col(number) == 1)
    without = docs.where("doc_id IS NULL").mapInArrow(_with_name(name), docs.select("*").schema.add(name, "string"))
    alone = without.join(known.where("component_id IS NOT NULL").select(F.col("name").alias(name)), name, "left_anti")
    alone = alone.withColumn(number, first(name)).where((F.col(number) == 1) | F.col(name).isNull())
    return with_id.select(*docs.columns).union(alone.select(*docs.columns))


def _with_name(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            found, counts = shingle_sets(data, offsets)
            a, b = names(found, counts)
            name = [f"{x:016x}{y:016x}" if n else None for x, y, n in zip(a.tolist(), b.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string())], [*batch.schema.names, column])

    return run
