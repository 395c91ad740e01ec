"""Embedding near-dedup over robust-pruned flat graphs.

1. Equal vectors are one node. Nodes go to the shards of their nearest centroids (SPREAD of them, so shards overlap).
   Centroids grow with the nodes: where one k-means is not enough, each of its cells has centroids of its own.
2. Nodes that lie within a narrow ball around one of them (the leader) become a bundle: any two of them link, so however
   many near copies a vector has, they take one place in what follows. Most bundles are single nodes.
3. In each shard a flat graph over the leaders is built by robust pruning, and the adjacency lists of all shards are united.
4. Every shard searches for all its leaders, greedily from its medoid, and expands along the united lists as long as nodes
   are in range; close neighbours that other shards added come along with their vectors.
5. Every pair of leaders is verified in double precision: by their radii all, none or some members of two bundles link;
   where it is some, the members meet in blocks that only add up counts. Pairs that several shards find count once.
6. Shards of too many leaders (wide clusters that no ball holds) are not searched but compared exactly, in blocks.

`audit` measures the recall against all vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, share_of, spread_join

#: Nodes link at this cosine; nodes this near to a leader join its bundle (twice that angle is below the angle of a link);
#: lists are followed this much below what can link while a range is expanded.
LEAST, BALL, SLACK = 0.9, 0.976, 0.1
ANGLE = float(np.arccos(LEAST))
#: Nodes of a shard before overlap, shards of a node, rows that one k-means is fitted on at most, rows per centroid.
SHARD_NODES, SPREAD, SAMPLE_ROWS, PER_CENTROID = 512, 3, 65_536, 16
#: Nodes among which bundles are sought at once, leaders that a shard is searched with at most, rows of an exact block.
BUNDLE_NODES, SHARD_MOST, BLOCK = 4096, 6144, 2048
#: Candidates of a node, near and far neighbours that stay, the pruning factor, places of the search's beam, queries at once.
POOL, NEAR, FAR, ALPHA, BEAM, AT_ONCE = 48, 12, 4, 1.2, 16, 256


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors; None for what links with nothing."""
    out = []
    for v in column.to_pylist():
        x = np.array(v, float) if v is not None and len(v) and None not in v else None
        top = np.abs(x).max() if x is not None else 0.0
        if x is None or not np.isfinite(x).all() or top == 0:
            out.append(None)
        else:
            x = x / top
            out.append(x / np.sqrt(x @ x))
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1)
        units = _rows(raw)
        names = [None if u is None else hashlib.md5(np.array(v, "<f8").tobytes()).hexdigest() for u, v in zip(units, raw.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], ["vec_id", "name", "dims", "vector"])


def stacked(vectors, dims: int | None = None) -> np.ndarray:
    """Vectors as rows, filled up with 0 to the longest or cut to `dims`."""
    each = [np.frombuffer(v) for v in vectors]
    dims = max(map(len, each), default=1) if dims is None else dims
    if all(len(v) == dims for v in each):
        return np.stack(each) if each else np.zeros((0, dims))
    out = np.zeros((len(each), dims))
    for row, v in zip(out, each, strict=True):
        row[: min(dims, len(v))] = v[:dims]
    return out


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from rows at even steps."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(6):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums**2).sum(1))
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def centroids(vectors: DataFrame, nodes: int, dims: int) -> np.ndarray:
    """Over about SAMPLE_ROWS vectors by a hash of their names; one centroid for SHARD_NODES nodes, at most one for
    PER_CENTROID sampled rows."""
    sample = vectors.where(share_of(F.col("name"), SAMPLE_ROWS / nodes)).select("name", "vector").toPandas().sort_values("name")["vector"]
    if not len(sample):
        sample = vectors.select("vector").limit(1).toPandas()["vector"]
    x = stacked(sample, dims)
    return k_means(x, max(1, min(-(-nodes // SHARD_NODES), -(-len(x) // PER_CENTROID))))


def _nearest(centres, dims: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            if len(batch):
                x = stacked(batch.column(batch.schema.get_field_index("vector")).to_pylist(), dims)
                near = np.argsort(-(x @ c.T), 1, "stable")[:, :most].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "shards"])

    return run


def placed(nodes: DataFrame, count: int, dims: int) -> DataFrame:
    """`nodes` with shards, the nearest first. Beyond what one k-means can tell apart, each of its cells is fitted again on a
    sample of its own, and nodes meet the centroids of their nearest cell in groups of a bounded size."""
    spark = nodes.sparkSession
    c = centroids(nodes, count, dims)
    kept = "node long, dims int, vector binary, times long"
    near = nodes.select("node", "dims", "vector", "times").mapInArrow(_nearest(spark.sparkContext.broadcast(c), dims, SPREAD), f"{kept}, shards array<long>")
    if len(c) * SHARD_NODES * 2 >= count:
        return cut(near)
    cells = cut(near.withColumn("cell", F.col("shards")[0]).drop("shards"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("n") < F.lit(SAMPLE_ROWS) * F.lit(1 << 30)  # SAMPLE_ROWS of a cell

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        x, n = stacked(group.sort_values("node")["vector"], dims), int(group["n"].iloc[0])
        own = k_means(x, max(1, min(-(-n // SHARD_NODES), -(-len(x) // PER_CENTROID))))
        return pd.DataFrame({"cell": group["cell"].iloc[0], "centre": [v.tobytes() for v in own]})

    own = cut(cells.join(sizes, "cell").where(share).select("cell", "n", "node", "vector").groupBy("cell").applyInPandas(fitted, "cell long, centre binary"))
    own = cut(own.withColumn("shard", F.monotonically_increasing_id()))
    parts = sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(8 * BUNDLE_NODES)).cast("int")).select("cell", "parts")
    dealt = cells.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    centres = own.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def assigned(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"node": [], "dims": [], "vector": [], "times": [], "shards": []})
        ids = known["shard"].to_numpy()
        order = np.argsort(-(stacked(group["vector"], dims) @ stacked(known["centre"], dims).T), 1, "stable")[:, :SPREAD]
        return group[["node", "dims", "vector", "times"]].assign(shards=list(ids[order]))

    return cut(dealt.groupBy("cell", "part").cogroup(centres.groupBy("cell", "part")).applyInPandas(assigned, f"{kept}, shards array<long>"))


def _bundled(group: pd.DataFrame) -> pd.DataFrame:
    """(node, leader, cosine): the first node without a bundle leads one of all such nodes in its ball."""
    group = group.sort_values("node")
    x, node, dims = stacked(group["vector"]), group["node"].to_numpy(), group["dims"].to_numpy()
    n = len(node)
    leader, cosine, open_ = np.arange(n), np.ones(n), np.ones(n, bool)
    for low in range(0, n, AT_ONCE):
        near = x[low : low + AT_ONCE] @ x.T
        ball = (near >= BALL) & (dims[low : low + AT_ONCE, None] == dims[None])
        ball[np.arange(len(ball)), np.arange(low, low + len(ball))] = False
        for i in np.flatnonzero(ball.any(1)).tolist():
            u = low + i
            if open_[u]:
                mine = ball[i] & open_
                mine[: u + 1] = False
                leader[mine], cosine[mine] = u, near[i, mine]
                open_[mine] = False
                open_[u] = False
    return pd.DataFrame({"node": node, "leader": node[leader], "cosine": cosine})


def robust_prune(x: np.ndarray, u: int, candidates: np.ndarray, keep: int) -> list[int]:
    """Of the candidates from near to far: each one that no kept one is nearer to by the factor ALPHA."""
    gap = 1 - x[candidates] @ x[u]
    order = np.argsort(gap, kind="stable")
    candidates, gap = candidates[order], np.maximum(gap[order], 0)
    between = np.maximum(1 - x[candidates] @ x[candidates].T, 0)
    open_, kept = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if open_[i]:
            kept.append(int(candidates[i]))
            if len(kept) == keep:
                break
            open_ &= ALPHA * between[i] > gap
    return kept


def build(x: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Adjacency lists of a flat graph over the vectors of a shard: pruned nearest neighbours, pruned far ones, and the
    reverse of both."""
    n = len(x)
    lists: list[list[int]] = [[] for _ in range(n)]
    random = np.random.default_rng(seed)
    step = max(1, (2 << 20) // max(n, 1))
    for low in range(0, n, step):
        near = x[low : low + step] @ x.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        pool = np.argpartition(-near, min(POOL, n) - 1, 1)[:, :POOL] if n > 1 else np.zeros((len(near), 0), int)
        for i in range(len(near)):
            u = low + i
            own = pool[i][pool[i] != u]
            far = np.setdiff1d(random.integers(0, n, 4 * FAR), [u, *own])
            lists[u] = (robust_prune(x, u, own, NEAR) if len(own) else []) + (robust_prune(x, u, far, FAR) if len(far) else [])
    out = [set(a) for a in lists]
    for u, a in enumerate(lists):
        for v in a:
            if len(out[v]) < 2 * (NEAR + FAR):
                out[v].add(u)
    return [np.array(sorted(a - {u}), np.int64) for u, a in enumerate(out)]


def may_link(radius: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The cosine from which members of two bundles of such radii can link."""
    return np.cos(np.minimum(ANGLE + radius + other + 1e-9, np.pi))


def _graph(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node")
    x, node, radius = stacked(group["vector"]), group["node"].to_numpy(), group["radius"].to_numpy()
    lists = build(x)
    close = [a[x[a] @ x[u] >= may_link(radius[u], radius[a]) - SLACK] for u, a in enumerate(lists)]
    return pd.DataFrame({"node": node, "near": [node[a] for a in lists], "close": [node[a] for a in close]})


def search(x: np.ndarray, lists: list[np.ndarray], start: int, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of what range-expanding greedy searches see: from `start` and from the query's own list a beam
    moves to the nearest nodes; then everything follows that lists reach without leaving a query's `reach`, a cosine. All
    queries take their steps at once."""
    n, sizes = len(x), np.array([len(a) for a in lists], np.int64)
    flat, begin = np.concatenate([*lists, np.zeros(0, np.int64)]), np.cumsum(sizes) - sizes
    seen = np.zeros(len(queries) * n, bool)

    def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("ij,ij->i", x[queries[q[k : k + 65_536]]], x[v[k : k + 65_536]]) for k in range(0, len(q), 65_536)] or [np.zeros(0)])

    def beyond(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of nodes that their queries have not seen."""
        have = sizes[v]
        code = np.repeat(q * n, have) + flat[np.repeat(begin[v] - (np.cumsum(have) - have), have) + np.arange(have.sum())]
        code = np.unique(code[~seen[code]])
        seen[code] = True
        return code // n, code % n

    every = np.arange(len(queries))
    own = np.concatenate([every * n + queries, every * n + start])
    seen[own] = True
    own = np.unique(own)
    q, v = own // n, own % n
    cosine, done = cosines(q, v), np.zeros(len(q), bool)
    while True:
        order = np.lexsort((-cosine, q))
        first = np.searchsorted(q[order], q[order])
        best = order[np.arange(len(q)) - first < BEAM]
        best = best[~done[best]]
        if not len(best):
            break
        turn = np.arange(len(best)) - np.searchsorted(q[best], q[best])
        best = best[turn < 4]
        done[best] = True
        a, b = beyond(q[best], v[best])
        q, v, cosine, done = np.append(q, a), np.append(v, b), np.append(cosine, cosines(a, b)), np.append(done, np.zeros(len(a), bool))
    front = (cosine >= reach[q]) & ~done
    fq, fv = q[front], v[front]
    parts = [(q, v, cosine)]
    while len(fq):
        a, b = beyond(fq, fv)
        c = cosines(a, b)
        parts.append((a, b, c))
        inside = c >= reach[a]
        fq, fv = a[inside], b[inside]
    q, v, cosine = (np.concatenate(p) for p in zip(*parts, strict=True))
    other = queries[q] != v
    return q[other], v[other], cosine[other]


def judged(cosine: np.ndarray, radius: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of bundles at such cosines: 1 where all members link, 2 where some may, 0 where none can."""
    single = (radius == 0) & (other == 0)
    angle, both = np.arccos(np.clip(cosine, -1, 1)), radius + other
    kind = np.where(angle + both <= ANGLE - 1e-9, 1, np.where(angle - both <= ANGLE + 1e-9, 2, 0))
    return np.where(single, cosine >= LEAST, kind).astype(np.int32)


def _common(a: list, b: list) -> bool:
    return bool(set(a) & set(b))


def _found(group: pd.DataFrame) -> pd.DataFrame:
    """(a, b, kind): pairs of leaders that the searches of a shard see and `judged` does not rule out."""
    group = group.sort_values(["member", "node"], ascending=[False, True]).drop_duplicates("node")
    node, radius, dims, packed = group["node"].to_numpy(), group["radius"].to_numpy(), group["dims"].to_numpy(), group["packed"].tolist()
    x = stacked(group["vector"])
    place = {int(v): i for i, v in enumerate(node)}
    lists = [np.array([place[int(v)] for v in a if int(v) in place], np.int64) if a is not None else np.zeros(0, np.int64) for a in group["near"]]
    members = int(group["member"].sum())
    start = int((x[:members] @ x[:members].sum(0)).argmax())
    widest, out = radius.max(), [np.zeros((3, 0), np.int64)]
    for low in range(0, members, AT_ONCE):
        queries = np.arange(low, min(low + AT_ONCE, members))
        q, v, cosine = search(x, lists, start, queries, may_link(radius[queries], widest) - SLACK)
        u = queries[q]
        kind = judged(cosine, radius[u], radius[v]) * (dims[u] == dims[v])
        u, v, kind = u[kind > 0], v[kind > 0], kind[kind > 0]
        out.append(np.stack([np.minimum(node[u], node[v]), np.maximum(node[u], node[v]), kind]))
    pairs = np.unique(np.concatenate(out, 1), axis=1)
    if any(len(p) for p in packed):  # pairs that share a crowded shard are counted there
        apart = [not _common(packed[place[a]], packed[place[b]]) for a, b in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True)]
        pairs = pairs[:, np.array(apart, bool)]
    return pd.DataFrame({"a": pairs[0], "b": pairs[1], "kind": pairs[2].astype(np.int32)})


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to one of their component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


_COUNTED = "what string, a long, b long, k long"


def _rows_of(what: str, a, b, k) -> pd.DataFrame:
    return pd.DataFrame({"what": pd.Series([what] * len(a), dtype=object), "a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64), "k": np.asarray(k, np.int64)})


def _crowd(group: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of a crowded shard: links of each node ("n"), one edge for each that is joined ("e"), and pairs of bundles
    ("p"); pairs that share a smaller crowded shard are left to that one."""
    i, j, shard = int(group["i"].iloc[0]), int(group["j"].iloc[0]), int(group["shard"].iloc[0])
    group = group.sort_values(["own", "node"]).reset_index(drop=True)
    left, right = (group.index[group["own"] == k].to_numpy() for k in (i, j))
    x, node, radius, dims, rows = stacked(group["vector"]), group["node"].to_numpy(), group["radius"].to_numpy(), group["dims"].to_numpy(), group["rows"].to_numpy()
    cosine = x[left] @ x[right].T
    kind = judged(cosine, radius[left][:, None], radius[right][None]) * (dims[left][:, None] == dims[right][None])
    if i == j:
        kind = np.triu(kind, 1)
    smaller = [{s for s in p if s < shard} for p in group["packed"]]
    if any(smaller):
        shared: dict[int, list[int]] = {}
        for k, own in enumerate(smaller):
            for s in own:
                shared.setdefault(s, []).append(k)
        for own in shared.values():
            kind[np.ix_(np.isin(left, own), np.isin(right, own))] = 0
    a, b = np.nonzero(kind)
    a, b, kind = left[a], right[b], kind[a, b]
    single = kind == 1
    count = np.bincount(a[single], rows[b[single]], len(node)) + np.bincount(b[single], rows[a[single]], len(node))
    some = np.flatnonzero(count)
    moved, root = _stars(a[single], b[single], len(node))
    unsure = ~single
    return pd.concat([_rows_of("n", node[some], node[some], count[some]), _rows_of("e", node[moved], node[root], np.zeros(len(moved))), _rows_of("p", np.minimum(node[a[unsure]], node[b[unsure]]), np.maximum(node[a[unsure]], node[b[unsure]]), np.full(unsure.sum(), 2))])


def _between(group: pd.DataFrame) -> pd.DataFrame:
    """Members of two bundles, in a block of each: links of each node, and one edge between the leaders if there are any."""
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    if not len(left) or not len(right):  # a block that the hash left empty
        return _rows_of("n", [], [], [])
    x, y = stacked(left["vector"]), stacked(right["vector"])
    links = x @ y.T >= LEAST
    n = [_rows_of("n", own["node"], own["node"], links.astype(np.int64) @ right["times"].to_numpy() if s == 0 else links.T.astype(np.int64) @ left["times"].to_numpy()) for s, own in enumerate((left, right))]
    rows = pd.concat(n)
    rows = rows[rows["k"] > 0]
    edge = [[int(group["a"].iloc[0])], [int(group["b"].iloc[0])], [0]] if links.any() else [[], [], []]
    return pd.concat([rows, _rows_of("e", *edge)])


def named_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, name, dims, vector) of all rows; all but vec_id are null for what links with nothing."""
    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "embedding").mapInArrow(_named, f"vec_id {kind}, name string, dims int, vector binary")


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, name) of all rows, and the nodes (node, name, dims, vector, times, low)."""
    named = named_rows(vectors)
    grouped = named.where("name IS NOT NULL").groupBy("name").agg(F.first("dims").alias("dims"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("low"))
    return named.select("vec_id", "name"), cut(grouped.withColumn("node", F.monotonically_increasing_id()))


def bundles(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, leader) of every node, and the leaders (node, dims, vector, shards, rows, radius, members): rows of the whole
    bundle, and the angle to its farthest member."""
    homes = places.withColumn("home", F.col("shards")[0])
    parts = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUNDLE_NODES)).cast("int").alias("parts"))
    dealt = homes.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    of = cut(dealt.select("home", "part", "node", "dims", "vector").groupBy("home", "part").applyInPandas(_bundled, "node long, leader long, cosine double"))
    whole = of.join(places.select("node", "times"), "node").groupBy("leader").agg(F.sum("times").alias("rows"), F.count(F.lit(1)).alias("members"), F.min("cosine").alias("least"))
    radius = F.when(F.col("members") == 1, 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.col("least"))) + 1e-7)
    leaders = places.join(whole.withColumnRenamed("leader", "node"), "node").select("node", "dims", "vector", "shards", "rows", radius.alias("radius"), "members")
    return of.select("node", "leader"), cut(leaders)


def crowds(leaders: DataFrame) -> DataFrame:
    """(shard, blocks) of the shards that have more leaders than a search takes."""
    sizes = leaders.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_MOST)
    return sizes.select("shard", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors`.

    n_links counts the other rows linked directly, equal vectors included. Vectors that are null, empty, zero or with null
    or non-finite components link with nothing and are their own component; vectors of different lengths do not link.
    Rows with equal ids each get their own row. An empty table gives an empty result.
    """
    rows, nodes = nodes_of(vectors)
    n = nodes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usual = nodes.groupBy("dims").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "dims").first()["dims"]
    places = placed(nodes, n, usual)
    of, leaders = bundles(places)
    crowded = cut(crowds(leaders))
    if crowded.isEmpty():
        leaders, counted = leaders.withColumn("packed", F.array().cast("array<long>")), None
    else:
        packed = leaders.select("node", F.explode("shards").alias("shard")).join(crowded, "shard").groupBy("node").agg(F.collect_list("shard").alias("packed"))  # SPREAD at most
        leaders = leaders.join(packed, "node", "left").withColumn("packed", F.coalesce("packed", F.array().cast("array<long>")))
        own = leaders.withColumn("shard", F.explode("packed")).join(crowded, "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        counted = cut(met.select("shard", "i", "j", "own", "node", "vector", "radius", "dims", "rows", "packed").groupBy("shard", "i", "j").applyInPandas(_crowd, _COUNTED))
    open_ = leaders.withColumn("shard", F.explode(F.array_except("shards", "packed")))
    lists = open_.select("shard", "node", "vector", "radius").groupBy("shard").applyInPandas(_graph, "node long, near array<long>, close array<long>")
    united = cut(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_distinct(F.flatten(F.collect_list("close"))).alias("close")))
    whole = leaders.join(united, "node")
    here = whole.withColumn("shard", F.explode(F.array_except("shards", "packed"))).withColumn("member", F.lit(1))
    beyond = here.select("shard", F.explode("close").alias("node")).distinct().join(whole, "node").where(~F.array_contains("shards", F.col("shard"))).withColumn("member", F.lit(0))
    order = ["shard", "node", "vector", "radius", "dims", "packed", "near", "member"]
    pairs = here.select(*order).union(beyond.select(*order)).groupBy("shard").applyInPandas(_found, "a long, b long, kind int")
    if counted is not None:
        pairs = pairs.union(counted.where("what = 'p'").select("a", "b", F.lit(2).alias("kind")))
    pairs = cut(pairs.distinct())
    between = cut(_blocks(pairs.where("kind = 2"), of, places).groupBy("a", "b", "i", "j").applyInPandas(_between, _COUNTED))
    sure = pairs.where("kind = 1")
    both = sure.select("a", "b").union(sure.select("b", "a")).toDF("leader", "other").join(leaders.select(F.col("node").alias("other"), "rows"), "other").select("leader", F.col("rows").alias("k"))
    edges, singles = sure.select("a", "b").union(between.where("what = 'e'").select("a", "b")), between.where("what = 'n'").select(F.col("a").alias("node"), "k")
    if counted is not None:
        both = both.union(counted.where("what = 'n'").select("a", "k"))
        edges = edges.union(counted.where("what = 'e'").select("a", "b"))
    roots = components(edges)
    by_bundle = leaders.select(F.col("node").alias("leader"), "rows").join(both.groupBy("leader").agg(F.sum("k").alias("linked")), "leader", "left").join(roots.withColumnRenamed("node", "leader"), "leader", "left")
    by_bundle = by_bundle.select("leader", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("root", "leader").alias("root"))
    known = spread_join(nodes.select("node", "name", "low").join(of, "node"), by_bundle, "leader", "node").join(singles.groupBy("node").agg(F.sum("k").alias("k")), "node", "left")
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = spread_join(known, lowest, "root", "node").select("name", (F.col("n") + F.coalesce("k", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _blocks(pairs: DataFrame, of: DataFrame, places: DataFrame) -> DataFrame:
    """The members of each two bundles, in blocks that meet each other once: (a, b, i, j, side, node, vector, times)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    members = of.join(ends, "leader").join(places.select("node", "vector", "times"), "node")
    sizes = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    size = lambda c: sizes.select(F.col("leader").alias(c), F.col("blocks").alias(f"{c}_blocks"))
    sized = pairs.select("a", "b").join(size("a"), "a").join(size("b"), "b")
    number = lambda c: F.pmod(F.xxhash64("node"), F.col(f"{c}_blocks")).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_blocks") - 1))
    left = sized.join(members.withColumnRenamed("leader", "a"), "a").select("a", "b", number("a").alias("i"), each("b").alias("j"), F.lit(0).alias("side"), "node", "vector", "times")
    right = sized.join(members.withColumnRenamed("leader", "b"), "b").select("a", "b", each("a").alias("i"), number("b").alias("j"), F.lit(1).alias("side"), "node", "vector", "times")
    return left.union(right)


def audit(vectors: DataFrame, result: DataFrame, every: int = 50) -> float:
    """Recall of the links of the rows whose vec_id `every` divides: links that `result` counts, of those that comparing
    them with all rows, in blocks, finds. Rows without an id are left out; without any link it is 1."""
    named = named_rows(vectors).where("vector IS NOT NULL AND vec_id IS NOT NULL")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), object)
            for d in np.unique(dims):
                yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([ids[dims == d].tobytes()]), pa.array([b"".join(raw[dims == d])])], ["dims", "ids", "block"])

    shape = "dims int, ids binary, block binary"
    blocks = named.select(F.col("vec_id").cast("long"), "dims", "vector").mapInArrow(blocked, shape)
    queries = named.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long"), "dims", "vector").mapInArrow(blocked, shape).toDF("dims", "q_ids", "q_block")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block, q_ids, q_block in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "block", "q_ids", "q_block")), strict=True):
                a, q = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                x, y = np.frombuffer(block).reshape(len(a), -1), np.frombuffer(q_block).reshape(len(q), -1)
                hits = ((y @ x.T >= LEAST) & (q[:, None] != a[None])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(hits.astype(np.int64))], ["vec_id", "true_links"])

    true = blocks.join(queries, "dims").mapInArrow(counted, "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("true_links"))
    sums = true.join(result, "vec_id").agg(F.sum(F.least("n_links", "true_links")).alias("got"), F.sum("true_links").alias("all")).first()
    return 1.0 if not sums["all"] else sums["got"] / sums["all"]
