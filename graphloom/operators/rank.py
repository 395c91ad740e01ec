"""Lexical ranking, fusion and layout probes over concepts, for whole batches of queries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.shared import BROADCAST_IDS, at_few, cut, written
from . import embed
from .neighbours import Neighbours, fetch

#: BM25 parameters and fusion weights.
K1, B = 1.5, 0.75
DENSE_SHARE, LEXICAL_SHARE = 0.58, 0.42


def postings(items: DataFrame, group: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """(node_id, term, tf, dl) of `items` (node_id, body); dl counts all content tokens. With `only` (term), other terms do
    not leave their items."""
    group = group or []
    words = items.select(*group, "node_id", text.tokens(F.col("body")).alias("words")).select(*group, "node_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if only is not None:
        words = words.join(only.select("term").distinct(), "term", "left_semi")
    return words.groupBy(*group, "node_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): a term that a query repeats adds as often."""
    return queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def few_terms(terms: DataFrame) -> bool:
    """Whether the terms of the queries are so few that they, and the counts of each, are broadcast."""
    return terms.count() <= BROADCAST_IDS


#: A term that no text has: the row of a postings pass that only counts its item.
ITEM = ""


def bm25(items: DataFrame, queries: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(query_id, node_id, score) of the items that share a term with a query. With `group`, the statistics are those of
    the item's group (whose columns `items` has).

    Texts are cut into tokens once: each item leaves its tokens that some query has, and one row that counts it."""
    group = group or []
    terms = query_terms(queries)
    asked = terms.select("term").distinct()
    words = items.select(*group, "node_id", F.coalesce(text.tokens(F.col("body")), F.array().cast("array<string>")).alias("words"))
    each = words.select(*group, "node_id", F.size("words").alias("dl"), F.explode(F.concat("words", F.array(F.lit(ITEM)))).alias("term"))
    wanted = asked.union(asked.sparkSession.createDataFrame([(ITEM,)], "term string"))
    kept = each.join(F.broadcast(wanted) if few_terms(terms) else wanted, "term", "left_semi")
    lists = written(kept.groupBy(*group, "node_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")), "lists")
    sizes = lists.where(F.col("term") == ITEM).groupBy(*group).agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    return bm25_of(lists.where(F.col("term") != ITEM), sizes, terms, group)


def bm25_of(lists: DataFrame, sizes: DataFrame, terms: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The same from stored postings, the number and mean length of items (n, avgdl; one row without groups), and the terms
    of the queries. Postings are dealt by item, so that the scores of an item with all queries are added up where they
    arise."""
    group = group or []
    small = F.broadcast if few_terms(terms) else (lambda rows: rows)
    # only the lists of terms that some query has go further
    asked = lists.join(small(terms.select("term").distinct()), "term", "left_semi")
    counts = asked.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df"))
    asked = asked.repartition("node_id").join(counts if group else small(counts), [*group, "term"])
    asked = asked.join(sizes, group) if group else asked.crossJoin(F.broadcast(sizes))  # one row without groups
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1e-9))))
    weighted = asked.withColumn("part", part)
    return weighted.join(small(terms), "term").groupBy("query_id", *group, "node_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def top(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The first k rows of each query by score, ties by node_id, with their rank. Scores are compared at 9 decimals, so
    that the order of summation does not matter."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc(F.round("score", 9)), "node_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scaled(score: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def fused(queries: DataFrame, items: DataFrame, lexical: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, node_id, score): dense and lexical scores, each scaled to [0, 1] over all items of the query, added by
    their shares. An item that no term of the query finds has a lexical score of 0 before scaling, so 0 is the low end
    unless every item is found.

    `queries` is (query_id, embedding), `items` is (node_id, embedding), `lexical` has all BM25 scores. Rows are made only for
    items that can be among the first k: the k + 1 nearest ones, the best ones by BM25, and of the others those whose BM25
    score is so good that they would be among the first k if they lay as near as the nearest one which is left."""
    near = cut(embed.topk(queries, items, k + 1))
    ends = near.groupBy("query_id").agg(F.max("score").alias("d_high"), F.max("low").alias("d_low"), F.min("score").alias("d_next"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    lexical = cut(lexical)
    found = lexical.groupBy("query_id").agg(F.min("score").alias("least"), F.max("score").alias("l_high"), F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(n))  # one row
    found = found.select("query_id", F.when(F.col("hits") == F.col("n"), F.col("least")).otherwise(F.least(F.lit(0.0), "least")).alias("l_low"), F.greatest(F.lit(0.0), "l_high").alias("l_high"))
    known = cut(ends.join(found, "query_id", "left").select("query_id", "d_high", "d_low", "d_next", F.coalesce("l_low", F.lit(0.0)).alias("l_low"), F.coalesce("l_high", F.lit(0.0)).alias("l_high")))
    lex, dense = scaled(F.col("l"), F.col("l_low"), F.col("l_high")), lambda d: scaled(F.col(d), F.col("d_low"), F.col("d_high"))
    whole = (DENSE_SHARE * dense("d") + LEXICAL_SHARE * lex).alias("score")

    def measured(hits: DataFrame) -> DataFrame:
        """(query_id, node_id, score) of hits (query_id, node_id, l): their vectors alone are joined."""
        vectors = items.join(hits.select("node_id").distinct(), "node_id", "left_semi").withColumnRenamed("embedding", "e")
        met = hits.join(queries.withColumnRenamed("embedding", "q"), "query_id").join(vectors, "node_id").select("query_id", "node_id", "l", geometry.dot(F.col("q"), F.col("e")).alias("d"))
        return met.join(known, "query_id").select("query_id", "node_id", whole)

    best = top(lexical, 4 * k).drop("rank").withColumnRenamed("score", "l")
    close = near.select("query_id", "node_id", F.col("score").alias("d")).join(lexical.withColumnRenamed("score", "l"), ["query_id", "node_id"], "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    close = close.join(known, "query_id").select("query_id", "node_id", whole)
    first = cut(close.union(measured(best.join(near.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"))))
    least = top(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    rest = lexical.withColumnRenamed("score", "l").join(first.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").join(known, "query_id").join(least, "query_id", "left")
    able = F.col("reached").isNull() | (DENSE_SHARE * dense("d_next") + LEXICAL_SHARE * lex >= F.col("reached") - 1e-6)
    return first.union(measured(cut(rest.where(able).select("query_id", "node_id", "l"))))


#: Nodes and queries of a block of the layout probe, and how far two scores of one rounded value can lie apart.
PROBE_NODES, PROBE_QUERIES, ROUNDED = 2048, 256, 3e-9
PROBED = "query_id string, node_id string, s_theta double, s_phi double, theta double, phi double"


def _rough(kind: str, queries: list[tuple], ids: list[str], theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The scores of a block of queries (query_id, theta, phi) and nodes, up to rounding; -inf where a place is missing."""
    if kind == "random":
        raw = [x.encode() for x in ids]
        digits = b"".join(hashlib.sha1(head + x).digest()[:4] for q in queries if (head := f"{q[0]}:".encode()) for x in raw)
        return np.frombuffer(digits, ">u4").reshape(len(queries), -1) / 4294967295.0
    gaps = [np.array([q[i] for q in queries], float)[:, None] - x for i, x in ((1, theta), (2, phi))]
    if kind == "torus":
        gaps = [np.mod(g + np.pi, geometry.TURN) - np.pi for g in gaps]
    return np.nan_to_num(-np.sqrt(gaps[0] ** 2 + gaps[1] ** 2), nan=-np.inf)


def _leading(found: list[tuple], k: int) -> list[tuple]:
    """Of (score, node_id, ...) those that can be among the first k by rounded score and id: all within ROUNDED of the k-th,
    of one score the first k ids."""
    found.sort(key=lambda x: (-x[0], x[1]))
    if len(found) <= k:
        return found
    least, out, same = found[k - 1][0] - ROUNDED, [], 0
    for x in found:
        same = same + 1 if out and x[0] == out[-1][0] else 0
        if x[0] < least:
            break
        if same < k:
            out.append(x)
    return out


def layout_probe(queries: DataFrame, nodes: DataFrame, kind: str, k: int = 5) -> DataFrame:
    """(query_id, node_id, score, rank): nodes by nearness to the query's seed on the torus ("torus"), without wrapping
    ("euclidean"), or by a hash ("random"). `queries` is (query_id, seed_id), `nodes` is (node_id, theta, phi).

    A stated set of queries meets all nodes in blocks. A task keeps what can be among the first k of each query, so the
    pairs are neither sorted nor shuffled; those few are then scored exactly."""
    nodes = nodes.select(F.col("node_id").cast("string").alias("node_id"), F.col("theta").cast("double").alias("theta"), F.col("phi").cast("double").alias("phi"))
    seeds = queries.join(nodes.select(F.col("node_id").alias("seed_id"), F.col("theta").alias("s_theta"), F.col("phi").alias("s_phi")), "seed_id").select(F.col("query_id").cast("string").alias("query_id"), "s_theta", "s_phi")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[tuple]] = {}
        for batch in batches:
            for q_ids, s_theta, s_phi, ids, theta, phi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = list(zip(q_ids, s_theta, s_phi, strict=True))
                t, p = (np.array([np.nan if x is None else x for x in c], float) for c in (theta, phi))
                score = _rough(kind, asked, ids, t, p)
                n = score.shape[1]
                least = np.partition(score, n - k, 1)[:, n - k] if n > k else np.full(len(asked), -np.inf)
                for i, q in enumerate(asked):
                    own = kept.get(q, [])
                    at = np.flatnonzero(score[i] >= max(least[i], own[k - 1][0] if len(own) >= k else -np.inf) - ROUNDED)
                    if len(at):
                        kept[q] = _leading(own + [(float(score[i, j]), ids[j], theta[j], phi[j]) for j in at.tolist()], k)
        rows = ((q, node, a, b, t, p) for (q, a, b), own in kept.items() for _, node, t, p in own)
        while some := list(islice(rows, 16384)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.float64()) for i, c in enumerate(zip(*some, strict=True))], ["query_id", "node_id", "s_theta", "s_phi", "theta", "phi"])

    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    met = cut(_listed(nodes, PROBE_NODES).repartition(tasks)).crossJoin(cut(_listed(seeds, PROBE_QUERIES)))
    found = met.select("query_id", "s_theta", "s_phi", "node_id", "theta", "phi").mapInArrow(best, PROBED)
    place = (F.col("s_theta"), F.col("s_phi"), F.col("theta"), F.col("phi"))
    score: Column = {"torus": 0.0 - geometry.torus_distance(*place), "euclidean": 0.0 - geometry.flat_distance(*place), "random": geometry.random_score(F.col("query_id"), F.col("node_id"))}[kind]
    return top(found.select("query_id", "node_id", score.alias("score")), k)


def _listed(rows: DataFrame, size: int) -> DataFrame:
    """`rows` with lists of up to `size` values of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), size):
                part = batch.slice(low, size)
                yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns], part.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{n} array<{t}>" for n, t in rows.dtypes))


def communities(items: DataFrame, queries: DataFrame, k: int = 5, most: int = 2) -> DataFrame:
    """(query_id, domain, node_id, score, rank): the two domains that share most terms with the query (plus their share of
    all items), then the items of each by BM25 with the domain's own statistics."""
    terms = items.select("domain", F.explode(text.token_set(F.col("body"))).alias("term")).distinct()
    hits = query_terms(queries).join(terms, "term").groupBy("query_id", "domain").agg(F.count(F.lit(1)).alias("shared"))
    sizes = items.groupBy("domain").agg(F.count(F.lit(1)).alias("items"))
    share = F.col("items") / F.sum("items").over(Window.partitionBy(F.lit(0)))  # as many rows as domains
    scored = hits.join(sizes.withColumn("share", share), "domain").withColumn("score", F.col("shared") + F.col("share")).withColumn("node_id", F.col("domain"))
    best = top(scored, most).select("query_id", "domain")
    ranked = bm25(items, queries, ["domain"]).join(best, ["query_id", "domain"])
    return top(ranked, k)


def rerank(items: DataFrame, queries: DataFrame, dense: DataFrame, lexical: DataFrame, edges: DataFrame, k: int = 5, near: Neighbours | None = None) -> DataFrame:
    """(query_id, node_id, score, rank): dense and lexical seeds with their four best neighbours, each node by dense,
    lexical, shared terms and evidence, neighbours with a bonus for the edge.

    `items` is (node_id, body, evidence), `dense` has the twelve best nodes of a query, `lexical` all BM25 scores. With
    `near`, the edges of the seeds are looked up there instead of in `edges`. Only candidates' texts are read."""
    per_query = Window.partitionBy("query_id")
    d = dense.withColumn("dense", geometry.min_max(F.col("score"), per_query)).select("query_id", "node_id", "dense", "rank")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    ends = lexical.groupBy("query_id").agg(F.min("score").alias("least"), F.max("score").alias("high"), F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(n))  # one row
    ends = ends.withColumn("low", F.when(F.col("hits") == F.col("n"), F.col("least")).otherwise(F.lit(0.0)))
    ends = cut(ends.select("query_id", "low", "high"))
    seeds = d.where("rank <= 8").select("query_id", "node_id").union(top(lexical.where("score > 0"), 8).select("query_id", "node_id")).distinct()
    asked = queries.select("query_id", text.token_set(F.col("query")).alias("terms"))
    seeds = cut(seeds)
    if near is None:
        both = edges.select("source", "target", "edge_type", "weight").union(edges.select("target", "source", "edge_type", "weight"))
        both = at_few(both, "source", seeds)
        both = cut(both.join(seeds.select(F.col("node_id").alias("source")).distinct(), "source", "left_semi"))
        there = at_few(items, "node_id", both, "target")
        both = both.join(there.select(F.col("node_id").alias("target"), text.token_set(F.col("body")).alias("tokens")), "target")
    else:
        both = near.around(seeds).where("there").select(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", "weight", "tokens")
    around = seeds.withColumnRenamed("node_id", "source").join(both, "source").join(asked, "query_id")
    portal = F.col("edge_type") == "portal"
    order = F.col("weight") + F.when(portal, 0.20).otherwise(0.05) + F.size(F.array_intersect("terms", "tokens"))
    w = Window.partitionBy("query_id", "source").orderBy(F.desc(F.round(order, 9)), "target", "edge_type")
    near = around.withColumn("_n", F.row_number().over(w)).where("_n <= 4").select("query_id", F.col("target").alias("node_id"), (F.col("weight") * 0.10 + F.when(portal, 0.18).otherwise(0.10)).alias("bonus"))
    candidates = seeds.withColumn("bonus", F.lit(0.0)).unionByName(near).groupBy("query_id", "node_id").agg(F.max("bonus").alias("bonus"))
    candidates = cut(candidates)
    pairs = candidates.select("query_id", "node_id")
    scores = lexical.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs, ["query_id", "node_id"], "left_semi")
    lex = scores.join(ends, "query_id").select("query_id", "node_id", scaled(F.col("score"), F.col("low"), F.col("high")).alias("lexical"))
    known = fetch(items, "node_id", candidates).select("node_id", text.token_set(F.col("body")).alias("tokens"), text.token_set(F.col("evidence")).alias("proof"))
    full = candidates.join(d, ["query_id", "node_id"], "left").join(lex, ["query_id", "node_id"], "left").join(asked, "query_id").join(known, "node_id")
    n = F.greatest(F.lit(1), F.size("terms"))
    share = lambda c: F.size(F.array_intersect("terms", c)) / n
    score = 0.36 * F.coalesce("dense", F.lit(0.0)) + 0.34 * F.coalesce("lexical", F.lit(0.0)) + 0.20 * share("tokens") + 0.10 * share("proof") + F.col("bonus")
    return top(full.select("query_id", "node_id", score.alias("score")), k)
