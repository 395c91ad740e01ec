"""Mixing sources to target weights.

Rows get a hash-random key. Each source is dealt out by ranges of that key (two bytes, so the ranges are even for any
source, however large), sorted by it inside a range, and prefix sums of the sizes come from three levels: ranges of
the first byte, ranges of the second, rows. A source whose target is b words takes floor(b / its words) whole passes
and then its rows in key order until the rest is used up; the row at the cut gives only the words that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights of the sources by code point order, repeating; a source's target is at most so many times its size.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(doc_id: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 16)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target): shares by weight, levelled where a source would be above
    `most` times its size. The level is level_k = (total - what the k first capped sources get) / (weights of the
    others), sources in ascending order of most * size / weight; k is the number of sources that stay below it."""
    everything = Window.partitionBy(F.lit(0))
    rank = Window.partitionBy(F.lit(0)).orderBy("skey")
    given = F.array(*map(F.lit, weights))
    s = sizes.withColumn("w", F.get(given, ((F.row_number().over(rank) - 1) % len(weights)).cast("int")).cast("long"))
    up = everything.orderBy((F.col("source_size") * most / F.col("w")).asc(), "skey")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("capped", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))).withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("used")))
    s = s.withColumn("fits", F.col("source_size") * most <= F.col("level") * F.col("w"))
    s = s.withColumn("first_open", F.min(F.when(~F.col("fits"), F.col("used"))).over(everything))
    s = s.withColumn("cut", F.max(F.when(F.col("used") == F.col("first_open"), F.col("level"))).over(everything))
    target = F.when(F.col("cut").isNull() | (F.col("used") < F.col("first_open")), (F.col("source_size") * most).cast("double")).otherwise(F.col("cut") * F.col("w"))
    return s.select("skey", "source_size", target.alias("target"))


def plan(docs: DataFrame, sizes: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, keep: tuple[str, ...] = ("doc_id",), narrow: bool = True) -> DataFrame:
    """The rows of `docs` with size, source_size, target, passes (whole passes over the row), rest (words of the last,
    cut pass) and taken = passes * size + rest. Only the columns in `keep` go with them through the shuffles.

    Null texts have size 0 and take nothing; a null source comes last in the order of sources and is a source of its
    own; rows alike in every way share a key and are interchangeable; an empty table gives an empty result.
    """
    size = words(F.col("text")) if sizes is None else sizes
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = docs.select(*keep, size.alias("size"), source.alias("skey"), hash_key(F.col("doc_id")).alias("key"), F.col("doc_id").alias("_tie"))
    rows = rows.withColumns({"b1": F.substring("key", 1, 2), "b2": F.substring("key", 3, 2)})
    if narrow:  # else the sizes are counted twice, which costs less than keeping whole texts
        rows = cut(rows)
    sums = rows.groupBy("skey", "b1", "b2").agg(F.sum("size").alias("n2"))
    firsts = sums.groupBy("skey", "b1").agg(F.sum("n2").alias("n1"))
    t = targets(firsts.groupBy("skey").agg(F.sum("n1").alias("source_size")), weights, most)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("p1", F.coalesce(F.sum("n1").over(before(Window.partitionBy("skey").orderBy("b1"))), F.lit(0)))
    seconds = sums.withColumn("p2", F.coalesce(F.sum("n2").over(before(Window.partitionBy("skey", "b1").orderBy("b2"))), F.lit(0)))
    ahead = seconds.join(firsts, ["skey", "b1"]).join(t, "skey").select("skey", "b1", "b2", (F.col("p1") + F.col("p2")).alias("p"), "source_size", "target")
    inside = F.coalesce(F.sum("size").over(before(Window.partitionBy("skey", "b1", "b2").orderBy("key", "_tie", "size"))), F.lit(0))
    rows = rows.withColumn("inside", inside).join(ahead, ["skey", "b1", "b2"])
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - passes * F.col("source_size") - F.col("p") - F.col("inside")))
    rows = rows.withColumns({"passes": passes}).withColumns({"rest": rest})
    return rows.select(*keep, "size", "source_size", "target", "passes", "rest", (F.col("passes") * F.col("size") + F.col("rest")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """The mixed documents themselves: `docs` with each row repeated as often as it is taken, and the row at a source's
    cut given once more with the words that are left (its own white space between them stays). Rows without words are
    in no source's budget; they come once for each whole pass."""
    inner = docs.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))  # columns of other names are in _row alone
    planned = plan(inner, weights=weights, most=most, keep=("_row",), narrow=False)
    whole = F.array_repeat("_row.text", F.col("passes").cast("int"))
    word_ends = F.split("_row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.when(F.col("rest") == F.col("size"), F.col("_row.text")).otherwise(F.array_join(F.slice(word_ends, 1, F.col("rest").cast("int")), ""))
    texts = F.when(F.col("rest") > 0, F.concat(whole, F.array(head))).otherwise(whole)
    out = planned.select("_row", F.explode(texts).alias("_text"))
    columns = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
