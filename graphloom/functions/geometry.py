"""Torus geometry, shards, edge weights and score scaling as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

TURN = 2 * math.pi
#: Base weight of an edge by its type.
BASE_WEIGHT = {"portal": 0.66, "supports": 0.64, "depends_on": 0.62, "related_to": 0.52, "adjacent_to": 0.58}


def angular_delta(left: Column, right: Column) -> Column:
    """The signed angle between two angles, in [-pi, pi)."""
    return F.pmod(left - right + F.lit(math.pi), F.lit(TURN)) - F.lit(math.pi)


def torus_distance(theta: Column, phi: Column, other_theta: Column, other_phi: Column) -> Column:
    a, b = angular_delta(theta, other_theta), angular_delta(phi, other_phi)
    return F.sqrt(a * a + b * b)


def flat_distance(theta: Column, phi: Column, other_theta: Column, other_phi: Column) -> Column:
    a, b = theta - other_theta, phi - other_phi
    return F.sqrt(a * a + b * b)


def random_score(query_id: Column, node_id: Column) -> Column:
    return F.conv(F.substring(F.sha1(F.concat_ws(":", query_id, node_id)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def shard_cell(angle: Column, cells: int) -> Column:
    """The cell of an angle on a circle of equal cells; 0 without an angle."""
    cell = F.floor(F.pmod(angle, F.lit(TURN)) / F.lit(TURN) * cells).cast("int")
    return F.when(angle.isNull(), 0).otherwise(F.least(F.lit(cells - 1), cell))


def shard_id(theta: Column, phi: Column, rows: int = 4, columns: int = 4) -> Column:
    if rows < 1 or columns < 1:
        raise ValueError("a torus needs one row and one column at least")
    return F.concat_ws(":", F.lit("shard"), shard_cell(phi, rows).cast("string"), shard_cell(theta, columns).cast("string"))


def edge_weight(edge_type: Column, shared: Column, phrase: Column) -> Column:
    return weight_of(edge_type, shared, F.size(F.split(phrase, " ")))


def weight_of(edge_type: Column, shared: Column, words: Column) -> Column:
    """The weight of an edge by its type, its shared terms and the words of its phrase."""
    base = F.lit(0.50)
    for kind, weight in BASE_WEIGHT.items():
        base = F.when(edge_type == kind, F.lit(weight)).otherwise(base)
    specific = F.least(F.lit(0.12), words * F.lit(0.03))
    return F.least(F.lit(0.92), base + specific + F.least(F.lit(0.14), shared * F.lit(0.02)))


def llm_edge_weight(confidence: Column) -> Column:
    return F.least(F.lit(0.94), F.lit(0.52) + F.lit(0.38) * confidence)


def min_max(score: Column, over: WindowSpec) -> Column:
    """A score scaled to [0, 1] within its group; 1 where all are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def unit(vector: Column) -> Column:
    """A vector by its length; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)


def proportion_low_high(rate: Column, count: Column) -> tuple[Column, Column]:
    """The normal 95 % interval of a share, kept in [0, 1]."""
    width = F.when(count > 0, F.lit(1.96) * F.sqrt(rate * (1 - rate) / count)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), rate - width), F.least(F.lit(1.0), rate + width)
