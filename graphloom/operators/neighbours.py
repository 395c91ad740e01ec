"""Edges around nodes: how a search gets the few rows that it asks for.

`Clustered` reads tables that are sorted by the id they are asked by, with the ends' terms and places beside each edge, so
that a round of a search is one look-up: the ids go to the scan as literals, and only the pages of a file that can hold one of
them are read. `Joined` does the same over any two tables by joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import at_few
from . import graph

#: Ids that go to a scan as literals at most, beyond which they are joined; and the session's setting up to which the Parquet
#: reader takes a list of ids one by one (it takes longer ones only as a range).
LITERALS, SETTING = 1000, "spark.sql.parquet.pushdown.inFilterThreshold"
#: Rows of a page and bytes of a row group of tables that are read by ids.
PAGE_ROWS, GROUP_BYTES = 1024, 16 << 20


#: Ids as a table (node_id), or as a list that `few` has made of one.
Ids = DataFrame | list[str]


def few(ids: DataFrame, column: str = "node_id", most: int = LITERALS) -> Ids:
    """The different ids as a list if there are at most `most` of them, else the table: so that several look-ups of the same
    ids collect them once."""
    known = [r[0] for r in ids.select(column).distinct().limit(most + 1).collect()]
    return sorted(k for k in known if k is not None) if len(known) <= most else ids


class Neighbours(Protocol):
    """What a search asks for."""

    def around(self, ids: Ids, local_only: bool = False) -> DataFrame:
        """The edges at the nodes `ids`, from that side, with their ends: as `graph.with_ends` has them."""

    def bodies(self, ids: Ids) -> DataFrame:
        """(id, tokens, theta, phi) of the nodes `ids`."""


def fetch(table: DataFrame, key: str, ids: Ids, column: str = "node_id", most: int = LITERALS) -> DataFrame:
    """The rows of `table` whose `key` is among `ids`. Up to `most` different ids are pushed to the scan; for more, a join
    that reads the table once is the shorter way. Both give the same rows. The session's SETTING is raised to LITERALS."""
    ids = few(ids, column, most) if isinstance(ids, DataFrame) else ids
    return _only(table, key, ids, column)


def _only(table: DataFrame, key: str, ids: Ids, column: str = "node_id") -> DataFrame:
    if isinstance(ids, DataFrame):
        kept = at_few(table, key, ids, column)
        return table.join(ids.select(F.col(column).alias(key)).distinct(), key, "left_semi") if kept is table else kept
    spark = table.sparkSession
    if int(spark.conf.get(SETTING)) < LITERALS:
        spark.conf.set(SETTING, LITERALS)
    return table.where(F.col(key).isin(ids))


def store(rows: DataFrame, path: str, *order: str) -> None:
    """Write a table that is read by the first column of `order`: in ranges of that order, with small pages."""
    sized = rows.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    sized.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", GROUP_BYTES).parquet(path)


@dataclass(frozen=True)
class Joined:
    """Neighbours in tables of any order."""

    nodes: DataFrame
    edges: DataFrame

    def around(self, ids: Ids, local_only: bool = False) -> DataFrame:
        return graph.with_ends(_only(graph.adjacency(self.edges, local_only), "src", ids), self.nodes)

    def bodies(self, ids: Ids) -> DataFrame:
        some = _only(self.nodes, "id", ids)
        return some.select("id", graph.node_tokens(some).alias("tokens"), "theta", "phi")


@dataclass(frozen=True)
class Clustered:
    """Neighbours in the two tables that `written` makes."""

    nodes: DataFrame
    edges: DataFrame

    def around(self, ids: Ids, local_only: bool = False) -> DataFrame:
        kept = self.edges.where("edge_type <> 'portal'") if local_only else self.edges
        return fetch(kept, "src", ids)

    def bodies(self, ids: Ids) -> DataFrame:
        return fetch(self.nodes, "id", ids).select("id", "tokens", "theta", "phi")


def written(nodes: DataFrame, edges: DataFrame, path: str) -> Clustered:
    """Store every edge from both of its ends below `path`/around, by node, and the nodes below `path`/nodes, by id."""
    spark = nodes.sparkSession
    store(nodes, f"{path}/nodes", "id")
    nodes = spark.read.parquet(f"{path}/nodes")
    store(graph.with_ends(graph.adjacency(edges), nodes), f"{path}/around", "src", "dst")
    return Clustered(nodes, spark.read.parquet(f"{path}/around"))
