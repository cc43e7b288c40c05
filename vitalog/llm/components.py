"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sized_join import join_group_rows
from .common import written


def _with_least(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v) with the least of u and its neighbours.

    The hub of a large component may have a third of all edges: small tables of least neighbours are broadcast once they are
    counted, larger ones meet the edges under salted keys.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_group_rows(edges, least, ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(links: DataFrame, label: str = "links") -> DataFrame:
    """Map every linked node to the least node of its component.

    ``links`` has the columns u and v of one orderable type; direction, repeats and loops don't matter, null ends are
    dropped. Returns (node, root) for the nodes that aren't their own root. Every round is written to the
    shared folder; rounds are logarithmic in the longest path in practice. An empty table gives an empty result.
    """
    edges = written(links.select("u", "v").filter("u <> v").distinct(), label)
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), label)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
