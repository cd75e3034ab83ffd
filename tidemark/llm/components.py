"""Connected components by alternating star contractions.

Edges are pointed at ever smaller neighbours until each node points at its component's
smallest node: the large step points a node's larger neighbours at its smallest, the small
step does so with its smaller ones. The number of rounds grows with the logarithm of the
longest path. Each round is written, so that no lineage builds up and an executor can be
lost at any time. A node with very many neighbours is joined straight from shuffles of
written tables, where adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import saved


def _least(edges: DataFrame, rows: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return saved(least.select("u", F.least("m", "u").alias("m")), "least", rows)


def _round(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both, rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = saved(large.distinct(), "large", rows)
    joined = large.join(_least(large, rows), "u")
    small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return saved(small.unionByName(joined.select("u", F.col("m").alias("v"))).distinct(), "small", rows)


def _finished(edges: DataFrame) -> bool:
    """Whether every node points once, at one that points nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("root")).unionAll(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("root").alias("root"))
    return nodes.where((F.col("points") > 1) | (F.col("points") + F.col("root") > 1)).isEmpty()


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in the pairs ``a``, ``b``."""
    ends = pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # No round has more than two rows for each edge, and the components one for each end.
    rows = 2 * pairs.count()
    edges = saved(ends.distinct(), "edges", rows)
    while not _finished(edges):
        edges = _round(edges, rows)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return saved(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components", rows)
