"""Joins and numbering that keep a hot key from ending up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import below, draw


def join_hot_keys(
    facts: DataFrame, lookup: DataFrame, on: str, spread_by: str, partitions: int | None = None
) -> DataFrame:
    """Inner join that spreads the rows of a hot key over several shuffle keys.

    Adaptive execution splits skewed join partitions by itself when both sides come
    straight from a shuffle. This is for joins where one side is an aggregate, which it
    leaves alone. A key is hot when it holds more rows than one of ``partitions`` shuffle
    partitions should; its rows are spread by ``spread_by``, a column that differs among
    them, over as many shuffle keys as it would fill partitions, and its lookup rows are
    copied to each. There are fewer hot keys than partitions, which bounds the broadcast,
    and with a unique lookup key fewer than two copies per partition.
    """
    if partitions is None:
        partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = facts.groupBy(on).agg((F.count(F.lit(1)) * partitions).alias("_rows"))
    total = facts.select(F.count(F.lit(1))).scalar()
    hot = counts.where(F.col("_rows") > total).select(on, F.ceil(F.col("_rows") / total).alias("_splits"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_splits")), F.lit(0).cast("bigint"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_splits", F.lit(1).cast("bigint")) - 1)
    salted_facts = facts.join(F.broadcast(hot), on, "left").withColumn("_salt", salt)
    salted_lookup = lookup.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(salts))
    return salted_facts.drop("_splits").join(salted_lookup.drop("_splits"), [on, "_salt"]).drop("_salt")


def number_within(frame: DataFrame, group: str, key: str, name: str, blocks: int = 1009) -> DataFrame:
    """Number the rows of each group from 0, in the order of (block, key).

    The key's hash puts a row into one of the group's blocks. Rows are ranked inside their
    block, and the ranks are then shifted by the sizes of the group's earlier blocks. No
    task sees more of a group than one block of it, or its block sizes. ``key`` must be
    unique in its group.
    """
    blocked = frame.withColumn("_block", F.expr(below(draw(0, "block", f"`{key}`"), blocks)))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(group, "_block")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(group, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy(group, "_block").orderBy(key))
    return (
        blocked.withColumn("_rank", rank)
        .join(offsets, [group, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_block", "_rank", "_offset")
    )
