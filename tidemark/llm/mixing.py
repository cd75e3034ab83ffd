"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight: good documents
tend to come first. Its source's target is served by complete epochs of the source and
then by the documents that come first, in the order of their keys, up to the words that
are left. The last of them is taken if more than half of it fits, which leaves each source
within half a document of its target.

Keys are cut into fine steps of their logarithm. The sizes of a source's earlier steps are
summed from a table of steps, the sizes before a document inside its step by a window over
that step. No task sees more of a source than one step, however many rows the source holds.

The key is a hash of seed and id, so reruns agree. Results for odd input: null and empty
texts have size 0 and none of their words are taken; a null source is a source of its own,
the last; a null id is drawn for like any other; rows that repeat an id have equal keys and
are taken in the order of their size.
Texts are counted whole, however long; an empty table gives an empty result; other
columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Steps of the key per doubling. At this many a step holds about 0.1 % of a source.
STEPS = 256


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(size: Column, text: str = "text") -> Column:
    """Near 1 for plain words, less the more markup symbols stand among them."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(F.col(text), SYMBOLS, "")), F.lit(0))
    return F.when(size > 0, size / (size + symbols)).otherwise(F.lit(1.0))


def ranked(frame: DataFrame, order: Column, name: str) -> DataFrame:
    """Number all rows from 0 in the order of a column, without bringing them into one task."""
    placed = saved(
        frame.withColumn("_order", order).repartitionByRange(F.col("_order")).withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    return (
        placed.withColumn("_rank", inside)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_part", "_order", "_rank", "_offset")
    )


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to ``source`` and ``source_size``.

    Sources share the sum of all sizes by weight. A target above ``most_epochs`` times its
    source's size stops there and the rest is shared again, until none is above. The share
    of a unit of weight only rises, so every round adds sources that stop.
    """
    # Null comes last: the first part of the order is 0 for every other source.
    order = F.struct(F.col("source").isNull().cast("int"), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    listed = saved(
        ranked(sources, order, "rank").select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * most_epochs).alias("most")
        ),
        "sources",
    )
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        stopped = F.lit(share) * F.col("weight") > F.col("most")
        taken, open_weight = listed.agg(
            F.coalesce(F.sum(F.when(stopped, F.col("most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)),
        ).first()
        following = (total - taken) / open_weight if open_weight else share
        if following == share:
            break
        share = following
    target = F.least(F.lit(share) * F.col("weight"), F.col("most").cast("double"))
    return listed.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    quality: Column | None = None,
    seed: int = 42,
    steps: int = STEPS,
) -> DataFrame:
    """How often each row of ``docs`` is taken.

    ``docs`` has ``doc_id``, ``source`` and ``text``. ``quality`` is a positive weight over
    its columns.
    """
    size = word_count()
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    draw = (F.conv(F.substring(code, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    keys = docs.select(
        "doc_id",
        "source",
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"),
        size.alias("size"),
        (-F.ln(draw) / (quality_weight(size) if quality is None else quality)).alias("key"),
    ).withColumn("step", F.floor(F.log2("key") * steps))
    keys = saved(keys, "keys")
    by_step = saved(keys.groupBy("source", "step").agg(F.sum("size").alias("step_size")), "steps")
    goal = targets(
        by_step.groupBy("source").agg(F.sum("step_size").alias("source_size")), weights, most_epochs
    )
    earlier = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = by_step.withColumn("step_before", F.coalesce(F.sum("step_size").over(earlier), F.lit(0)))
    plan = before.join(goal, before["source"].eqNullSafe(goal["source"])).select(
        before["source"].alias("plan_source"), F.col("step").alias("plan_step"), "step_before", "source_size", "target"
    )
    inside = (
        Window.partitionBy("source", "step").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keys.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("step") == F.col("plan_step"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    first = 2 * (F.col("step_before") + F.col("before")) + F.col("size") <= 2 * left
    return (
        placed.join(plan, same)
        .withColumn("epochs", epochs)
        .withColumn("copies", F.col("epochs") + F.when(first, 1).otherwise(0))
        .select(
            "doc_id",
            "source",
            "digest",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("copies")).alias("taken"),
            "copies",
        )
    )
