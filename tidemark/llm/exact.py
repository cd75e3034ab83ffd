"""Exact dedup by deterministic block naming.

Each text is cut into blocks of ``block_bytes``. The distinct blocks are sorted and
numbered; the number is the block's name. Neighbouring names are then paired, the distinct
pairs are sorted and numbered again, and so on until one name is left of every text.
Texts are equal exactly if they have as many blocks and the same last name: names come
from the blocks themselves, so no two texts share one by a hash collision.

A block's rows find their name by a 64-bit fingerprint, which moves 8 bytes a row instead
of the block. The table of distinct blocks shows which fingerprints stand for more than one
block; rows with such a fingerprint are joined by the block itself.

Distinct blocks and pairs are combined before the shuffle, so a text that a third of all
rows repeat arrives once from each task. The joins take both sides straight from a
shuffle, where adaptive execution splits a name that many rows share.

Results for odd input: null counts as the empty text. A null id is smaller than every
other. Of rows that repeat id and text exactly one stays.
Texts are read whole, a very long one as many blocks; an empty table gives an empty
result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import saved

BLOCK_BYTES = 4096


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Name each distinct row by its place in the sorted partitions; written, so that names stay as they are."""
    named = distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())
    return saved(named, "block-names")


def _blocks(docs: DataFrame, block_bytes: int, fingerprint) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    last = F.greatest(F.floor((F.octet_length(data) - 1) / block_bytes).cast("int"), F.lit(0))
    return (
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.sha2(data, 256).alias("digest"),
            F.transform(
                F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block_bytes + 1, block_bytes)
            ).alias("blocks"),
        )
        .select("row_id", "doc_id", "digest", F.size("blocks").alias("n"), F.posexplode("blocks").alias("i", "block"))
        .withColumn("print", fingerprint(F.col("block")))
    )


def _name_blocks(docs: DataFrame, block_bytes: int, fingerprint) -> DataFrame:
    """``row_id``, ``doc_id``, ``digest``, ``n``, ``i``, ``name``: the named blocks of each text.

    Row ids are given out by one scan and written with the names, so that it does not matter
    how later scans are split.
    """
    blocks = _blocks(docs, block_bytes, fingerprint)
    names = _numbered(blocks.select("print", "block").distinct(), ["block"])
    by_print = names.groupBy("print").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("same"))
    found = blocks.drop("block").join(saved(by_print, "block-prints"), "print")
    found = saved(found.withColumn("name", F.when(F.col("same") == 1, F.col("name"))).drop("same"), "blocks")
    if found.where("name IS NULL").isEmpty():
        return found.drop("print")
    # A fingerprint stands for several blocks: these rows find their names by the blocks.
    place = ["digest", "i"]
    shared = found.where("name IS NULL").drop("name")
    content = blocks.join(shared.select(place).distinct(), place, "left_semi").select(*place, "block").distinct()
    clear = shared.join(content, place).join(names, ["print", "block"]).drop("block")
    return saved(found.where("name IS NOT NULL").unionByName(clear).drop("print"), "blocks")


def _name_pairs(names: DataFrame) -> DataFrame:
    """One level up: neighbouring names become one. An odd last name pairs with -1, which names nothing."""
    pairs = names.groupBy("row_id", F.shiftright("i", 1).alias("i")).agg(
        F.max("doc_id").alias("doc_id"),
        F.max("digest").alias("digest"),
        F.max("n").alias("n"),
        F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    numbered = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
    above = pairs.join(numbered, ["left", "right"]).select("row_id", "doc_id", "digest", "n", "i", "name")
    return saved(above, "pairs")


def text_names(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, fingerprint=F.xxhash64
) -> DataFrame:
    """``row_id``, ``doc_id``, ``digest``, ``n`` and ``name`` of each row; (n, name) is the text's identity."""
    level = _name_blocks(docs, block_bytes, fingerprint)
    done, blocks = [], 1
    while True:
        # A text of n blocks has one name left after the levels that n takes.
        done.append(level.where(F.col("n") <= blocks).where(F.col("n") > blocks // 2).drop("i"))
        level = level.where(F.col("n") > blocks)
        if level.isEmpty():
            break
        level, blocks = _name_pairs(level), 2 * blocks
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def exact_duplicates(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, fingerprint=F.xxhash64
) -> DataFrame:
    """The verdict on each row of ``docs``: of equal texts one row with the largest ``doc_id`` stays."""
    named = text_names(docs, block_bytes, fingerprint)
    groups = named.groupBy("n", "name").agg(
        F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    return named.join(saved(groups, "copies"), ["n", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
