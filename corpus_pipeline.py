"""The stages that turn documents into packed training sequences.

Each stage reads all that its predecessor kept. Documents are told apart by id and text, as
``tidemark.llm.storage.KEY`` says, so stages do not depend on how a scan is split. Rows that
repeat a document's id and text, and differ in other columns at most, are one document.

Every stage takes null and empty texts (the first one drops them, as they have too few words),
null ids and sources, very long texts, ties, repeated rows, other columns of any name, and tables
without rows, which give tables without rows. What each does with them is in its docstring and
in that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, jaccard, mixing, packing, rules
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.storage import KEY, documents, keyed, saved


def _joined(docs: DataFrame, chosen: DataFrame, digest=F.xxhash64) -> DataFrame:
    """Each row of ``chosen``, which has the columns of ``KEY`` once, with its document."""
    rows = keyed(docs, F.struct(*docs.columns).alias("document"), digest=digest)
    # The join has the rows in the order that dropping repeated ones needs.
    return rows.join(chosen, KEY).dropDuplicates(KEY)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail the base rules or come from a rejected source.

    Null and empty texts fail; a null source is never rejected; repeated rows are judged one by one.
    """
    return rules.accepted(docs, host="source")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id.

    A null id is smaller than every other; of rows that repeat id and text one stays.
    """
    kept = exact.exact_duplicates(docs).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    last_id, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    chosen = kept.select(last_id.alias("last_id"), number.alias("id"), "digest")
    return _joined(docs, chosen, lambda text: F.sha2(text, 256)).select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates keep the document with the smallest id.

    A null id is larger than every other; ties are in the order of a hash of the text; texts without
    words are alone and stay.
    """
    found = jaccard.near_duplicates(docs)
    alone = found.where("component IS NULL").select(*KEY).distinct()
    smallest = F.min(F.struct(*KEY)).alias("one")
    chosen = found.where("component IS NOT NULL").groupBy("component").agg(smallest).select("one.*")
    return _joined(docs, chosen.unionByName(alone)).select("document.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their target sizes.

    A null source is one of its own; null ids are drawn for like others; repeated rows are counted once
    each and come out as one document as often as they are taken in all.
    """
    last_id, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    taken = mixing.mix(docs).select(last_id.alias("last_id"), number.alias("id"), "digest", "copies")
    copies = taken.groupBy(KEY).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    rows = _joined(docs, copies).select("document", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into pieces of at most 4096 tokens and give each its place in a sequence.

    A null or empty text is its end id alone; repeated rows are packed one by one.
    """
    return packing.pack(docs, tokenizer_path(), end=1)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", near_dedup),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Token ids, components of links and best-fit packing are beyond SQL; the tests hold ``run``
#: against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents; each one's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
