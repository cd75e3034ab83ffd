"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import workspace


#: Rows of a few numbers that make a file worth its while.
FILE_ROWS = 250_000


def saved(frame: DataFrame, purpose: str, rows: int | None = None) -> DataFrame:
    """Write ``frame`` below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: what follows reads files, whichever executors are lost. ``rows`` is about
    how many there are, if that is known: small tables then go to few files, written by few tasks.
    """
    spark = frame.sparkSession
    folder = workspace(spark, purpose)
    if rows is not None:
        frame = frame.coalesce(max(1, -(-rows // FILE_ROWS)))
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What tells documents apart, whichever scan they come from: the id (null as 0 with
#: ``last_id``, which puts it last) and a hash of the text.
KEY = ["last_id", "id", "digest"]


def keyed(docs: DataFrame, *more: Column | str, digest=F.xxhash64) -> DataFrame:
    """``docs`` by the columns of ``KEY``, with more columns of theirs."""
    return docs.select(
        F.col("doc_id").isNull().alias("last_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
        digest(F.coalesce(F.col("text"), F.lit(""))).alias("digest"),
        *more,
    )


def doc_id() -> Column:
    """The id that ``keyed`` took apart."""
    return F.when(~F.col("last_id"), F.col("id")).alias("doc_id")


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).alias("text")
