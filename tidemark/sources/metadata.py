"""Table metadata documents: JSON objects with a ``properties`` map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_GLOB = "*.metadata.json"
DOCUMENT_DDL = "properties MAP<STRING, STRING>"


def metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and modification time of every metadata file below ``folder``; no file content is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", METADATA_GLOB)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(F.col("path").alias("file_path"), F.col("modificationTime").alias("file_modification_time"))
    )


def metadata_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole metadata files as text, folders searched to any depth, with path and modification time."""
    return (
        spark.read.option("pathGlobFilter", METADATA_GLOB)
        .option("recursiveFileLookup", True)
        .text(paths, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_modification_time").alias("file_modification_time"),
            "value",
        )
    )


def newest_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The most recently modified metadata file, with its properties parsed.

    The newest path is found from the listing, so only that one file is opened.
    """
    newest = (
        metadata_files(spark, folder)
        .agg(F.max_by("file_path", F.struct("file_modification_time", "file_path")).alias("file_path"))
        .first()["file_path"]
    )
    if newest is None:
        raise FileNotFoundError(f"no {METADATA_GLOB} in {folder}")
    return with_properties(metadata_documents(spark, newest))


def with_properties(documents: DataFrame, body: str = "value") -> DataFrame:
    """Replace the JSON text by its ``properties`` map, NULL for text that is not JSON."""
    return documents.withColumn("properties", F.from_json(body, DOCUMENT_DDL)["properties"]).drop(body)


def newest_per_table(documents: DataFrame, table: str, modified: str, body: str = "value") -> DataFrame:
    """The newest document of every table; of several at that time, the one with the largest hash.

    The newest is found from time and hash alone, so no body is sorted or kept in an
    aggregation; the bodies are then joined to it by a shuffle. What the planner expects of
    texts that were parsed or put together is far too little, so it would send them all to the driver.
    """
    return _one_per_table(documents, table, modified, body, F.max)


def oldest_per_table(documents: DataFrame, table: str, modified: str, body: str = "value") -> DataFrame:
    """The oldest document of every table, found in the same way."""
    return _one_per_table(documents, table, modified, body, F.min)


def _one_per_table(documents: DataFrame, table: str, modified: str, body: str, pick) -> DataFrame:
    ranked = documents.select(table, modified, body, F.xxhash64(body).alias("_rank"))
    chosen = ranked.groupBy(table).agg(pick(F.struct(modified, "_rank")).alias("_chosen")).select(table, "_chosen.*")
    # Equal documents of the same time are one.
    return ranked.join(chosen.hint("merge"), [table, modified, "_rank"]).drop("_rank").distinct()


def json_property(properties: str | Column, key: str) -> Column:
    """One property by its literal, possibly dotted, key."""
    return F.element_at(properties, F.lit(key))


def required_json(text: str | Column, ddl: str) -> Column:
    """Parse JSON that must be valid: malformed text fails the query."""
    return F.from_json(text, ddl, {"mode": "FAILFAST"})


def canonical_json(entries: str | Column) -> Column:
    """A map as compact JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
