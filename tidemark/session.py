"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
R = TypeVar("R")

# Adaptive execution sizes shuffle partitions at run time, splits skewed join partitions
# and splits or merges the partitions of a REBALANCE before a write.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
    # Files keep the least and the largest of these, so filters on a time skip the others.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


ADVISORY_BYTES = 128 * 2**20


def sizing(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job whose largest shuffle moves about ``shuffle_bytes``.

    Adaptive execution merges small shuffle partitions but does not split evenly large
    ones, so there must be enough of them from the start.
    """
    partitions = max(2 * cores, -(-shuffle_bytes // ADVISORY_BYTES))
    return {"spark.sql.shuffle.partitions": str(partitions)}


def build_session(app_name: str = "tidemark", extra: dict[str, str] | None = None) -> SparkSession:
    """Create a session; catalogs and master come from ``extra`` or from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Without that setting it is below the warehouse, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def side_by_side(
    spark: SparkSession, function: Callable[[T], R], items: Iterable[T], concurrency: int = 4
) -> list[R]:
    """Run independent Spark jobs at the same time, so that a small one leaves no cores idle."""
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        return list(pool.map(inheritable_thread_target(spark)(function), items))
