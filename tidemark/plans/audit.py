"""The audit table: one row per copied table and run."""

from __future__ import annotations

import datetime
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.layout import compact_table
from tidemark.sources.lake import is_session_catalog, literal, quote, remove_old_folders, user_properties
from tidemark.sources.schemas import TABLE_DDL, schema_of

log = logging.getLogger(__name__)

# Layout and commit settings of the audit table.
AUDIT_PROPERTIES = {
    "format-version": "2",
    "write.target-file-size-bytes": "134217728",
    "write.metadata.delete-after-commit.enabled": "true",
    "write.metadata.previous-versions-max": "10",
    "write.distribution-mode": "hash",
    "write.sort-order": "audit_ts DESC",
    "write.fanout.enabled": "true",
    "commit.retry.num-retries": "5",
    "commit.retry.min-wait-ms": "200",
    "commit.retry.max-wait-ms": "60000",
}


def create_audit_table(
    spark: SparkSession, name: str, location: str | None = None, provider: str = "parquet"
) -> None:
    properties = ", ".join(f"{literal(key)} = {literal(value)}" for key, value in AUDIT_PROPERTIES.items())
    place = f" LOCATION {literal(location)}" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quote(name)} ({TABLE_DDL['audit_stats']}) "
        f"USING {provider}{place} TBLPROPERTIES ({properties})"
    )


def audit_rows(copies: DataFrame, run_id: str, audited_at: datetime.datetime | None = None) -> DataFrame:
    """Audit rows for ``copies``: source and target names, row counts and error.

    A copy is COMPLETE when both counts are known and equal, else INCOMPLETE.
    """
    moment = F.current_timestamp() if audited_at is None else F.lit(audited_at).cast("timestamp")
    complete = F.col("source_row_count") == F.col("target_row_count")
    return copies.select(
        moment.alias("audit_ts"),
        F.lit(run_id).alias("job_run_id"),
        "source_table",
        "source_row_count",
        "target_table",
        "target_row_count",
        F.when(complete, "COMPLETE").otherwise("INCOMPLETE").alias("sync_status"),
        F.nullif("error_message", F.lit("")).alias("error_message"),
    )


def write_audit(rows: DataFrame, name: str) -> bool:
    """Append one run's rows, newest first, with the table's own settings for retries and layout.

    A failure is logged and never stops the job. When runs have left many small files, the table is
    rewritten in few sorted ones, and what has been out of use for a day is removed.
    """
    spark = rows.sparkSession
    try:
        settings = {**AUDIT_PROPERTIES, **user_properties(spark, name)}
        attempts = 1 + int(settings["commit.retry.num-retries"])
        wait, most = (int(settings[f"commit.retry.{bound}-wait-ms"]) / 1000 for bound in ("min", "max"))
        ordered = rows.select(*schema_of("audit_stats").fieldNames())
        # The rows are made once, so a second attempt appends the same ones.
        ordered = spark.createDataFrame(ordered.collect(), ordered.schema).coalesce(1).sortWithinPartitions(F.desc("audit_ts"))
        for attempt in range(attempts):
            try:
                ordered.write.insertInto(quote(name))
                break
            except Exception:
                if attempt == attempts - 1:
                    raise
                log.warning("audit rows not written to %s, trying again", name, exc_info=True)
                time.sleep(min(wait * 2**attempt, most))
    except Exception:
        log.exception("audit rows not written to %s", name)
        return False
    try:
        if is_session_catalog(spark, name):
            before, after = compact_table(spark, name)
            if settings["write.metadata.delete-after-commit.enabled"] == "true" and after < before:
                remove_old_folders(spark, name)
    except Exception:
        log.exception("audit table %s not compacted", name)
    return True
