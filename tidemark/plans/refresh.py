"""Full refresh of tables from one catalog or namespace into another."""

from __future__ import annotations

import datetime
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import verify
from tidemark.plans.audit import audit_rows, create_audit_table, write_audit
from tidemark.plans.reconcile import SAME, column_differences, conform
from tidemark.session import side_by_side
from tidemark.sources.lake import ensure_table, is_session_catalog, quote, replace_table, row_count, user_properties
from tidemark.sources.schemas import LAKE_TABLES

log = logging.getLogger(__name__)

GOVERNANCE_PREFIX = "governance."
RESULT_DDL = "table_name STRING, status STRING, source_rows BIGINT, target_rows BIGINT, error STRING"


def _properties_of(spark: SparkSession, name: str) -> dict[str, str]:
    """A table's properties; a temporary view has none."""
    if "." not in name and spark.catalog.getTable(name).isTemporary:
        return {}
    return user_properties(spark, name)


def refresh_table(
    spark: SparkSession,
    source: str,
    target: str,
    location: str | None = None,
    provider: str = "parquet",
    columns: str = "source",
    keys: Sequence[str] = (),
) -> tuple[int, int] | tuple[int, int, DataFrame | None]:
    """Replace ``target`` by the rows of ``source``; returns both row counts.

    With ``keys`` the contents are verified as well, and the keys whose rows differ are returned
    (None if there are none): digests are summed while the rows are written, and compared with
    those of what can be read back.

    A target that is not there is created first, with the source's columns and comments. One
    that is takes over the source's columns, or with ``columns="target"`` keeps its own, with
    what ``reconcile`` says about casts; if there is no safe one, the old rows stay.

    The source is counted while it is written, in the stage that writes: there Spark counts
    every task once even if an executor is lost. Another catalog may shuffle before it
    writes, where a repeated task would count twice, so there the source is counted first.
    The target is counted from what can be read back. Properties that classify the source's
    columns go with the rows, and the target keeps its own.
    """
    if source == target:
        raise ValueError(f"{source} cannot be refreshed from itself")
    if columns not in ("source", "target"):
        raise ValueError(f"columns must be 'source' or 'target', got {columns!r}")
    rows = spark.table(quote(source))
    ensure_table(spark, source, target, provider=provider, location=location)
    own = spark.table(quote(target)).schema
    for difference in column_differences(rows.schema, own):
        if difference.change != SAME:
            log.info("%s and %s differ: %s", source, target, difference)
    if columns == "target":
        rows = conform(rows, own)
    carried = {k: v for k, v in _properties_of(spark, source).items() if k.startswith(GOVERNANCE_PREFIX)}
    if keys:
        if not is_session_catalog(spark, target):
            raise ValueError(f"{target}: contents are verified in the session catalog only")
        written = Observation()
        replace_table(
            verify.observed(rows, keys, written), target, location=location, provider=provider, properties=carried
        )
        copy = spark.table(quote(target)).select(*rows.columns)
        sums = verify.bucket_sums(copy, keys)
        differing = verify.differing_buckets(written, sums)
        found = verify.differences(rows, copy, keys, differing) if differing else None
        return written.get["rows"], sum(n for n, _ in sums.values()), found
    if is_session_catalog(spark, target):
        written = Observation()
        observed = rows.observe(written, F.count(F.lit(1)).alias("rows"))
        replace_table(observed, target, location=location, provider=provider, properties=carried)
        source_rows = written.get["rows"]
    else:
        source_rows = rows.count()
        replace_table(rows, target, location=location, provider=provider, properties=carried)
    return source_rows, row_count(spark, target)


def refresh_tables(
    spark: SparkSession,
    source_namespace: str,
    target_namespace: str,
    tables: Sequence[str] = LAKE_TABLES,
    location: str | None = None,
    provider: str = "parquet",
    concurrency: int = 4,
    columns: str = "source",
    keys: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Refresh every table; one that fails is reported and does not stop the others.

    The contents of tables that ``keys`` names are verified, the others' row counts only.
    """

    def one(table: str) -> tuple:
        try:
            source_rows, target_rows, *differing = refresh_table(
                spark,
                f"{source_namespace}.{table}",
                f"{target_namespace}.{table}",
                f"{location.rstrip('/')}/{table}" if location else None,
                provider,
                columns,
                (keys or {}).get(table, ()),
            )
            if differing and differing[0] is not None:
                text = f"rows of {differing[0].count()} keys differ"
                return (table, "CONTENT_MISMATCH", source_rows, target_rows, text)
        except Exception as error:
            log.warning("refresh of %s failed: %s", table, error)
            return (table, "FAILED", None, None, str(error))
        status = "OK" if source_rows == target_rows else "ROW_MISMATCH"
        return (table, status, source_rows, target_rows, None)

    results = side_by_side(spark, one, tables, concurrency)
    return spark.createDataFrame(results, RESULT_DDL)


def overall_status(results: DataFrame) -> DataFrame:
    """SUCCESS when every table is OK, else PARTIAL FAILURE, with the tables per status."""
    return results.agg(
        F.when(F.coalesce(F.bool_and(F.col("status") == "OK"), F.lit(True)), "SUCCESS")
        .otherwise("PARTIAL FAILURE")
        .alias("overall_status"),
        F.count_if(F.col("status") == "OK").alias("ok_tables"),
        F.count_if(F.col("status").isin("ROW_MISMATCH", "CONTENT_MISMATCH")).alias("mismatched_tables"),
        F.count_if(F.col("status") == "FAILED").alias("failed_tables"),
    )


def refresh_with_audit(
    spark: SparkSession,
    source_namespace: str,
    target_namespace: str,
    audit_table: str,
    run_id: str,
    tables: Sequence[str] = LAKE_TABLES,
    location: str | None = None,
    audited_at: datetime.datetime | None = None,
    provider: str = "parquet",
) -> DataFrame:
    """Refresh the tables, append one audit row per table, return the results."""
    log.info("start of run %s: %s to %s", run_id, source_namespace, target_namespace)
    results = refresh_tables(spark, source_namespace, target_namespace, tables, location, provider)
    copies = results.select(
        F.concat(F.lit(f"{source_namespace}."), "table_name").alias("source_table"),
        F.col("source_rows").alias("source_row_count"),
        F.concat(F.lit(f"{target_namespace}."), "table_name").alias("target_table"),
        F.col("target_rows").alias("target_row_count"),
        F.col("error").alias("error_message"),
    )
    try:
        create_audit_table(spark, audit_table, f"{location.rstrip('/')}/audit" if location else None, provider)
    except Exception:
        log.exception("audit table %s not created", audit_table)
    else:
        write_audit(audit_rows(copies, run_id, audited_at), audit_table)
    log.info("end of run %s: %s", run_id, overall_status(results).first()["overall_status"])
    return results
