"""Refresh between namespaces, verification and audit."""

import datetime
import uuid

import pytest

from tidemark.plans import audit, generate, refresh
from tidemark.sources import lake
from tidemark.sources.schemas import LAKE_TABLES, schema_of

WHEN = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


@pytest.fixture
def spaces(spark, tmp_path):
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("src", "dst")]
    for name in names:
        spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    lake.LakeWriter(namespace=names[0]).write_all(generate.dataset(spark, "2026-01-01", 2, 5, 10))
    return names


def test_refresh_all_tables_twice(spark, spaces):
    source, target = spaces
    for _ in range(2):
        results = refresh.refresh_tables(spark, source, target)
        assert {row.status for row in results.collect()} == {"OK"}
    assert refresh.overall_status(results).first().overall_status == "SUCCESS"
    for table in LAKE_TABLES:
        copy, original = spark.table(f"{target}.{table}"), spark.table(f"{source}.{table}")
        assert copy.exceptAll(original).isEmpty() and original.exceptAll(copy).isEmpty()
        assert [f.metadata for f in copy.schema] == [f.metadata for f in original.schema]


def test_one_failure_does_not_stop_the_others(spark, spaces):
    source, target = spaces
    spark.sql(f"DROP TABLE {source}.products")
    results = refresh.refresh_tables(spark, source, target)
    found = {row.table_name: row for row in results.collect()}
    assert found["products"].status == "FAILED" and "products" in found["products"].error
    assert found["products"].source_rows is None
    assert {found[table].status for table in LAKE_TABLES if table != "products"} == {"OK"}
    overall = refresh.overall_status(results).first()
    assert (overall.overall_status, overall.ok_tables, overall.failed_tables) == ("PARTIAL FAILURE", 4, 1)


def test_a_failing_refresh_keeps_the_last_good_copy(spark, spaces, tmp_path):
    source, target = spaces
    refresh.refresh_tables(spark, source, target, ["orders"], location=f"{tmp_path}/copies")
    place = lake.table_place(spark, f"{target}.orders")[0]
    spark.sql(f"DROP TABLE {source}.orders")
    broken = "SELECT *, CAST(raise_error('lost') AS BIGINT) AS more FROM VALUES (1) AS t(order_id)"
    spark.sql(f"CREATE VIEW {source}.orders AS {broken}")
    results = refresh.refresh_tables(spark, source, target, ["orders"], location=f"{tmp_path}/copies")
    assert results.first().status == "FAILED"
    assert spark.table(f"{target}.orders").count() == 10
    assert lake.table_place(spark, f"{target}.orders")[0] == place


def test_refreshing_keeps_the_location(spark, spaces, tmp_path):
    source, target = spaces
    refresh.refresh_table(spark, f"{source}.orders", f"{target}.orders", f"{tmp_path}/place/orders")
    refresh.refresh_table(spark, f"{source}.orders", f"{target}.orders")
    folder, managed, _ = lake.table_place(spark, f"{target}.orders")
    assert folder.removeprefix("file:").startswith(f"{tmp_path}/place/orders/") and not managed


def test_lost_rows_are_a_mismatch(spark, spaces, monkeypatch):
    source, target = spaces
    real = refresh.row_count
    monkeypatch.setattr(refresh, "row_count", lambda spark, table: real(spark, table) - 1)
    results = refresh.refresh_tables(spark, source, target, ["customers"])
    row = results.first()
    assert (row.status, row.source_rows, row.target_rows) == ("ROW_MISMATCH", 5, 4)
    assert refresh.overall_status(results).first().overall_status == "PARTIAL FAILURE"


def test_source_and_target_must_differ(spark, spaces):
    results = refresh.refresh_tables(spark, spaces[0], spaces[0], ["orders"])
    assert results.first().status == "FAILED" and spark.table(f"{spaces[0]}.orders").count() == 10


def test_audit_rows(spark):
    copies = spark.createDataFrame(
        [("a", 2, "b", 2, ""), ("it's", 2, "b", 1, None), ("a", None, "b", None, "it's lost"), ("a", 0, "b", 0, None)],
        "source_table STRING, source_row_count BIGINT, target_table STRING, target_row_count BIGINT, error_message STRING",
    )
    rows = audit.audit_rows(copies, "run", WHEN)
    assert rows.columns == schema_of("audit_stats").fieldNames()
    assert [(r.source_table, r.sync_status, r.error_message) for r in rows.collect()] == [
        ("a", "COMPLETE", None),
        ("it's", "INCOMPLETE", None),
        ("a", "INCOMPLETE", "it's lost"),
        ("a", "COMPLETE", None),
    ]


def test_audit_table_is_created_once_and_appended(spark, spaces):
    name = f"{spaces[1]}.audit_stats"
    audit.create_audit_table(spark, name)
    audit.create_audit_table(spark, name)
    assert spark.table(name).isEmpty() and spark.table(name).schema == schema_of("audit_stats")
    for run in ("r1", "r2"):
        refresh.refresh_with_audit(spark, *spaces, name, run, ["orders", "customers", "nothing"], audited_at=WHEN)
    rows = spark.table(name).collect()
    assert len(rows) == 6
    assert {(r.job_run_id, r.source_table.split(".")[1], r.sync_status) for r in rows} == {
        (run, table, status)
        for run in ("r1", "r2")
        for table, status in [("orders", "COMPLETE"), ("customers", "COMPLETE"), ("nothing", "INCOMPLETE")]
    }
    assert all((r.error_message is None) == (r.sync_status == "COMPLETE") for r in rows)


def test_audit_failure_does_not_stop_the_refresh(spark, spaces):
    results = refresh.refresh_with_audit(spark, *spaces, "missing_ns.audit_stats", "r", ["orders"])
    assert results.first().status == "OK"
    assert audit.write_audit(spark.createDataFrame([], schema_of("audit_stats")), "missing_ns.a") is False


def test_default_audit_time_is_now(spark):
    copies = spark.createDataFrame(
        [("a", 1, "b", 1, None)],
        "source_table STRING, source_row_count BIGINT, target_table STRING, target_row_count BIGINT, error_message STRING",
    )
    assert audit.audit_rows(copies, "run").first().audit_ts is not None
