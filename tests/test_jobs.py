"""The batch jobs end to end."""

import uuid

import pytest

from tidemark import jobs
from tidemark.plans import governance
from tidemark.sources import lake
from tidemark.sources.schemas import LAKE_TABLES

AS_OF = "2026-01-01"


@pytest.fixture
def namespace(spark, tmp_path):
    name = f"ns_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    return name


def test_generate_tables_and_report(spark, namespace, tmp_path):
    reports = jobs.run_generate(spark, f"{tmp_path}/lake", "table", namespace, AS_OF)
    summary = reports["summary"].first()
    assert (summary.organizations_count, summary.customers_count, summary.orders_count) == (5, 100, 500)
    assert 10 <= summary.products_count <= 60
    assert 0 < summary.order_items_count <= 2500
    assert summary.total_order_value > 0
    assert reports["orders_with_customers"].first().row_count == 500
    assert reports["top_products"].count() == reports["customer_spending"].count() == 5
    assert "registered" not in reports


def test_generate_folders_and_register(spark, namespace, tmp_path):
    reports = jobs.run_generate(
        spark, f"{tmp_path}/lake", "parquet", namespace, AS_OF, 3, 20, 40, register=True
    )
    assert {row.table_name: row.status for row in reports["registered"].collect()} == dict.fromkeys(
        LAKE_TABLES, "CREATED"
    )
    assert spark.table(f"{namespace}.orders").count() == 40


def test_failing_report_does_not_stop_the_job(spark, namespace, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs.sales, "top_products", lambda lines: 1 / 0)
    assert jobs.run_generate(spark, f"{tmp_path}/lake", "table", namespace, AS_OF, 2, 5, 5) == {}
    assert spark.table(f"{namespace}.orders").count() == 5


def test_directory(spark, namespace, tmp_path):
    name = jobs.run_directory(spark, f"{tmp_path}/lake/", namespace, AS_OF)
    assert spark.table(name).count() == 100 and len(spark.table(name).columns) == 10
    assert governance.table_classes(spark, name) == governance.EMPLOYEE_CLASSIFICATION
    assert all(lake.comment_of(field) is None for field in spark.table(name).schema)


def test_command_line(spark, namespace, tmp_path):
    target = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {target} LOCATION '{tmp_path}/{target}'")
    sizes = ["--organizations", "2", "--customers", "5", "--orders", "7", "--as-of-date", AS_OF]
    jobs.main(["generate", "--output", f"{tmp_path}/lake", "--namespace", namespace, *sizes])
    jobs.main(["directory", "--namespace", namespace])
    jobs.main(["refresh", "--source", namespace, "--target", target, "--run-id", "r1"])
    assert spark.table(f"{target}.orders").count() == 7
    rows = spark.table(f"{target}.audit_stats").collect()
    assert len(rows) == 5 and {row.sync_status for row in rows} == {"COMPLETE"}
