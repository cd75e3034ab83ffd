"""The batch jobs, for spark-submit.

generate   make the five related tables, write them, report on them
directory  make the employee directory and store its classification as table properties
refresh    copy the tables into another namespace, verify and audit the copies
"""

from __future__ import annotations

import argparse
import datetime
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import sales
from tidemark.plans import generate, governance, refresh
from tidemark.session import build_session
from tidemark.sources import folders, lake
from tidemark.sources.schemas import LAKE_TABLES

log = logging.getLogger(__name__)


def run_generate(
    spark: SparkSession,
    output: str,
    format: str,
    namespace: str,
    as_of_date: str,
    organization_count: int = len(generate.ORGANIZATIONS),
    customer_count: int = generate.DEFAULT_CUSTOMERS,
    order_count: int = generate.DEFAULT_ORDERS,
    register: bool = False,
) -> dict[str, DataFrame]:
    """Write the dataset, then report from what was written; a failing report stops nothing."""
    tables = generate.dataset(spark, as_of_date, organization_count, customer_count, order_count)
    written = lake.LakeWriter(output, format, namespace).write_all(tables)
    for table, place in written.items():
        log.info("%s written to %s", table, place)
    stored = lake.LakeReader(spark, output, format, namespace).read_all()
    reports = {}
    try:
        reports = {
            "summary": sales.dataset_summary(**stored),
            "orders_with_customers": sales.row_total(
                sales.orders_with_customers(stored["orders"], stored["customers"])
            ),
            "top_products": sales.top_products(stored["order_items"]),
            "customer_spending": sales.customer_spending(stored["orders"]),
        }
        for name, report in reports.items():
            log.info("%s\n%s", name, report.toPandas().to_string(index=False))
    except Exception:
        log.exception("reports failed")
    if register and format == "parquet":
        reports["registered"] = folders.register_folders(spark, output, LAKE_TABLES, namespace)
    return reports


def run_directory(
    spark: SparkSession,
    output: str | None,
    namespace: str,
    as_of_date: str,
    table: str = "employee_directory_poc",
    employee_count: int = generate.DEFAULT_EMPLOYEES,
) -> str:
    rows = generate.employees(generate.ids(spark, employee_count), as_of_date)
    return governance.write_classified(
        rows,
        f"{namespace}.{table}",
        governance.EMPLOYEE_CLASSIFICATION,
        "synthetic-poc",
        f"{output.rstrip('/')}/{table}" if output else None,
    )


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    today = datetime.date.today().isoformat()

    make = commands.add_parser("generate")
    make.add_argument("--output", required=True)
    make.add_argument("--format", choices=lake.FORMATS, default="table")
    make.add_argument("--namespace", default="default")
    make.add_argument("--as-of-date", default=today)
    make.add_argument("--organizations", type=int, default=len(generate.ORGANIZATIONS))
    make.add_argument("--customers", type=int, default=generate.DEFAULT_CUSTOMERS)
    make.add_argument("--orders", type=int, default=generate.DEFAULT_ORDERS)
    make.add_argument("--register", action="store_true", help="register Parquet folders as tables")

    directory = commands.add_parser("directory")
    directory.add_argument("--output")
    directory.add_argument("--namespace", default="default")
    directory.add_argument("--as-of-date", default=today)
    directory.add_argument("--table", default="employee_directory_poc")

    copy = commands.add_parser("refresh")
    copy.add_argument("--source", required=True)
    copy.add_argument("--target", required=True)
    copy.add_argument("--location")
    copy.add_argument("--audit-table")
    copy.add_argument("--provider", default="parquet", help="table format of the copies and the audit table")
    copy.add_argument("--run-id", default=f"refresh-{datetime.datetime.now().isoformat()}")

    options = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(name)s: %(message)s")
    spark = build_session(f"tidemark-{options.command}")
    if options.command == "generate":
        run_generate(
            spark,
            options.output,
            options.format,
            options.namespace,
            options.as_of_date,
            options.organizations,
            options.customers,
            options.orders,
            options.register,
        )
    elif options.command == "directory":
        run_directory(spark, options.output, options.namespace, options.as_of_date, options.table)
    else:
        audit = options.audit_table or f"{options.target}.audit_stats"
        results = refresh.refresh_with_audit(
            spark,
            options.source,
            options.target,
            audit,
            options.run_id,
            location=options.location,
            provider=options.provider,
        )
        log.info("%s", results.toPandas().to_string(index=False))


if __name__ == "__main__":
    main()
