"""Every registered query: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.hashing import below, choice, draw
from tidemark.operators import sales
from tidemark.plans import audit, generate, governance, layout, reconcile, refresh, verify
from tidemark.session import side_by_side, workspace
from tidemark.sources import folders, lake, metadata
from tidemark.sources.schemas import LAKE_TABLES, schema_of
from tidemark.sources.star import BASE_DDL, Star
from tidemark.streaming import landing, topics

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# Analyses


@query
def orders_with_customers(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return sales.orders_with_customers(star.orders, star.customers)


@query
def order_items_with_products(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return sales.order_items_with_products(star.order_items, star.products)


@query
def order_chain(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return sales.order_chain(star.orders, star.customers, star.organizations)


@query
def order_customer_list(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return sales.order_customer_list(star.orders, star.customers, ["customer_name"])


@query
def top_products(spark: SparkSession, folder: str) -> DataFrame:
    return sales.top_products(Star(spark, folder).order_items)


@query
def customer_spending(spark: SparkSession, folder: str) -> DataFrame:
    return sales.customer_spending(Star(spark, folder).orders)


@query
def organization_performance(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return sales.organization_performance(star.orders, star.organizations)


@query
def product_performance(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return sales.product_performance(star.products, star.order_items)


@query
def category_sales(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return sales.category_sales(star.products, star.order_items)


@query
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sales.dataset_summary(**Star(spark, folder).tables())


@query
def table_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sales.table_row_counts(Star(spark, folder).tables())


@query
def orders_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return sales.with_status(Star(spark, folder).orders, "F")


@query
def customers_preview(spark: SparkSession, folder: str) -> DataFrame:
    return sales.preview(Star(spark, folder).customers, 10, ["customer_id"])


@query
def unordered_preview(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows a preview without an order has, all of them rows of the orders."""
    orders = Star(spark, folder).orders
    some = sales.preview(orders, 10)
    return some.join(orders.select("order_id"), "order_id", "left_semi").agg(F.count(F.lit(1)).alias("rows"))


# Generated data, one row or order per row of a given table


AS_OF = "2026-01-01"


def _ids(star: Star, table: str, key: str) -> DataFrame:
    return star.base(table).select((F.col(key) + 1).alias("id"))


def _generated_products(star: Star) -> DataFrame:
    return generate.products(generate.organizations(_ids(star, "supplier", "s_suppkey")), AS_OF)


def _generated_orders(star: Star) -> DataFrame:
    totals = star.base("customer").count(), star.base("supplier").count()
    return generate.orders(_ids(star, "orders", "o_orderkey"), _generated_products(star), *totals, AS_OF)


@query
def gen_organizations(spark: SparkSession, folder: str) -> DataFrame:
    return generate.organizations(_ids(Star(spark, folder), "supplier", "s_suppkey"))


@query
def gen_products(spark: SparkSession, folder: str) -> DataFrame:
    return _generated_products(Star(spark, folder))


@query
def gen_customers(spark: SparkSession, folder: str) -> DataFrame:
    return generate.customers(_ids(Star(spark, folder), "customer", "c_custkey"), AS_OF)


@query
def gen_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _generated_orders(Star(spark, folder))


@query
def gen_order_items(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return generate.order_items(_generated_orders(star), _generated_products(star))


@query
def gen_employees(spark: SparkSession, folder: str) -> DataFrame:
    return generate.employees(_ids(Star(spark, folder), "customer", "c_custkey"), AS_OF)


# Reading, writing and table lifecycle: each writes below a fresh folder and returns what
# is read back


NAMESPACE_PREFIX = "tidemark_"


def _namespace(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """A fresh catalog namespace and the folder it keeps its tables in."""
    location = workspace(spark, purpose)
    name = f"{NAMESPACE_PREFIX}{purpose}_{location.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION {lake.literal(location)}")
    return name, location


def drop_namespace(spark: SparkSession, name: str, location: str) -> None:
    spark.sql(f"DROP DATABASE {name} CASCADE")
    lake.delete_folder(spark, location)


def drop_namespaces(spark: SparkSession) -> int:
    """Drop what the queries left in the catalog, once their results are no longer read."""
    found = [row[0] for row in spark.sql(f"SHOW DATABASES LIKE '{NAMESPACE_PREFIX}*'").collect()]
    for name in found:
        detail = {row[0]: row[1] for row in spark.sql(f"DESCRIBE DATABASE {name}").collect()}
        drop_namespace(spark, name, detail["Location"])
    return len(found)


def _fingerprint(frame: DataFrame) -> DataFrame:
    """Row count and a sum over hashes of whole rows, which any changed value changes."""
    row = F.xxhash64(*frame.columns).cast("decimal(38,0)")
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("digest"))


def _compared(spark: SparkSession, tables: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """Per table the rows written and read back, and whether they are the same."""

    def one(name: str) -> tuple:
        source, target = _fingerprint(tables[name]).first(), _fingerprint(stored[name]).first()
        return name, source["rows"], target["rows"], source == target

    results = side_by_side(spark, one, tables)
    return spark.createDataFrame(results, "table_name STRING, source_rows BIGINT, stored_rows BIGINT, same BOOLEAN")


@query
def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All five tables as Parquet folders, compared row by row with what was written."""
    base = workspace(spark, "folders")
    tables = Star(spark, folder).tables()
    lake.LakeWriter(base, "parquet").write_all(tables)
    # The star views have fewer columns than the declared tables, so read what is stored.
    stored = lake.LakeReader(spark, base, "parquet", schemas={}).read_all()
    results = _compared(spark, tables, stored)
    lake.delete_folder(spark, base)
    return results


@query
def table_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All five tables as catalog tables, compared row by row; nothing is left behind."""
    name, location = _namespace(spark, "tables")
    tables = Star(spark, folder).tables()
    lake.LakeWriter(location, namespace=name).write_all(tables)
    results = _compared(spark, tables, lake.LakeReader(spark, namespace=name).read_all())
    drop_namespace(spark, name, location)
    return results


@query
def declared_folder_read(spark: SparkSession, folder: str) -> DataFrame:
    """Generated tables as folders, read with their declared schemas."""
    star = Star(spark, folder)
    base = workspace(spark, "declared")
    tables = {
        "organizations": generate.organizations(_ids(star, "supplier", "s_suppkey")),
        "products": _generated_products(star),
        "customers": generate.customers(_ids(star, "customer", "c_custkey"), AS_OF),
        "orders": _generated_orders(star),
        "order_items": generate.order_items(_generated_orders(star), _generated_products(star)),
    }
    lake.LakeWriter(base, "parquet").write_all(tables)
    stored = lake.LakeReader(spark, base, "parquet").read_all()
    results = _compared(spark, tables, stored)
    lake.delete_folder(spark, base)
    return results


@query
def fallback_write(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose table cannot be written go to a folder, and are read from there."""
    name, location = _namespace(spark, "fallback")
    # A format that does not exist fails the table write.
    writer = lake.LakeWriter(location, namespace=name, provider="no_such_format", on_error="parquet")
    place = writer.write(Star(spark, folder).orders, "orders")
    return lake.read_written(spark, place)


@query
def partitioned_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{workspace(spark, 'dated')}/orders"
    rows = Star(spark, folder).orders.withColumn("load_date", F.trunc("order_date", "month"))
    lake.write_dated_folder(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query
def cross_source_order_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders from a catalog table, customers from a Parquet folder."""
    star = Star(spark, folder)
    name, location = _namespace(spark, "cross")
    lake.replace_table(star.orders, f"{name}.orders", location=f"{location}/orders")
    customers = spark.read.parquet(lake.write_folder(star.customers, f"{location}/landing/customers"))
    return sales.customer_order_counts(spark.table(f"{name}.orders"), customers, ["customer_name"])


AUDITED_AT = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
AS_OF_DAY = "1996-05-17"


@query
def load_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The orders of the newest load not after a day, from a folder split by load date."""
    path = f"{workspace(spark, 'loads')}/orders"
    rows = Star(spark, folder).orders.withColumn("load_date", F.trunc("order_date", "month"))
    lake.write_dated_folder(rows, path)
    return lake.read_as_of_date(spark, path, AS_OF_DAY)


@query
def register_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Register the five folders, let the orders gain a column, register again."""
    name, location = _namespace(spark, "register")
    tables = Star(spark, folder).tables()
    early = sales.with_status(tables["orders"], "F").drop("num_items")
    late = tables["orders"].where(F.col("order_status") != "F")
    lake.LakeWriter(location, "parquet").write_all({**tables, "orders": early})
    folders.register_folders(spark, location, LAKE_TABLES, name)
    late.write.mode("append").parquet(f"{location}/orders")
    results = folders.register_folders(spark, location, LAKE_TABLES, name)
    registered = {table: spark.table(f"{name}.{table}") for table in LAKE_TABLES}
    return results.join(sales.table_row_counts(registered), "table_name").select(
        "table_name", "status", F.concat_ws(",", "added_columns").alias("added_columns"), "row_count"
    )


@query
def register_grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in subfolders of two kinds that do not fit together, registered as two tables; their rows.

    One subfolder has a column more, one comes after the first call, and two write amounts as text.
    """
    name, location = _namespace(spark, "grouped")
    orders = Star(spark, folder).orders
    as_text = orders.withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)").cast("string"))
    parts = {
        "a": orders.where("order_id % 4 = 0").drop("num_items"),
        "b old": as_text.where("order_id % 4 = 1"),
        "c": orders.where("order_id % 4 = 2"),
    }
    for part, rows in parts.items():
        lake.write_folder(rows, f"{location}/orders/{part}")
    folders.register_grouped(spark, name, "orders", f"{location}/orders")
    lake.write_folder(as_text.where("order_id % 4 = 3").drop("order_status"), f"{location}/orders/0 late")
    folders.register_grouped(spark, name, "orders", f"{location}/orders")
    shown = []
    for table in ("orders", "orders_b_old"):
        rows = spark.table(f"{name}.{table}").withColumn("table_name", F.lit(table))
        shown.append(rows.withColumn("total_amount", F.col("total_amount").cast("double")))
    return shown[0].unionByName(shown[1], allowMissingColumns=True).withColumnRenamed("_folder", "folder")


@query
def compacted_audit(spark: SparkSession, folder: str) -> DataFrame:
    """An audit table after many appended runs, with one row for each order, and a rewrite in few files.

    The rows that a filter on their time leaves, and how many files the table has.
    """
    name, location = _namespace(spark, "compacted")
    table = f"{name}.audit_stats"
    audit.create_audit_table(spark, table, f"{location}/audit")
    orders = Star(spark, folder).orders
    runs = 20
    for run in range(runs):
        some = orders.where(F.col("order_id") % runs == run).select(
            F.col("order_date").cast("timestamp").alias("audit_ts"),
            F.concat(F.lit("run-"), F.lit(run)).alias("job_run_id"),
            F.lit("orders").alias("source_table"),
            F.col("order_id").alias("source_row_count"),
            F.lit("copy").alias("target_table"),
            F.col("order_id").alias("target_row_count"),
            F.lit("COMPLETE").alias("sync_status"),
            F.lit(None).cast("string").alias("error_message"),
        )
        some.coalesce(1).write.insertInto(table)
    before, after = layout.compact_table(spark, table)
    late = spark.table(table).where("audit_ts >= TIMESTAMP '1997-01-01'")
    sums = late.agg(F.count(F.lit(1)).alias("late_rows"), F.sum("source_row_count").alias("late_ids"))
    return sums.select("*", F.lit(before >= runs).alias("had_many_files"), F.lit(after).cast("bigint").alias("files"))


@query
def changed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Which orders differ between a table and a copy with as many rows.

    Some amounts were changed, some statuses lost, and for each missing order there is one too many.
    """
    orders = Star(spark, folder).orders
    key = F.col("order_id")
    amount = F.when(key % 1000 == 7, F.col("total_amount") + 1).otherwise(F.col("total_amount"))
    status = F.when(key % 1000 != 8, F.col("order_status"))
    copy = orders.withColumns({"total_amount": amount, "order_status": status})
    copy = copy.withColumn("order_id", F.when(key % 1000 == 9, -key).otherwise(key))
    return verify.differences(orders, copy, ["order_id"])


@query
def verified_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """A refresh whose contents are verified by key while it is written."""
    source = _sources(spark, folder, "source")
    target, location = _namespace(spark, "verified")
    keys = {
        "organizations": ["org_id"],
        "products": ["product_id"],
        "customers": ["customer_id"],
        "orders": ["order_id"],
        "order_items": ["order_item_id"],
    }
    return refresh.refresh_tables(spark, source, target, location=location, keys=keys)


def _sources(spark: SparkSession, folder: str, purpose: str) -> str:
    """A namespace with the lake's tables, written once."""
    name, location = _namespace(spark, purpose)
    lake.LakeWriter(location, namespace=name).write_all(Star(spark, folder).tables())
    return name


@query
def replicate_status(spark: SparkSession, folder: str) -> DataFrame:
    source = _sources(spark, folder, "source")
    target, location = _namespace(spark, "replica")
    return refresh.refresh_tables(spark, source, target, location=location).drop("error")


def _part_of_lake(spark: SparkSession, folder: str, purpose: str) -> tuple[str, tuple[str, ...]]:
    """A namespace with all tables but the products, and a list that names them as well."""
    name, location = _namespace(spark, purpose)
    tables = Star(spark, folder).tables()
    lake.LakeWriter(location, namespace=name).write_all({t: rows for t, rows in tables.items() if t != "products"})
    return name, tuple(tables)


@query
def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of a refresh in which one table is missing."""
    source, tables = _part_of_lake(spark, folder, "source")
    target, location = _namespace(spark, "audited")
    refresh.refresh_with_audit(
        spark, source, target, f"{target}.audit_stats", "run-1", tables, location, audited_at=AUDITED_AT
    )
    # The namespaces have random names, so only the table part is comparable.
    names = {column: F.substring_index(column, ".", -1) for column in ("source_table", "target_table")}
    failed = F.when(F.col("error_message").isNotNull(), "failed")
    return spark.table(f"{target}.audit_stats").withColumns(names).withColumn("error_message", failed)


@query
def audit_times(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the audit rows of a refresh bear the time at which it ran."""
    source = _sources(spark, folder, "source")
    target, location = _namespace(spark, "timed")
    began = datetime.datetime.now(datetime.UTC)
    refresh.refresh_with_audit(spark, source, target, f"{target}.audit_stats", "run-now", location=location)
    ended = datetime.datetime.now(datetime.UTC)
    in_time = F.col("audit_ts").between(F.lit(began), F.lit(ended))
    names = F.substring_index("source_table", ".", -1).alias("table_name")
    return spark.table(f"{target}.audit_stats").select(names, in_time.alias("in_time"))


@query
def namespace_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of a namespace with their row counts."""
    name = _sources(spark, folder, "listed")
    spark.range(1).createOrReplaceTempView("not_a_table_of_the_namespace")
    tables = [row["tableName"] for row in lake.list_tables(spark, name).collect()]
    counts = sales.table_row_counts({table: spark.table(f"{name}.{table}") for table in tables})
    return lake.list_tables(spark, name).select(F.col("tableName").alias("table_name")).join(counts, "table_name")


@query
def refresh_partial_failure(spark: SparkSession, folder: str) -> DataFrame:
    """The overall status of a refresh in which one table is missing, with the rows copied."""
    source, tables = _part_of_lake(spark, folder, "source")
    target, location = _namespace(spark, "partial")
    results = refresh.refresh_tables(spark, source, target, tables, location=location)
    copied = results.agg(F.sum("target_rows").alias("copied_rows")).scalar()
    return refresh.overall_status(results).withColumn("copied_rows", copied)


#: What an older copy of the orders looks like.
OLD_ORDERS = """order_id BIGINT, customer_id INT, org_id BIGINT, order_date TIMESTAMP_NTZ, total_amount DOUBLE,
    num_items BIGINT, note STRING"""


def _older_copy(spark: SparkSession, folder: str) -> tuple[str, str, str]:
    """A source with orders and customers, and a target with an older copy of the orders."""
    name, location = _namespace(spark, "newer")
    star = Star(spark, folder)
    lake.LakeWriter(location, namespace=name).write_all({"orders": star.orders, "customers": star.customers})
    target, place = _namespace(spark, "older")
    spark.sql(f"CREATE TABLE {target}.orders ({OLD_ORDERS}) USING parquet LOCATION {lake.literal(f'{place}/orders')}")
    spark.sql(f"INSERT INTO {target}.orders VALUES (-1, 1, 1, TIMESTAMP_NTZ '2020-01-01 00:00:00', 1.5, 1, 'old')")
    return name, target, place


@query
def column_differences(spark: SparkSession, folder: str) -> DataFrame:
    """How an older copy differs from its source, and the rows of both after a refresh that keeps its columns."""
    source, target, place = _older_copy(spark, folder)
    tables = ("orders", "customers")
    found = reconcile.namespace_differences(spark, source, target, tables)
    results = refresh.refresh_tables(spark, source, target, tables, place, columns="target")
    return found.join(results.drop("error"), "table_name")


@query
def conformed_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The orders in a copy that kept its own columns and types."""
    source, target, place = _older_copy(spark, folder)
    refresh.refresh_table(spark, f"{source}.orders", f"{target}.orders", f"{place}/orders", columns="target")
    return spark.table(f"{target}.orders")


@query
def refresh_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Classified customers, refreshed twice, read by a role that may not see them."""
    name, location = _namespace(spark, "twice")
    customers = Star(spark, folder).customers
    governance.write_classified(customers, f"{name}.people", PEOPLE_CLASSES, "lake", f"{location}/people")
    for _ in range(2):
        refresh.refresh_table(spark, f"{name}.people", f"{name}.people_copy", f"{location}/people_copy")
    return governance.read_masked_table(spark, f"{name}.people_copy", governance.READER_ROLE)


# Governance


@query
def pii_columns_preview(spark: SparkSession, folder: str) -> DataFrame:
    """Marked columns with tag, mask and the number of values that the tag covers."""
    tables = Star(spark, folder).tables()
    schemas = {table: frame.schema for table, frame in tables.items()}
    marked = {table: names for table, schema in schemas.items() if (names := governance.marked_columns(schema))}
    preview = governance.pii_columns(governance.column_catalog(spark, schemas, "lake"))
    return preview.join(governance.covered_values(tables, marked), ["table_name", "column_name"])


@query
def pii_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tag rows of the marked columns with the row count of their table."""
    tables = Star(spark, folder).tables()
    catalog = governance.column_catalog(spark, {table: frame.schema for table, frame in tables.items()}, "lake")
    counts = sales.table_row_counts(tables).withColumnRenamed("table_name", "object_name")
    return governance.comment_tags(catalog, "LAKE").join(counts, "object_name")


@query
def customers_masked_reader(spark: SparkSession, folder: str) -> DataFrame:
    return governance.mask_by_comment(Star(spark, folder).customers, governance.READER_ROLE)


@query
def customers_masked_pii_reader(spark: SparkSession, folder: str) -> DataFrame:
    return governance.mask_by_comment(Star(spark, folder).customers, governance.PII_READER_ROLE)


@query
def synthetic_customers_masked_reader(spark: SparkSession, folder: str) -> DataFrame:
    rows = generate.customers(_ids(Star(spark, folder), "customer", "c_custkey"), AS_OF)
    return governance.mask_by_comment(rows, governance.READER_ROLE)


def _masked_directory(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """Store an employee directory with its classification as a property, read it under a role."""
    name, location = _namespace(spark, "directory")
    table = f"{name}.employee_directory_poc"
    rows = generate.employees(_ids(Star(spark, folder), "customer", "c_custkey"), AS_OF)
    governance.write_classified(
        rows, table, governance.EMPLOYEE_CLASSIFICATION, "synthetic-poc", f"{location}/employee_directory_poc"
    )
    return governance.read_masked_table(spark, table, role)


@query
def directory_masked_reader(spark: SparkSession, folder: str) -> DataFrame:
    return _masked_directory(spark, folder, governance.READER_ROLE)


@query
def directory_masked_pii_reader(spark: SparkSession, folder: str) -> DataFrame:
    return _masked_directory(spark, folder, governance.PII_READER_ROLE)


def _directory(org_id: Column) -> Column:
    return F.concat(F.lit("directory_"), org_id.cast("string"))


def _metadata_documents(star: Star) -> DataFrame:
    """One metadata document per product for the employee directory of its organization.

    The classes differ per document and include unknown ones; one document in ten holds a
    broken map, and every other one spells the column names in capitals.
    """
    labels = ["PII", "pii", "UNCLASSIFIED_PII", "none", "internal"]
    key = F.col("product_id")
    columns = schema_of("employee_directory_poc").fieldNames()
    upper = key % 2 == 1
    entries = []
    for column in columns:
        label = F.expr(choice(draw(7, column, "product_id"), labels))
        entries += [F.when(upper, F.lit(column.upper())).otherwise(F.lit(column)), label]
    broken = F.expr(below(draw(7, "broken", "product_id"), 10)) == 0
    classes = F.when(broken, F.lit('{"email": ')).otherwise(metadata.canonical_json(F.create_map(*entries)))
    properties = F.create_map(
        F.lit(governance.CLASSIFICATION_PROPERTY),
        classes,
        F.lit(governance.CLASSIFICATION_SCHEMA_PROPERTY),
        F.lit(governance.CLASSIFICATION_SCHEMA),
        F.lit(governance.TAG_PROPERTY),
        F.lit("PII"),
    )
    return star.products.select(
        _directory(F.col("org_id")).alias("table_name"),
        (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=key)).alias("modified"),
        F.to_json(F.struct(properties.alias("properties"))).alias("value"),
    )


def _newest_properties(star: Star) -> DataFrame:
    newest = metadata.newest_per_table(_metadata_documents(star), "table_name", "modified")
    return metadata.with_properties(newest)


PEOPLE_CLASSES = {"customer_segment": "UNCLASSIFIED_PII", "customer_name": "PII", "country": "none"}


@query
def masked_by_both_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Customers marked by comments, in a table whose classification names another column.

    What either marks is masked; a second table with a broken classification shows no more.
    """
    name, location = _namespace(spark, "routes")
    customers = Star(spark, folder).customers
    shown = []
    for table, text in (("named", '{"customer_segment": "PII"}'), ("broken", '{"customer_segment": ')):
        properties = {governance.CLASSIFICATION_PROPERTY: text}
        lake.replace_table(customers, f"{name}.{table}", location=f"{location}/{table}", properties=properties)
        shown.append(governance.read_masked_table(spark, f"{name}.{table}", governance.READER_ROLE))
    return shown[0].unionByName(shown[1])


def _customer_dates(star: Star) -> DataFrame:
    """Customers with the day of their last order: text, numbers and a date."""
    last_day = F.max("o_orderdate").cast("date").alias("last_order_date")
    last = star.base("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(last_day)
    customers = star.base("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return customers.join(last, "c_custkey", "left")


CUSTOMER_CLASSES = {
    "old": {"c_name": "NONE", "c_mktsegment": "PII"},
    "new": {"C_NAME": "PII", "c_custkey": "unclassified_pii", "c_nationkey": "NONE", "last_order_date": "PII"},
}


def _customer_metadata(spark: SparkSession) -> str:
    """Two metadata files of the customer table, the newer one deeper in the folder."""
    folder = workspace(spark, "metadata")
    for name, place in (("old", "v1.metadata.json"), ("new", "metadata/v2.metadata.json")):
        properties = governance.classification_properties(CUSTOMER_CLASSES[name], "lake")
        lake.write_text(spark, f"{folder}/{place}", json.dumps({"properties": properties}))
    return folder


@query
def newest_metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """The newest metadata file of the customer table, and how many values each class covers."""
    newest = metadata.newest_metadata(spark, _customer_metadata(spark))
    rows = _customer_dates(Star(spark, folder))
    counts = governance.covered_values({"customer": rows}, {"customer": rows.columns}).drop("table_name")
    text = metadata.json_property("properties", governance.CLASSIFICATION_PROPERTY)
    classes = newest.select(
        F.substring_index("file_path", "/", -1).alias("file_name"),
        F.explode(F.from_json(text, "map<string,string>")).alias("column_name", "class"),
    )
    return classes.withColumn("column_name", F.lower("column_name")).join(counts, "column_name")


def _tag_masked(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """From metadata files to tags to a masked read of the customers."""
    rows = _customer_dates(Star(spark, folder))
    newest = metadata.newest_metadata(spark, _customer_metadata(spark))
    catalog = governance.column_catalog(spark, {"customer": rows.schema}, "lake")
    tags = governance.property_tags(newest.withColumn("table_name", F.lit("customer")), catalog, "LAKE")
    return governance.mask_by_tags(rows, tags, "lake", "customer", role)


@query
def tag_masked_reader(spark: SparkSession, folder: str) -> DataFrame:
    return _tag_masked(spark, folder, governance.READER_ROLE)


@query
def tag_masked_pii_reader(spark: SparkSession, folder: str) -> DataFrame:
    return _tag_masked(spark, folder, governance.PII_READER_ROLE)


@query
def tag_report(spark: SparkSession, folder: str) -> DataFrame:
    """Marked columns, those without a mask, and the rows of the tables they are in."""
    tables = Star(spark, folder).tables()
    catalog = governance.column_catalog(spark, {table: frame.schema for table, frame in tables.items()}, "lake")
    rows = sales.table_row_counts(tables).join(governance.pii_columns(catalog), "table_name", "left_semi")
    return governance.tag_report(catalog).withColumn("covered_rows", rows.agg(F.sum("row_count")).scalar())


@query
def tag_references(spark: SparkSession, folder: str) -> DataFrame:
    """The classified columns of one organization's directory."""
    return governance.tag_references(property_tags(spark, folder), governance.PROPERTY_TAG, "lake", "directory_1")


@query
def verification_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A query text for each organization's directory."""
    return governance.verification_queries(_directory_catalog(Star(spark, folder)), "lake.tags")


@query
def property_classification(spark: SparkSession, folder: str) -> DataFrame:
    """The classification in the newest metadata document of every directory."""
    return _newest_properties(Star(spark, folder)).select(
        "table_name",
        "modified",
        metadata.json_property("properties", governance.CLASSIFICATION_PROPERTY).alias("pii_classification_json"),
        metadata.json_property("properties", governance.CLASSIFICATION_SCHEMA_PROPERTY).alias("pii_schema"),
        metadata.json_property("properties", governance.TAG_PROPERTY).alias("pii_tag"),
    )


def _directory_catalog(star: Star) -> DataFrame:
    """The columns of every organization's employee directory."""
    columns = F.array(
        *[
            F.struct(F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("data_type"))
            for field in schema_of("employee_directory_poc").fields
        ]
    )
    return star.base("supplier").select(
        F.lit("lake").alias("table_schema"), _directory(F.col("s_suppkey")).alias("table_name"), F.inline(columns)
    )


@query
def property_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Column tags of every organization's employee directory."""
    star = Star(spark, folder)
    return governance.property_tags(_newest_properties(star), _directory_catalog(star), "LAKE")


@query
def property_tag_totals(spark: SparkSession, folder: str) -> DataFrame:
    return governance.tag_totals(property_tags(spark, folder))


@query
def retagged_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Tags from the oldest document of every directory, then again from the newest.

    A column that the newest document does not class, or a directory where it is broken,
    keeps its old tag.
    """
    star = Star(spark, folder)
    oldest = metadata.oldest_per_table(_metadata_documents(star), "table_name", "modified")
    first = governance.property_tags(metadata.with_properties(oldest), _directory_catalog(star), "LAKE")
    return governance.retag(first, property_tags(spark, folder))


@query
def stored_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of every directory in a stored table: from the oldest documents, then from the newest, twice.

    Meanwhile the directories lose a column, and so the table its tags.
    """
    name, location = _namespace(spark, "tags")
    star = Star(spark, folder)
    catalog = _directory_catalog(star)
    oldest = metadata.oldest_per_table(_metadata_documents(star), "table_name", "modified")
    first = governance.property_tags(metadata.with_properties(oldest), catalog, "LAKE")
    governance.store_tags(first, f"{name}.tags", catalog, f"{location}/tags")
    left = catalog.where("column_name <> 'phone'")
    newest = governance.property_tags(_newest_properties(star), left, "LAKE")
    for _ in range(2):
        governance.store_tags(newest, f"{name}.tags", left)
    return spark.table(f"{name}.tags")


@query
def masked_by_stored_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Customers under both roles, masked by what a stored table of tags says after they were tagged anew."""
    name, location = _namespace(spark, "tagged")
    rows = _customer_dates(Star(spark, folder))
    catalog = governance.column_catalog(spark, {"customer": rows.schema}, "lake")
    for version in ("old", "new"):
        properties = F.create_map(
            F.lit(governance.CLASSIFICATION_PROPERTY), F.lit(json.dumps(CUSTOMER_CLASSES[version]))
        )
        documents = spark.range(1).select(F.lit("customer").alias("table_name"), properties.alias("properties"))
        tags = governance.property_tags(documents, catalog, "LAKE")
        governance.store_tags(tags, f"{name}.tags", catalog, f"{location}/tags")
    stored = spark.table(f"{name}.tags")
    shown = [
        governance.mask_by_tags(rows, stored, "lake", "customer", role).withColumn("role", F.lit(role))
        for role in (governance.READER_ROLE, governance.PII_READER_ROLE)
    ]
    return shown[0].unionByName(shown[1])


@query
def masking_views(spark: SparkSession, folder: str) -> DataFrame:
    """One view of the customers, read under two roles of the session.

    Comments mark some columns, the table's classification and a stored tag each another one.
    """
    name, location = _namespace(spark, "views")
    customers = Star(spark, folder).customers
    properties = governance.classification_properties({"customer_segment": "PII"}, "lake")
    lake.replace_table(customers, f"{name}.customers", location=f"{location}/customers", properties=properties)
    catalog = governance.catalog_of_namespace(spark, name)
    one = F.create_map(F.lit(governance.CLASSIFICATION_PROPERTY), F.lit('{"COUNTRY": "unclassified_pii"}'))
    documents = spark.range(1).select(F.lit("customers").alias("table_name"), one.alias("properties"))
    tags = governance.property_tags(documents, catalog, "LAKE")
    governance.store_tags(tags, f"{name}.tags", location=f"{location}/tags")
    governance.create_masking_views(spark, name, spark.table(f"{name}.tags"))
    shown = []
    for role in (governance.READER_ROLE, governance.PII_READER_ROLE):
        governance.set_role(spark, role)
        shown.append(spark.table("customers_masked").withColumn("role", F.lit(role)))
    return shown[0].unionByName(shown[1])


# Streaming


EVENT_DDL = (
    "event_id BIGINT NOT NULL, ts TIMESTAMP_NTZ NOT NULL, user_id BIGINT, event_type STRING, value DOUBLE, "
    "k INT NOT NULL"
)


def _land_events(spark: SparkSession, folder: str) -> str:
    """Stream the events as messages; error events come as plain text instead of JSON."""
    location = workspace(spark, "landing")
    # The glob makes the source take one file as well as a folder of files.
    events = spark.readStream.schema(BASE_DDL["events"]).parquet(f"{folder.rstrip('/')}/events.parque[t]")
    document = F.to_json(
        F.struct(
            "event_id",
            F.col("ts").cast("string").alias("ts"),
            "user_id",
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )
    )
    plain = F.concat_ws(" ", F.lit("error"), "event_id", "props")
    messages = events.select(F.when(F.col("event_type") == "error", plain).otherwise(document).alias("value"))
    landing.land(messages, StructType.fromDDL(EVENT_DDL), f"{location}/events", f"{location}/checkpoint").awaitTermination()
    return f"{location}/events"


@query
def land_events(spark: SparkSession, folder: str) -> DataFrame:
    return landing.landed(spark, StructType.fromDDL(EVENT_DDL), _land_events(spark, folder))


@query
def quarantine_events(spark: SparkSession, folder: str) -> DataFrame:
    return landing.quarantined(spark, _land_events(spark, folder))


@query
def landing_counts(spark: SparkSession, folder: str) -> DataFrame:
    return landing.landing_counts(spark, _land_events(spark, folder))


TOPIC_DDL = {
    "view": "event_id BIGINT NOT NULL, ts TIMESTAMP_NTZ NOT NULL, user_id BIGINT NOT NULL, k INT NOT NULL",
    "click": "event_id BIGINT NOT NULL, ts TIMESTAMP_NTZ NOT NULL, user_id BIGINT, k BIGINT",
    "purchase": "event_id BIGINT NOT NULL, ts TIMESTAMP_NTZ NOT NULL, value DOUBLE NOT NULL",
    "signup": "event_id BIGINT NOT NULL, ts TIMESTAMP_NTZ NOT NULL, user_id BIGINT, value DOUBLE",
}
TOPIC_COLUMNS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "value": "double", "k": "bigint"}


def _topic_schemas() -> dict[str, StructType]:
    return {topic: StructType.fromDDL(ddl) for topic, ddl in TOPIC_DDL.items()}


def _event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _topic_messages(events: DataFrame) -> DataFrame:
    """Events as messages of the topic that their type names; some of them are not as their topic asks.

    Purchases with an odd ``k`` have their value as text, signups with ``k`` 3 are plain text,
    and no schema is declared for errors.
    """
    as_text = (F.col("event_type") == "purchase") & (_event_k() % 2 == 1)
    document = F.to_json(
        F.struct(
            "event_id",
            F.col("ts").cast("string").alias("ts"),
            F.when(F.col("event_type") != "purchase", F.col("user_id")).alias("user_id"),
            F.when(as_text, F.lit("much")).alias("value_text"),
            F.when(~as_text & F.col("event_type").isin("purchase", "signup"), F.col("value")).alias("value"),
            F.when(F.col("event_type").isin("view", "click"), _event_k()).alias("k"),
        )
    )
    document = F.replace(document, F.lit('"value_text"'), F.lit('"value"'))
    plain = (F.col("event_type") == "signup") & (_event_k() == 3)
    text = F.when(plain, F.concat_ws(" ", F.lit("signup"), "event_id")).otherwise(document)
    return events.select(F.col("event_type").alias("topic"), F.col("event_id").alias("id"), text.alias("value"))


def _land_topics(spark: SparkSession, folder: str) -> str:
    location = workspace(spark, "topics")
    events = spark.readStream.schema(BASE_DDL["events"]).parquet(f"{folder.rstrip('/')}/events.parque[t]")
    landing_of = topics.land(_topic_messages(events), _topic_schemas(), f"{location}/topics", f"{location}/checkpoint")
    landing_of.awaitTermination()
    return f"{location}/topics"


def _all_topics(spark: SparkSession, target: str, verdict: str) -> DataFrame:
    """The rows of all topics with one verdict, with null for what a topic does not have."""
    found = None
    for topic, schema in _topic_schemas().items():
        rows = topics.landed(spark, schema, target, topic, verdict)
        own = [
            (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in TOPIC_COLUMNS.items()
        ]
        rows = rows.select(F.lit(topic).alias("topic"), *own)
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def land_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows of four topics with different schemas, landed from one stream."""
    return _all_topics(spark, _land_topics(spark, folder), landing.VALID)


@query
def quarantine_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Why messages were put in quarantine; their first number is the event's."""
    found = topics.quarantined(spark, _land_topics(spark, folder))
    return found.select("topic", "reason", F.regexp_extract("raw", r"(\d+)", 1).cast("bigint").alias("event_id"))


def _redelivered(spark: SparkSession, folder: str) -> str:
    """Two runs over one checkpoint: first the events with even ids, then all of them.

    Valid ones that are a week or more behind the newest of the first run are late.
    """
    location = workspace(spark, "redelivered")
    events = Star(spark, folder).base("events")
    for part in (events.where("event_id % 2 = 0"), events):
        _topic_messages(part).write.mode("append").parquet(f"{location}/in")
        stream = spark.readStream.schema("topic string, id bigint, value string").parquet(f"{location}/in")
        topics.land(
            stream, _topic_schemas(), f"{location}/topics", f"{location}/checkpoint", key="id", time="ts", lateness="7 days"
        ).awaitTermination()
    return f"{location}/topics"


@query
def redelivered_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events that landed in time when many came twice, each once."""
    return _all_topics(spark, _redelivered(spark, folder), landing.VALID)


@query
def redelivered_counts(spark: SparkSession, folder: str) -> DataFrame:
    return topics.topic_counts(spark, _redelivered(spark, folder))


#: Two versions of the fields of each topic, besides the event's id.
SCHEMA_PAIRS = {
    "view": ("k INT NOT NULL", "k BIGINT NOT NULL, value DOUBLE"),
    "click": ("k INT, user_id BIGINT", "k INT"),
    "purchase": ("value DOUBLE", "value DOUBLE NOT NULL, k INT"),
    "signup": ("k INT", "k STRING"),
    "error": ("k INT NOT NULL, day DATE", "k INT, day STRING NOT NULL"),
}


def _versions(topic: str) -> tuple[Column, Column]:
    """The documents of both versions: what a writer of each may well write."""
    k, user, value = _event_k(), F.col("user_id"), F.col("value")
    day = F.col("ts").cast("date").cast("string")
    old, new = {
        "view": ([k.alias("k")], [(k.cast("bigint") * 1_000_000_000).alias("k"), value]),
        "click": ([k.alias("k"), user], [k.alias("k")]),
        "purchase": ([F.when(k > 4, value).alias("value")], [value, k.alias("k")]),
        "signup": ([k.alias("k")], [k.cast("string").alias("k")]),
        "error": ([k.alias("k"), F.when(k > 4, day).alias("day")], [k.alias("k"), F.concat(F.lit("day "), day).alias("day")]),
    }[topic]
    return F.to_json(F.struct("event_id", *old)), F.to_json(F.struct("event_id", *new))


@query
def schema_compatibility(spark: SparkSession, folder: str) -> DataFrame:
    """What two versions of each topic's schema can read of each other, and what they did read.

    The events are written as messages under each version and read under the other.
    """
    events = Star(spark, folder).base("events")
    pairs = {
        topic: tuple(StructType.fromDDL(f"event_id BIGINT NOT NULL, {fields}") for fields in versions)
        for topic, versions in SCHEMA_PAIRS.items()
    }

    def one(topic: str) -> tuple:
        old, new = pairs[topic]
        own = events.where(F.col("event_type") == topic)
        by_old, by_new = _versions(topic)
        forth = topics.replay(own.select(by_old.alias("value")), new).first()
        back = topics.replay(own.select(by_new.alias("value")), old).first()
        return topic, *forth, *back

    counts = "pair string, new_reads bigint, new_refuses bigint, old_reads bigint, old_refuses bigint"
    replayed = spark.createDataFrame(side_by_side(spark, one, pairs), counts)
    return topics.compatibility_table(spark, pairs).join(replayed, "pair")


@query
def strict_json(spark: SparkSession, folder: str) -> DataFrame:
    """The events' properties, parsed so that a broken one would fail the query."""
    events = Star(spark, folder).base("events")
    return events.select("event_id", metadata.required_json("props", "k BIGINT")["k"].alias("k"))
