"""The lake's tables over the star schema."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans.governance import marked_columns
from tidemark.sources.star import Star, line_digest


@pytest.fixture(scope="module")
def star(spark, data):
    return Star(spark, f"{data}/")


def test_keys_are_unique_and_references_close(star):
    tables = star.tables()
    keys = {
        "organizations": "org_id",
        "products": "product_id",
        "customers": "customer_id",
        "orders": "order_id",
        "order_items": "order_item_id",
    }
    for table, key in keys.items():
        assert tables[table].select(key).distinct().count() == tables[table].count() > 0
    for child, parent, key in [
        ("products", "organizations", "org_id"),
        ("orders", "customers", "customer_id"),
        ("order_items", "orders", "order_id"),
        ("order_items", "products", "product_id"),
    ]:
        assert tables[child].join(tables[parent], key, "left_anti").isEmpty()
    assert tables["orders"].where("org_id IS NOT NULL").join(tables["organizations"], "org_id", "left_anti").isEmpty()


def test_orders_without_lines_are_kept(star):
    orders = star.orders
    assert orders.count() == star.base("orders").count()
    assert orders.where((F.col("org_id").isNull()) != (F.col("num_items") == 0)).isEmpty()
    assert orders.agg(F.sum("num_items")).first()[0] == star.base("lineitem").count()


def test_marked_columns(star):
    marked = {table: marked_columns(frame.schema) for table, frame in star.tables().items()}
    assert marked == {
        "organizations": [],
        "products": [],
        "customers": ["customer_id", "customer_name", "country", "account_balance"],
        "orders": ["customer_id"],
        "order_items": [],
    }


def test_declared_base_types_are_the_stored_ones(spark, star, data):
    for table in ("customer", "supplier", "part", "orders", "lineitem", "events", "nation", "region"):
        assert star.base(table).dtypes == spark.read.parquet(f"{data}/{table}.parquet").dtypes


def test_digest_tells_any_two_lines_apart(spark):
    rows = [
        (1, 1.0, "a", "b"),
        (1, 1.0000000000000002, "a", "b"),
        (1, 1.5, "a", "b"),
        (1, 1.0, None, "b"),
        (1, 1.0, "a", None),
        (1, 1.0, "\\0", "b"),
        (1, 1.0, "a|b", ""),
        (1, 1.0, "a", "|b"),
        (1, 1.0, "", "a|b"),
        (None, 1.0, "a", "b"),
        (11, 1.0, "a", "b"),
    ]
    frame = spark.createDataFrame(rows, "a INT, b DOUBLE, c STRING, d STRING")
    digest = line_digest([F.col(name) for name in frame.columns])
    assert frame.select(digest).distinct().count() == len(rows)
    assert frame.unionAll(frame).select(digest).distinct().count() == len(rows)


def test_a_line_of_quantity_zero_and_a_gap_in_the_suppliers(spark, data, tmp_path):
    for table in ("part", "supplier", "lineitem"):
        frame = spark.read.parquet(f"{data}/{table}.parquet")
        if table == "lineitem":
            frame = frame.withColumn("l_quantity", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity")))
        if table == "supplier":
            frame = frame.where("s_suppkey <> 3")
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    star = Star(spark, str(tmp_path))
    assert star.order_items.where("unit_price IS NULL").count() > 0
    assert star.products.select("product_id").count() > 0
    with pytest.raises(Exception, match="supplier keys have gaps"):
        star.products.select("org_id").collect()
