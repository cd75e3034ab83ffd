"""Edge cases of the analyses on hand-made rows."""

import pytest

from tidemark.functions.money import money_total
from tidemark.operators import sales


@pytest.fixture
def lines(spark):
    return spark.createDataFrame(
        [(1, 10, 2, 0.10), (1, 11, 1, 0.20), (2, 11, 1, 0.20), (3, 10, 3, 0.30), (4, 99, 1, 5.0)],
        "order_id BIGINT, product_id BIGINT, quantity INT, subtotal DOUBLE",
    )


@pytest.fixture
def products(spark):
    return spark.createDataFrame(
        [(10, "Tea", "Food"), (11, "Lamp", "Home"), (12, "Plant", "Home")],
        "product_id BIGINT, product_name STRING, category STRING",
    )


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [(1, 7, 1, 10.0), (2, 5, 1, 10.0), (3, 6, 2, 4.0), (4, 6, None, 1.0), (5, 404, 9, 2.0)],
        "order_id BIGINT, customer_id BIGINT, org_id BIGINT, total_amount DOUBLE",
    )


@pytest.fixture
def customers(spark):
    return spark.createDataFrame(
        [(5, "Ann", "UK"), (6, "Bob", "USA"), (7, "Cy", "UK"), (8, "Di", "UK")],
        "customer_id BIGINT, customer_name STRING, country STRING",
    )


@pytest.fixture
def organizations(spark):
    return spark.createDataFrame(
        [(1, "A", "USA"), (2, "B", "UK"), (3, "C", "UK")], "org_id BIGINT, org_name STRING, country STRING"
    )


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def test_unknown_customer_is_dropped(orders, customers):
    assert {row.order_id for row in sales.orders_with_customers(orders, customers).collect()} == {1, 2, 3, 4}


def test_line_of_unknown_product_is_dropped(lines, products):
    assert sales.order_items_with_products(lines, products).count() == 4


def test_chain_keeps_both_countries_and_can_be_written(orders, customers, organizations, tmp_path):
    chain = sales.order_chain(orders, customers, organizations)
    chain.write.parquet(str(tmp_path / "chain"))
    found = {row.order_id: (row.customer_country, row.org_country) for row in chain.collect()}
    assert found == {1: ("UK", "USA"), 2: ("UK", "USA"), 3: ("USA", "UK")}


def test_ties_go_to_the_lower_key(lines, orders):
    assert rows(sales.top_products(lines, 2)) == [(10, 2), (11, 2)]
    assert rows(sales.customer_spending(orders, 2)) == [(5, 10.0, 1), (7, 10.0, 1)]


def test_limit_beyond_the_rows(lines):
    assert sales.top_products(lines, 50).count() == 3


def test_performance_leaves_out_what_was_never_sold(lines, products, orders, organizations):
    assert rows(sales.product_performance(products, lines).select("product_id", "total_revenue", "total_quantity_sold")) == [
        (10, 0.4, 5),
        (11, 0.4, 2),
    ]
    assert rows(sales.organization_performance(orders, organizations).select("org_id", "total_revenue", "total_orders")) == [
        (1, 20.0, 2),
        (2, 4.0, 1),
    ]


def test_category_sales_equal_join_then_sum(spark, lines, products):
    assert rows(sales.category_sales(products, lines)) == [("Food", 0.4, 5), ("Home", 0.4, 2)]
    twice = products.unionAll(spark.createDataFrame([(10, "Tea", "Food")], products.schema))
    assert rows(sales.category_sales(twice, lines))[0] == ("Food", 0.8, 10)


def test_money_is_summed_exactly(spark):
    orders = spark.range(1, 100001).selectExpr("id AS order_id", "1L AS customer_id", "0.1D AS total_amount")
    assert rows(sales.customer_spending(orders)) == [(1, 10000.0, 100000)]


def test_order_list_and_counts(orders, customers):
    assert rows(sales.order_customer_list(orders, customers, ["customer_name"], 2)) == [(1, "Cy", 10.0), (2, "Ann", 10.0)]
    assert rows(sales.customer_order_counts(orders, customers, ["customer_name"], 2)) == [(6, "Bob", 2), (5, "Ann", 1)]


def test_status_is_case_sensitive(spark):
    orders = spark.createDataFrame([(1, "Completed"), (2, "completed")], "order_id BIGINT, order_status STRING")
    assert rows(sales.with_status(orders, "completed")) == [(2, "completed")]


def test_summary(orders, customers, organizations, products, lines):
    summary = sales.dataset_summary(organizations, products, customers, orders, lines).first()
    assert tuple(summary) == (3, 3, 4, 5, 5, 27.0, 5.4)


def test_summary_of_nothing_is_zero(orders, customers, organizations, products, lines):
    none = [frame.limit(0) for frame in (organizations, products, customers, orders, lines)]
    assert tuple(sales.dataset_summary(*none).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)


def test_row_counts_and_preview(orders, lines):
    assert rows(sales.table_row_counts({"orders": orders, "none": lines.limit(0)})) == [("orders", 5), ("none", 0)]
    assert sales.preview(orders, 3).count() == 3
    assert [row.order_id for row in sales.preview(orders, 2, ["order_id"]).collect()] == [1, 2]


def test_sums_are_rounded_once_and_survive_nan(spark):
    rows = [(1, 0.125)] * 8 + [(2, float("nan")), (2, 1.5), (3, float("inf")), (4, None), (5, 1e12), (5, 0.01)]
    totals = spark.createDataFrame(rows, "k INT, v DOUBLE").groupBy("k").agg(money_total("v").cast("double").alias("t"))
    assert {row.k: row.t for row in totals.collect()} == {1: 1.0, 2: 1.5, 3: None, 4: None, 5: 1e12 + 0.01}


def test_first_orders_without_customers_are_passed_over(spark):
    orders = spark.range(200).selectExpr("id AS order_id", "IF(id < 90, -1, id) AS customer_id", "1.0D AS total_amount")
    customers = spark.range(200).selectExpr("id AS customer_id", "CAST(id AS STRING) AS name")
    found = sales.order_customer_list(orders, customers, ["name"], limit=20).collect()
    assert [row.order_id for row in found] == list(range(90, 110))
    few = sales.order_customer_list(orders, customers.where("customer_id = 150"), ["name"]).collect()
    assert [row.order_id for row in few] == [150]
