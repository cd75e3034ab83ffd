"""Joins and aggregations over customers, products, organizations and orders.

Joins carry no broadcast hint: Spark broadcasts a side only when its measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides, where
adaptive execution splits a partition made large by a hot key. Aggregations that feed a
join run before it, so a hot key reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import money_total


def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers, "customer_id")


def order_items_with_products(order_items: DataFrame, products: DataFrame) -> DataFrame:
    return order_items.join(products, "product_id")


def order_chain(orders: DataFrame, customers: DataFrame, organizations: DataFrame) -> DataFrame:
    """Orders with customer and organization details; both countries are kept apart."""
    return orders.join(customers.withColumnRenamed("country", "customer_country"), "customer_id").join(
        organizations.withColumnRenamed("country", "org_country"), "org_id"
    )


def order_customer_list(
    orders: DataFrame, customers: DataFrame, names: list[str], limit: int = 20
) -> DataFrame:
    """The first orders by id that have a customer, with the customer's name columns.

    Which orders have one is decided by keys alone; the names are looked up for ``limit`` orders.
    """
    known = orders.join(customers.select("customer_id"), "customer_id", "left_semi")
    first = known.select("order_id", "customer_id", "total_amount").orderBy("order_id").limit(limit)
    listed = first.join(customers.select("customer_id", *names), "customer_id")
    return listed.select("order_id", *names, "total_amount").orderBy("order_id").limit(limit)


def customer_order_counts(
    orders: DataFrame, customers: DataFrame, names: list[str], limit: int = 10
) -> DataFrame:
    """Customers with the most orders; the two frames may come from different catalogs."""
    per_customer = orders.groupBy("customer_id").agg(F.count("order_id").alias("n"))
    return (
        per_customer.join(customers.select("customer_id", *names), "customer_id")
        .groupBy("customer_id", *names)
        .agg(F.sum("n").alias("total_orders"))
        .orderBy(F.desc("total_orders"), "customer_id", *names)
        .limit(limit)
    )


def top_products(order_items: DataFrame, limit: int = 5) -> DataFrame:
    """Products with the most order lines; the lower id first on a tie."""
    return (
        order_items.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "product_id")
        .limit(limit)
    )


def customer_spending(orders: DataFrame, limit: int = 5) -> DataFrame:
    """Customers with the highest order total; the lower id first on a tie."""
    return (
        orders.groupBy("customer_id")
        .agg(money_total("total_amount").alias("spent"), F.count("order_id").alias("num_orders"))
        .orderBy(F.desc("spent"), "customer_id")
        .limit(limit)
        .select("customer_id", F.col("spent").cast("double").alias("total_spent"), "num_orders")
    )


def organization_performance(orders: DataFrame, organizations: DataFrame) -> DataFrame:
    per_org = orders.groupBy("org_id").agg(
        money_total("total_amount").cast("double").alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
    )
    return per_org.join(organizations, "org_id").orderBy(F.desc("total_revenue"), "org_id")


def product_performance(products: DataFrame, order_items: DataFrame) -> DataFrame:
    per_product = order_items.groupBy("product_id").agg(
        money_total("subtotal").cast("double").alias("total_revenue"),
        F.sum("quantity").alias("total_quantity_sold"),
    )
    return per_product.join(products, "product_id").orderBy(F.desc("total_revenue"), "product_id")


def category_sales(products: DataFrame, order_items: DataFrame) -> DataFrame:
    """Revenue and quantity per category, summed per product before the join."""
    per_product = order_items.groupBy("product_id").agg(
        money_total("subtotal").alias("revenue"), F.sum("quantity").alias("quantity")
    )
    return (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(
            F.sum("revenue").cast("double").alias("category_revenue"),
            F.sum("quantity").alias("category_quantity"),
        )
        .orderBy(F.desc("category_revenue"), "category")
    )


def with_status(orders: DataFrame, status: str) -> DataFrame:
    """Orders whose status equals ``status``, case included."""
    return orders.where(F.col("order_status") == status)


def preview(frame: DataFrame, limit: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first rows; name ``order_by`` for the same rows on every run."""
    return (frame.orderBy(*order_by) if order_by else frame).limit(limit)


def row_total(frame: DataFrame) -> DataFrame:
    """One row with the frame's row count."""
    return frame.agg(F.count(F.lit(1)).alias("row_count"))


def _scalar_count(frame: DataFrame) -> Column:
    return row_total(frame).scalar()


def dataset_summary(
    organizations: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    order_items: DataFrame,
) -> DataFrame:
    """Row counts of the five tables, total and average order value (0 without orders)."""
    total = F.coalesce(F.col("total"), F.lit(0))
    return orders.agg(
        F.count(F.lit(1)).alias("orders_count"), money_total("total_amount").alias("total")
    ).select(
        _scalar_count(organizations).alias("organizations_count"),
        _scalar_count(products).alias("products_count"),
        _scalar_count(customers).alias("customers_count"),
        "orders_count",
        _scalar_count(order_items).alias("order_items_count"),
        total.cast("double").alias("total_order_value"),
        F.coalesce(F.try_divide(total.cast("double"), F.col("orders_count")), F.lit(0.0)).alias(
            "avg_order_value"
        ),
    )


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, answered from Parquet footers where possible."""
    counts = None
    for name, frame in tables.items():
        one = row_total(frame).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionAll(one)
    return counts
