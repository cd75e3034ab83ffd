"""The lake's five tables as views over a TPC-H-like star schema.

Every frame is a lazy projection, so a query reads only the columns it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schemas import PII_COMMENT

# Declared rather than inferred: inference costs one job per table read.
BASE_DDL = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def _pii(column: Column, name: str) -> Column:
    return column.alias(name, metadata={"comment": PII_COMMENT})


def line_digest(columns: list[Column]) -> Column:
    """An MD5 that tells apart any two different rows of ``columns``.

    Every value counts in full: numbers with all their digits, times with their fractions,
    and NULL unlike any text.
    """
    parts = []
    for column in columns:
        text = F.replace(F.replace(column.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
        parts.append(F.coalesce(text, F.lit("\\0")))
    return F.md5(F.concat_ws("|", *parts))


class Star:
    """Lake tables derived from the base tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE_DDL[name]).parquet(f"{self.folder}/{name}.parquet")

    def row_total(self, name: str) -> Column:
        """Row count of a base table as a scalar subquery, answered from file footers."""
        return self.base(name).select(F.count(F.lit(1))).scalar()

    @property
    def organizations(self) -> DataFrame:
        """One organization per supplier; its region stands in for the industry."""
        return (
            self.base("supplier")
            .join(self.base("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("org_id"),
                F.col("s_name").alias("org_name"),
                F.col("r_name").alias("industry"),
                F.col("n_name").alias("country"),
            )
        )

    @property
    def products(self) -> DataFrame:
        """Parts, dealt to the organizations by key.

        The base tables name a supplier per order line, not per part. Taking it from the
        lines would scan and shuffle the largest table for every read of the products.
        Supplier keys must be 0 to n-1; others fail the query when ``org_id`` is read.
        """
        total = self.row_total("supplier")
        last = self.base("supplier").select(F.max("s_suppkey") + F.min("s_suppkey")).scalar()
        org_id = F.when(last == total - 1, F.col("p_partkey") % total).otherwise(
            F.raise_error(F.lit("supplier keys have gaps")).cast("bigint")
        )
        return self.base("part").select(
            F.col("p_partkey").alias("product_id"),
            org_id.alias("org_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"),
            F.col("p_size").alias("stock_quantity"),
        )

    @property
    def customers(self) -> DataFrame:
        return (
            self.base("customer")
            .join(self.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                _pii(F.col("c_custkey"), "customer_id"),
                _pii(F.col("c_name"), "customer_name"),
                _pii(F.col("n_name"), "country"),
                _pii(F.col("c_acctbal"), "account_balance"),
                F.col("c_mktsegment").alias("customer_segment"),
            )
        )

    @property
    def orders(self) -> DataFrame:
        """All orders; the organization is the lowest supplier key among the lines.

        An order without lines keeps a NULL organization. The line statistics are unique
        per order, so Catalyst drops the left join when a query uses neither of them.
        """
        per_order = (
            self.base("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.min("l_suppkey").alias("org_id"), F.count(F.lit(1)).alias("num_lines"))
        )
        return (
            self.base("orders")
            .join(per_order, "o_orderkey", "left")
            .select(
                F.col("o_orderkey").alias("order_id"),
                _pii(F.col("o_custkey"), "customer_id"),
                "org_id",
                F.col("o_orderdate").cast("date").alias("order_date"),
                F.col("o_totalprice").alias("total_amount"),
                F.coalesce("num_lines", F.lit(0)).cast("int").alias("num_items"),
                F.col("o_orderstatus").alias("order_status"),
            )
        )

    @property
    def order_items(self) -> DataFrame:
        """Order lines, identified by a digest of the whole line.

        The keys of a line repeat in the base table; only whole lines do not. Numbering the
        lines of an order would need one task per order, however large the order is; a
        digest needs no shuffle and survives recomputation.
        """
        lines = self.base("lineitem")
        return lines.select(
            line_digest([F.col(name) for name in lines.columns]).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
            F.col("l_extendedprice").alias("subtotal"),
        )

    def tables(self) -> dict[str, DataFrame]:
        return {
            "organizations": self.organizations,
            "products": self.products,
            "customers": self.customers,
            "orders": self.orders,
            "order_items": self.order_items,
        }
