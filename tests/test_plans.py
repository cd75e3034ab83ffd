"""What the plans must look like to hold at scale."""

import re

import pytest

from tidemark.plans import governance
from tidemark.queries import REGISTRY, _directory_catalog
from tidemark.sources.star import Star

FOLDER = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(frame):
    """Columns read per base table."""
    found = {}
    for scan in re.findall(r"FileScan parquet.*", physical(frame)):
        table = re.search(r"/(\w+)\.parquet\]", scan).group(1)
        columns = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
        found.setdefault(table, []).append({column.split(":")[0] for column in columns.split(",") if column})
    return found


def test_no_document_body_is_sorted(spark):
    """Bodies are joined to the newest of every table, not kept in an aggregation of their own."""
    for name in ("property_classification", "property_tags", "property_tag_totals", "retagged_columns"):
        for line in physical(REGISTRY[name](spark, FOLDER)).splitlines():
            assert not ("SortAggregate" in line and "value#" in line)


LAZY = [
    "orders_with_customers",
    "order_items_with_products",
    "order_chain",
    "order_customer_list",
    "top_products",
    "customer_spending",
    "organization_performance",
    "product_performance",
    "category_sales",
    "dataset_summary",
    "table_row_counts",
    "orders_by_status",
    "customers_preview",
    "gen_organizations",
    "gen_products",
    "gen_customers",
    "gen_orders",
    "gen_order_items",
    "gen_employees",
    "customers_masked_reader",
    "property_classification",
    "property_tags",
    "property_tag_totals",
    "retagged_columns",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_no_python_no_single_task_windows(spark, name):
    plan = physical(REGISTRY[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Scan ExistingRDD" not in plan
    # One task may only receive the rows of a global aggregate, one per map task.
    for before, line in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[]" in before


def test_analyses_read_only_their_columns(spark):
    def columns(name):
        return scans(REGISTRY[name](spark, FOLDER))

    assert columns("top_products") == {"lineitem": [{"l_partkey"}]}
    assert columns("customer_spending") == {"orders": [{"o_orderkey", "o_custkey", "o_totalprice"}]}
    assert columns("category_sales") == {
        "lineitem": [{"l_partkey", "l_quantity", "l_extendedprice"}],
        "part": [{"p_partkey", "p_type"}],
    }
    found = columns("organization_performance")
    assert found["lineitem"] == [{"l_orderkey", "l_suppkey"}]
    assert found["orders"] == [{"o_orderkey", "o_totalprice"}]
    assert columns("product_performance")["lineitem"] == [{"l_partkey", "l_quantity", "l_extendedprice"}]


def test_counts_read_no_columns_of_the_large_tables(spark):
    found = scans(REGISTRY["table_row_counts"](spark, FOLDER))
    assert found["lineitem"] == [set()] and found["orders"] == [set()] and found["part"] == [set()]
    found = scans(REGISTRY["dataset_summary"](spark, FOLDER))
    assert found["lineitem"] == [set()] and found["orders"] == [{"o_totalprice"}]


def test_unused_line_statistics_are_not_computed(spark):
    star = Star(spark, FOLDER)
    assert "lineitem" not in scans(star.orders.select("order_id", "total_amount"))
    assert "lineitem" in scans(star.orders.select("order_id", "num_items"))


def test_filters_reach_the_scan(spark):
    plan = physical(REGISTRY["orders_by_status"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderstatus,F\)", plan)


@pytest.mark.parametrize("name", ["top_products", "customer_spending", "order_customer_list", "customers_preview"])
def test_top_k_keeps_k_rows_per_task(spark, name):
    assert "TakeOrderedAndProject" in physical(REGISTRY[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["organization_performance", "product_performance", "category_sales"])
def test_aggregates_combine_before_every_shuffle(spark, name):
    plan = physical(REGISTRY[name](spark, FOLDER))
    keyed = re.findall(r"HashAggregate\(keys=\[\w.*", plan)
    partial = [line for line in keyed if "partial_" in line]
    assert len(keyed) == 2 * len(partial) >= 2


def test_category_sums_come_before_the_join(spark):
    plan = physical(REGISTRY["category_sales"](spark, FOLDER)).splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert any("partial_sum" in line for line in plan[join:])


def test_joins_do_not_rely_on_broadcast(spark):
    """With broadcasting off, the fact joins shuffle both sides directly and can be split."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("orders_with_customers", "order_items_with_products", "order_chain"):
            plan = physical(REGISTRY[name](spark, FOLDER)).splitlines()
            top = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line)
            depth = len(plan[top]) - len(plan[top].lstrip(" :+-"))
            sides = [
                (i, line)
                for i, line in enumerate(plan[top + 1 :], top + 1)
                if len(line) - len(line.lstrip(" :+-")) == depth + 3
            ][:2]
            assert len(sides) == 2
            for i, line in sides:
                assert "Sort [" in line and "Exchange hashpartitioning" in plan[i + 1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_generated_orders_need_no_shuffle(spark):
    plan = optimized(REGISTRY["gen_orders"](spark, FOLDER))
    assert "Join" not in plan.split("Subquery")[0]
    assert "Exchange hashpartitioning" not in physical(REGISTRY["gen_orders"](spark, FOLDER))


def test_tags_and_documents_are_not_broadcast(spark):
    """What the planner expects of parsed and exploded rows says nothing; they would go through the driver."""
    for name in ("property_classification", "property_tags", "property_tag_totals", "retagged_columns", "tag_references"):
        assert "BroadcastHashJoin" not in physical(REGISTRY[name](spark, FOLDER)), name
    star = Star(spark, FOLDER)
    tags = REGISTRY["property_tags"](spark, FOLDER)
    plan = physical(governance.of_existing_columns(tags, _directory_catalog(star)))
    # The schemas alone, one row each.
    assert plan.count("BroadcastHashJoin") <= 1 and "SortMergeJoin" in plan.split("LeftSemi")[0].splitlines()[-1]
