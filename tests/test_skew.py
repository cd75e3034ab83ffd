"""Hot keys: whole results, and no task that holds a hot key alone."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.skew import join_hot_keys, number_within
from tidemark.operators import sales


def _orders(spark, rows=60_000):
    """A third of the rows belongs to customer 0; the others are spread over 5000."""
    return spark.range(rows).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("customer_id"),
        F.repeat(F.lit("x"), 50).alias("pad"),
    )


def test_join_hot_keys_equals_the_plain_join(spark):
    facts = _orders(spark)
    lookup = facts.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where("customer_id % 7 <> 1")
    salted = join_hot_keys(facts, lookup, "customer_id", "order_id", partitions=64)
    plain = facts.join(lookup, "customer_id")
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_hot_key_is_spread_over_tasks(spark):
    facts = _orders(spark)
    lookup = facts.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_hot_keys(facts, lookup, "customer_id", "order_id", partitions=300)
        hot = joined.where("customer_id = 0").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(row["count"] for row in hot) == 20_000
    assert len(hot) == 8 and max(row["count"] for row in hot) < 5_000


def test_adaptive_execution_splits_a_hot_customer(spark):
    """Both sides of the fact joins come straight from a shuffle, so the split applies."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        customers = spark.range(5001).select(F.col("id").alias("customer_id"), F.lit("n").alias("customer_name"))
        joined = sales.orders_with_customers(_orders(spark), customers)
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert len(rows) == 60_000
    assert "skew=true" in plan


def test_number_within_counts_every_group_from_zero(spark):
    frame = spark.range(9_000).select(
        F.col("id").alias("key"), F.when(F.col("id") < 3_000, 0).otherwise(F.col("id") % 1000).alias("group")
    )
    numbered = number_within(frame, "group", "key", "position", blocks=13)
    found = {}
    for row in numbered.collect():
        found.setdefault(row["group"], []).append(row["position"])
    assert sum(map(len, found.values())) == 9_000
    assert all(sorted(positions) == list(range(len(positions))) for positions in found.values())
    again = number_within(frame.repartition(3), "group", "key", "position", blocks=13)
    assert numbered.exceptAll(again).isEmpty()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    keys=st.lists(st.integers(0, 4) | st.none(), max_size=30),
    lookup=st.lists(st.integers(0, 6), max_size=8),
    partitions=st.integers(1, 40),
)
def test_any_keys_join_like_the_plain_join(spark, keys, lookup, partitions):
    """Small inputs of every shape: empty sides, missing keys, repeated lookup keys."""
    facts = spark.createDataFrame(list(enumerate(keys)), "id BIGINT, k BIGINT")
    other = spark.createDataFrame([(key, f"v{n}") for n, key in enumerate(lookup)], "k BIGINT, v STRING")
    found = join_hot_keys(facts, other, "k", "id", partitions).collect()
    expected = [(key, row, f"v{n}") for row, key in enumerate(keys) for n, entry in enumerate(lookup) if key == entry]
    assert sorted(tuple(row) for row in found) == sorted(expected)
