"""What the queries leave behind."""

from tidemark import queries

FOLDER = "/root/testdata/sf0.001"


def databases(spark):
    return {row[0] for row in spark.sql("SHOW DATABASES").collect()}


def test_round_trips_leave_nothing(spark):
    before = databases(spark)
    for name in ("parquet_roundtrip", "table_roundtrip", "declared_folder_read"):
        assert {row.same for row in queries.REGISTRY[name](spark, FOLDER).collect()} == {True}
    assert databases(spark) == before


def test_namespaces_can_be_dropped(spark):
    queries.REGISTRY["replicate_status"](spark, FOLDER).collect()
    assert queries.drop_namespaces(spark) >= 2
    assert not [name for name in databases(spark) if name.startswith(queries.NAMESPACE_PREFIX)]
