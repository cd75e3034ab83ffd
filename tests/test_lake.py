"""Reading and writing folders and catalog tables."""

import datetime
import os
import time
import uuid
from unittest import mock

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType

from tidemark.plans import generate
from tidemark.sources import lake
from tidemark.sources.schemas import LAKE_TABLES, schema_of

AS_OF = "2026-01-01"


@pytest.fixture
def namespace(spark, tmp_path):
    name = f"ns_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    return name


@pytest.fixture(scope="module")
def tables(spark):
    return generate.dataset(spark, AS_OF, 3, 20, 50)


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_arguments_are_checked_before_any_work():
    for build in (
        lambda: lake.LakeWriter(format="orc"),
        lambda: lake.LakeWriter(format="parquet"),
        lambda: lake.LakeWriter(on_error="ignore"),
        lambda: lake.LakeWriter(on_error="parquet"),
        lambda: lake.LakeReader(None, format="csv"),
        lambda: lake.LakeReader(None, format="parquet"),
        lambda: lake.LakeWriter("/nowhere", "parquet").write_table(None, "t"),
    ):
        with pytest.raises(ValueError):
            build()


def test_folders_round_trip(spark, tables, tmp_path):
    base = f"{tmp_path}/lake/"
    places = lake.LakeWriter(base, "PARQUET").write_all(tables)
    assert places["orders"] == f"{tmp_path}/lake/orders"
    stored = lake.LakeReader(spark, base, "parquet").read_all()
    assert tuple(stored) == LAKE_TABLES
    for table, frame in stored.items():
        assert same(frame, tables[table])
        assert [f.dataType for f in frame.schema] == [f.dataType for f in schema_of(table)]


def test_folder_is_overwritten(spark, tmp_path):
    lake.write_folder(spark.range(10), f"{tmp_path}/t")
    lake.write_folder(spark.range(3), f"{tmp_path}/t", max_records_per_file=1)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert len(list((tmp_path / "t").glob("*.parquet"))) >= 3


def test_tables_round_trip_with_comments(spark, tables, namespace):
    writer = lake.LakeWriter(namespace=namespace)
    names = writer.write_all(tables)
    assert names["customers"] == f"{namespace}.customers"
    stored = lake.LakeReader(spark, namespace=namespace).read_all()
    for table, frame in stored.items():
        assert same(frame, tables[table])
        assert {f.name: lake.comment_of(f) for f in frame.schema} == {
            f.name: lake.comment_of(f) for f in schema_of(table)
        }
    assert {row.tableName for row in lake.list_tables(spark, namespace).collect()} == set(LAKE_TABLES)
    assert lake.row_count(spark, "orders", namespace) == lake.row_count(spark, f"{namespace}.orders") == 50


def test_replacing_keeps_properties_and_comments(spark, namespace):
    name = f"{namespace}.t"
    note = "it's PII=PII; a \\ and \"quotes\""
    first = spark.range(5).select(F.col("id").alias("k", metadata={"comment": note}))
    lake.replace_table(first, name, properties={"a.b": "it's", "n": 1})
    second = spark.range(2).select(F.col("id").alias("k", metadata={"comment": note}), F.lit("x").alias("v"))
    lake.replace_table(second, name, properties={"a.b": '{"k":"v"}'})
    assert spark.table(name).columns == ["k", "v"] and spark.table(name).count() == 2
    properties = lake.table_properties(spark, name)
    assert properties["a.b"] == '{"k":"v"}' and properties["n"] == "1"
    assert lake.comment_of(spark.table(name).schema["k"]) == note


def test_comments_are_applied_once_and_only_where_given(spark, namespace):
    name = f"{namespace}.t"
    spark.range(1).selectExpr("id AS a", "id AS b").write.saveAsTable(name)
    schema = StructType([StructField("a", LongType(), True, {"comment": "it's"}), StructField("b", LongType())])
    frame = spark.createDataFrame([(1, 2)], schema)
    assert lake.apply_column_comments(spark, frame, name) == 1
    assert lake.apply_column_comments(spark, frame, name) == 0
    assert [lake.comment_of(f) for f in spark.table(name).schema] == ["it's", None]


def test_failed_table_write_raises_or_falls_back(spark, tmp_path):
    frame = spark.range(4)
    with pytest.raises(Exception):
        lake.LakeWriter(f"{tmp_path}", namespace="missing_ns").write(frame, "t")
    writer = lake.LakeWriter(f"{tmp_path}/lake", namespace="missing_ns", on_error="parquet")
    place = writer.write(frame, "t")
    assert place == f"{tmp_path}/lake/t_fallback" and spark.read.parquet(place).count() == 4
    dated = writer.write(frame, "u", load_date="2026-01-31")
    assert (tmp_path / "lake" / "u_fallback" / "load_date=2026-01-31").is_dir()
    assert spark.read.parquet(dated).count() == 4
    with pytest.raises(Exception):
        writer.write_table(frame, "t")


def test_ensure_table_copies_columns_once(spark, tables, namespace, tmp_path):
    lake.replace_table(tables["customers"], f"{namespace}.customers")
    target = f"{namespace}.copy"
    lake.ensure_table(spark, f"{namespace}.customers", target, properties={"p": "1"})
    assert spark.table(target).isEmpty()
    assert [(f.name, f.dataType, f.metadata) for f in spark.table(target).schema] == [
        (f.name, f.dataType, f.metadata) for f in spark.table(f"{namespace}.customers").schema
    ]
    lake.ensure_table(spark, f"{namespace}.customers", f"{namespace}.placed", location=f"{tmp_path}/placed")
    spark.sql(f"INSERT INTO {target} SELECT * FROM {namespace}.customers")
    lake.replace_table(tables["orders"], f"{namespace}.orders")
    lake.ensure_table(spark, f"{namespace}.orders", target)
    assert spark.table(target).columns[1] == "first_name" and spark.table(target).count() == 20


def test_bucketed_tables_join_without_a_shuffle(spark, namespace):
    left = spark.range(1000).select(F.col("id").alias("order_id"), F.lit(1).alias("a"))
    right = spark.range(1000).select(F.col("id").alias("order_id"), F.lit(2).alias("b"))
    lake.write_bucketed(left, f"{namespace}.l", 4, ["order_id"])
    lake.write_bucketed(right, f"{namespace}.r", 4, ["order_id"])
    joined = spark.table(f"{namespace}.l").join(spark.table(f"{namespace}.r").hint("merge"), "order_id")
    assert joined.count() == 1000
    assert "Exchange hashpartitioning(order_id" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("place", [None, "out"])
def test_table_can_be_replaced_from_itself(spark, namespace, tmp_path, place):
    location = place and f"{tmp_path}/{place}/t"
    name = f"{namespace}.t"
    lake.replace_table(spark.range(3), name, location=location)
    for _ in range(2):
        lake.replace_table(spark.table(name).where("id > 0").union(spark.range(9, 10)), name)
    assert {row.id for row in spark.table(name).collect()} == {1, 2, 9}


@pytest.mark.parametrize("place", [None, "out"])
def test_failed_replace_keeps_the_old_rows(spark, namespace, tmp_path, place):
    location = place and f"{tmp_path}/{place}/t"
    name = f"{namespace}.t"
    lake.replace_table(spark.range(3), name, location=location, properties={"k": "v"})
    before = lake.table_place(spark, name)[0]
    failing = spark.range(100).select(F.expr("IF(id = 50, CAST(raise_error('no') AS BIGINT), id)").alias("id"))
    for frame in (failing, failing.withColumn("more", F.lit(1))):
        with pytest.raises(Exception, match="no"):
            lake.replace_table(frame, name, location=location)
        assert spark.table(name).count() == 3 and spark.table(name).columns == ["id"]
        assert lake.table_properties(spark, name)["k"] == "v"
    assert lake.table_place(spark, name)[0] == before


NOW = datetime.timedelta(0)


@pytest.mark.parametrize("place", [None, "out"])
def test_replacing_leaves_no_old_files_once_they_are_removed(spark, namespace, tmp_path, place):
    location = place and f"{tmp_path}/{place}/t"
    name = f"{namespace}.t"
    for n in (3, 4, 5):
        lake.replace_table(spark.range(n), name, location=location)
        assert spark.table(name).count() == n
    assert lake.remove_old_folders(spark, name) == []  # none went out of use a day ago
    assert len(lake.remove_old_folders(spark, name, NOW)) == 2
    lake.replace_table(spark.range(6).withColumn("more", F.lit("x")), name)
    assert spark.table(name).columns == ["id", "more"] and spark.table(name).count() == 6
    folder = lake.table_place(spark, name)[0].removeprefix("file:")
    lake.remove_old_folders(spark, name, NOW)
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path)).count()
    assert rows == 6 and spark.read.parquet(folder).count() == 6
    assert lake.remove_old_folders(spark, name, NOW) == []
    if place:
        assert folder.startswith(f"{location}/version-")
    else:
        assert folder.count("version-") <= 1


@pytest.mark.parametrize("place", [None, "out"])
def test_a_scan_planned_before_a_replace_finishes_after_it(spark, namespace, tmp_path, place):
    location, name = place and f"{tmp_path}/{place}/t", f"{namespace}.t"
    lake.replace_table(spark.range(1000).repartition(8), name, location=location)
    planned = spark.table(name).selectExpr("sum(id) AS total")
    planned._jdf.queryExecution().executedPlan()
    lake.replace_table(spark.range(5), name, location=location)
    assert planned.first().total == 499500
    assert len(lake.remove_old_folders(spark, name, NOW)) == 1
    assert spark.table(name).count() == 5


def test_only_folders_long_out_of_use_are_removed(spark, namespace, tmp_path):
    name, location = f"{namespace}.t", f"{tmp_path}/t"
    for n in (1, 2, 3):
        lake.replace_table(spark.range(n), name, location=location)
    current = lake.table_place(spark, name)[0].removeprefix("file:")
    versions = sorted((p for p in (tmp_path / "t").iterdir()), key=lambda p: (p / "_SUCCESS").stat().st_mtime_ns)
    assert str(versions[-1]) == current
    # The first two were finished long ago; the second went out of use when the third was finished.
    for age, version in zip((90, 80), versions):
        past = time.time() - age * 3600
        os.utime(version / "_SUCCESS", (past, past))
    (tmp_path / "t" / "version-being-written").mkdir()
    os.utime(tmp_path / "t" / "version-being-written", (time.time() + 60,) * 2)
    (tmp_path / "t" / "someone-elses").mkdir()
    removed = lake.remove_old_folders(spark, name, datetime.timedelta(days=1))
    assert [path.rsplit("/", 1)[1] for path in removed] == [versions[0].name]
    left = {p.name for p in (tmp_path / "t").iterdir()}
    assert left == {versions[1].name, versions[2].name, "version-being-written", "someone-elses"}
    assert spark.table(name).count() == 3


def test_a_table_whose_files_are_in_its_root_can_be_replaced(spark, namespace, tmp_path):
    """The location is given without the scheme that the catalog adds to it."""
    name, location = f"{namespace}.t", f"{tmp_path}/t"
    spark.range(4).write.parquet(location)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{location}'")
    lake.replace_table(spark.range(7), name, location=location)
    assert spark.table(name).count() == 7
    assert lake.remove_old_folders(spark, name) == []
    assert lake.remove_old_folders(spark, name, NOW)
    assert [p.name[:8] for p in (tmp_path / "t").iterdir()] == ["version-"] and spark.table(name).count() == 7


def test_reader_always_finds_the_table(spark, namespace, tmp_path):
    name = f"{namespace}.t"
    lake.replace_table(spark.range(5), name, location=f"{tmp_path}/t")
    for _ in range(3):
        seen = spark.sql(f"SELECT count(*) FROM {name}")
        lake.replace_table(spark.range(5), name, location=f"{tmp_path}/t")
        assert spark.catalog.tableExists(name) and spark.table(name).count() == 5
    assert seen.columns


def test_comments_of_kept_columns_survive_other_columns(spark, namespace):
    name = f"{namespace}.t"
    marked = spark.range(2).select(F.col("id").alias("k", metadata={"comment": "PII=PII"}))
    lake.replace_table(marked, name)
    lake.replace_table(spark.range(2).select(F.col("id").alias("k"), F.lit(1).alias("v")), name)
    assert lake.comment_of(spark.table(name).schema["k"]) == "PII=PII"


def test_what_a_fallback_wrote_is_readable(spark, namespace, tmp_path):
    writer = lake.LakeWriter(f"{tmp_path}/lake", namespace=namespace, provider="no_such_format", on_error="parquet")
    assert lake.read_written(spark, writer.write(spark.range(4), "t")).count() == 4
    assert not spark.catalog.tableExists(f"{namespace}.t")
    place = lake.LakeWriter(f"{tmp_path}/lake", namespace=namespace).write(spark.range(3), "t")
    assert lake.read_written(spark, place).count() == 3


def test_rows_as_of_a_day(spark, tmp_path):
    rows = spark.range(90).selectExpr("id", "date_add(DATE'2026-01-01', CAST(id % 3 AS INT) * 31) AS load_date")
    path = lake.write_dated_folder(rows, f"{tmp_path}/t")
    found = lake.read_as_of_date(spark, path, "2026-03-01")
    assert {str(row.load_date) for row in found.collect()} == {"2026-02-01"} and found.count() == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in plan and "2026-02-01" in plan
    assert lake.read_as_of_date(spark, path, "2025-12-31").count() == 0


def test_hot_day_is_written_whole(spark, tmp_path):
    rows = spark.range(9000).select(
        "id", F.expr("date_add(DATE'2026-01-01', IF(id % 3 = 0, 0, CAST(id % 20 AS INT)))").alias("load_date")
    )
    lake.write_dated_folder(rows, f"{tmp_path}/t")
    back = spark.read.schema(rows.schema).parquet(f"{tmp_path}/t")
    assert same(back, rows)
    scan = back.where("load_date = DATE'2026-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in scan


def test_names_and_their_catalogs(spark):
    assert lake.quote("a.`b`.c d") == "`a`.`b`.`c d`"
    assert lake.qualified("db", "t") == "db.t" and lake.qualified("db", "x.t") == "x.t"
    assert lake.is_session_catalog(spark, "t") and lake.is_session_catalog(spark, "db.t")
    assert lake.is_session_catalog(spark, "spark_catalog.db.t")
    assert not lake.is_session_catalog(spark, "other.db.t")
    spark.conf.set("spark.sql.catalog.named", "some.Catalog")
    try:
        assert not lake.is_session_catalog(spark, "named.t")
    finally:
        spark.conf.unset("spark.sql.catalog.named")


def test_replacing_catalog_gets_one_atomic_call(spark):
    """No such catalog is available here, so only the calls are checked."""
    frame = mock.MagicMock()
    frame.sparkSession.conf.get.side_effect = lambda key, default=None: default
    frame.sparkSession.catalog.tableExists.return_value = True
    kept = mock.MagicMock()
    kept.collect.return_value = [{"key": "governance.x", "value": "y"}, {"key": "p", "value": "0"}]
    frame.sparkSession.sql.return_value = kept
    lake.replace_table(
        frame, "other.db.t", location="s3a://b/t", properties={"p": 1}, provider="fmt", column_comments=False
    )
    frame.writeTo.assert_called_once_with("`other`.`db`.`t`")
    writer = frame.writeTo.return_value.using
    writer.assert_called_once_with("fmt")
    calls = str(writer.return_value.mock_calls)
    assert "tableProperty('governance.x', 'y')" in calls and "tableProperty('p', '0')" not in calls
    assert "tableProperty('p', '1')" in calls and "tableProperty('location', 's3a://b/t')" in calls
    assert calls.count("createOrReplace()") == 1 and not frame.write.mock_calls


def test_folders_with_int_keys_can_be_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", "I", "UK")], "org_id INT, org_name STRING, industry STRING, country STRING")
    lake.write_folder(rows, f"{tmp_path}/organizations")
    stored = lake.LakeReader(spark, str(tmp_path), "parquet").read("organizations")
    assert tuple(stored.first()) == (1, "A", "I", "UK") and stored.dtypes[0] == ("org_id", "bigint")
