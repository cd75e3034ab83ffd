"""Registering Parquet folders as tables."""

import uuid

import pytest

from tidemark.sources import folders, lake


@pytest.fixture
def namespace(spark, tmp_path):
    name = f"ns_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    return name


def test_register_merge_miss_and_fail(spark, namespace, tmp_path):
    base = f"{tmp_path}/raw"
    lake.write_folder(spark.range(2).selectExpr("id AS a"), f"{base}/grows")
    lake.write_folder(spark.range(2).selectExpr("id AS a"), f"{base}/clashes")
    lake.write_folder(spark.range(2).selectExpr("id AS a"), f"{base}/retyped")

    def register():
        result = folders.register_folders(spark, base, ["grows", "clashes", "retyped", "absent"], namespace)
        return {row.table_name: row for row in result.collect()}

    first = register()
    assert {table: row.status for table, row in first.items()} == {
        "grows": "CREATED",
        "clashes": "CREATED",
        "retyped": "CREATED",
        "absent": "MISSING",
    }
    spark.range(3).selectExpr("id AS a", "'x' AS b").write.mode("append").parquet(f"{base}/grows")
    spark.range(3).selectExpr("'text' AS a").write.mode("append").parquet(f"{base}/clashes")
    lake.write_folder(spark.range(2).selectExpr("'text' AS a"), f"{base}/retyped")
    second = register()
    assert second["grows"].status == "UPDATED" and second["grows"].added_columns == ["b"]
    assert second["clashes"].status == "FAILED" and second["clashes"].error
    assert second["retyped"].status == "FAILED" and "bigint in the table" in second["retyped"].error
    assert spark.table(f"{namespace}.grows").where("b IS NULL").count() == 2
    assert spark.table(f"{namespace}.grows").count() == 5
    third = register()["grows"]
    assert third.status == "UNCHANGED" and third.added_columns == []


def grouped(spark, namespace, base):
    return folders.register_grouped(spark, namespace, "t", base)


def test_subfolders_are_grouped_by_schemas_that_fit(spark, namespace, tmp_path):
    base = f"{tmp_path}/raw/t"
    lake.write_folder(spark.range(2).selectExpr("id AS a"), f"{base}/one")
    lake.write_folder(spark.range(3).selectExpr("'x' AS a", "1 AS b"), f"{base}/other kind")
    lake.write_folder(spark.range(4).selectExpr("id AS A", "'y' AS c"), f"{base}/two")
    assert grouped(spark, namespace, base) == {"t": ("CREATED", []), "t_other_kind": ("CREATED", [])}
    assert spark.table(f"{namespace}.t").columns == ["a", "c", "_folder"]
    assert {row[0]: row[1] for row in spark.table(f"{namespace}.t").groupBy("_folder").count().collect()} == {"one": 2, "two": 4}
    assert spark.table(f"{namespace}.t_other_kind").where("a = 'x' AND b = 1").count() == 3
    assert grouped(spark, namespace, base) == {"t": ("UNCHANGED", []), "t_other_kind": ("UNCHANGED", [])}
    # A folder that sorts first and fits both joins the first table; tables keep their names.
    lake.write_folder(spark.range(5).selectExpr("1.5D AS d"), f"{base}/0")
    spark.range(1).selectExpr("'z' AS a", "2 AS b", "3 AS e").write.mode("append").parquet(f"{base}/other kind")
    assert grouped(spark, namespace, base) == {"t": ("UPDATED", ["d"]), "t_other_kind": ("UPDATED", ["e"])}
    assert spark.table(f"{namespace}.t").where("d = 1.5 AND a IS NULL").count() == 5
    assert spark.table(f"{namespace}.t_other_kind").where("e = 3").count() == 1
    plan = spark.table(f"{namespace}.t").where("_folder = 'two'").select("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_folder" in plan


def test_fitting_is_not_transitive(spark, namespace, tmp_path):
    base = f"{tmp_path}/raw/t"
    for name, sql in (("a", "1 AS x"), ("b", "1 AS y"), ("c", "'1' AS x"), ("d", "'1' AS y, '2' AS x")):
        lake.write_folder(spark.range(1).selectExpr(*sql.split(", ")), f"{base}/{name}")
    assert set(grouped(spark, namespace, base)) == {"t", "t_c"}
    assert {r[0] for r in spark.table(f"{namespace}.t").select("_folder").collect()} == {"a", "b"}
    assert {r[0] for r in spark.table(f"{namespace}.t_c").select("_folder").collect()} == {"c", "d"}


def test_a_subfolder_that_changed_its_kind_is_refused(spark, namespace, tmp_path):
    base = f"{tmp_path}/raw/t"
    lake.write_folder(spark.range(1).selectExpr("1 AS x"), f"{base}/a")
    grouped(spark, namespace, base)
    lake.write_folder(spark.range(1).selectExpr("'1' AS x"), f"{base}/a")
    with pytest.raises(TypeError, match="no longer fits table t"):
        grouped(spark, namespace, base)
    lake.write_folder(spark.range(1).selectExpr("1 AS x"), f"{base}/a")
    spark.range(1).write.saveAsTable(f"{namespace}.t_b")
    lake.write_folder(spark.range(1).selectExpr("'1' AS x"), f"{base}/b")
    with pytest.raises(ValueError, match="t_b exists"):
        grouped(spark, namespace, base)
