"""Metadata documents and JSON properties."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import metadata


@pytest.fixture
def folder(tmp_path):
    def put(name, text, modified):
        path = tmp_path / name
        path.write_text(text)
        os.utime(path, (modified, modified))

    put("v1.metadata.json", '{"properties": {"a.b": "old"}}', 1_700_000_000)
    put("v2.metadata.json", '{\n  "properties": {"a.b": "new", "n": 7},\n  "other": [1, 2]\n}', 1_700_000_900)
    put("v3.json", '{"properties": {"a.b": "ignored"}}', 1_800_000_000)
    return str(tmp_path)


def test_files_and_documents(spark, folder):
    files = metadata.metadata_files(spark, folder)
    assert sorted(os.path.basename(row.file_path) for row in files.collect()) == ["v1.metadata.json", "v2.metadata.json"]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    documents = metadata.metadata_documents(spark, folder)
    assert documents.columns == ["file_path", "file_modification_time", "value"]
    assert documents.count() == 2


def test_newest_file_wins(spark, folder):
    row = metadata.newest_metadata(spark, folder).withColumn("p", metadata.json_property("properties", "a.b")).first()
    assert row.p == "new" and row.properties["n"] == "7" and row.file_path.endswith("v2.metadata.json")


def test_files_in_subfolders_are_found(spark, folder, tmp_path):
    deeper = tmp_path / "a" / "b"
    deeper.mkdir(parents=True)
    path = deeper / "v9.metadata.json"
    path.write_text('{"properties": {"a.b": "newest"}}')
    os.utime(path, (1_700_009_000, 1_700_009_000))
    assert metadata.metadata_files(spark, folder).count() == 3
    assert metadata.metadata_documents(spark, folder).count() == 3
    assert metadata.newest_metadata(spark, folder).first().properties["a.b"] == "newest"


def test_folder_without_metadata(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        metadata.newest_metadata(spark, str(tmp_path))


def test_newest_per_table(spark):
    documents = spark.createDataFrame(
        [("t", 1, '{"properties":{"k":"1"}}'), ("t", 2, '{"properties":{"k":"2"}}'), ("u", 5, "broken")],
        "table_name STRING, modified INT, value STRING",
    )
    newest = metadata.with_properties(metadata.newest_per_table(documents, "table_name", "modified"))
    found = {row.table_name: (row.modified, row.properties) for row in newest.collect()}
    assert found == {"t": (2, {"k": "2"}), "u": (5, None)}
    oldest = metadata.oldest_per_table(documents, "table_name", "modified").collect()
    assert {row.table_name: row.modified for row in oldest} == {"t": 1, "u": 5}


def test_newest_of_ties_and_repeated_documents(spark):
    rows = [("t", 2, "a"), ("t", 2, "b"), ("t", 2, "b"), ("t", 2, "a"), ("u", None, "x")]
    documents = spark.createDataFrame(rows, "table_name STRING, modified INT, value STRING")
    found = metadata.newest_per_table(documents, "table_name", "modified").collect()
    assert len([row for row in found if row.table_name == "t"]) == 1
    assert found == metadata.newest_per_table(documents.repartition(3), "table_name", "modified").collect()


def test_property_access_and_strict_parsing(spark):
    frame = spark.createDataFrame([('{"b":"2","a":"1"}',), ("{",)], "text STRING")
    parsed = frame.select(F.from_json("text", "map<string,string>").alias("m"))
    found = parsed.select(
        metadata.json_property("m", "b").alias("b"),
        metadata.json_property("m", "missing").alias("missing"),
        metadata.canonical_json("m").alias("text"),
    ).collect()
    assert [tuple(row) for row in found] == [("2", None, '{"a":"1","b":"2"}'), (None, None, None)]
    with pytest.raises(Exception):
        frame.select(metadata.required_json("text", "map<string,string>")).collect()
