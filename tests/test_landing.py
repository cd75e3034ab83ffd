"""Stream landing on hand-made messages."""

import json

import pytest
from pyspark.sql.types import StructType

from tidemark.streaming import landing

DDL = "id BIGINT NOT NULL, name STRING, amount DOUBLE, small INT, day DATE, flag BOOLEAN"
GOOD = [
    '{"id": 1, "name": "a", "amount": 1.5}',
    '{"id": 2}',
    '{"id": 3, "extra": true}',
    ' {"id": 4, "name": "] } x", "amount": 2, "small": 7, "day": "2026-01-31", "flag": false, "extra": null} ',
    '{"id": 5, "name": null, "amount": 1e300}',
]
BAD = [
    '{"id": "x"}',
    "not json",
    '{"name": "no id"}',
    '{"id": 6, "amount": "much"}',
    "[1, 2]",
    '{"id": 1}{"id": 2}',
    '{"id": 1} trailing',
    '{"id": 1}] x',
    '{"id": 1}} x',
    '{"id": 1}, {"id": 2}',
    '{"id": 1}, "m": {"id": 2}',
    '{"id": 1, "name": 5}',
    '{"id": 1, "name": {"x": 1}}',
    '{"id": 1, "amount": "NaN"}',
    '{"id": 1, "amount": NaN}',
    '{"id": 1, "id": 2}',
    "{'id': 1}",
    '{"id": 1.5}',
    '{"id": null}',
    '{"id": 1, "small": 3000000000}',
    '{"id": 1, "day": "31.1.2026"}',
    '{"id": 1, "flag": "true"}',
    '{"id": 1, "day": 20260131}',
    "7",
    "null",
    "",
]


@pytest.fixture
def schema(spark):
    return StructType.fromDDL(DDL)


def test_judge(spark, schema):
    messages = spark.createDataFrame([(text,) for text in [*GOOD, *BAD, None]], "value STRING")
    rows = landing.judge(messages, schema).collect()
    valid = [row for row in rows if row[landing.VERDICT] == landing.VALID]
    bad = [row for row in rows if row[landing.VERDICT] == landing.QUARANTINED]
    assert [row[landing.RAW] for row in bad] == [*BAD, None]
    assert all(row.id is None and row.amount is None for row in bad)
    assert sorted(row.id for row in valid) == [1, 2, 3, 4, 5]
    by = {row.id: row for row in valid}
    assert (by[4]["name"], by[4].amount, by[4].small, str(by[4].day), by[4].flag) == ("] } x", 2.0, 7, "2026-01-31", False)
    # Fields that the schema does not name are kept with the raw message.
    assert {row.id: row[landing.RAW] for row in valid if row[landing.RAW]} == {3: GOOD[2], 4: GOOD[3]}


def test_reserved_and_unknown_fields_are_refused(spark):
    messages = spark.createDataFrame([("{}",)], "value STRING")
    landing.judge(messages, StructType.fromDDL("raw STRING, verdict INT")).collect()
    for ddl in ("_raw_message STRING", "_verdict INT", "a INT, A INT", "a ARRAY<INT>"):
        with pytest.raises(ValueError):
            landing.judge(messages, StructType.fromDDL(ddl))


def test_land_restart_and_late_files(spark, schema, tmp_path):
    source, target, checkpoint = (f"{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join([*GOOD, *BAD[:-1]]))

    def run():
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(source)
        landing.land(stream, schema, target, checkpoint).awaitTermination()
        counts = {row.verdict: row.messages for row in landing.landing_counts(spark, target).collect()}
        return counts

    assert run() == {"valid": 5, "quarantined": len(BAD) - 1}
    assert run() == {"valid": 5, "quarantined": len(BAD) - 1}
    (tmp_path / "in" / "2.txt").write_text(json.dumps({"id": 9, "name": "late", "amount": 2}))
    assert run() == {"valid": 6, "quarantined": len(BAD) - 1}
    rows = landing.landed(spark, schema, target)
    assert rows.columns == schema.fieldNames()
    assert {row.id for row in rows.collect()} == {1, 2, 3, 4, 5, 9}
    assert {row.raw for row in landing.quarantined(spark, target).collect()} == set(BAD[:-1])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_verdict" in plan


def test_a_batch_that_runs_again_lands_once(spark, schema, tmp_path):
    """The progress of the last batch is lost, as after a crash between writing and committing."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join(GOOD))
    target, checkpoint = f"{tmp_path}/out", tmp_path / "checkpoint"
    for _ in range(2):
        landing.land(spark.readStream.text(f"{tmp_path}/in"), schema, target, str(checkpoint)).awaitTermination()
        assert landing.landed(spark, schema, target).count() == len(GOOD)
        for commit in (checkpoint / "commits").iterdir():
            commit.unlink()
