"""Contents of copies compared by digests."""

import random
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.plans import refresh, verify
from tidemark.sources import lake

DDL = "k INT, g STRING, v DOUBLE, d DECIMAL(9,2)"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5)


def found(source, copy, keys=("k",)):
    return {(*row[:-1], row.difference) for row in verify.differences(source, copy, list(keys)).collect()}


@pytest.fixture
def rows():
    rng = random.Random(1)
    return [(i, rng.choice(["a", "", None]), rng.choice([0.0, 1.5, None, float("nan")]), None) for i in range(500)] + [
        (None, "null key", 1.0, None)
    ]


def test_equal_rows_in_any_order_do_not_differ(spark, rows):
    shuffled = random.Random(2).sample(rows, len(rows))
    assert found(frame(spark, rows), frame(spark, shuffled)) == set()
    assert found(frame(spark, []), frame(spark, [])) == set()
    # Columns are taken by name.
    assert found(frame(spark, rows), frame(spark, rows).select("d", "v", "g", "k")) == set()


def test_every_kind_of_difference_is_found(spark, rows):
    copy = [list(row) for row in rows]
    copy[3][1] = "changed"
    copy[10][1], copy[10][2] = None, 7.0
    empty = next(i for i, row in enumerate(copy) if row[1] == "" and i > 10)
    copy[empty][1] = None  # a null instead of an empty text
    copy[-1][2] = None
    gone = copy.pop(200)
    copy.append([9999, "extra", 1.0, None])
    copy.append(list(copy[50]))  # a row twice
    assert found(frame(spark, rows), frame(spark, [tuple(r) for r in copy])) == {
        (3, "changed"),
        (10, "changed"),
        (empty, "changed"),
        (None, "changed"),
        (gone[0], "missing"),
        (9999, "extra"),
        (50, "changed"),
    }
    assert found(frame(spark, rows), frame(spark, [])) == {(row[0], "missing") for row in rows}


def test_swapped_values_and_keys_of_several_columns(spark):
    source = frame(spark, [(1, "a", 1.0, None), (1, "b", 2.0, None)])
    copy = frame(spark, [(1, "a", 2.0, None), (1, "b", 1.0, None)])
    assert found(source, copy, ("k", "g")) == {(1, "a", "changed"), (1, "b", "changed")}
    assert found(source, copy) == {(1, "changed")}


def test_sums_seen_while_reading_are_those_of_the_rows(spark, rows):
    seen = Observation()
    one = frame(spark, rows)
    verify.observed(one, ["k"], seen).write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == len(rows)
    sums = verify.bucket_sums(one, ["k"])
    assert verify.differing_buckets(seen, sums) == [] and sum(n for n, _ in sums.values()) == len(rows)
    other = verify.bucket_sums(one.withColumn("v", F.when(~F.col("k").eqNullSafe(7), F.col("v"))), ["k"])
    expected = frame(spark, rows).where("k = 7").select(verify._bucket(["k"])).first()[0]
    assert verify.differing_buckets(seen, other) in ([expected], [])  # the value may be null already


def test_a_refresh_finds_a_changed_value_with_equal_counts(spark, rows, tmp_path, monkeypatch):
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("src", "dst")]
    for name in names:
        spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    lake.replace_table(frame(spark, rows), f"{names[0]}.t")
    results = refresh.refresh_tables(spark, *names, ["t"], keys={"t": ["k"]}).first()
    assert (results.status, results.source_rows, results.target_rows) == ("OK", 501, 501)
    real = refresh.replace_table

    def damaging(written, target, **more):
        return real(written.withColumn("g", F.when(F.col("k") == 42, "bad").otherwise(F.col("g"))), target, **more)

    monkeypatch.setattr(refresh, "replace_table", damaging)
    counts = refresh.refresh_tables(spark, *names, ["t"]).first()
    assert counts.status == "OK"  # by counts alone
    results = refresh.refresh_tables(spark, *names, ["t"], keys={"t": ["k"]})
    assert results.first().status == "CONTENT_MISMATCH" and "1 keys" in results.first().error
    assert refresh.overall_status(results).first().mismatched_tables == 1
    differing = refresh.refresh_table(spark, f"{names[0]}.t", f"{names[1]}.t", keys=["k"])[2]
    assert [tuple(row) for row in differing.collect()] == [(42, "changed")]
