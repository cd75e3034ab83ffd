"""Column differences and safe casts between a source and its copy."""

import decimal
import uuid

import pytest
from pyspark.sql.types import StructType

from tidemark.functions.types import checked, lossless
from tidemark.plans import reconcile, refresh
from tidemark.plans.reconcile import CAST, CHECKED_CAST, CREATE, KEEP, LEAVE_NULL, REFUSE
from tidemark.sources import lake


def differences(source, target):
    found = reconcile.column_differences(StructType.fromDDL(source), StructType.fromDDL(target))
    return {d.column_name: (d.change, d.action) for d in found}


def test_differences(spark):
    source = "a INT, B STRING, c BIGINT COMMENT 'new', d DATE, e DOUBLE, g DECIMAL(9,2), h STRING COMMENT 'x'"
    target = "a BIGINT, b STRING, c BIGINT COMMENT 'old', d TIMESTAMP, e FLOAT, f INT, g DECIMAL(6,2), h STRING COMMENT 'x'"
    assert differences(source, target) == {
        "a": ("retyped", CAST),
        "b": ("respelled", KEEP),
        "c": ("comment changed", KEEP),
        "d": ("retyped", CAST),
        "e": ("retyped", REFUSE),
        "f": ("gone", LEAVE_NULL),
        "g": ("retyped", CHECKED_CAST),
        "h": ("same", KEEP),
    }
    assert differences("a INT", "") == {"a": ("added", CREATE)}
    # A source without a comment does not take one away.
    assert differences("a INT", "a INT COMMENT 'kept'") == {"a": ("same", KEEP)}
    assert [d.column_name for d in reconcile.column_differences(
        StructType.fromDDL("x INT, b INT, a INT"), StructType.fromDDL("a INT, c INT"))] == ["a", "c", "x", "b"]


KINDS = ["TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(3,0)", "DECIMAL(19,0)", "DECIMAL(5,2)",
         "DECIMAL(21,2)", "STRING", "DATE"]
EDGES = ["127", "-128", "128", "32767", "2147483647", "9223372036854775807", "16777217", "9007199254740993", "99.99",
         "999.99", "0.1", "1e300", "2026-01-31"]


def test_casts_keep_values_or_fail(spark):
    """For every pair of types and values at their edges: what is cast comes back as it was."""
    for a in KINDS:
        source = StructType.fromDDL(f"v {a}")
        edges = [(e,) for e in EDGES if a != "DATE" or e.count("-") == 2]
        values = spark.createDataFrame(edges, "t STRING").selectExpr(f"try_cast(t AS {a}) AS v")
        values = values.where("v IS NOT NULL").distinct().cache()
        held = values.collect()
        for b in KINDS:
            target = StructType.fromDDL(f"v {b}")
            types = source["v"].dataType, target["v"].dataType
            if not (lossless(*types) or checked(*types)):
                with pytest.raises(TypeError, match="no safe cast of v"):
                    reconcile.conform(values, target)
                continue
            fits = values.where(f"try_cast(try_cast(v AS {b}) AS {a}) = v")
            if lossless(*types):
                assert fits.count() == len(held), (a, b)
            back = reconcile.conform(fits, target)
            assert back.schema["v"].dataType == types[1]
            assert sorted(map(str, back.selectExpr(f"CAST(v AS {a}) AS v").collect())) == sorted(map(str, fits.collect()))
            if fits.count() < len(held):
                with pytest.raises(Exception, match="does not fit"):
                    reconcile.conform(values, target).collect()


@pytest.fixture
def spaces(spark, tmp_path):
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("src", "dst")]
    for name in names:
        spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    return names


def put(spark, name, ddl, *rows):
    lake.replace_table(spark.createDataFrame(list(rows), ddl), name)


@pytest.mark.parametrize("placed", [False, True])
def test_refresh_creates_a_missing_target_and_keeps_its_columns(spark, spaces, tmp_path, placed):
    source, target = (f"{space}.t" for space in spaces)
    place = f"{tmp_path}/copy" if placed else None
    put(spark, source, "id INT COMMENT 'key', v DECIMAL(9,2)", (1, decimal.Decimal("1.50")))
    assert refresh.refresh_table(spark, source, target, place, columns="target") == (1, 1)
    assert spark.table(target).schema["id"].metadata["comment"] == "key"
    put(spark, target, "id BIGINT COMMENT 'key', V DECIMAL(5,2), gone STRING", (9, decimal.Decimal("9.00"), "old"))
    put(spark, source, "id INT, v DECIMAL(9,2), more STRING", (1, decimal.Decimal("1.50"), "x"), (2, None, None))
    assert refresh.refresh_table(spark, source, target, place, columns="target") == (2, 2)
    copy = spark.table(target)
    assert copy.dtypes == [("id", "bigint"), ("V", "decimal(5,2)"), ("gone", "string"), ("more", "string")]
    assert copy.schema["id"].metadata["comment"] == "key"
    rows = [(1, decimal.Decimal("1.50"), None, "x"), (2, None, None, None)]
    assert sorted(map(tuple, copy.collect())) == rows
    # A value that does not fit, and a type that has no safe cast, leave the copy as it is.
    put(spark, source, "id INT, v DECIMAL(9,2)", (1, decimal.Decimal("1234.50")))
    results = refresh.refresh_tables(spark, *spaces, ["t"], columns="target").first()
    assert results.status == "FAILED" and "does not fit decimal(5,2): 1234.50" in results.error
    put(spark, source, "id STRING, v DECIMAL(9,2)", ("a", None))
    results = refresh.refresh_tables(spark, *spaces, ["t"], columns="target").first()
    assert results.status == "FAILED" and "id from string to bigint" in results.error
    assert sorted(map(tuple, spark.table(target).collect())) == rows
    # The other way takes over the source's columns.
    assert refresh.refresh_table(spark, source, target, place) == (1, 1)
    assert spark.table(target).dtypes == [("id", "string"), ("v", "decimal(9,2)")]


def test_an_unknown_choice_is_refused(spark, spaces):
    put(spark, f"{spaces[0]}.t", "id INT", (1,))
    with pytest.raises(ValueError, match="columns"):
        refresh.refresh_table(spark, f"{spaces[0]}.t", f"{spaces[1]}.t", columns="both")
