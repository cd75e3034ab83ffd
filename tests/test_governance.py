"""Classification, tags and masks."""

import datetime
import decimal
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans import generate, governance, refresh
from tidemark.plans.governance import PII_READER_ROLE, READER_ROLE
from tidemark.sources import lake
from tidemark.sources.schemas import TABLE_DDL, schema_of

PII = "COMMENT 'PII=PII'"
DDL = f"""a STRING {PII}, b INT {PII}, c DECIMAL(9,2) {PII}, d DATE {PII}, e DOUBLE {PII}, f TIMESTAMP {PII},
    g BOOLEAN {PII}, h STRING, i STRING COMMENT 'has PII=pii here', j STRING COMMENT 'PII', k VARCHAR(9) {PII}"""


@pytest.fixture
def schema(spark):
    return StructType.fromDDL(DDL)


@pytest.fixture
def catalog(spark, schema):
    return governance.column_catalog(spark, {"t": schema, "orders": schema_of("orders")}, "db")


@pytest.fixture
def frame(spark):
    day = datetime.date(2026, 1, 1)
    moment = datetime.datetime(2026, 1, 1)
    rows = [("x", 1, decimal.Decimal("1.50"), day, 2.5, moment, True, "h", "i", "j", "k"), (None,) * 11]
    # Rows cannot be created as VARCHAR.
    plain = StructType.fromDDL(DDL.replace("VARCHAR(9)", "STRING"))
    return spark.createDataFrame(rows, plain)


@pytest.fixture
def namespace(spark, tmp_path):
    name = f"ns_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    return name


def test_column_catalog(catalog):
    row = catalog.where("table_name = 'orders' AND column_name = 'customer_id'").first()
    assert tuple(row) == ("db", "orders", "customer_id", "bigint", "PII=PII", 2)


def test_marked_columns_and_their_masks(spark, catalog):
    hidden = governance.column_catalog(spark, {"x": schema_of("orders")}, "information_schema")
    rows = governance.pii_columns(catalog.unionAll(hidden)).collect()
    assert [(r.table_name, r.column_name, r.masking_policy.rsplit(".", 1)[-1]) for r in rows] == [
        ("orders", "customer_id", "PII_NUMBER_MASK"),
        ("t", "a", "PII_STRING_MASK"),
        ("t", "b", "PII_NUMBER_MASK"),
        ("t", "c", "PII_NUMBER_MASK"),
        ("t", "d", "PII_DATE_MASK"),
        ("t", "e", "UNSUPPORTED_DATA_TYPE"),
        ("t", "f", "UNSUPPORTED_DATA_TYPE"),
        ("t", "g", "UNSUPPORTED_DATA_TYPE"),
        ("t", "i", "PII_STRING_MASK"),
        ("t", "k", "PII_STRING_MASK"),
    ]


def test_tags_and_report(catalog):
    tags = governance.comment_tags(catalog, "LAKE")
    assert tags.count() == 10 and {row.tag_value for row in tags.collect()} == {"PII"}
    assert tuple(governance.tag_report(catalog).first()) == (10, 3)
    found = governance.tag_references(tags, "pii", "db", "orders").collect()
    assert [(row.object_name, row.column_name) for row in found] == [("orders", "customer_id")]
    assert governance.tag_references(tags, "PII").count() == 10
    assert governance.tag_references(tags, "OTHER").isEmpty()


def test_retagging_sets_columns_anew_and_removes_none(spark, catalog):
    tags = governance.comment_tags(catalog, "LAKE")
    old = tags.where("column_name = 'a'").withColumn("tag_value", F.lit("OLD"))
    unmatched = tags.where("column_name = 'a'").withColumn("column_name", F.lit("no_longer_matched"))
    other = tags.where("object_name = 'orders'").withColumn("object_name", F.lit("untouched"))
    result = governance.retag(old.unionAll(unmatched).unionAll(other), tags)
    assert result.count() == 12 and result.where("tag_value = 'OLD'").isEmpty()
    assert result.where("column_name = 'no_longer_matched'").count() == 1
    again = governance.retag(result, tags)
    assert again.exceptAll(result).isEmpty() and result.exceptAll(again).isEmpty()


def test_verification_queries_run(spark, catalog):
    governance.comment_tags(catalog, "LAKE").createOrReplaceTempView("column_tags")
    rows = governance.verification_queries(catalog, "column_tags").collect()
    assert len(rows) == 2
    assert [spark.sql(row.verification_sql).count() for row in rows] == [1, 9]
    odd = governance.column_catalog(spark, {"it's": schema_of("orders")}, "db")
    assert "object_name = 'it''s'" in governance.verification_queries(odd, "t").first().verification_sql


def test_masked_by_comment(frame):
    masked = governance.mask_by_comment(frame, READER_ROLE)
    assert [(f.name, f.dataType) for f in masked.schema] == [(f.name, f.dataType) for f in frame.schema]
    first, second = masked.collect()
    star = "***PII MASKED***"
    moment = datetime.datetime(2026, 1, 1)
    assert tuple(first) == (star, None, None, None, 2.5, moment, True, "h", star, "j", star)
    # A missing string is hidden like any other.
    assert tuple(second) == (star, None, None, None, None, None, None, None, star, None, star)


def test_reveal_needs_the_exact_role(frame):
    assert governance.mask_by_comment(frame, PII_READER_ROLE).exceptAll(frame).isEmpty()
    for role in ("SYSADMIN", "pii_reader", "", "PII_READER "):
        assert governance.mask_by_comment(frame, role).first().a == "***PII MASKED***"
    assert governance.mask_by_comment(frame, "X", reveal_role="X").first().a == "x"


def test_stricter_option_hides_other_types(frame):
    row = governance.mask_by_comment(frame, READER_ROLE, unsupported="null").first()
    assert (row.e, row.f, row.g, row.h) == (None, None, None, "h")
    with pytest.raises(ValueError):
        governance.mask_by_comment(frame, READER_ROLE, unsupported="drop")
    assert governance.unsupported_columns(frame, ["A", "E", "g"]) == ["e", "g"]


def test_masked_columns_are_not_read(spark, tmp_path):
    rows = generate.customers(generate.ids(spark, 10), "2026-01-01")
    rows.write.parquet(f"{tmp_path}/c")
    stored = spark.read.schema(TABLE_DDL["customers"]).parquet(f"{tmp_path}/c")
    plan = governance.mask_by_comment(stored, READER_ROLE)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<signup_date:date,customer_segment:string>" in plan


def test_masked_by_class(frame):
    classes = {"A": "PII", "b": "UNCLASSIFIED_PII", "d": "PII", "e": "PII", "h": "NONE", "i": "pii"}
    row = governance.mask_by_class(frame, classes, READER_ROLE).first()
    assert (row.a, row.b, row.d, row.e, row.h, row.i) == ("***PII PROPERTY MASKED***", None, None, 2.5, "h", "i")
    assert governance.mask_by_class(frame, classes, PII_READER_ROLE).exceptAll(frame).isEmpty()


def test_property_tags(spark, catalog):
    documents = spark.createDataFrame(
        [
            ("ORDERS", {governance.CLASSIFICATION_PROPERTY: '{"ORDER_ID":"none","customer_id":"Pii","org_id":"bogus","x":"PII"}'}),
            ("t", {governance.CLASSIFICATION_PROPERTY: "not json"}),
            ("t", {"other": "x"}),
            ("t", None),
        ],
        "table_name STRING, properties MAP<STRING, STRING>",
    )
    rows = governance.property_tags(documents, catalog, "LAKE").collect()
    assert {(r.object_name, r.column_name, r.tag_value) for r in rows} == {
        ("orders", "order_id", "NONE"),
        ("orders", "customer_id", "PII"),
    }
    twice = spark.createDataFrame(
        [("t", {governance.CLASSIFICATION_PROPERTY: '{"A":"NONE","a":"UNCLASSIFIED_PII"}'})], documents.schema
    )
    assert [row.tag_value for row in governance.property_tags(twice, catalog, "LAKE").collect()] == ["UNCLASSIFIED_PII"]


def test_parse_classes():
    columns = ["email", "phone", "city"]
    text = '{"EMAIL":"pii","phone":"unclassified_pii","city":"bogus","other":"PII"}'
    assert governance.parse_classes(text, columns) == {"email": "PII", "phone": "UNCLASSIFIED_PII"}
    # A JSON null is no class, in this route and in that of the tags.
    assert governance.parse_classes('{"email":null,"phone":"none"}', columns) == {"phone": "NONE"}
    for broken in (None, "", "{", "[1]", "7"):
        assert governance.parse_classes(broken, columns) == {}


def test_classified_table_is_read_under_both_roles(spark, namespace):
    name = f"{namespace}.directory"
    rows = generate.employees(generate.ids(spark, 10), "2026-01-01")
    governance.write_classified(rows, name, governance.EMPLOYEE_CLASSIFICATION, "synthetic-poc")
    properties = lake.table_properties(spark, name)
    assert properties[governance.CLASSIFICATION_PROPERTY].startswith('{"country":"NONE","department":"NONE",')
    assert properties[governance.CLASSIFICATION_SCHEMA_PROPERTY] == "column-classification-v1"
    assert governance.table_classes(spark, name) == governance.EMPLOYEE_CLASSIFICATION
    masked = governance.read_masked_table(spark, name, READER_ROLE)
    hidden = {"first_name", "last_name", "email", "phone"}
    for row in masked.collect():
        assert {c for c, v in row.asDict().items() if v == "***PII PROPERTY MASKED***"} == hidden
    assert governance.read_masked_table(spark, name, PII_READER_ROLE).exceptAll(rows).isEmpty()


@pytest.mark.parametrize("text", ['{"email": ', '{"customer_segment":"PII"}', "{}", '{"email":"NONE"}'])
def test_a_classification_uncovers_nothing_that_comments_mark(spark, namespace, text):
    name = f"{namespace}.customers"
    rows = generate.customers(generate.ids(spark, 5), "2026-01-01")
    lake.replace_table(rows, name, properties={governance.CLASSIFICATION_PROPERTY: text})
    row = governance.read_masked_table(spark, name, READER_ROLE).first()
    assert row.email == row.national_id == "***PII MASKED***" and row.customer_id is None
    segment = "***PII PROPERTY MASKED***" if "segment" in text else None
    assert segment is None or row.customer_segment == segment
    assert governance.read_masked_table(spark, name, PII_READER_ROLE).exceptAll(rows).isEmpty()


def test_reader_sees_no_marked_value_after_two_refreshes(spark, namespace):
    people = generate.employees(generate.ids(spark, 10), "2026-01-01")
    governance.write_classified(people, f"{namespace}.source", governance.EMPLOYEE_CLASSIFICATION, "poc")
    customers = generate.customers(generate.ids(spark, 5), "2026-01-01")
    lake.replace_table(customers, f"{namespace}.marked")
    for _ in range(2):
        for table in ("source", "marked"):
            refresh.refresh_table(spark, f"{namespace}.{table}", f"{namespace}.{table}_copy")
            copy = governance.read_masked_table(spark, f"{namespace}.{table}_copy", READER_ROLE)
            assert not copy.isEmpty()
            assert copy.where("email NOT LIKE '***%' OR phone NOT LIKE '***%' OR first_name NOT LIKE '***%'").isEmpty()
    # The target keeps its own properties as well, and a source that lost its own uncovers nothing.
    lake.set_properties(spark, f"{namespace}.source_copy", {"keeper": "x"})
    spark.sql(f"ALTER TABLE {namespace}.source UNSET TBLPROPERTIES ('{governance.CLASSIFICATION_PROPERTY}')")
    refresh.refresh_table(spark, f"{namespace}.source", f"{namespace}.source_copy")
    assert lake.table_properties(spark, f"{namespace}.source_copy")["keeper"] == "x"
    copy = governance.read_masked_table(spark, f"{namespace}.source_copy", READER_ROLE)
    assert copy.where("email NOT LIKE '***%'").isEmpty()


def test_masks_from_tags(spark, frame, catalog):
    columns = "tag_name STRING, tag_value STRING, object_schema STRING, object_name STRING, column_name STRING"
    rows = [
        ("PII", "PII", "db", "t", "a"),
        ("PII_CLASSIFICATION", "PII", "DB", "T", "B"),
        ("PII_CLASSIFICATION", "UNCLASSIFIED_PII", "db", "t", "d"),
        ("PII_CLASSIFICATION", "NONE", "db", "t", "h"),
        ("PII_CLASSIFICATION", "PII", "db", "t", "i"),
        ("PII", "PII", "db", "t", "i"),
        ("PII_CLASSIFICATION", "PII", "db", "other", "j"),
        ("OWNER", "PII", "db", "t", "k"),
    ]
    tags = spark.createDataFrame(rows, columns)
    row = governance.mask_by_tags(frame, tags, "db", "t", READER_ROLE).where("h IS NOT NULL").first()
    assert (row.a, row.b, row.d, row.i) == ("***PII MASKED***", None, None, "***PII PROPERTY MASKED***")
    assert (row.h, row.j, row.k, row.c) == ("h", "j", "k", decimal.Decimal("1.50"))
    revealed = governance.mask_by_tags(frame, tags, "db", "t", PII_READER_ROLE)
    assert revealed.exceptAll(frame).isEmpty() and revealed.schema == frame.schema
    # The tags that comments give mask the table as its comments do.
    by_tags = governance.mask_by_tags(frame, governance.comment_tags(catalog, "LAKE"), "db", "t", READER_ROLE)
    assert by_tags.exceptAll(governance.mask_by_comment(frame, READER_ROLE)).isEmpty()


def test_table_without_classification_uses_comments(spark, namespace):
    lake.replace_table(generate.customers(generate.ids(spark, 5), "2026-01-01"), f"{namespace}.customers")
    row = governance.read_masked_table(spark, f"{namespace}.customers", READER_ROLE).first()
    assert row.email == "***PII MASKED***" and row.customer_id is None and row.signup_date is not None
    catalog = governance.catalog_of_namespace(spark, namespace)
    assert governance.pii_columns(catalog).count() == 11


def test_covered_values(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "a INT, b STRING")
    rows = governance.covered_values({"t": frame}, {"t": ["a", "b"]}).collect()
    assert {(r.table_name, r.column_name, r.covered_values) for r in rows} == {("t", "a", 2), ("t", "b", 1)}


def tag(column, value, table="t", schema="db", name=governance.PROPERTY_TAG):
    return ("GOVERNANCE", "CLASSIFICATION", name, value, "LAKE", schema, table, column)


def tags_of(spark, *rows):
    names = "tag_database tag_schema tag_name tag_value object_database object_schema object_name column_name".split()
    return spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names))


def stored(spark, name):
    return {(r.object_schema, r.object_name, r.column_name): r.tag_value for r in spark.table(name).collect()}


def test_stored_tags_are_set_by_column_and_last(spark, namespace, tmp_path):
    name = f"{namespace}.tags"
    first = tags_of(spark, tag("a", "PII"), tag("b", "NONE"), tag("x", "PII", "other"), tag("q", "PII", schema="far"))
    governance.store_tags(first, name, location=f"{tmp_path}/tags")
    again = tags_of(spark, tag("b", "PII"), tag("c", "NONE"))
    for _ in range(2):
        governance.store_tags(again, name)
        assert stored(spark, name) == {
            ("db", "t", "a"): "PII",
            ("db", "t", "b"): "PII",
            ("db", "t", "c"): "NONE",
            ("db", "other", "x"): "PII",
            ("far", "t", "q"): "PII",
        }
    # Table t lost column a and the other table is gone; nothing is known of the schema far.
    left = governance.column_catalog(spark, {"T": StructType.fromDDL("B INT, c INT")}, "db")
    governance.store_tags(again, name, left)
    assert stored(spark, name) == {("db", "t", "b"): "PII", ("db", "t", "c"): "NONE", ("far", "t", "q"): "PII"}
    # One tag a column of either kind.
    governance.store_tags(tags_of(spark, tag("b", "PII", name=governance.COMMENT_TAG)), name)
    assert spark.table(name).where("column_name = 'b'").count() == 2
    # A failed replace leaves the tags as they were.
    broken = tags_of(spark, tag("z", "PII")).withColumn("tag_value", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        governance.store_tags(broken, name)
    assert spark.table(name).count() == 4


def test_masking_views_look_up_the_role_when_read(spark, namespace, frame, schema, tmp_path):
    columns = [F.col(f.name).alias(f.name, metadata=f.metadata) for f in schema.fields]
    lake.replace_table(frame.select(*columns), f"{namespace}.t", location=f"{tmp_path}/t")
    plain = spark.createDataFrame([(1, "o'neil")], "id INT, `odd ``name` STRING")
    lake.replace_table(plain, f"{namespace}.u", location=f"{tmp_path}/u")
    tags = tags_of(spark, tag("odd `name", "PII", "u", namespace), tag("h", "UNCLASSIFIED_PII", "T", namespace.upper()))
    views = governance.create_masking_views(spark, namespace, tags)
    assert views == ["t_masked", "u_masked"]
    row = spark.table("t_masked").first()
    assert (row.a, row.b, row.c, row.d) == (governance.COMMENT_LITERAL, None, None, None)
    assert (row.e, row.h, row.j) == (2.5, governance.PROPERTY_LITERAL, "j")
    assert spark.table("u_masked").first()[1] == governance.PROPERTY_LITERAL
    assert spark.table("t_masked").schema["b"].dataType == frame.schema["b"].dataType
    governance.set_role(spark, PII_READER_ROLE)
    assert spark.table("u_masked").first()[1] == "o'neil"
    assert spark.sql("SELECT a, b, h FROM t_masked ORDER BY b NULLS LAST").first() == ("x", 1, "h")
    # Another role, a null and what only looks like the reader's role show nothing.
    for role in ("'SYSADMIN'", "NULL", "'pii_reader'"):
        spark.sql(f"SET VARIABLE {governance.ROLE_VARIABLE} = {role}")
        assert spark.table("u_masked").first()[1] == governance.PROPERTY_LITERAL


def test_masked_columns_of_a_view_are_not_read(spark, namespace, tmp_path):
    rows = spark.createDataFrame([(1, "secret", "open")], f"id INT, name STRING {PII}, note STRING")
    lake.replace_table(rows, f"{namespace}.p", location=f"{tmp_path}/p")
    governance.create_masking_views(spark, namespace)

    def read_schema():
        plan = spark.table("p_masked")._jdf.queryExecution().executedPlan().toString()
        return plan.split("ReadSchema:")[1].splitlines()[0]

    assert "name" not in read_schema() and "note" in read_schema()
    governance.set_role(spark, PII_READER_ROLE)
    assert "name" in read_schema()
