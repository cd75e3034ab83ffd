"""Finding personal-data columns and masking them by the reader's role.

Columns are classified either by their comment or by a JSON map in a table property. A
mask is a projection applied when reading, not an access boundary: whoever can read the
files can read the values.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    CharType,
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructType,
    VarcharType,
)

from tidemark.session import side_by_side
from tidemark.sources.lake import comment_of, list_tables, literal, quote, replace_table, table_properties
from tidemark.sources.metadata import json_property
from tidemark.sources.schemas import PII_COMMENT

# Property names, classes, tag and mask literals.
CLASSIFICATION_PROPERTY = "governance.pii.classification"
CLASSIFICATION_SCHEMA_PROPERTY = "governance.pii.classification.schema"
CLASSIFICATION_SCHEMA = "column-classification-v1"
TAG_PROPERTY = "governance.pii.tag"
SOURCE_PROPERTY = "governance.pii.source"
CLASSES = ("NONE", "UNCLASSIFIED_PII", "PII")
MASKED_CLASSES = ("PII", "UNCLASSIFIED_PII")
EMPLOYEE_CLASSIFICATION = {
    "employee_id": "NONE",
    "first_name": "PII",
    "last_name": "PII",
    "email": "PII",
    "phone": "UNCLASSIFIED_PII",
    "department": "NONE",
    "job_title": "NONE",
    "country": "NONE",
    "employment_type": "NONE",
    "hire_date": "NONE",
}
COMMENT_LITERAL = "***PII MASKED***"
PROPERTY_LITERAL = "***PII PROPERTY MASKED***"
UNSUPPORTED = "UNSUPPORTED_DATA_TYPE"

READER_ROLE = "READER"
PII_READER_ROLE = "PII_READER"
TAG_DATABASE = "GOVERNANCE"
TAG_SCHEMA = "CLASSIFICATION"
COMMENT_TAG = "PII"
PROPERTY_TAG = "PII_CLASSIFICATION"

# One mask per type family; a type outside the families is reported and left alone.
FAMILY_TYPES = {
    "STRING": (StringType, CharType, VarcharType),
    "NUMBER": (ByteType, ShortType, IntegerType, LongType, DecimalType),
    "DATE": (DateType,),
}

COLUMN_DDL = (
    "table_schema STRING, table_name STRING, column_name STRING, data_type STRING, comment STRING, "
    "ordinal_position INT"
)


def family(data_type: DataType) -> str | None:
    return next((name for name, types in FAMILY_TYPES.items() if isinstance(data_type, types)), None)


# Column catalog


def column_catalog(spark: SparkSession, schemas: Mapping[str, StructType], table_schema: str) -> DataFrame:
    """One row per column of the given schemas."""
    rows = [
        (table_schema, table, field.name, field.dataType.simpleString(), comment_of(field), position)
        for table, schema in schemas.items()
        for position, field in enumerate(schema.fields, 1)
    ]
    return spark.createDataFrame(rows, COLUMN_DDL)


def catalog_of_namespace(spark: SparkSession, namespace: str) -> DataFrame:
    """The column catalog of every table in a namespace, from metadata only."""
    tables = [row["tableName"] for row in list_tables(spark, namespace).collect()]
    schemas = side_by_side(spark, lambda table: spark.table(quote(f"{namespace}.{table}")).schema, tables)
    return column_catalog(spark, dict(zip(tables, schemas)), namespace)


def masking_policy(data_type: Column, tag: str = COMMENT_TAG) -> Column:
    """Name of the mask for a column type, by family."""
    base = F.regexp_extract(data_type, "^[a-z]+", 0)
    prefix = f"{TAG_DATABASE}.{TAG_SCHEMA}.{tag}"
    return (
        F.when(base.isin("string", "char", "varchar"), F.lit(f"{prefix}_STRING_MASK"))
        .when(base.isin("tinyint", "smallint", "int", "bigint", "decimal"), F.lit(f"{prefix}_NUMBER_MASK"))
        .when(base == "date", F.lit(f"{prefix}_DATE_MASK"))
        .otherwise(F.lit(UNSUPPORTED))
    )


def pii_columns(catalog: DataFrame) -> DataFrame:
    """Columns whose comment holds the personal-data mark, with tag and mask."""
    return (
        catalog.where(F.lower("table_schema") != "information_schema")
        .where(F.coalesce("comment", F.lit("")).ilike(f"%{PII_COMMENT}%"))
        .select(
            "table_schema",
            "table_name",
            "column_name",
            "data_type",
            "comment",
            F.lit(f"{TAG_DATABASE}.{TAG_SCHEMA}.{COMMENT_TAG}").alias("tag"),
            masking_policy(F.col("data_type")).alias("masking_policy"),
            "ordinal_position",
        )
        .orderBy("table_schema", "table_name", "ordinal_position")
    )


def covered_values(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """How many values the given columns of each table hold: one pass and one row per column."""
    counts = None
    for table, names in columns.items():
        one = (
            tables[table]
            .agg(*[F.count(quote_name(name)).alias(name) for name in names])
            .unpivot([], list(names), "column_name", "covered_values")
            .select(F.lit(table).alias("table_name"), "column_name", "covered_values")
        )
        counts = one if counts is None else counts.unionAll(one)
    return counts


def marked_columns(schema: StructType) -> list[str]:
    """Names of the columns whose comment holds the personal-data mark."""
    return [f.name for f in schema.fields if PII_COMMENT.lower() in (comment_of(f) or "").lower()]


# Tags


def _tag_rows(columns: DataFrame, database: str, tag_name: str, tag_value: Column) -> DataFrame:
    return columns.select(
        F.lit(TAG_DATABASE).alias("tag_database"),
        F.lit(TAG_SCHEMA).alias("tag_schema"),
        F.lit(tag_name).alias("tag_name"),
        tag_value.alias("tag_value"),
        F.lit(database).alias("object_database"),
        F.col("table_schema").alias("object_schema"),
        F.col("table_name").alias("object_name"),
        "column_name",
    )


def comment_tags(catalog: DataFrame, database: str) -> DataFrame:
    """The tag of every column marked by its comment, whatever its type."""
    return _tag_rows(pii_columns(catalog), database, COMMENT_TAG, F.lit("PII"))


def tag_report(catalog: DataFrame) -> DataFrame:
    """How many columns get the tag and how many of those have no mask for their type."""
    return pii_columns(catalog).agg(
        F.count(F.lit(1)).alias("tagged_columns"),
        F.count_if(F.col("masking_policy") == UNSUPPORTED).alias("skipped_columns"),
    )


def property_tags(documents: DataFrame, catalog: DataFrame, database: str) -> DataFrame:
    """Column tags from classification maps, one ``properties`` map per ``table_name``.

    A map that is not valid JSON gives no tags, names match whatever their case, classes
    outside the allowed set and names of no column are dropped. When two spellings of a
    name give different classes the stricter one counts. The joins of tags shuffle both
    sides: the planner expects far too little of exploded rows and would broadcast them.
    """
    entries = (
        documents.select(
            F.lower("table_name").alias("_table"),
            F.explode(
                F.from_json(json_property("properties", CLASSIFICATION_PROPERTY), "map<string,string>")
            ).alias("_key", "_value"),
        )
        .select("_table", F.lower("_key").alias("_column"), F.upper("_value").alias("_class"))
        .where(F.col("_class").isin(*CLASSES))
        .groupBy("_table", "_column")
        .agg(F.max_by("_class", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("_class"))).alias("_class"))
    )
    matched = catalog.where(F.lower("table_schema") != "information_schema").join(
        entries.hint("merge"), (F.lower("table_name") == F.col("_table")) & (F.lower("column_name") == F.col("_column"))
    )
    return _tag_rows(matched, database, PROPERTY_TAG, F.col("_class"))


def retag(existing: DataFrame, tags: DataFrame) -> DataFrame:
    """``existing`` with the tags of the columns in ``tags`` set anew; no column loses a tag."""
    owner = ["tag_name", "object_database", "object_schema", "object_name", "column_name"]
    return existing.join(tags.select(*owner).distinct().hint("merge"), owner, "left_anti").unionByName(tags)


def of_existing_columns(tags: DataFrame, catalog: DataFrame) -> DataFrame:
    """``tags`` without those of columns that the schemas in ``catalog`` no longer have."""
    named = catalog.select(
        F.lower("table_schema").alias("_schema"), F.lower("table_name").alias("_table"), F.lower("column_name").alias("_column")
    ).distinct()
    same_schema = F.lower("object_schema") == F.col("_schema")
    same_column = (
        same_schema & (F.lower("object_name") == F.col("_table")) & (F.lower("column_name") == F.col("_column"))
    )
    elsewhere = tags.join(named.select("_schema").distinct(), same_schema, "left_anti")
    return elsewhere.unionByName(tags.join(named.hint("merge"), same_column, "left_semi"))


def store_tags(tags: DataFrame, name: str, catalog: DataFrame | None = None, location: str | None = None) -> str:
    """Set tags in a stored table by tag and column; running it again changes nothing.

    Other columns keep the tags that they have, except, with ``catalog``, those that its
    schemas no longer have. The table is replaced as a whole, so readers see all tags from
    before or all from after.
    """
    spark = tags.sparkSession
    if spark.catalog.tableExists(name):
        tags = retag(spark.table(quote(name)), tags)
    if catalog is not None:
        tags = of_existing_columns(tags, catalog)
    return replace_table(tags, name, location=location)


def namespace_tags(spark: SparkSession, namespace: str, database: str) -> DataFrame:
    """The tags that comments and classification properties give the columns of a namespace's tables."""
    catalog = catalog_of_namespace(spark, namespace)
    tables = [row["tableName"] for row in list_tables(spark, namespace).collect()]
    texts = side_by_side(
        spark, lambda t: table_properties(spark, f"{namespace}.{t}").get(CLASSIFICATION_PROPERTY), tables
    )
    documents = spark.createDataFrame(list(zip(tables, texts)), "table_name string, classes string")
    documents = documents.select("table_name", F.create_map(F.lit(CLASSIFICATION_PROPERTY), "classes").alias("properties"))
    return comment_tags(catalog, database).unionByName(property_tags(documents, catalog, database))


def tag_references(tags: DataFrame, tag_name: str, schema: str | None = None, table: str | None = None) -> DataFrame:
    """The tagged columns of one table, of one schema or of the whole database."""
    found = tags.where(F.upper("tag_name") == tag_name.upper())
    if schema is not None:
        found = found.where(F.col("object_schema") == schema)
    if table is not None:
        found = found.where(F.col("object_name") == table)
    return found.orderBy("object_schema", "object_name", "column_name")


def tag_totals(tags: DataFrame) -> DataFrame:
    """Tagged columns and tables per tag value."""
    per_table = tags.groupBy("tag_name", "tag_value", "object_schema", "object_name").agg(F.count(F.lit(1)).alias("n"))
    return per_table.groupBy("tag_name", "tag_value").agg(
        F.sum("n").alias("tagged_columns"), F.count(F.lit(1)).alias("tagged_tables")
    )


def verification_queries(catalog: DataFrame, tags_table: str) -> DataFrame:
    """One query text per table that lists its tagged columns."""

    def text(column: str) -> Column:
        return F.replace(F.col(column), F.lit("'"), F.lit("''"))

    tables = catalog.where(F.lower("table_schema") != "information_schema").select("table_schema", "table_name")
    return (
        tables.distinct()
        .orderBy("table_schema", "table_name")
        .select(
            F.concat(
                F.lit(f"SELECT * FROM {tags_table} WHERE object_schema = '"),
                text("table_schema"),
                F.lit("' AND object_name = '"),
                text("table_name"),
                F.lit(f"' AND upper(tag_name) = '{COMMENT_TAG}' ORDER BY column_name"),
            ).alias("verification_sql")
        )
    )


# Masks


def _mask(field, literal: str, unsupported: str) -> Column | None:
    kind = family(field.dataType)
    if kind == "STRING":
        return F.lit(literal)
    if kind is not None or unsupported == "null":
        return F.lit(None).cast(field.dataType)
    return None


def _masked(
    frame: DataFrame, hidden: set[str], literal: str, role: str, reveal_role: str, unsupported: str
) -> DataFrame:
    if unsupported not in ("keep", "null"):
        raise ValueError(f"unsupported must be 'keep' or 'null', got {unsupported!r}")
    columns = []
    for field in frame.schema.fields:
        value = F.col(quote_name(field.name))
        mask = _mask(field, literal, unsupported) if field.name.lower() in hidden else None
        if mask is not None:
            value = F.when(F.lit(role) == F.lit(reveal_role), value).otherwise(mask)
        columns.append(value.alias(field.name, metadata=field.metadata))
    return frame.select(*columns)


def quote_name(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def mask_by_comment(
    frame: DataFrame, role: str, reveal_role: str = PII_READER_ROLE, unsupported: str = "keep"
) -> DataFrame:
    """Mask the columns whose comment marks them, unless ``role`` is exactly ``reveal_role``.

    Column order and types stay. The role is a literal, so Catalyst folds the condition
    and a masked column is not even read. ``unsupported="null"`` also hides marked columns
    of types that have no mask of their own.
    """
    hidden = {name.lower() for name in marked_columns(frame.schema)}
    return _masked(frame, hidden, COMMENT_LITERAL, role, reveal_role, unsupported)


def mask_by_class(
    frame: DataFrame,
    classes: Mapping[str, str],
    role: str,
    reveal_role: str = PII_READER_ROLE,
    unsupported: str = "keep",
) -> DataFrame:
    """Mask the columns classed PII or UNCLASSIFIED_PII; others pass through."""
    hidden = {column.lower() for column, value in classes.items() if value in MASKED_CLASSES}
    return _masked(frame, hidden, PROPERTY_LITERAL, role, reveal_role, unsupported)


def mask_by_tags(
    frame: DataFrame,
    tags: DataFrame,
    schema: str,
    table: str,
    role: str,
    reveal_role: str = PII_READER_ROLE,
    unsupported: str = "keep",
) -> DataFrame:
    """Mask the columns that the tag rows of one table mark, by either kind of tag.

    There is at most one row for each tag and column of the table. A column that both kinds
    mark gets the property mask; a column that either marks is never shown.
    """
    rows = (
        tags.where((F.lower("object_schema") == schema.lower()) & (F.lower("object_name") == table.lower()))
        .where(F.upper("tag_value").isin(*MASKED_CLASSES))
        .select(F.upper("tag_name").alias("tag"), F.lower("column_name").alias("column"))
        .distinct()
        .collect()
    )
    by_comment = {row["column"] for row in rows if row["tag"] == COMMENT_TAG}
    by_property = {row["column"] for row in rows if row["tag"] == PROPERTY_TAG}
    masked = _masked(frame, by_property, PROPERTY_LITERAL, role, reveal_role, unsupported)
    return _masked(masked, by_comment - by_property, COMMENT_LITERAL, role, reveal_role, unsupported)


ROLE_VARIABLE = "tidemark_role"


def set_role(spark: SparkSession, role: str) -> None:
    """The role under which this session reads masking views from now on."""
    spark.sql(f"SET VARIABLE {ROLE_VARIABLE} = {literal(role)}")


def masking_view(schema: StructType, source: str, by_property: set[str], by_comment: set[str], reveal_role: str) -> str:
    """The query of a masking view: what it shows is decided by the session's role when it is read."""
    columns = []
    for field in schema.fields:
        value, low = quote_name(field.name), field.name.lower()
        if low in by_property | by_comment and (kind := family(field.dataType)) is not None:
            text = literal(PROPERTY_LITERAL if low in by_property else COMMENT_LITERAL)
            hidden = text if kind == "STRING" else f"CAST(NULL AS {field.dataType.simpleString()})"
            # An unset role reveals nothing.
            value = f"CASE WHEN session.{ROLE_VARIABLE} = {literal(reveal_role)} THEN {value} ELSE {hidden} END AS {value}"
        columns.append(value)
    return f"SELECT {', '.join(columns)} FROM {quote(source)}"


def create_masking_views(
    spark: SparkSession,
    namespace: str,
    tags: DataFrame | None = None,
    suffix: str = "_masked",
    role: str = READER_ROLE,
    reveal_role: str = PII_READER_ROLE,
) -> list[str]:
    """A view of every table of a namespace that masks by the session's role; returns their names.

    Columns are masked by what their comments and their tables' classification say, and by
    ``tags``, for example a stored table of them. The role is looked up whenever a query over a
    view is analyzed: one view shows different things after ``set_role``. Spark allows variables
    in temporary views only, so each session makes its views from what is stored.
    """
    spark.sql(f"DECLARE OR REPLACE VARIABLE {ROLE_VARIABLE} STRING DEFAULT {literal(role)}")
    found = namespace_tags(spark, namespace, TAG_DATABASE)
    if tags is not None:
        found = found.unionByName(tags.where(F.lower("object_schema") == namespace.lower()).select(found.columns))
    rows = (
        found.where(F.upper("tag_value").isin(*MASKED_CLASSES))
        .select(F.lower("object_name").alias("table"), F.upper("tag_name").alias("tag"), F.lower("column_name").alias("column"))
        .distinct()
        .collect()
    )
    marked: dict[tuple[str, str], set[str]] = {}
    for row in rows:
        marked.setdefault((row["table"], row["tag"]), set()).add(row["column"])
    views = []
    for table in [row["tableName"] for row in list_tables(spark, namespace).collect()]:
        source = f"{namespace}.{table}"
        by_property, by_comment = (marked.get((table.lower(), tag), set()) for tag in (PROPERTY_TAG, COMMENT_TAG))
        query = masking_view(spark.table(quote(source)).schema, source, by_property, by_comment, reveal_role)
        views.append(f"{table}{suffix}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {quote_name(views[-1])} AS {query}")
    return views


def unsupported_columns(frame: DataFrame, columns: Sequence[str]) -> list[str]:
    """The given columns that have no mask for their type."""
    wanted = {column.lower() for column in columns}
    return [f.name for f in frame.schema.fields if f.name.lower() in wanted and family(f.dataType) is None]


# Classification in table properties


def classification_properties(classes: Mapping[str, str], source: str) -> dict[str, str]:
    """The table properties that carry a classification map."""
    return {
        CLASSIFICATION_PROPERTY: json.dumps(dict(classes), sort_keys=True, separators=(",", ":")),
        CLASSIFICATION_SCHEMA_PROPERTY: CLASSIFICATION_SCHEMA,
        TAG_PROPERTY: "PII",
        SOURCE_PROPERTY: source,
    }


def write_classified(
    frame: DataFrame, name: str, classes: Mapping[str, str], source: str, location: str | None = None
) -> str:
    """Replace a table and store its classification as properties, not as comments."""
    properties = classification_properties(classes, source)
    return replace_table(frame, name, location=location, properties=properties, column_comments=False)


def parse_classes(text: str | None, columns: Sequence[str]) -> dict[str, str]:
    """Classes per column from the property text of one table."""
    try:
        entries = json.loads(text or "")
    except json.JSONDecodeError:
        return {}
    if not isinstance(entries, dict):
        return {}
    known = {column.lower(): column for column in columns}
    classes: dict[str, str] = {}
    for key, value in entries.items():
        column, label = known.get(key.lower()), str(value).upper()
        # A JSON null is no class, as in ``property_tags``.
        if column is None or value is None or label not in CLASSES:
            continue
        if column not in classes or CLASSES.index(label) > CLASSES.index(classes[column]):
            classes[column] = label
    return classes


def table_classes(spark: SparkSession, name: str) -> dict[str, str]:
    return parse_classes(
        table_properties(spark, name).get(CLASSIFICATION_PROPERTY), spark.table(quote(name)).columns
    )


def read_masked_table(spark: SparkSession, name: str, role: str, reveal_role: str = PII_READER_ROLE) -> DataFrame:
    """A catalog table under a role: what its comments or its classification property mark is masked.

    Either is enough, so a property that is broken or names other columns uncovers nothing.
    """
    frame = spark.table(quote(name))
    classes = table_classes(spark, name)
    hidden = {column.lower() for column, value in classes.items() if value in MASKED_CLASSES}
    marked = {column.lower() for column in marked_columns(frame.schema)} - hidden
    masked = mask_by_class(frame, classes, role, reveal_role)
    return _masked(masked, marked, COMMENT_LITERAL, role, reveal_role, "keep")
