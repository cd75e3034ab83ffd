"""Classification, tags and masked reads."""

from oracle.generated import CUSTOMERS, EMPLOYEES, below, num, pick
from oracle.star import STAR
from tidemark.plans.governance import EMPLOYEE_CLASSIFICATION

MASK = "'***PII MASKED***'"
PROPERTY_MASK = "'***PII PROPERTY MASKED***'"
TAG = "GOVERNANCE.CLASSIFICATION.PII"

# table, column, type, mask family, position
MARKED = [
    ("customers", "customer_id", "bigint", "NUMBER", 1),
    ("customers", "customer_name", "string", "STRING", 2),
    ("customers", "country", "string", "STRING", 3),
    ("customers", "account_balance", "double", None, 4),
    ("orders", "customer_id", "bigint", "NUMBER", 2),
]

PREVIEW = STAR + " UNION ALL ".join(
    f"""SELECT 'lake' AS table_schema, '{table}' AS table_name, '{column}' AS column_name,
               '{kind}' AS data_type, 'PII=PII' AS comment, '{TAG}' AS tag,
               '{f"{TAG}_{family}_MASK" if family else "UNSUPPORTED_DATA_TYPE"}' AS masking_policy,
               {position} AS ordinal_position, (SELECT count({column}) FROM s_{table}) AS covered_values"""
    for table, column, kind, family, position in MARKED
)

TAGS = STAR + " UNION ALL ".join(
    f"""SELECT 'GOVERNANCE' AS tag_database, 'CLASSIFICATION' AS tag_schema, 'PII' AS tag_name,
               'PII' AS tag_value, 'LAKE' AS object_database, 'lake' AS object_schema,
               '{table}' AS object_name, '{column}' AS column_name,
               (SELECT count(*) FROM s_{table}) AS row_count"""
    for table, column, *_ in MARKED
)

COLUMNS = list(EMPLOYEE_CLASSIFICATION)
LABELS = ["PII", "pii", "UNCLASSIFIED_PII", "none", "internal"]


def label(column):
    return pick(num(7, column, "p_partkey"), LABELS)




BROKEN = f"({below(num(7, 'broken', 'p_partkey'), 10)} = 0)"


def documents(name, pick):
    """One document per organization: that of its highest or lowest part key."""
    return f"""{name} AS (
  SELECT p_partkey % (SELECT count(*) FROM supplier) AS org_id, {pick}(p_partkey) AS p_partkey
  FROM part GROUP BY 1
)"""


def tags(name, source):
    """The tags that the documents of ``source`` give."""
    entries = " UNION ALL ".join(
        f"SELECT org_id, p_partkey, '{column}' AS column_name, {label(column)} AS label FROM {source}"
        for column in COLUMNS
    )
    return f"""{name} AS (
  SELECT 'GOVERNANCE' AS tag_database, 'CLASSIFICATION' AS tag_schema,
         'PII_CLASSIFICATION' AS tag_name, upper(label) AS tag_value, 'LAKE' AS object_database,
         'lake' AS object_schema, 'directory_' || org_id AS object_name, column_name
  FROM ({entries}) WHERE NOT {BROKEN} AND label <> 'internal'
)"""


NEWEST = documents("newest", "max")
NEWEST_TAGS = tags("newest_tags", "newest")

JSON_TEXT = " || ',' || ".join(
    f"""'"' || CASE WHEN p_partkey % 2 = 1 THEN upper('{column}') ELSE '{column}' END || '":"'
        || {label(column)} || '"'"""
    for column in sorted(COLUMNS)
)


def directory(*masked):
    return "SELECT * REPLACE (" + ", ".join(f"{PROPERTY_MASK} AS {c}" for c in masked) + f") FROM ({EMPLOYEES})"


DATED = """
WITH dated AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(last AS DATE) AS last_order_date
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey
)"""

ORACLE = {
    "pii_columns_preview": PREVIEW,
    "pii_tags": TAGS,
    "customers_masked_reader": STAR
    + f"""SELECT CAST(NULL AS BIGINT) AS customer_id, {MASK} AS customer_name, {MASK} AS country,
                 account_balance, customer_segment FROM s_customers""",
    "customers_masked_pii_reader": STAR + "SELECT * FROM s_customers",
    "synthetic_customers_masked_reader": f"""
        SELECT CAST(NULL AS BIGINT) AS customer_id, {MASK} AS first_name, {MASK} AS last_name, {MASK} AS email,
               {MASK} AS phone, CAST(NULL AS DATE) AS date_of_birth, {MASK} AS address_line1,
               {MASK} AS postal_code, {MASK} AS national_id, {MASK} AS city, {MASK} AS country,
               signup_date, customer_segment
        FROM ({CUSTOMERS})""",
    "directory_masked_reader": directory("first_name", "last_name", "email", "phone"),
    "directory_masked_pii_reader": EMPLOYEES,
    "property_classification": f"""WITH {NEWEST}
        SELECT 'directory_' || org_id AS table_name,
               make_timestamp((1767225600 + p_partkey) * 1000000) AS modified,
               CASE WHEN {BROKEN} THEN '{{"email": '
                    ELSE '{{' || {JSON_TEXT} || '}}' END AS pii_classification_json,
               'column-classification-v1' AS pii_schema, 'PII' AS pii_tag
        FROM newest""",
    "property_tags": f"WITH {NEWEST}, {NEWEST_TAGS} SELECT * FROM newest_tags",
    "property_tag_totals": f"""WITH {NEWEST}, {NEWEST_TAGS}
        SELECT tag_name, tag_value, count(*) AS tagged_columns, count(DISTINCT object_name) AS tagged_tables
        FROM newest_tags GROUP BY 1, 2""",
    "retagged_columns": f"""WITH {NEWEST}, {NEWEST_TAGS}, {documents("oldest", "min")}, {tags("oldest_tags", "oldest")}
        SELECT * FROM newest_tags UNION ALL
        SELECT * FROM oldest_tags ANTI JOIN newest_tags USING (object_name, column_name)""",
    "stored_tags": f"""WITH {NEWEST}, {NEWEST_TAGS}, {documents("oldest", "min")}, {tags("oldest_tags", "oldest")}
        SELECT * FROM (SELECT * FROM newest_tags UNION ALL
        SELECT * FROM oldest_tags ANTI JOIN newest_tags USING (object_name, column_name)) WHERE column_name <> 'phone'""",
    "masked_by_stored_tags": f"""{DATED}
        SELECT CAST(NULL AS BIGINT) AS c_custkey, {PROPERTY_MASK} AS c_name, c_nationkey, {PROPERTY_MASK} AS c_mktsegment,
               CAST(NULL AS DATE) AS last_order_date, 'READER' AS role FROM dated
        UNION ALL SELECT *, 'PII_READER' FROM dated""",
    "masking_views": STAR
    + f"""SELECT CAST(NULL AS BIGINT) AS customer_id, {MASK} AS customer_name, {PROPERTY_MASK} AS country,
                 account_balance, {PROPERTY_MASK} AS customer_segment, 'READER' AS role FROM s_customers
          UNION ALL SELECT *, 'PII_READER' FROM s_customers""",
    "masked_by_both_routes": STAR
    + f"""SELECT CAST(NULL AS BIGINT) AS customer_id, {MASK} AS customer_name, {MASK} AS country, account_balance,
                 segment AS customer_segment
          FROM (SELECT *, {PROPERTY_MASK} AS segment FROM s_customers
                UNION ALL SELECT *, customer_segment FROM s_customers)""",
    "refresh_twice": STAR
    + f"""SELECT CAST(NULL AS BIGINT) AS customer_id, {PROPERTY_MASK} AS customer_name, {MASK} AS country,
                 account_balance, {PROPERTY_MASK} AS customer_segment FROM s_customers""",
    "newest_metadata_files": f"""{DATED}
        SELECT 'v2.metadata.json' AS file_name, column_name, class, covered_values FROM (
            SELECT 'c_name' AS column_name, 'PII' AS class, count(c_name) AS covered_values FROM dated
            UNION ALL SELECT 'c_custkey', 'unclassified_pii', count(c_custkey) FROM dated
            UNION ALL SELECT 'c_nationkey', 'NONE', count(c_nationkey) FROM dated
            UNION ALL SELECT 'last_order_date', 'PII', count(last_order_date) FROM dated)""",
    "tag_masked_reader": f"""{DATED}
        SELECT CAST(NULL AS BIGINT) AS c_custkey, {PROPERTY_MASK} AS c_name, c_nationkey, c_mktsegment,
               CAST(NULL AS DATE) AS last_order_date FROM dated""",
    "tag_masked_pii_reader": f"{DATED} SELECT * FROM dated",
    "tag_report": STAR
    + """SELECT CAST(5 AS BIGINT) AS tagged_columns, CAST(1 AS BIGINT) AS skipped_columns,
                (SELECT count(*) FROM s_customers) + (SELECT count(*) FROM s_orders) AS covered_rows""",
    "tag_references": f"WITH {NEWEST}, {NEWEST_TAGS} SELECT * FROM newest_tags WHERE object_name = 'directory_1'",
    "verification_texts": """
        SELECT replace('SELECT * FROM lake.tags WHERE object_schema = "lake" AND object_name = "directory_'
               || s_suppkey || '" AND upper(tag_name) = "PII" ORDER BY column_name', '"', chr(39)) AS verification_sql
        FROM supplier""",
}
