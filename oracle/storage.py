"""Writers, table lifecycle and landing: the source query is what must be read back."""

from oracle.generated import ORACLE as GENERATED
from oracle.star import ORACLE as STAR_ORACLE
from oracle.star import STAR

FIRST = "TIMESTAMP '2026-01-01 00:00:00'"
COUNTS = f"({STAR_ORACLE['table_row_counts']})"
ROUNDTRIP = f"SELECT table_name, row_count AS source_rows, row_count AS stored_rows, true AS same FROM {COUNTS}"

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
# Events as messages of their type's topic, with what is wrong with them.
TOPICS = f"""WITH topics AS (
  SELECT *, {K} AS k, CASE WHEN event_type = 'error' THEN 'unknown topic'
    WHEN event_type = 'signup' AND {K} = 3 THEN 'not one object'
    WHEN event_type = 'purchase' AND ({K} % 2 = 1 OR value IS NULL) THEN 'fields do not fit'
    WHEN event_type = 'view' AND (user_id IS NULL OR {K} IS NULL) THEN 'fields do not fit'
    WHEN event_type <> 'error' AND ts IS NULL THEN 'fields do not fit' END AS reason
  FROM events
), newest AS (SELECT max(ts) AS newest FROM topics WHERE event_id % 2 = 0 AND reason IS NULL
), placed AS (
  SELECT *, reason IS NULL AND event_id % 2 = 1 AND ts < newest - INTERVAL 7 DAY AS late FROM topics, newest
)"""
TOPIC_ROW = """event_type AS topic, event_id, ts, CASE WHEN event_type <> 'purchase' THEN user_id END AS user_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS value,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(k AS BIGINT) END AS k"""


def _pair(topic, verdict, fields, forth, back):
    """The rows of one pair: its fields, and how many messages the other version reads."""
    rows = " UNION ALL ".join(f"SELECT '{f}' AS field, '{c}' AS change, '{v}' AS field_verdict" for f, c, v in fields)
    return f"""SELECT '{topic}' AS pair, '{verdict}' AS verdict, field, change, field_verdict,
        (SELECT count(*) FROM kinds WHERE event_type = '{topic}' AND ({forth})) AS new_reads,
        (SELECT count(*) FROM kinds WHERE event_type = '{topic}' AND NOT ({forth})) AS new_refuses,
        (SELECT count(*) FROM kinds WHERE event_type = '{topic}' AND ({back})) AS old_reads,
        (SELECT count(*) FROM kinds WHERE event_type = '{topic}' AND NOT ({back})) AS old_refuses FROM ({rows})"""


PAIRS = [
    ("view", "BACKWARD", [("event_id", "same", "FULL"), ("k", "widened", "BACKWARD"), ("value", "added", "FULL")], "true", "k <= 2"),
    ("click", "FULL", [("event_id", "same", "FULL"), ("k", "same", "FULL"), ("user_id", "dropped", "FULL")], "true", "true"),
    ("purchase", "FORWARD", [("event_id", "same", "FULL"), ("value", "made required", "FORWARD"), ("k", "added", "FULL")],
     "k > 4 AND value IS NOT NULL", "true"),
    ("signup", "NONE", [("event_id", "same", "FULL"), ("k", "retyped", "NONE")], "k IS NULL", "k IS NULL"),
    ("error", "NONE", [("event_id", "same", "FULL"), ("k", "made optional", "BACKWARD"), ("day", "widened", "NONE")],
     "k > 4", "false"),
]

ORACLE = {
    "land_topics": f"{TOPICS} SELECT {TOPIC_ROW} FROM topics WHERE reason IS NULL",
    "quarantine_topics": f"{TOPICS} SELECT event_type AS topic, reason, event_id FROM topics WHERE reason IS NOT NULL",
    "redelivered_events": f"{TOPICS} SELECT {TOPIC_ROW} FROM placed WHERE reason IS NULL AND NOT late",
    "redelivered_counts": f"""{TOPICS}
        SELECT event_type AS topic, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN late THEN 'late' ELSE 'valid' END
            AS verdict, count(*) AS messages FROM placed GROUP BY 1, 2""",
    "schema_compatibility": f"WITH kinds AS (SELECT *, {K} AS k FROM events) "
    + " UNION ALL ".join(_pair(*pair) for pair in PAIRS),
    "parquet_roundtrip": ROUNDTRIP,
    "table_roundtrip": ROUNDTRIP,
    "declared_folder_read": f"""
        SELECT table_name, rows AS source_rows, rows AS stored_rows, true AS same FROM (
            SELECT 'organizations' AS table_name, count(*) AS rows FROM supplier
            UNION ALL SELECT 'products', count(*) FROM ({GENERATED['gen_products']})
            UNION ALL SELECT 'customers', count(*) FROM customer
            UNION ALL SELECT 'orders', count(*) FROM orders
            UNION ALL SELECT 'order_items', count(*) FROM ({GENERATED['gen_order_items']}))""",
    "fallback_write": STAR + "SELECT * FROM s_orders",
    "partitioned_roundtrip": STAR
    + "SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS load_date FROM s_orders",
    "load_as_of": STAR
    + """, loads AS (SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS load_date FROM s_orders)
         SELECT * FROM loads WHERE load_date = (SELECT max(load_date) FROM loads WHERE load_date <= DATE '1996-05-17')""",
    "register_folders": f"""
        SELECT table_name, CASE WHEN table_name = 'orders' THEN 'UPDATED' ELSE 'UNCHANGED' END AS status,
               CASE WHEN table_name = 'orders' THEN 'num_items' ELSE '' END AS added_columns, row_count
        FROM {COUNTS}""",
    "register_grouped": STAR
    + """SELECT order_id, customer_id, org_id, order_date, total_amount,
                CASE WHEN order_id % 4 <> 0 THEN num_items END AS num_items,
                CASE WHEN order_id % 4 <> 3 THEN order_status END AS order_status,
                CASE order_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b old' WHEN 2 THEN 'c' ELSE '0 late' END AS folder,
                CASE WHEN order_id % 2 = 0 THEN 'orders' ELSE 'orders_b_old' END AS table_name
         FROM s_orders""",
    "compacted_audit": STAR
    + """SELECT count(*) AS late_rows, CAST(sum(order_id) AS BIGINT) AS late_ids, true AS had_many_files,
                CAST(1 AS BIGINT) AS files
         FROM s_orders WHERE order_date >= DATE '1997-01-01'""",
    "changed_rows": STAR
    + """SELECT order_id, 'changed' AS difference FROM s_orders
         WHERE order_id % 1000 = 7 OR (order_id % 1000 = 8 AND order_status IS NOT NULL)
         UNION ALL SELECT order_id, 'missing' FROM s_orders WHERE order_id % 1000 = 9
         UNION ALL SELECT -order_id, 'extra' FROM s_orders WHERE order_id % 1000 = 9""",
    "verified_refresh": f"""
        SELECT table_name, 'OK' AS status, row_count AS source_rows, row_count AS target_rows,
               CAST(NULL AS VARCHAR) AS error FROM {COUNTS}""",
    "replicate_status": f"""
        SELECT table_name, 'OK' AS status, row_count AS source_rows, row_count AS target_rows FROM {COUNTS}""",
    "audit_log": f"""
        SELECT {FIRST} AS audit_ts, 'run-1' AS job_run_id, table_name AS source_table,
               CASE WHEN table_name <> 'products' THEN row_count END AS source_row_count, table_name AS target_table,
               CASE WHEN table_name <> 'products' THEN row_count END AS target_row_count,
               CASE WHEN table_name <> 'products' THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS sync_status,
               CASE WHEN table_name = 'products' THEN 'failed' END AS error_message
        FROM {COUNTS}""",
    "audit_times": f"SELECT table_name, true AS in_time FROM {COUNTS}",
    "namespace_tables": f"SELECT table_name, row_count FROM {COUNTS}",
    "unordered_preview": "SELECT least(10, count(*)) AS rows FROM orders",
    "refresh_partial_failure": f"""
        SELECT 'PARTIAL FAILURE' AS overall_status, CAST(4 AS BIGINT) AS ok_tables,
               CAST(0 AS BIGINT) AS mismatched_tables, CAST(1 AS BIGINT) AS failed_tables,
               CAST(sum(row_count) AS BIGINT) AS copied_rows
        FROM {COUNTS} WHERE table_name <> 'products'""",
    "column_differences": f"""
        SELECT table_name, column_name, change, source_type, target_type, action, 'OK' AS status,
               row_count AS source_rows, row_count AS target_rows
        FROM {COUNTS} JOIN (VALUES
            ('orders', 'customer_id', 'retyped', 'bigint', 'int', 'checked cast'),
            ('orders', 'order_date', 'retyped', 'date', 'timestamp_ntz', 'cast'),
            ('orders', 'num_items', 'retyped', 'int', 'bigint', 'cast'),
            ('orders', 'note', 'gone', NULL, 'string', 'leave null'),
            ('orders', 'order_status', 'added', 'string', NULL, 'create'),
            ('customers', 'customer_id', 'added', 'bigint', NULL, 'create'),
            ('customers', 'customer_name', 'added', 'string', NULL, 'create'),
            ('customers', 'country', 'added', 'string', NULL, 'create'),
            ('customers', 'account_balance', 'added', 'double', NULL, 'create'),
            ('customers', 'customer_segment', 'added', 'string', NULL, 'create')
        ) AS d (table_name, column_name, change, source_type, target_type, action) USING (table_name)""",
    "conformed_refresh": STAR
    + """SELECT order_id, CAST(customer_id AS INTEGER) AS customer_id, org_id, CAST(order_date AS TIMESTAMP) AS order_date,
                total_amount, CAST(num_items AS BIGINT) AS num_items, CAST(NULL AS VARCHAR) AS note, order_status
         FROM s_orders""",
    "land_events": """
        SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events WHERE event_type <> 'error'""",
    "quarantine_events": """
        SELECT 'error ' || event_id || ' ' || props AS raw FROM events WHERE event_type = 'error'""",
    "landing_counts": """
        SELECT CASE WHEN event_type = 'error' THEN 'quarantined' ELSE 'valid' END AS verdict, count(*) AS messages
        FROM events GROUP BY 1""",
    "strict_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
