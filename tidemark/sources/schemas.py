"""Declared table schemas.

Keys are BIGINT so that a table may hold more than 2^31 rows; all other types are as
users of these tables know them.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# Table and column names, types, and the personal-data comment.
PII_COMMENT = "PII=PII"

TABLE_DDL = {
    "organizations": """
        org_id BIGINT NOT NULL,
        org_name STRING NOT NULL,
        industry STRING NOT NULL,
        country STRING NOT NULL""",
    "products": """
        product_id BIGINT NOT NULL,
        org_id BIGINT NOT NULL,
        product_name STRING NOT NULL,
        category STRING NOT NULL,
        price DOUBLE NOT NULL,
        stock_quantity INT NOT NULL,
        created_date DATE NOT NULL""",
    "customers": """
        customer_id BIGINT NOT NULL COMMENT 'PII=PII',
        first_name STRING NOT NULL COMMENT 'PII=PII',
        last_name STRING NOT NULL COMMENT 'PII=PII',
        email STRING NOT NULL COMMENT 'PII=PII',
        phone STRING NOT NULL COMMENT 'PII=PII',
        date_of_birth DATE NOT NULL COMMENT 'PII=PII',
        address_line1 STRING NOT NULL COMMENT 'PII=PII',
        postal_code STRING NOT NULL COMMENT 'PII=PII',
        national_id STRING NOT NULL COMMENT 'PII=PII',
        city STRING NOT NULL COMMENT 'PII=PII',
        country STRING NOT NULL COMMENT 'PII=PII',
        signup_date DATE NOT NULL,
        customer_segment STRING NOT NULL""",
    "orders": """
        order_id BIGINT NOT NULL,
        customer_id BIGINT NOT NULL COMMENT 'PII=PII',
        org_id BIGINT NOT NULL,
        order_date DATE NOT NULL,
        total_amount DOUBLE NOT NULL,
        num_items INT NOT NULL,
        order_status STRING NOT NULL""",
    "order_items": """
        order_item_id BIGINT NOT NULL,
        order_id BIGINT NOT NULL,
        product_id BIGINT NOT NULL,
        quantity INT NOT NULL,
        unit_price DOUBLE NOT NULL,
        subtotal DOUBLE NOT NULL""",
    "employee_directory_poc": """
        employee_id BIGINT NOT NULL,
        first_name STRING NOT NULL,
        last_name STRING NOT NULL,
        email STRING NOT NULL,
        phone STRING NOT NULL,
        department STRING NOT NULL,
        job_title STRING NOT NULL,
        country STRING NOT NULL,
        employment_type STRING NOT NULL,
        hire_date DATE NOT NULL""",
    "audit_stats": """
        audit_ts TIMESTAMP,
        job_run_id STRING,
        source_table STRING,
        source_row_count BIGINT,
        target_table STRING,
        target_row_count BIGINT,
        sync_status STRING,
        error_message STRING""",
}

LAKE_TABLES = ("organizations", "products", "customers", "orders", "order_items")


def schema_of(table: str) -> StructType:
    """The declared schema of ``table``, column comments included."""
    return StructType.fromDDL(TABLE_DDL[table])
