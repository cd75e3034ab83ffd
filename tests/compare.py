"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _value(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return canonical(frame.columns, [tuple(row) for row in frame.collect()])


def duck_rows(connection, sql):
    result = connection.execute(sql)
    return canonical([column[0] for column in result.description], result.fetchall())


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def assert_same(frame, connection, sql):
    result = connection.execute(sql)
    duck_types = {c[0]: str(c[1]) for c in result.description}
    expected = canonical([column[0] for column in result.description], result.fetchall())
    actual = spark_rows(frame)
    assert actual[0] == expected[0]
    spark_types = {f.name: SAME_TYPE[f.dataType.simpleString()] for f in frame.schema.fields}
    assert spark_types == duck_types
    assert len(actual[1]) == len(expected[1])
    for left, right in zip(actual[1], expected[1]):
        assert left == right
