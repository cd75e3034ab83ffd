"""How the columns of a copy differ from those of its source, and what to do about it.

A copy may keep its own columns: then source columns are cast to its types where no
value can change, or where a cast fails for each value that would.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.functions.types import checked, lossless
from tidemark.session import side_by_side
from tidemark.sources.lake import comment_of, quote

ADDED, GONE, RETYPED, COMMENTED, RESPELLED, SAME = "added", "gone", "retyped", "comment changed", "respelled", "same"
#: What happens to a column if the copy keeps its own: a column of the copy takes over the
#: source's values as they are, cast without loss, or cast with a check; it is created; it is
#: left without values; or the copy is refused.
KEEP, CAST, CHECKED_CAST, CREATE, LEAVE_NULL, REFUSE = "keep", "cast", "checked cast", "create", "leave null", "refuse"

DIFF_DDL = "table_name string, column_name string, change string, source_type string, target_type string, action string"


class ColumnDifference(NamedTuple):
    column_name: str
    change: str
    source_type: str | None
    target_type: str | None
    action: str


def _difference(source: StructField | None, target: StructField | None) -> ColumnDifference:
    if target is None:
        return ColumnDifference(source.name, ADDED, source.dataType.simpleString(), None, CREATE)
    kind = target.dataType.simpleString()
    if source is None:
        return ColumnDifference(target.name, GONE, None, kind, LEAVE_NULL)
    if source.dataType != target.dataType:
        action = REFUSE
        if lossless(source.dataType, target.dataType):
            action = CAST
        elif checked(source.dataType, target.dataType):
            action = CHECKED_CAST
        return ColumnDifference(target.name, RETYPED, source.dataType.simpleString(), kind, action)
    change = SAME
    if source.name != target.name:
        change = RESPELLED
    elif comment_of(source) and comment_of(source) != comment_of(target):
        change = COMMENTED
    return ColumnDifference(target.name, change, kind, kind, KEEP)


def column_differences(source: StructType, target: StructType) -> list[ColumnDifference]:
    """One entry for each column of either schema: the target's first, in its order."""
    offered = {field.name.lower(): field for field in source.fields}
    known = {field.name.lower() for field in target.fields}
    found = [_difference(offered.get(field.name.lower()), field) for field in target.fields]
    return found + [_difference(field, None) for field in source.fields if field.name.lower() not in known]


def conform(rows: DataFrame, target: StructType) -> DataFrame:
    """``rows`` with the columns and types of ``target``, and behind them what only ``rows`` has.

    A value that a checked cast would change fails the query. Columns that cannot be cast are
    refused at once, all of them by name.
    """
    differences = column_differences(rows.schema, target)
    refused = [f"{d.column_name} from {d.source_type} to {d.target_type}" for d in differences if d.action == REFUSE]
    if refused:
        raise TypeError(f"no safe cast of {', '.join(refused)}")
    offered = {field.name.lower(): field for field in rows.schema.fields}
    known = {field.name.lower(): field for field in target.fields}
    columns = []
    for difference in differences:
        low = difference.column_name.lower()
        name, field = quote(difference.column_name), known.get(low)
        if difference.action == CREATE:
            columns.append(F.col(name))
            continue
        kind = field.dataType.simpleString()
        value = F.lit(None).cast(field.dataType) if difference.action == LEAVE_NULL else F.col(name)
        if difference.action == CAST:
            value = value.cast(field.dataType)
        elif difference.action == CHECKED_CAST:
            # Whatever the session's rules for casts are.
            cast = F.expr(f"try_cast({name} AS {kind})")
            problem = F.concat(F.lit(f"{difference.column_name} does not fit {kind}: "), F.col(name).cast("string"))
            value = F.when(F.col(name).isNotNull() & cast.isNull(), F.raise_error(problem).cast(field.dataType)).otherwise(cast)
        comment = comment_of(offered[low]) if low in offered else None
        comment = comment or comment_of(field)
        columns.append(value.alias(field.name, metadata={"comment": comment} if comment else {}))
    return rows.select(*columns)


def difference_table(spark: SparkSession, tables: Mapping[str, tuple[StructType, StructType]]) -> DataFrame:
    """The differences between source and target of each table, equal columns left out."""
    rows = [
        (table, *difference)
        for table, (source, target) in tables.items()
        for difference in column_differences(source, target)
        if difference.change != SAME
    ]
    return spark.createDataFrame(rows, DIFF_DDL)


def namespace_differences(
    spark: SparkSession, source_namespace: str, target_namespace: str, tables: Sequence[str]
) -> DataFrame:
    """The same for tables of two namespaces, from metadata only; a table that is not there has no columns."""

    def one(table: str) -> tuple[StructType, StructType]:
        names = (f"{source_namespace}.{table}", f"{target_namespace}.{table}")
        return tuple(spark.table(quote(n)).schema if spark.catalog.tableExists(n) else StructType() for n in names)

    return difference_table(spark, dict(zip(tables, side_by_side(spark, one, tables))))
