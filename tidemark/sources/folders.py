"""Registering Parquet folders as catalog tables, one table per folder."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import side_by_side
from tidemark.sources.lake import column_ddl, literal, quote, table_properties

log = logging.getLogger(__name__)

RESULT_DDL = "table_name STRING, status STRING, added_columns ARRAY<STRING>, error STRING"


def register_folder(spark: SparkSession, namespace: str, table: str, path: str) -> tuple[str, list[str]]:
    """Create the table over ``path``, or add the columns that its files have gained.

    The status is CREATED, UPDATED when columns were added, or UNCHANGED.
    The schema is merged from all files of the folder; Spark reads their footers in
    parallel. Columns of incompatible types make the merge, and so the call, fail.
    """
    name = f"{namespace}.{table}"
    merged = spark.read.option("mergeSchema", True).parquet(path).schema
    if not spark.catalog.tableExists(name):
        columns = ", ".join(column_ddl(field) for field in merged.fields)
        spark.sql(f"CREATE TABLE {quote(name)} ({columns}) USING parquet LOCATION {literal(path)}")
        return "CREATED", []
    known = {field.name.lower(): field for field in spark.table(quote(name)).schema.fields}
    added = []
    for field in merged.fields:
        before = known.get(field.name.lower())
        if before is None:
            added.append(field)
        elif before.dataType != field.dataType:
            # A table keeps its types: readers of the column would silently get others.
            raise TypeError(
                f"column {field.name} is {before.dataType.simpleString()} in the table "
                f"and {field.dataType.simpleString()} in the files"
            )
    if added:
        columns = ", ".join(column_ddl(field) for field in added)
        spark.sql(f"ALTER TABLE {quote(name)} ADD COLUMNS ({columns})")
    spark.catalog.refreshTable(name)
    return "UPDATED" if added else "UNCHANGED", [field.name for field in added]


FOLDER = "_folder"
#: The property of a table that several subfolders share, with the folder they are in.
GROUP_PROPERTY = "tidemark.folder"


def merged(one: StructType, other: StructType) -> StructType | None:
    """The columns of both, or None if a column has different types in them."""
    types = {field.name.lower(): field.dataType for field in one.fields}
    new = [field for field in other.fields if field.name.lower() not in types]
    if any(types.get(field.name.lower(), field.dataType) != field.dataType for field in other.fields):
        return None
    return StructType([*one.fields, *new])


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders right below a folder, hidden ones left out."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in system.listStatus(folder) if s.isDirectory()]
    return sorted(name for name in found if not name.startswith(("_", ".")))


def _groups(spark: SparkSession, namespace: str, table: str, path: str) -> dict[str, tuple[StructType, set[str]]]:
    """The tables that an earlier call made of a folder: their columns and the subfolders in them."""
    found = {}
    for row in spark.sql(f"SHOW TABLES IN {quote(namespace)}").where("NOT isTemporary").collect():
        name = row["tableName"]
        if name != table and not name.startswith(f"{table}_"):
            continue
        full = f"{namespace}.{name}"
        if table_properties(spark, full).get(GROUP_PROPERTY) != path:
            continue
        columns = StructType([field for field in spark.table(quote(full)).schema.fields if field.name != FOLDER])
        parts = spark.sql(f"SHOW PARTITIONS {quote(full)}").selectExpr("substring_index(partition, '=', -1)").collect()
        found[name] = (columns, {part[0] for part in parts})
    return found


def register_grouped(
    spark: SparkSession, namespace: str, table: str, path: str, concurrency: int = 8
) -> dict[str, tuple[str, list[str]]]:
    """One table for the subfolders of ``path`` whose schemas fit together, another one for others.

    Each subfolder's schema is merged from the footers of its files, in parallel; types that
    differ inside one fail the call. A subfolder stays in the table that it is in; a new one
    joins the first table that it fits, by name, or starts one named by itself (the very first is
    ``table``). Fitting is not transitive, so what counts is the merged schema of a table. The
    rows keep their subfolder's name in ``_folder``. Returns status and added columns by table.
    """
    path = path.rstrip("/")
    names = subfolders(spark, path)
    read = side_by_side(
        spark, lambda name: spark.read.option("mergeSchema", True).parquet(f"{path}/{name}").schema, names, concurrency
    )
    groups = _groups(spark, namespace, table, path)
    before = {name: (schema, set(held)) for name, (schema, held) in groups.items()}
    for folder, schema in zip(names, read):
        own = next((name for name, (_, held) in groups.items() if folder in held), None)
        if own is not None and merged(groups[own][0], schema) is None:
            raise TypeError(f"{path}/{folder} no longer fits table {own}")
        order = [own] if own is not None else sorted(groups, key=lambda name: (name != table, name))
        target = next((name for name in order if merged(groups[name][0], schema) is not None), None)
        if target is None:
            target = table if not groups else f"{table}_{re.sub(r'[^0-9a-zA-Z]+', '_', folder).lower()}"
            if target in groups or (target not in groups and spark.catalog.tableExists(f"{namespace}.{target}")):
                raise ValueError(f"table {target} exists and holds something else")
            groups[target] = (StructType(), set())
        columns, held = groups[target]
        groups[target] = (merged(columns, schema), held | {folder})
    results = {}
    for name, (columns, held) in groups.items():
        full = quote(f"{namespace}.{name}")
        known, placed = before.get(name, (StructType(), set()))
        added = columns.fields[len(known.fields) :]
        if name not in before:
            listed = ", ".join([*map(column_ddl, columns.fields), f"{FOLDER} STRING"])
            spark.sql(
                f"CREATE TABLE {full} ({listed}) USING parquet PARTITIONED BY ({FOLDER}) LOCATION {literal(path)} "
                f"TBLPROPERTIES ({literal(GROUP_PROPERTY)} = {literal(path)})"
            )
        elif added:
            spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({', '.join(map(column_ddl, added))})")
        for folder in sorted(held - placed):
            place = literal(f"{path}/{folder}")
            spark.sql(f"ALTER TABLE {full} ADD IF NOT EXISTS PARTITION ({FOLDER} = {literal(folder)}) LOCATION {place}")
        spark.catalog.refreshTable(full)
        status = "CREATED" if name not in before else "UPDATED" if added or held - placed else "UNCHANGED"
        results[name] = (status, [field.name for field in added] if name in before else [])
    return results


def register_folders(
    spark: SparkSession, base_path: str, tables: Sequence[str], namespace: str, concurrency: int = 4
) -> DataFrame:
    """Register every folder; a missing one is only logged, a failing one does not stop the rest."""

    def one(table: str) -> tuple:
        try:
            status, added = register_folder(spark, namespace, table, f"{base_path.rstrip('/')}/{table}")
            return (table, status, added, None)
        except Exception as error:
            log.warning("folder of %s: %s", table, error)
            if isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND":
                return (table, "MISSING", [], None)
            return (table, "FAILED", [], str(error))

    return spark.createDataFrame(side_by_side(spark, one, tables, concurrency), RESULT_DDL)
