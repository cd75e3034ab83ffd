"""Reading and writing lake tables as Parquet folders or as catalog tables."""

from __future__ import annotations

import datetime
import logging
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tidemark.session import side_by_side
from tidemark.sources.schemas import LAKE_TABLES, TABLE_DDL

log = logging.getLogger(__name__)

FORMATS = ("parquet", "table")


def quote(identifier: str) -> str:
    """Backquote every part of a dotted identifier."""
    return ".".join(f"`{part.strip('`').replace('`', '``')}`" for part in identifier.split("."))


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qualified(namespace: str, table: str) -> str:
    """``table`` in ``namespace`` unless it already names one."""
    return table if "." in table else f"{namespace}.{table}"


def _properties(properties: Mapping[str, str]) -> str:
    return ", ".join(f"{literal(key)} = {literal(str(value))}" for key, value in properties.items())


def write_folder(
    frame: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    max_records_per_file: int = 0,
) -> str:
    """Overwrite one Parquet folder.

    With ``partition_by`` the rows are rebalanced by those columns first, so that a value
    is written by few tasks while adaptive execution still splits a value that holds a
    large share of the rows.
    """
    if partition_by:
        frame = frame.hint("rebalance", *partition_by)
    writer = frame.write.mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_dated_folder(frame: DataFrame, path: str, load_date: str | None = None) -> str:
    """Overwrite a folder split by ``load_date``: the given day, or the frame's own column."""
    if load_date is not None:
        # One day for all rows: nothing to bring together before the write.
        frame.withColumn("load_date", F.to_date(F.lit(load_date))).write.mode("overwrite").partitionBy(
            "load_date"
        ).parquet(path)
        return path
    return write_folder(frame, path, ["load_date"])


def comment_of(field: StructField) -> str | None:
    return field.metadata.get("comment") or None


def apply_column_comments(spark: SparkSession, frame: DataFrame, name: str) -> int:
    """Persist field comments that the table does not have yet; returns how many."""
    stored = {field.name.lower(): comment_of(field) for field in spark.table(quote(name)).schema.fields}
    commented = [
        field
        for field in frame.schema.fields
        if comment_of(field) and comment_of(field) != stored[field.name.lower()]
    ]
    for field in commented:
        spark.sql(
            f"ALTER TABLE {quote(name)} ALTER COLUMN {quote(field.name)} "
            f"COMMENT {literal(comment_of(field))}"
        )
    return len(commented)


def set_properties(spark: SparkSession, name: str, properties: Mapping[str, str]) -> None:
    if properties:
        spark.sql(f"ALTER TABLE {quote(name)} SET TBLPROPERTIES ({_properties(properties)})")


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {quote(name)}").collect()}


def is_session_catalog(spark: SparkSession, name: str) -> bool:
    """Whether a table name, with or without its catalog, is in Spark's own catalog."""
    first, *rest = [part.strip("`") for part in name.split(".")]
    names_catalog = len(rest) > 1 or (rest and spark.conf.get(f"spark.sql.catalog.{first}", None) is not None)
    return (first if names_catalog else spark.catalog.currentCatalog()) == "spark_catalog"


#: Properties that a catalog keeps for itself.
INTERNAL_PROPERTY = re.compile(r"^(spark\.sql\.|transient_lastDdlTime$|numFiles$|totalSize$|option\.|view\.)")


def user_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {k: v for k, v in table_properties(spark, name).items() if not INTERNAL_PROPERTY.match(k)}


def table_place(spark: SparkSession, name: str) -> tuple[str, bool, str]:
    """Folder of a session-catalog table, whether Spark manages it, and its provider."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quote(name)}").collect()
    detail = {row["col_name"]: row["data_type"] for row in rows}
    return detail["Location"].rstrip("/"), detail["Type"] == "MANAGED", detail["Provider"].lower()


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and its path with the scheme that the file system gives it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    system, path = _files(spark, folder)
    system.delete(path, True)


def table_files(spark: SparkSession, name: str) -> list[tuple[str, int]]:
    """Path and bytes of each data file of a session-catalog table; no file is opened."""
    return files_below(spark, table_place(spark, name)[0])


def files_below(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Path and bytes of each data file of a folder; no file is opened."""
    system, path = _files(spark, folder)
    found, listing = [], system.listFiles(path, True)
    while listing.hasNext():
        status = listing.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, such as a metadata document, in any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(text.encode()))
    stream.close()


VERSION = "/version-"
#: Of managed tables, whose folder goes with the table.
BESIDE = "-version-"


def _replace_in_session_catalog(
    frame: DataFrame, name: str, location: str | None, properties: Mapping[str, str], provider: str
) -> None:
    """Write to a fresh folder first; the table changes only when all rows are there.

    A table with the same columns is switched by one change of its location, so readers
    always find it. With other columns the new table takes the old one's name after that
    is dropped, which readers may notice for a moment. The old folder stays for those who
    still read it, until ``remove_old_folders``.
    """
    spark = frame.sparkSession
    version = uuid.uuid4().hex
    if not spark.catalog.tableExists(name):
        writer = frame.write.format(provider)
        if location:
            writer = writer.option("path", f"{location.rstrip('/')}{VERSION}{version}")
        writer.saveAsTable(quote(name))
        set_properties(spark, name, properties)
        return
    old = spark.table(quote(name)).schema
    folder, managed, old_provider = table_place(spark, name)
    root = re.sub(rf"({VERSION}|{BESIDE})[0-9a-f]{{32}}$", "", folder)
    # A managed table's folder goes with the table, so the new one is put beside it.
    fresh = f"{location.rstrip('/') if location else root}{VERSION if location or not managed else BESIDE}{version}"
    try:
        frame.write.format(provider).save(fresh)
    except Exception:
        delete_folder(spark, fresh)
        raise
    merged = {**user_properties(spark, name), **properties}
    columns = [(field.name, field.dataType) for field in frame.schema.fields]
    if columns == [(field.name, field.dataType) for field in old.fields] and provider.lower() == old_provider:
        spark.sql(f"ALTER TABLE {quote(name)} SET LOCATION {literal(fresh)}")
        set_properties(spark, name, merged)
    else:
        comments = {field.name.lower(): comment_of(field) for field in old.fields}
        fields = []
        for field in frame.schema.fields:
            comment = comment_of(field) or comments.get(field.name.lower())
            fields.append(StructField(field.name, field.dataType, True, {"comment": comment} if comment else {}))
        following = f"{name}_{version}"
        spark.sql(
            f"CREATE TABLE {quote(following)} ({', '.join(map(column_ddl, fields))}) USING {provider} "
            f"LOCATION {literal(fresh)}"
        )
        set_properties(spark, following, merged)
        spark.sql(f"DROP TABLE {quote(name)}")
        spark.sql(f"ALTER TABLE {quote(following)} RENAME TO {quote(name)}")
    spark.catalog.refreshTable(quote(name))


def _written(system, status) -> int:
    """When a folder or file was finished, in milliseconds; stores need not date their folders."""
    if status.isFile():
        return status.getModificationTime()
    inside = list(system.listStatus(status.getPath()))
    done = [s.getModificationTime() for s in inside if s.getPath().getName() == "_SUCCESS"]
    return max(done or [s.getModificationTime() for s in inside] or [status.getModificationTime()])


def remove_old_folders(
    spark: SparkSession, name: str, older_than: datetime.timedelta = datetime.timedelta(days=1)
) -> list[str]:
    """Delete what earlier replacements of a table left, if it went out of use so long ago; returns what.

    A folder went out of use when the next one was finished. Folders newer than the table's own
    stay, as a replacement may be writing them. Choose an age that no query lasts.
    """
    if not is_session_catalog(spark, name):
        raise ValueError(f"{name} is in a catalog that keeps its own files")
    folder = table_place(spark, name)[0]
    system, current = _files(spark, folder)
    parent, own = current.getParent(), current.getName()
    if own.startswith(VERSION[1:]):
        # The table's first files may be in the root itself.
        found = [s for s in system.listStatus(parent) if s.isFile() or re.match(r"version-|[_.]|.+=", s.getPath().getName())]
    elif BESIDE in own:
        root = re.sub(rf"{BESIDE}[0-9a-f]{{32}}$", "", own)
        found = [s for s in system.listStatus(parent) if re.match(rf"{re.escape(root)}({BESIDE}|$)", s.getPath().getName())]
    else:
        return []
    times = {s.getPath().toString(): _written(system, s) for s in found}
    now = times.pop(current.toString())
    versions = sorted([t for path, t in times.items() if VERSION in path or BESIDE in path] + [now])
    limit = (datetime.datetime.now(datetime.UTC) - older_than).timestamp() * 1000
    removed = []
    for path, written in times.items():
        unused_since = next((t for t in versions if t > written), now)
        if written <= now and unused_since <= limit:
            system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
            removed.append(path)
    return sorted(removed)


def replace_table(
    frame: DataFrame,
    name: str,
    *,
    location: str | None = None,
    properties: Mapping[str, str] | None = None,
    column_comments: bool = True,
    provider: str = "parquet",
) -> str:
    """Create the table or replace its rows and columns, without a moment in which rows are lost.

    Properties that the table has are kept unless ``properties`` gives them anew, and so
    are comments of columns that stay. A table that exists stays at its location unless
    another one is given. A catalog that supports atomic replacement gets
    ``writeTo(...).createOrReplace()``; the session catalog has no such operation, so there
    the rows go to a fresh folder below the location and the table is switched to it.
    """
    spark = frame.sparkSession
    properties = dict(properties or {})
    if is_session_catalog(spark, name):
        _replace_in_session_catalog(frame, name, location, properties, provider)
    else:
        if spark.catalog.tableExists(name):
            properties = {**user_properties(spark, name), **properties}
        if location:
            properties["location"] = location
        replacement = frame.writeTo(quote(name)).using(provider)
        for key, value in properties.items():
            replacement = replacement.tableProperty(key, str(value))
        replacement.createOrReplace()
    if column_comments:
        apply_column_comments(spark, frame, name)
    return name


def write_bucketed(frame: DataFrame, name: str, buckets: int, columns: Sequence[str]) -> str:
    """Create a table whose joins and sums on ``columns`` need no shuffle.

    All rows of a key are in one bucket, which adaptive execution cannot split: for keys
    without a hot one only.
    """
    frame.write.bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(quote(name))
    return name


def column_ddl(field: StructField) -> str:
    comment = comment_of(field)
    ddl = f"{quote(field.name)} {field.dataType.simpleString()}"
    return f"{ddl} COMMENT {literal(comment)}" if comment else ddl


def ensure_table(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    provider: str = "parquet",
    location: str | None = None,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Create ``target`` with the columns and comments of ``source`` unless it exists."""
    columns = ", ".join(column_ddl(field) for field in spark.table(quote(source)).schema.fields)
    statement = f"CREATE TABLE IF NOT EXISTS {quote(target)} ({columns}) USING {provider}"
    if location:
        statement += f" LOCATION {literal(location)}"
    if properties:
        statement += f" TBLPROPERTIES ({_properties(properties)})"
    spark.sql(statement)


def list_tables(spark: SparkSession, namespace: str) -> DataFrame:
    """The tables of a namespace, without temporary views."""
    return spark.sql(f"SHOW TABLES IN {quote(namespace)}").where("NOT isTemporary").select("namespace", "tableName")


def row_count(spark: SparkSession, table: str, namespace: str = "default") -> int:
    """Row count of a table, with or without its namespace."""
    return spark.table(quote(qualified(namespace, table))).count()


def _check_format(format: str) -> str:
    if format.lower() not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {format!r}")
    return format.lower()


class LakeWriter:
    """Writes lake tables below one base path, or into one catalog namespace."""

    def __init__(
        self,
        base_path: str | None = None,
        format: str = "table",
        namespace: str = "default",
        provider: str = "parquet",
        on_error: str = "raise",
    ):
        self.format = _check_format(format)
        if self.format == "parquet" and not base_path:
            raise ValueError("the parquet format needs a base path")
        if on_error not in ("raise", "parquet"):
            raise ValueError(f"on_error must be 'raise' or 'parquet', got {on_error!r}")
        if on_error == "parquet" and not base_path:
            raise ValueError("falling back to parquet needs a base path")
        self.base_path = base_path.rstrip("/") if base_path else None
        self.namespace = namespace
        self.provider = provider
        self.on_error = on_error

    def write(
        self,
        frame: DataFrame,
        table: str,
        properties: Mapping[str, str] | None = None,
        column_comments: bool = True,
        load_date: str | None = None,
    ) -> str:
        """Write one table; returns the table name or the folder that received the rows.

        With ``on_error="parquet"`` a failed table write goes to a Parquet folder instead,
        under ``load_date`` when it is given.
        """
        if self.format == "parquet":
            return write_folder(frame, f"{self.base_path}/{table}")
        try:
            return replace_table(
                frame,
                f"{self.namespace}.{table}",
                location=f"{self.base_path}/{table}" if self.base_path else None,
                properties=properties,
                column_comments=column_comments,
                provider=self.provider,
            )
        except Exception:
            if self.on_error == "raise":
                raise
            log.exception("table %s.%s not written, falling back to a folder", self.namespace, table)
            # Beside the table's own folder; what the failed write left there is gone.
            folder = f"{self.base_path}/{table}_fallback"
            if load_date:
                return write_dated_folder(frame, folder, load_date)
            return write_folder(frame, folder)

    def write_table(
        self,
        frame: DataFrame,
        table: str,
        properties: Mapping[str, str] | None = None,
        column_comments: bool = True,
    ) -> str:
        """Write one catalog table with properties; never falls back to a folder."""
        if self.format != "table":
            raise ValueError("write_table needs format='table'")
        return replace_table(
            frame,
            f"{self.namespace}.{table}",
            location=f"{self.base_path}/{table}" if self.base_path else None,
            properties=properties,
            column_comments=column_comments,
            provider=self.provider,
        )

    def write_all(self, tables: Mapping[str, DataFrame], concurrency: int = 4) -> dict[str, str]:
        """Write every table; returns where each of them went."""
        if not tables:
            return {}
        spark = next(iter(tables.values())).sparkSession
        written = side_by_side(spark, lambda item: self.write(item[1], item[0]), tables.items(), concurrency)
        return dict(zip(tables, written))


class LakeReader:
    """Reads lake tables from Parquet folders or from one catalog namespace."""

    def __init__(
        self,
        spark: SparkSession,
        base_path: str | None = None,
        format: str = "table",
        namespace: str = "default",
        schemas: Mapping[str, str] | None = None,
    ):
        self.format = _check_format(format)
        if self.format == "parquet" and not base_path:
            raise ValueError("the parquet format needs a base path")
        self.spark = spark
        self.base_path = base_path.rstrip("/") if base_path else None
        self.namespace = namespace
        self.schemas = TABLE_DDL if schemas is None else schemas

    def read(self, table: str) -> DataFrame:
        """One table; a folder is read with its declared schema when there is one."""
        if self.format == "table":
            return self.spark.table(quote(f"{self.namespace}.{table}"))
        reader = self.spark.read
        if table in self.schemas:
            reader = reader.schema(self.schemas[table])
        return reader.parquet(f"{self.base_path}/{table}")

    def read_all(self, tables: Sequence[str] = LAKE_TABLES) -> dict[str, DataFrame]:
        return {table: self.read(table) for table in tables}


def read_written(spark: SparkSession, place: str) -> DataFrame:
    """What ``LakeWriter.write`` wrote, from the place that it returned: a folder or a table."""
    return spark.read.parquet(place) if "/" in place else spark.table(quote(place))


def read_as_of_date(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The rows of the newest ``load_date`` of a dated folder that is not after ``day``.

    Only file names are looked at to find it, and only its files are read.
    """
    dated = spark.read.parquet(path)
    newest = dated.where(F.col("load_date") <= F.lit(day).cast("date")).agg(F.max("load_date")).first()[0]
    return dated.where(F.col("load_date") == F.lit(newest).cast("date"))


def read_table_as_of(spark: SparkSession, name: str, moment: str) -> DataFrame:
    """A table as it was at ``moment``, in a catalog whose tables keep their versions."""
    return spark.read.option("timestampAsOf", moment).table(quote(name))
