"""Keeping a table that grows by small appends in few sorted files.

The settings are the table's own properties: the size of files and the order of rows.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from tidemark.session import workspace
from tidemark.sources.lake import delete_folder, files_below, quote, replace_table, table_files, user_properties

log = logging.getLogger(__name__)

TARGET_PROPERTY, ORDER_PROPERTY = "write.target-file-size-bytes", "write.sort-order"
DEFAULT_TARGET_BYTES = 128 << 20
#: A table is rewritten when it would have so many files less.
LEAST_SAVED = 16
#: Rows that one task sorts, in memory. Files hold many times as much where values repeat.
SORT_BYTES = 256 << 20


def packed(sizes: Sequence[int], target: int) -> list[list[int]]:
    """Which files go together: each of the largest first into the first bin that has room."""
    bins: list[list[int]] = []
    room: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, free in enumerate(room) if sizes[i] <= free), None)
        if at is None:
            bins.append([])
            room.append(max(target, sizes[i]))
            at = len(bins) - 1
        bins[at].append(i)
        room[at] -= sizes[i]
    return bins


def _held_bytes(rows: DataFrame) -> int:
    """About how many bytes all rows take while they are sorted."""
    each: Column = F.lit(24 + 16 * len(rows.columns)).cast("long")
    for field in rows.schema.fields:
        column = F.col(quote(field.name))
        if isinstance(field.dataType, (StringType, BinaryType)):
            each += F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType)):
            each += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return rows.agg(F.sum(each)).first()[0] or 0


def _sorted_files(rows: DataFrame, files: int, order: Sequence[Column], folder: str) -> DataFrame:
    """``rows`` in ``order`` in so many partitions, each with a range of them.

    No task sorts more than about ``SORT_BYTES``. A file that holds more is put together from
    ranges that were sorted and written to ``folder`` by tasks of their own, read one after the other.
    """
    # Equal values of the first column alone would all go to one file.
    spread = [*order, F.xxhash64(*rows.columns)]
    each = -(-_held_bytes(rows) // (files * SORT_BYTES))
    if each <= 1:
        return rows.repartitionByRange(files, *spread).sortWithinPartitions(*order)
    rows.repartitionByRange(files * each, *spread).sortWithinPartitions(*order).write.parquet(folder)
    spark = rows.sparkSession
    # Files are named by their tasks, which are in the order of the ranges.
    parts = sorted((path for path, _ in files_below(spark, folder)), key=lambda p: (_task(p), p))
    groups: dict[int, list[DataFrame]] = {}
    for path in parts:
        groups.setdefault(_task(path) // each, []).append(spark.read.schema(rows.schema).parquet(path))
    whole = [reduce(DataFrame.unionAll, group).coalesce(1) for group in groups.values()]
    return reduce(DataFrame.unionAll, whole)


def _task(path: str) -> int:
    return int(re.search(r"part-(\d+)[^/]*$", path)[1])


def compact_table(spark: SparkSession, name: str, least_saved: int = LEAST_SAVED) -> tuple[int, int]:
    """Rewrite a table in as many files as its rows fill, in its sort order; files before and after.

    Nothing is done while that saves fewer than ``least_saved`` files, so a table is not
    rewritten for each append. Rows are dealt out by ranges of the order's first column, so
    its minimum and maximum in each file let a filter skip the others. A task sorts at most
    about ``SORT_BYTES``, however well the rows of a file compress. Readers see the old
    files or the new ones. Appends that run meanwhile must wait: a file that was added after
    the old ones were listed fails the switch.
    """
    properties = user_properties(spark, name)
    target = int(properties.get(TARGET_PROPERTY, DEFAULT_TARGET_BYTES))
    files = table_files(spark, name)
    sizes = [size for _, size in files]
    bins = len(packed(sizes, target))
    if len(files) - bins < least_saved:
        return len(files), len(files)
    spark.catalog.refreshTable(quote(name))
    rows = spark.table(quote(name))
    order = []
    for term in properties.get(ORDER_PROPERTY, "").split(","):
        if found := re.fullmatch(r"\s*(\w+)(?:\s+(ASC|DESC))?\s*", term, re.IGNORECASE):
            column = F.col(quote(found[1]))
            order.append(column.desc() if (found[2] or "").upper() == "DESC" else column.asc())
    scratch = workspace(spark, "compaction")
    try:
        rows = _sorted_files(rows, bins, order, scratch) if order else rows.repartition(bins)
        if table_files(spark, name) != files:
            raise RuntimeError(f"{name} was appended to while it was being compacted")
        replace_table(rows, name)
    finally:
        delete_folder(spark, scratch)
    log.info("%s: %d files became %d", name, len(files), bins)
    return len(files), len(table_files(spark, name))
