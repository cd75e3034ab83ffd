"""Whether a copy holds what its source does, beyond equal row counts.

A row's digest counts for the bucket of its key. Sums of digests do not depend on the order of
rows, so the source's are summed while it is written and the copy's in one pass. Only in
buckets that differ are finer ones compared, and only in those the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Buckets that are summed in the writing stage, and the parts that one is cut into later.
BUCKETS, PARTS = 16, 1024

MISSING, EXTRA, CHANGED = "missing", "extra", "changed"


def _place(keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("place"), *keys)


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(_place(keys), F.lit(BUCKETS))


def _digest(columns: Sequence[str]) -> Column:
    """A number for a whole row; a null and an empty value differ by their place in the row."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return F.xxhash64(nulls, *columns).cast("decimal(38,0)")


def observed(rows: DataFrame, keys: Sequence[str], seen: Observation) -> DataFrame:
    """``rows`` whose count and digests by bucket are observed by what reads them."""
    bucket, digest = _bucket(keys), _digest(rows.columns)
    sums = [F.sum(F.when(bucket == i, digest)).alias(f"bucket_{i}") for i in range(BUCKETS)]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *sums)


def bucket_sums(rows: DataFrame, keys: Sequence[str]) -> dict[int, tuple]:
    """Count and digest of each bucket, in one pass."""
    sums = rows.groupBy(_bucket(keys).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(_digest(rows.columns)).alias("d"))
    return {row["bucket"]: (row["n"], row["d"]) for row in sums.collect()}


def differing_buckets(seen: Observation, copy: dict[int, tuple]) -> list[int]:
    found = seen.get
    return [i for i in range(BUCKETS) if found[f"bucket_{i}"] != copy.get(i, (0, None))[1]]


def differences(source: DataFrame, copy: DataFrame, keys: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
    """The keys whose rows differ: missing in the copy, extra in it, or changed.

    ``buckets`` are those known to differ; without them both sides are summed first. A key that
    several rows have differs if their digests do in sum. The columns are those of the source.
    """
    columns = source.columns
    copy = copy.select(*columns)
    if buckets is None:
        left, right = bucket_sums(source, keys), bucket_sums(copy, keys)
        buckets = [i for i in range(BUCKETS) if left.get(i) != right.get(i)]
    part = F.pmod(F.shiftright(_place(keys), 8), F.lit(PARTS))

    def sides(*group: Column) -> DataFrame:
        both = None
        for is_source, rows in ((True, source), (False, copy)):
            rows = rows.where(_bucket(keys).isin(list(buckets)))
            sign = F.lit(1 if is_source else -1)
            one = rows.select(
                *group,
                F.lit(int(is_source)).cast("long").alias("_source"),
                F.lit(int(not is_source)).cast("long").alias("_copy"),
                (sign * _digest(columns)).alias("_digest"),
            )
            both = one if both is None else both.unionAll(one)
        return both

    def uneven(rows: DataFrame, *group: str) -> DataFrame:
        sums = rows.groupBy(*group).agg(F.sum("_source").alias("_s"), F.sum("_copy").alias("_c"), F.sum("_digest").alias("_d"))
        return sums.where((F.col("_s") != F.col("_c")) | (F.col("_d") != 0))

    bucket = _bucket(keys).alias("_bucket")
    # At most BUCKETS x PARTS rows.
    parts = uneven(sides(bucket, part.alias("_part")), "_bucket", "_part").select("_bucket", "_part")
    rows = sides(*[F.col(k) for k in keys], bucket, part.alias("_part")).join(F.broadcast(parts), ["_bucket", "_part"])
    kind = F.when(F.col("_c") == 0, MISSING).when(F.col("_s") == 0, EXTRA).otherwise(CHANGED)
    return uneven(rows, *keys).select(*keys, kind.alias("difference"))
