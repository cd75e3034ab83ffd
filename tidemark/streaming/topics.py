"""Landing the messages of many topics, each with a schema of its own, from one stream.

A table of topics and their fields is joined to the stream, so which fields a message must
have is data and not a plan for each topic. A message is parsed once. Every batch is one
write: fields that topics have in common (name and type) share a column, the folders are
split by topic and verdict, and a topic is read with its own columns only.

Messages that come again are dropped by key. The state of that holds the keys of the last
``remember`` of arrival, whatever times the messages bear, so none is lost for being old.
Rows whose own time is further behind the newest of the earlier batches than ``lateness`` are put
aside as late.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

from tidemark.functions.types import lossless
from tidemark.streaming import landing
from tidemark.streaming.landing import BATCH, QUARANTINED, RAW, VALID, VERDICT, check_schema, kinds_of, whole_objects

LATE = "late"
TOPIC = "_topic"
REASON = "_reason"
KEY = "_key"
ARRIVED = "_arrived"
RESERVED = (TOPIC, REASON, KEY, ARRIVED)

UNKNOWN_TOPIC, NOT_AN_OBJECT, BAD_FIELDS = "unknown topic", "not one object", "fields do not fit"


def column_of(field: StructField) -> str:
    """The stored column of a field: fields of one name and type share it, whichever topic they are of."""
    kind = re.sub(r"\W+", "_", field.dataType.simpleString()).strip("_")
    return f"{field.name.lower()}__{kind}"


def _fields(schemas: Mapping[str, StructType]) -> dict[str, StructField]:
    """Every stored column with one of its fields."""
    spelled: dict[str, str] = {}
    columns: dict[str, StructField] = {}
    for schema in schemas.values():
        check_schema(schema)
        for field in schema.fields:
            kinds_of(field.dataType)
            if field.name.lower() in RESERVED or spelled.setdefault(field.name.lower(), field.name) != field.name:
                raise ValueError(f"{field.name} is reserved, or spelled in two ways")
            known = columns.setdefault(column_of(field), field)
            if (known.name, known.dataType) != (field.name, field.dataType):
                raise ValueError(f"{known.name} and {field.name} would share the column {column_of(field)}")
    return columns


def topic_table(spark: SparkSession, schemas: Mapping[str, StructType]) -> DataFrame:
    """One row for each topic: the stored columns of its fields, and which it must have."""
    rows = [
        (
            topic,
            [field.name for field in schema.fields],
            [column_of(field) for field in schema.fields],
            [column_of(field) for field in schema.fields if not field.nullable],
        )
        for topic, schema in schemas.items()
    ]
    return spark.createDataFrame(
        rows, f"{TOPIC} string, _names array<string>, _declared array<string>, _required array<string>"
    )


def _time_of(fields: Mapping[str, StructField], name: str) -> Column:
    """The time of a message in whichever of its topic's columns bear that name."""
    times = [c for c, f in fields.items() if f.name == name and isinstance(f.dataType, (TimestampType, TimestampNTZType))]
    return F.coalesce(*[F.col(c).cast("timestamp") for c in times], F.lit(None).cast("timestamp"))


def judge(
    messages: DataFrame, schemas: Mapping[str, StructType], topic: str = "topic", body: str = "value", more: tuple = ()
) -> DataFrame:
    """The stored columns of every message, its raw text, a verdict and a reason.

    The rules for one message are those of ``landing.judge`` with the schema of its topic. A
    message of a topic that the table does not name is quarantined.
    """
    fields = _fields(schemas)
    parsed = whole_objects(messages, body, F.col(topic).alias(TOPIC), *more)
    joined = parsed.join(topic_table(messages.sparkSession, schemas), TOPIC, "left")
    names = sorted({field.name for field in fields.values()})
    place = {name: i for i, name in enumerate(names)}
    kept = [TOPIC, *more, RAW, "_keys", "_names", "_declared", "_required"]
    parts = []
    for name, i in place.items():
        parts.append(F.try_variant_get("_message", f"$['{name}']", "variant").alias(f"_variant_{i}"))
        parts.append(F.try_variant_get("_message", f"$['{name}']", "string").alias(f"_text_{i}"))
    joined = joined.select(*kept, *parts)
    values, ok = {}, F.lit(True)
    for column, field in fields.items():
        i = place[field.name]
        declared = F.array_contains("_declared", column)
        kind = F.schema_of_variant(f"_variant_{i}")
        missing = F.col(f"_variant_{i}").isNull() | (kind == "VOID")
        read = F.expr(f"try_cast(_text_{i} AS {field.dataType.simpleString()})")
        fits = kind.rlike(kinds_of(field.dataType)) & read.isNotNull()
        fine = F.coalesce((missing & ~F.array_contains("_required", column)) | (~missing & fits), F.lit(False))
        ok = ok & F.when(declared, fine).otherwise(True)
        values[column] = F.when(declared, read)
    reason = (
        F.when(F.col("_declared").isNull(), UNKNOWN_TOPIC).when(F.col("_keys").isNull(), NOT_AN_OBJECT).when(~ok, BAD_FIELDS)
    )
    judged = joined.select("*", reason.alias(REASON))
    valid = F.col(REASON).isNull()
    unnamed = F.size(F.array_except("_keys", "_names")) > 0
    return judged.select(
        TOPIC,
        *more,
        *[F.when(valid, read).alias(column) for column, read in values.items()],
        F.when(~valid | unnamed, F.col(RAW)).alias(RAW),
        REASON,
        F.when(valid, VALID).otherwise(QUARANTINED).alias(VERDICT),
    )


def once(messages: DataFrame, key: str | None, body: str = "value", topic: str = "topic", remember: str = "7 days") -> DataFrame:
    """The messages of a stream without those whose topic and key came before, ``KEY`` with each.

    A message without a key is known by its text. The watermark is on the time of arrival, which
    only rises: it bounds the state and makes no message late.
    """
    digest = F.md5(F.coalesce(F.col(body), F.lit("")))
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("t"), digest)) if key else digest
    arriving = messages.withColumn(KEY, named).withColumn(ARRIVED, F.current_timestamp())
    return arriving.withWatermark(ARRIVED, remember).dropDuplicatesWithinWatermark([topic, KEY]).drop(ARRIVED)


def land(
    messages: DataFrame,
    schemas: Mapping[str, StructType],
    target: str,
    checkpoint: str,
    topic: str = "topic",
    body: str = "value",
    key: str | None = None,
    time: str | None = None,
    lateness: str = "1 hour",
    remember: str = "7 days",
) -> StreamingQuery:
    """Start landing everything that is available now, then stop.

    With ``key`` (a column of the messages) what comes again within ``remember`` is dropped, over
    restarts as well. With ``time`` (a field) valid rows that are late land apart. Every batch
    has a folder of its own, overwritten if it runs again, and beside it the newest time
    that it brought: what is late follows from the batches before, so a batch that runs
    again comes to the same result.
    """
    spark = messages.sparkSession
    target = target.rstrip("/")
    fields = _fields(schemas)
    stream = once(messages, key, body, topic, remember) if key else messages
    judged = judge(stream, schemas, topic, body)

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        if time is not None:
            own = F.when(F.col(VERDICT) == VALID, _time_of(fields, time))
            newest = _newest(spark, f"{target}/progress", number)
            batch = batch.observe(seen, F.max(own).alias("newest"))
            if newest is not None:
                is_late = own < F.lit(newest) - F.expr(f"INTERVAL {lateness}")
                batch = batch.withColumn(VERDICT, F.when(is_late, LATE).otherwise(F.col(VERDICT)))
        batch.write.mode("overwrite").partitionBy(TOPIC, VERDICT).parquet(f"{target}/messages/{BATCH}={number}")
        if time is not None:
            ahead = max((t for t in (newest, seen.get["newest"]) if t is not None), default=None)
            row = spark.createDataFrame([(ahead,)], "newest timestamp")
            row.coalesce(1).write.mode("overwrite").parquet(f"{target}/progress/{BATCH}={number}")

    return (
        judged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(spark: SparkSession, progress: str, number: int):
    """The newest time that the batches before ``number`` brought: each has that of all up to it."""
    if number == 0:
        return None
    return spark.read.schema("newest timestamp").parquet(f"{progress}/{BATCH}={number - 1}").first()[0]


def _read(spark: SparkSession, target: str, fields: Mapping[str, StructField]) -> DataFrame:
    full = StructType([StructField(column, field.dataType) for column, field in fields.items()])
    for name in (RAW, REASON):
        full = full.add(name, "string")
    full = full.add(BATCH, "long").add(TOPIC, "string").add(VERDICT, "string")
    return spark.read.schema(full).parquet(f"{target.rstrip('/')}/messages")


def landed(spark: SparkSession, schema: StructType, target: str, topic: str, verdict: str = VALID) -> DataFrame:
    """The valid (or late) rows of one topic, with its own columns; only its folders are read."""
    fields = {column_of(field): field for field in schema.fields}
    rows = _read(spark, target, fields).where((F.col(TOPIC) == topic) & (F.col(VERDICT) == verdict))
    return rows.select(*[F.col(column).alias(field.name) for column, field in fields.items()])


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    rows = _read(spark, target, {}).where(F.col(VERDICT) == QUARANTINED)
    return rows.select(F.col(TOPIC).alias("topic"), F.col(REASON).alias("reason"), F.col(RAW).alias("raw"))


def topic_counts(spark: SparkSession, target: str) -> DataFrame:
    """Messages by topic and verdict."""
    groups = [F.col(TOPIC).alias("topic"), F.col(VERDICT).alias("verdict")]
    return _read(spark, target, {}).groupBy(*groups).agg(F.count(F.lit(1)).alias("messages"))


# Compatibility of schemas


BACKWARD, FORWARD, FULL, NONE = "BACKWARD", "FORWARD", "FULL", "NONE"


def _reads(written: StructField | None, read: StructField | None) -> bool:
    if read is None:  # a field that the reader does not name stays in the raw message
        return True
    if written is None:
        return read.nullable
    return lossless(written.dataType, read.dataType) and (read.nullable or not written.nullable)


def _change(old: StructField | None, new: StructField | None) -> str:
    if old is None:
        return "added"
    if new is None:
        return "dropped"
    if old.dataType != new.dataType:
        if lossless(old.dataType, new.dataType):
            return "widened"
        return "narrowed" if lossless(new.dataType, old.dataType) else "retyped"
    if old.nullable != new.nullable:
        return "made optional" if new.nullable else "made required"
    return "same"


def verdict(backward: bool, forward: bool) -> str:
    return FULL if backward and forward else BACKWARD if backward else FORWARD if forward else NONE


def compare(old: StructType, new: StructType) -> list[tuple[str, str, str]]:
    """Each field's name, change and verdict.

    BACKWARD: the new schema reads what the old one let in. FORWARD: the old schema reads
    what the new one lets in. Field names are compared as they are spelled, as messages are read.
    """
    before, after = ({field.name: field for field in schema.fields} for schema in (old, new))
    return [
        (
            name,
            _change(before.get(name), after.get(name)),
            verdict(_reads(before.get(name), after.get(name)), _reads(after.get(name), before.get(name))),
        )
        for name in [*before, *(name for name in after if name not in before)]
    ]


def compatibility(old: StructType, new: StructType) -> str:
    """What holds for all fields."""
    found = {v for _, _, v in compare(old, new)}
    return verdict(found <= {FULL, BACKWARD}, found <= {FULL, FORWARD})


def evolve(schemas: Mapping[str, StructType], topic: str, schema: StructType, mode: str = BACKWARD) -> dict[str, StructType]:
    """The schemas with a new one for a topic, refused if it is not compatible as ``mode`` asks."""
    if mode not in (BACKWARD, FORWARD, FULL, NONE):
        raise ValueError(f"unknown compatibility {mode!r}")
    check_schema(schema)
    if topic in schemas and mode != NONE:
        found = compatibility(schemas[topic], schema)
        if found not in (mode, FULL):
            refused = [f"{name} ({change})" for name, change, v in compare(schemas[topic], schema) if v not in (mode, FULL)]
            raise ValueError(f"{topic}: the schema is not {mode} compatible: {', '.join(refused)}")
    return {**schemas, topic: schema}


def compatibility_table(spark: SparkSession, pairs: Mapping[str, tuple[StructType, StructType]]) -> DataFrame:
    """One row for each field of each pair of schemas, with the pair's verdict."""
    rows = [
        (name, compatibility(old, new), field, change, own)
        for name, (old, new) in pairs.items()
        for field, change, own in compare(old, new)
    ]
    return spark.createDataFrame(rows, "pair string, verdict string, field string, change string, field_verdict string")


def replay(messages: DataFrame, schema: StructType, body: str = "value") -> DataFrame:
    """How many messages a schema reads and refuses."""
    read = F.col(VERDICT) == VALID
    return landing.judge(messages, schema, body).agg(
        F.count_if(read).alias("read_messages"), F.count_if(~read).alias("refused_messages")
    )
