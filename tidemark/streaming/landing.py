"""Landing a stream of JSON messages: valid rows as Parquet, the rest in quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

VALID = "valid"
QUARANTINED = "quarantined"
VERDICT = "_verdict"
RAW = "_raw_message"
BATCH = "_batch"
RESERVED = (VERDICT, RAW, BATCH)

# JSON kinds that a declared type is read from, as Spark names them.
WHOLE = "^(BIGINT|DECIMAL\\(\\d+,0\\))$"
NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL\\(.*\\))$"
TEXT = "^STRING$"
KINDS = {
    StringType: TEXT,
    BooleanType: "^BOOLEAN$",
    ByteType: WHOLE,
    ShortType: WHOLE,
    IntegerType: WHOLE,
    LongType: WHOLE,
    FloatType: NUMBER,
    DoubleType: NUMBER,
    DecimalType: NUMBER,
    DateType: TEXT,
    TimestampType: TEXT,
    TimestampNTZType: TEXT,
}


def kinds_of(data_type: DataType) -> str:
    try:
        return KINDS[type(data_type)]
    except KeyError:
        raise ValueError(f"messages cannot have fields of type {data_type.simpleString()}") from None


def check_schema(schema: StructType) -> None:
    names = [field.name.lower() for field in schema.fields]
    taken = [name for name in names if name in RESERVED]
    if taken or len(set(names)) < len(names) or any("'" in name or "`" in name for name in names):
        raise ValueError(f"field names must be distinct, without quotes and none of {RESERVED}")


def whole_objects(messages: DataFrame, body: str, *more: Column | str) -> DataFrame:
    """``RAW``, ``more``, and of messages that are one JSON object ``_message`` (a variant) and ``_keys``.

    The parser stops at the end of the first value, so what follows would go unseen. Each
    message is put in a list before its own digest and parsed once: only if it is one
    value is the digest, which no message can hold itself, the second value of the list.
    """
    text = F.col(body)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "'), F.md5(text), F.lit('"]')))
    parsed = messages.select(*more, text.alias(RAW), listed.alias("_listed"), F.md5(text).alias("_digest"))
    first = F.try_variant_get("_listed", "$[0]", "variant")
    is_one = F.try_variant_get("_listed", "$[1]", "string") == F.col("_digest")
    one = parsed.drop("_listed", "_digest").columns
    parsed = parsed.select(*one, F.when(is_one, first).alias("_message"))
    keys = F.map_keys(F.expr("try_cast(_message AS map<string, variant>)"))
    return parsed.select(*one, "_message", keys.alias("_keys"))


def judge(messages: DataFrame, schema: StructType, body: str = "value") -> DataFrame:
    """Parse every message once; columns of ``schema``, the raw text and a verdict.

    A message is valid when all of it is one JSON object without repeated keys, every field
    is of its declared kind and fits it (a number is no text, a text no number), and no
    field declared NOT NULL is missing. The raw text is kept for quarantined messages and
    for valid ones with fields that the schema does not name, so nothing is lost.
    """
    check_schema(schema)
    parsed = whole_objects(messages, body)
    parts, ok = [], F.col("_keys").isNotNull()
    for i, field in enumerate(schema.fields):
        path = f"$['{field.name}']"
        parts.append(F.try_variant_get("_message", path, "variant").alias(f"_variant_{i}"))
        parts.append(F.try_variant_get("_message", path, "string").alias(f"_text_{i}"))
    parsed = parsed.select(RAW, "_keys", *parts)
    values = []
    for i, field in enumerate(schema.fields):
        kind = F.schema_of_variant(f"_variant_{i}")
        missing = F.col(f"_variant_{i}").isNull() | (kind == "VOID")
        read = F.expr(f"try_cast(_text_{i} AS {field.dataType.simpleString()})")
        fits = kind.rlike(kinds_of(field.dataType)) & read.isNotNull()
        ok = ok & F.coalesce((missing & F.lit(field.nullable)) | (~missing & fits), F.lit(False))
        values.append(read)
    judged = parsed.select("*", F.coalesce(ok, F.lit(False)).alias("_ok"))
    names = F.array(*[F.lit(field.name) for field in schema.fields]).cast("array<string>")
    more = F.size(F.array_except("_keys", names)) > 0
    return judged.select(
        *[F.when(F.col("_ok"), read).alias(field.name) for field, read in zip(schema.fields, values)],
        F.when(~F.col("_ok") | more, F.col(RAW)).alias(RAW),
        F.when(F.col("_ok"), VALID).otherwise(QUARANTINED).alias(VERDICT),
    )


def land(
    messages: DataFrame, schema: StructType, target: str, checkpoint: str, body: str = "value"
) -> StreamingQuery:
    """Start landing everything that is available now, then stop.

    Every batch is written to a folder of its own, named by the batch and overwritten if the
    batch is run again, so a message lands exactly once after a restart, and no list of all
    files ever written is kept. A message is parsed and written once; the folders are split by
    verdict. The source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` sets the batch size.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(VERDICT).parquet(f"{target.rstrip('/')}/{BATCH}={number}")

    return (
        judge(messages, schema, body)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def landed(spark: SparkSession, schema: StructType, target: str) -> DataFrame:
    """The valid rows; only their partitions are read."""
    return _read(spark, schema, target).where(F.col(VERDICT) == VALID).select(*schema.fieldNames())


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    return _read(spark, StructType(), target).where(F.col(VERDICT) == QUARANTINED).select(F.col(RAW).alias("raw"))


def _read(spark: SparkSession, schema: StructType, target: str) -> DataFrame:
    full = StructType([*schema.fields]).add(RAW, StringType()).add(BATCH, LongType()).add(VERDICT, StringType())
    return spark.read.schema(full).parquet(target)


def landing_counts(spark: SparkSession, target: str) -> DataFrame:
    """Messages per verdict."""
    return (
        _read(spark, StructType(), target)
        .groupBy(F.col(VERDICT).alias("verdict"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )
