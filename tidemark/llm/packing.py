"""Best-fit packing planned on a histogram of lengths.

Texts become ids, longer ones are cut into pieces of the sequence length, and the pieces
are counted by length. Best-fit decreasing then runs over the counts: sequences with the
same room left are handled as one run, so the plan depends on the lengths that occur (at
most the sequence length) and not on the number of documents. The plan is a table of runs
of slots: ``count`` sequences from ``sequence_id`` on have a slot for a piece of ``length``
at ``offset``; these slots go to the pieces of that length from rank ``first`` on. Runs are
spread out to slots by Spark, and pieces take theirs by a join on (length, rank).

A piece's rank within its length is counted over 1009 blocks of each length, so a length
that a third of all pieces have does not meet in one task.

Results for odd input: null and empty texts are the end id alone; rows that repeat a
document are packed one by one; with no documents there are no sequences.
Texts are encoded whole, and only those longer than a sequence are cut; pieces of one length
take its slots in the order of a hash; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.skew import number_within
from tidemark.llm.storage import saved, whole_text
from tidemark.llm.tokens import Encoder, read_tokenizer
from tidemark.llm.words import chunks

CAPACITY = 4096
#: Slots that one row of the plan stands for at most while it is spread out.
SPREAD = 1 << 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of text that are encoded together; results do not depend on it.
TEXT_BYTES = 1 << 20

PLAN = "length long, first long, sequence_id long, offset long, count long"


def _cut(definition, end: int, capacity: int):
    names = [field.split()[0] for field in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition.value)
        for batch in batches:
            for begin, stop in chunks(batch.column("text"), TEXT_BYTES):
                part = batch.slice(begin, stop - begin)
                ids, counts = encoder.encode(part.column("text"), end)
                pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[owner] - start, capacity)
                edge = np.cumsum(length) - length
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(edge.tolist(), length.tolist())]
                rows = pa.array(owner)
                columns = [
                    part.column("doc_id").take(rows),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of (length, first rank, first sequence, offset, count)."""
    rows, sequences = [], 0
    room: list[int] = []  # the rooms that occur, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in runs:
                bisect.insort(room, left)
                runs[left] = []
            runs[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, wanted = 0, histogram[length]
        while wanted:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                left = room[at]
                first, count = runs[left].pop()
                if not runs[left]:
                    del runs[left], room[at]
            else:
                # New sequences, each filled with as many pieces of this length as there are.
                left, first = capacity, sequences
                count = max(1, wanted // (capacity // length))
                sequences += count
            used = min(count, wanted)
            rows.append((length, rank, first, capacity - left, used))
            put(left - length, first, used)
            put(left, first + used, count - used)
            rank, wanted = rank + used, wanted - used
    return rows


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row of ``docs``, which has ``doc_id`` and ``text``."""
    definition = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text())
    cut = texts.mapInArrow(_cut(definition, end, capacity), PIECES)
    return saved(cut.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with the ``sequence_id`` and ``offset`` of each."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, end, capacity)
    # At most one row for each length up to the capacity.
    histogram = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    table = spark.createDataFrame(plan(histogram, capacity), PLAN)
    spread = F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / SPREAD))
    slots = (
        table.withColumn("part", F.explode(spread))
        .repartition("length", "first", "part")
        .withColumn(
            "i",
            F.explode(
                F.sequence(F.col("part") * SPREAD, F.least(F.col("count"), (F.col("part") + 1) * SPREAD) - 1)
            ),
        )
        .select(
            "length",
            (F.col("first") + F.col("i")).alias("rank"),
            (F.col("sequence_id") + F.col("i")).alias("sequence_id"),
            "offset",
        )
    )
    ranked = number_within(cut, "length", "piece_id", "rank")
    return ranked.join(slots, ["length", "rank"]).drop("rank", "piece_id")
