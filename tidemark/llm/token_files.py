"""Token ids in files, Simple-8b coded.

``write`` sorts the documents by id, turns their texts into ids and writes blocks of whole
documents, one row each: ``shard`` and ``block`` order them, ``first`` is the number of ids
of the shard before the block, ``payload`` is the block. A payload starts with the magic
``S8TB`` and four 32-bit numbers (ids, documents, coding blocks, words), all little-endian,
followed by

* one row of 17 bytes for each document: its id (0 if null), the number of its ids, and
  1 if the id is null;
* the place of each coding block's first word (32 bits each);
* the words of the code (64 bits each).

The files are Parquet, so that Spark's commit protocol keeps half-written ones from being
read; the blocks are bytes and need no Parquet reader's help to be decoded.

The documents are ordered by a range shuffle on (id, hash of the text), so rows that share
an id do not land in one task. ``start`` is summed from one row for each shard.

Results for odd input: null and empty texts have the end id alone; a null id comes last;
rows that repeat an id are in the order of a hash of the text.
Texts are encoded whole, a very long one as a block of its own; an empty table gives files
without documents; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import simple8b
from tidemark.llm.storage import whole_text
from tidemark.llm.tokens import Encoder, read_tokenizer
from tidemark.llm.words import chunks

MAGIC = b"S8TB"
HEADER = "<4s4I"
#: A payload is closed after the document that reaches this many ids.
BLOCK_IDS = 1 << 16
DOCUMENT = np.dtype([("id", "<i8"), ("tokens", "<u8"), ("null", "u1")])

BLOCKS = "shard int, block int, first long, n_ids long, payload binary"
READ = "shard int, block int, position int, doc_id long, inside long, n_tokens long, ids_crc32 long"


def pack(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    table = np.zeros(len(counts), dtype=DOCUMENT)
    table["id"], table["tokens"], table["null"] = doc_ids, counts, missing
    words, offsets = simple8b.encode(ids)
    header = struct.pack(HEADER, MAGIC, len(ids), len(counts), len(offsets), len(words))
    return b"".join((header, table.tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a payload and all their ids."""
    magic, n_ids, n_docs, n_offsets, n_words = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = struct.calcsize(HEADER)
    table = np.frombuffer(payload, DOCUMENT, n_docs, at)
    at += table.nbytes
    offsets = np.frombuffer(payload, "<u4", n_offsets, at)
    words = np.frombuffer(payload, "<u8", n_words, at + offsets.nbytes)
    return table, simple8b.decode(words, offsets, n_ids).astype(np.uint32)


def _encode(definition, end: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition.value)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first
            columns = [np.concatenate(column) for column in zip(*waiting)]
            waiting.clear()
            row = (shard, block, first, len(columns[3]), pack(*columns))
            block, first = block + 1, first + len(columns[3])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = [field.split()[0] for field in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for begin, stop in chunks(batch.column("text")):
                part = batch.slice(begin, stop - begin)
                ids, counts = encoder.encode(part.column("text"), end)
                doc_id = part.column("doc_id")
                missing = doc_id.is_null().to_numpy(zero_copy_only=False)
                doc_id = doc_id.fill_null(0).to_numpy()
                edges = np.concatenate(([0], np.cumsum(counts)))
                done, held = 0, sum(len(w[3]) for w in waiting)
                while done < len(counts):
                    # Documents up to the one that fills the block.
                    full = int(np.searchsorted(edges, edges[done] + block_ids - held, side="left"))
                    upto = min(max(full, done + 1), len(counts))
                    rows = slice(done, upto)
                    waiting.append((doc_id[rows], missing[rows], counts[rows], ids[edges[done] : edges[upto]]))
                    held += int(edges[upto] - edges[done])
                    done = upto
                    if held >= block_ids:
                        yield close()
                        held = 0
        if waiting:
            yield close()

    return run


def write(
    docs: DataFrame, folder: str, tokenizer: str, end: int, block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of ``docs``, in ascending order of ``doc_id``, to ``folder``."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    ordered = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            whole_text(),
            F.col("doc_id").isNull().alias("last"),
            F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"),
        )
        .repartitionByRange("last", "doc_id", "digest")
        .sortWithinPartitions("last", "doc_id", "digest")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(_encode(definition, end, block_ids), BLOCKS).write.parquet(folder)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in READ.split(", ")]
    for batch in batches:
        for shard, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            table, ids = unpack(payload)
            counts = table["tokens"].astype(np.int64)
            inside = np.cumsum(counts) - counts
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(inside.tolist(), counts.tolist())]
            rows = len(table)
            columns = [
                pa.array(np.full(rows, shard, dtype=np.int32)),
                pa.array(np.full(rows, block, dtype=np.int32)),
                pa.array(np.arange(rows, dtype=np.int32)),
                pa.array(table["id"].astype(np.int64), mask=table["null"].astype(bool)),
                pa.array(inside),
                pa.array(counts),
                pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document in the files, from their blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    # One row for each shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    places = blocks.select("shard", "block", "first").join(shards, "shard")
    found = blocks.select("shard", "block", "payload").mapInArrow(_decode, READ)
    return found.join(places, ["shard", "block"]).select(
        "doc_id", (F.col("before") + F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
