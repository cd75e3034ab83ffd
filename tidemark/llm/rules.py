"""Quality rules with host verdicts.

Every document is measured and fails the base rules if it is too short or repeats itself.
Failures are then counted by host. A host's failure rate is shrunk towards all hosts' by a
beta prior that is fitted to them, so that a host with few documents is judged like the
others, and hosts whose shrunk rate is above a limit lose all their documents.

The prior's mean and strength are the moments of the hosts' rates: with mean m and variance
v over hosts, strength = m (1 - m) / v - 1. Hosts are counted with partial sums, so a host
that holds a third of all rows reaches the shuffle once from each task.

Results for odd input: null and empty texts have no words and fail the base rules. Rows
with a null host are judged by the base rules alone. Repeated rows are measured one by one.
Texts are measured whole, however long; an empty table gives an empty result; other
columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.llm.storage import saved
from tidemark.llm.words import Words, chunks, inside, mix, windows

LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = b"#*$%&|<>"
#: A host is rejected when its shrunk failure rate is above this.
MOST_FAILING = 0.5
STRONGEST_PRIOR = 1e6

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one anywhere, and which have an equal one before them."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    found, before = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    before[order[1:][same]] = True
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found, before


def measured(texts: pa.Array) -> list[pa.Array]:
    """The measures of some texts, in the order of ``MEASURES``."""
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    words = Words(texts)
    counts, rows = words.counts, len(words.counts)
    letter = words.in_word & ((words.data & 0xC0) != 0x80)

    # The text's number is part of a window's name, so equal windows of other texts differ.
    owner = np.repeat(np.arange(rows), counts)
    names = windows(words.hashes(), REPEAT_WINDOW)
    starts = np.flatnonzero(inside(counts, REPEAT_WINDOW)[: len(names)])
    again, _ = _repeated(mix(names[starts] ^ mix(owner[starts].astype(np.uint64))))
    cover = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(cover, starts[again], 1)
    np.add.at(cover, starts[again] + REPEAT_WINDOW, -1)
    repeat_words = _per_text(np.cumsum(cover)[:-1] > 0, words.bounds)

    # Lines end at a line feed or at the end of their text.
    feeds = np.flatnonzero(words.data == 0x0A)
    begin = np.union1d(np.concatenate(([0], feeds + 1)), words.offsets)
    begin = begin[begin < len(words.data)]
    end = np.append(begin[1:], len(words.data))
    end = end - (words.data[end - 1] == 0x0A)
    line_text = np.searchsorted(words.offsets, begin, side="right") - 1
    first_word = np.searchsorted(words.starts, begin)
    has_word = np.zeros(len(begin), dtype=bool)
    known = first_word < len(words)
    has_word[known] = words.starts[first_word[known]] < end[known]
    begin, end, line_text = begin[has_word], end[has_word], line_text[has_word]
    edges = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(end - begin, out=edges[1:])
    in_line = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(in_line, begin, 1)
    np.add.at(in_line, end, -1)
    packed = words.data[np.cumsum(in_line, dtype=np.int8)[:-1] > 0]
    lines = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(packed)]
    )
    line = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, before = _repeated(line_text * (len(line) + 1) + line)
    dup_lines = np.bincount(line_text[before], minlength=rows)

    return [
        pa.array(values, pa.int64())
        for values in (
            counts,
            _per_text(letter, words.offsets),
            _per_text(symbol[words.data], words.offsets),
            dup_lines,
            repeat_words,
        )
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in chunks(batch.column("text")):
            part = batch.slice(first, last - first)
            kept = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
            names = [name for name in part.schema.names if name != "text"]
            columns = kept + measured(part.column("text"))
            yield pa.RecordBatch.from_arrays(columns, names=names + MEASURES)


def measure(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, the measures, and ``base_failed``."""
    others = [field for field in docs.schema.fields if field.name != "text"]
    schema = StructType([*others, *(StructField(name, LongType()) for name in MEASURES)])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    texts = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return texts.mapInArrow(_measure, schema).withColumn("base_failed", failed)


def rejected_hosts(judged: DataFrame, host: str, most_failing: float = MOST_FAILING) -> DataFrame:
    """The hosts whose shrunk rate of ``base_failed`` is above ``most_failing``."""
    hosts = saved(
        judged.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")),
        "hosts",
    )
    rate = F.col("failed") / F.col("n")
    mean, variance = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    mean, strength = mean or 0.0, STRONGEST_PRIOR
    if variance:
        strength = min(max(mean * (1 - mean) / variance - 1, 0.0), STRONGEST_PRIOR)
    shrunk = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.where(shrunk > most_failing).select(host)


def judge(docs: DataFrame, host: str, most_failing: float = MOST_FAILING) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` of each row of ``docs``."""
    judged = saved(measure(docs.select("doc_id", F.col(host).alias("host"), "text")), "measures")
    bad = rejected_hosts(judged, "host", most_failing).withColumnRenamed("host", "bad_host")
    kept = ~F.col("base_failed") & F.col("bad_host").isNull()
    verdicts = judged.join(bad, F.col("host") == F.col("bad_host"), "left")
    return verdicts.withColumn("kept", kept).drop("host", "bad_host")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (host, document): host, ``base_failed``, and the document if it passes the base rules."""
    for batch in batches:
        texts = batch.column(1).field("text").fill_null("")
        for first, last in chunks(texts):
            part = batch.slice(first, last - first)
            found = [column.to_numpy() for column in measured(texts.slice(first, last - first))]
            n_words, n_repeat = found[0], found[MEASURES.index("n_repeat_words")]
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
            document = part.column(1).take(pa.array(np.where(failed, None, np.arange(len(failed))), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(failed), document], names=["host", "base_failed", "document"]
            )


def accepted(docs: DataFrame, host: str, most_failing: float = MOST_FAILING) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Each text is read and measured once: the documents that pass the base rules are written, with
    their hosts' failures, and those of rejected hosts are left out when they are read back. A null
    text is empty and fails; a null host is never rejected; repeated rows are judged one by one.
    An empty table gives an empty one. Other columns go along, whatever their names.
    """
    rows = docs.select(F.col(host).alias("host"), F.struct(*docs.columns).alias("document"))
    document = StructField("document", rows.schema["document"].dataType)
    schema = StructType([rows.schema["host"], StructField("base_failed", BooleanType()), document])
    judged = saved(rows.mapInArrow(_passing, schema), "judged")
    bad = rejected_hosts(judged.select("host", "base_failed"), "host", most_failing)
    return judged.where(~F.col("base_failed")).join(bad, "host", "left_anti").select("document.*")
