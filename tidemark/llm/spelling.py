"""Groups of spelling variants: words that are one edit apart, and the most usual of them.

The join uses asymmetric chunks. Of two words that differ by one inserted, deleted or
replaced code point take the shorter one (of equally long ones the smaller one). It gives
two disjoint chunks, its first and its second half. One edit leaves one of them whole, and it
stands in the other word at the same place or, behind an insertion, one place on. So the
other word gives its grams of that length at those places; the rest of its positional
grams cannot meet a chunk. Words that share a chunk and a gram are verified in the join.

Chunks of short words are shared by many. Where the pairs of a chunk are more than
``PAIRS_OF_CHUNK``, the part of the word outside the chunk is cut in two in the same way: the one
edit leaves one of these chunks whole too. Then two words meet only if both chunks do.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import saved
from tidemark.llm.words import chunks, distinct_pieces, utf8

LEAST_LENGTH, LEAST_TIMES = 5, 3
#: A run loses a code point if this divides its checksum.
DIVISOR = 97
#: Pairs of chunks and grams from which on a chunk is refined.
PAIRS_OF_CHUNK = 20_000

COUNTED = "word string, n long"
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LATIN_LEAD = 0xC3  # of the characters U+00C0 to U+00FF and no others
#: Runs of at most so many bytes have their checksums combined from tables.
TABLE_BYTES = 64


def shift_tables() -> np.ndarray:
    """``tables[n, k, b]``: what byte ``b`` at place ``k`` of a checksum becomes ``n`` bytes further on."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    tables = np.empty((TABLE_BYTES + 1, 4, 256), dtype=np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(TABLE_BYTES):
        tables[n + 1] = (tables[n] >> 8) ^ step[tables[n] & 0xFF]
    return tables


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each run of letters its text's place and its number among the distinct runs, and these."""
    data, offsets = utf8(texts)
    lead = data == LATIN_LEAD
    letter = LETTER[data] | lead
    letter[1:] |= lead[:-1]
    upper = (data >= 0x41) & (data <= 0x5A)
    lower = data + upper.view(np.uint8) * np.uint8(0x20)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    numbers, distinct = distinct_pieces(lower[letter], ends - starts)
    return np.searchsorted(offsets, starts, side="right") - 1, numbers, distinct


def word_counts(ids: list, texts: pa.Array, tables: np.ndarray) -> pa.RecordBatch:
    """How often each word comes in some texts, its runs changed as their checksums say."""
    owner, number, distinct = runs(texts)
    known = distinct.to_pylist()
    count = len(known)
    place, times = np.unique(owner * max(count, 1) + number, return_counts=True)
    row, run = place // max(count, 1), place % max(count, 1)
    heads = [f"{'null' if i is None else i}:".encode() for i in ids]
    head = np.array([zlib.crc32(h) for h in heads], dtype=np.uint32)[row]
    size = np.array([len(r) for r in known], dtype=np.int64)
    # The checksum of head and run, from both checksums and the length of the run.
    at = np.minimum(size[run], TABLE_BYTES)
    check = np.array([zlib.crc32(r) for r in known], dtype=np.uint32)[run]
    for k in range(4):
        check = check ^ tables[at, k, head >> np.uint32(8 * k) & np.uint32(0xFF)]
    for i in np.flatnonzero(size[run] > TABLE_BYTES).tolist():
        check[i] = zlib.crc32(heads[row[i]] + known[run[i]])
    changes = check % DIVISOR == 0
    whole = np.bincount(run[~changes], times[~changes], minlength=count).astype(np.int64)
    changed: Counter[str] = Counter()
    for r, n, h in zip(run[changes].tolist(), times[changes].tolist(), check[changes].tolist()):
        word = known[r].decode()
        gone = h % len(word)
        changed[word[:gone] + word[gone + 1 :]] += n
    latin = [sum(b == LATIN_LEAD for b in r) if not r.isascii() else 0 for r in known]
    long = np.flatnonzero((size - np.array(latin, dtype=np.int64) >= LEAST_LENGTH) & (whole > 0))
    others = [(word, n) for word, n in changed.items() if len(word) >= LEAST_LENGTH]
    words = [known[i].decode() for i in long.tolist()] + [word for word, _ in others]
    totals = np.concatenate((whole[long], np.array([n for _, n in others], dtype=np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(totals)], names=["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = shift_tables()
    for batch in batches:
        for begin, end in chunks(batch.column(1)):
            some = batch.slice(begin, end - begin)
            yield word_counts(some.column(0).to_pylist(), some.column(1), tables)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of every word that is long and usual enough."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(_count, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_TIMES)


def _gram(begin: Column, length: Column) -> Column:
    return F.substring(F.col("word"), begin + 1, length)


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts).alias("key")


def _one(size: Column, half: int, shift: Column, length: Column) -> Column:
    """A chunk's or gram's key, with all that refining it needs: whose size, which half, how far on."""
    begin = F.lit(0) if half == 0 else length
    return F.struct(
        size.alias("size"),
        F.lit(half).alias("half"),
        shift.alias("shift"),
        _key(size, F.lit(half), _gram(begin + shift, length)),
    )


def chunks_of(words: DataFrame) -> DataFrame:
    """The two disjoint chunks of each word."""
    size = F.char_length("word")
    length = F.floor(size / 2).cast("int")
    both = F.array(*[_one(size, half, F.lit(0), length) for half in (0, 1)])
    return words.select("word", "n", F.explode(both).alias("c")).select("word", "n", "c.*")


def grams_of(words: DataFrame) -> DataFrame:
    """The grams of each word that can meet a chunk of a word as long as it or one shorter."""
    size = F.char_length("word")
    grams = [_one(size, half, F.lit(0), F.floor(size / 2).cast("int")) for half in (0, 1)]
    shorter = size - 1
    grams += [
        _one(shorter, half, F.lit(shift), F.floor(shorter / 2).cast("int")) for half in (0, 1) for shift in (0, 1)
    ]
    reach = F.filter(F.array(*grams), lambda g: g["size"] >= LEAST_LENGTH)
    return words.select("word", "n", F.explode(reach).alias("c")).select("word", "n", "c.*")


def refined(rows: DataFrame, grams: bool) -> DataFrame:
    """Each row's key with the two chunks outside its half; for grams, at every place that they can have."""
    half = F.floor(F.col("size") / 2).cast("int")
    first = F.col("half") == 0
    # Outside the first half is all behind it, outside the second what stands before it.
    begin = F.when(first, half).otherwise(0)
    length = F.floor(F.when(first, F.col("size") - half).otherwise(half) / 2).cast("int")
    zero = F.lit(0)
    if grams:
        # One insertion moves all that is behind it: nothing before an unmoved chunk has moved,
        # all behind a moved one has. In a word of the same length nothing moves.
        longer = F.char_length("word") > F.col("size")
        least = F.when(first, F.col("shift")).otherwise(0)
        most = F.when(~longer, zero).when(first, F.lit(1)).otherwise(F.col("shift"))
        shifts = F.sequence(least, most)
    else:
        shifts = F.array(zero)
    rows = rows.withColumns({"begin": begin, "length": length})
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), shifts.alias("shifts"))
    rows = rows.select("*", F.explode("shifts").alias("on"))
    gram = _gram(F.col("begin") + F.col("part") * F.col("length") + F.col("on"), F.col("length"))
    return rows.select("word", "n", _key(F.col("key"), F.col("part"), gram))


def near_pairs(words: DataFrame, pairs_of_chunk: int = PAIRS_OF_CHUNK) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: every two words of a written table that are one edit apart, once."""
    chunk_rows, gram_rows = saved(chunks_of(words), "chunks"), saved(grams_of(words), "grams")
    one = F.lit(1).cast("long")
    sides = chunk_rows.select("key", one.alias("c"), (0 * one).alias("g")).unionAll(
        gram_rows.select("key", 0 * one, one)
    )
    hot = sides.groupBy("key").agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
    hot = saved(hot.where(F.col("c") * F.col("g") > pairs_of_chunk).select("key"), "hot-chunks")

    def keys(rows: DataFrame, grams: bool) -> DataFrame:
        usual = rows.join(hot, "key", "left_anti").select("word", "n", "key")
        return saved(usual.unionByName(refined(rows.join(hot, "key", "left_semi"), grams)), "keys")

    a = keys(chunk_rows, False).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keys(gram_rows, True).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    shorter = F.char_length("a") < F.char_length("b")
    one_edit = (shorter | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    met = a.alias("l").join(b.alias("r"), (F.col("l.key") == F.col("r.key")) & one_edit)
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last form, of each word that has one.

    A form is at least twice as usual as its word, so following forms ends, after a number of
    steps that grows with the logarithm of the largest count. Each round doubles the steps.
    """
    found = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = saved(found.join(further, "root", "left"), "roots")
        found = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where("next IS NOT NULL").isEmpty():
            return found


def spelling_variants(docs: DataFrame, pairs_of_chunk: int = PAIRS_OF_CHUNK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each usual word of ``docs``.

    A word's form is the most usual of the words that are one edit away (of equally usual ones
    the first in code-point order) if it is at least twice as usual as the word.

    Null and empty texts have no words; the id of a row without one reads as ``null``. Rows that
    repeat count each time. Texts and words are taken whole, however long. An empty table gives an
    empty one. Other columns are left alone, whatever their names.
    """
    words = saved(vocabulary(docs), "words")
    pairs = saved(near_pairs(words, pairs_of_chunk), "near")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first)
    joined = words.join(best, "word", "left")
    is_form = -F.col("first.less") >= 2 * F.col("n")
    judged = saved(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("first.near")).alias("form"),
            F.when(is_form, -F.col("first.less")).alias("form_n"),
        ),
        "forms",
    )
    found = roots(judged.where("form IS NOT NULL"))
    result = judged.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return result.select("word", "form", "root", "n", "n_near", "form_n")
