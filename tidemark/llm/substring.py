"""Substring dedup: words in a passage that also starts earlier are removed.

Method: full-length names, partitioned by anchors. Every window of ``window`` words (20) of
every text is named by a hash at once. Its anchor is the window of ``base`` words (5) with the
smallest name among those inside: equal windows have equal anchors at equal places, so
windows are dealt out by anchor, neighbours with one anchor as one row, and compared by
their full-length names. A longer repeat covers no word that its windows do not cover.

This is not level-wise doubling (count 5-word windows over all data, extend the repeated ones
to 10 words, then to 20): no length is tested for repeats before the next, there is no
10-word level, and windows of an anchor that nothing shares are named like all others.
README.md says why, with figures.

Before the shuffle each chunk of texts settles the windows that repeat inside it, so a
passage that a third of all documents share reaches the shuffle once per chunk. Windows
that straddle its edge differ in every document and yet have one of its few anchors, so
the windows of each anchor are counted first (by ``BUCKETS`` remainders, which can only
count too many). Those of an anchor with more than ``limit`` are sent one by one, by anchor
and full-length name: equal windows still meet, and a task holds one name of them at a
time. The group of any other anchor has ``limit`` windows at most, whatever the input.

Names have 64 bits at the base and 48 more at full length, which are compared together.

Results for odd input: null, empty and separator-only texts have no words and keep the
empty text. A null id counts as larger than every other. Rows of one id and different texts
are different documents, in the order of a hash of the text. Rows that repeat id and text
are one document and each get its result.
Texts are read whole, however long; of equal passages the earliest stays; an empty table
gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import KEY, doc_id, keyed, whole_text
from tidemark.llm.words import Words, chunks, inside, joined, mix, windows

WINDOW = 20
BASE = 5
NAME_BYTES = 6
#: Windows that one anchor may have before they are dealt out by their names.
ANCHOR_WINDOWS = 1 << 16
#: Remainders of anchors whose windows are counted together.
BUCKETS = 1 << 20

_CANDIDATE = "anchor long, last_id boolean, id long, digest long, start long, names binary, covered int"
_LOAD = "bucket int, windows long"
_COVER = "id long, last_id boolean, digest long, start long, covered int"


def _anchors(base: np.ndarray, span: int) -> np.ndarray:
    """For each window, the place of the smallest of the ``span`` base names inside (leftmost of ties)."""
    least, place, size = base, np.arange(len(base)), 1
    while size < span:
        step = min(size, span - size)
        right = least[step:] < least[:-step]
        least = np.where(right, least[step:], least[:-step])
        place = np.where(right, place[step:], place[:-step])
        size += step
    return place


def _runs(place: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of consecutive places with equal values begin."""
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1] + 1
    for values in same:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _bucket(anchors: np.ndarray) -> np.ndarray:
    # The low bits: anchors are the smallest names of several, so their high bits are uneven.
    return (anchors & np.uint64(BUCKETS - 1)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        table = pa.table(batch)
        for first, last in chunks(batch.column("text")):
            yield table.slice(first, last - first)


def _windows_of(part: pa.Table, window: int, base: int):
    """The windows of some texts: text, place, name and anchor (its place among all words and name), and which are settled."""
    words = Words(part.column("text").combine_chunks())
    counts = words.counts
    hashes = words.hashes()
    names = windows(hashes, window)
    if len(names) == 0:
        return None
    small = windows(hashes, base)
    ids, digests = part.column("id").to_numpy(), part.column("digest").to_numpy()
    missing = part.column("last_id").to_numpy()
    by_document = np.lexsort((digests, ids, missing))
    differs = np.zeros(len(counts), dtype=np.int64)
    for values in (missing, ids, digests):
        differs[1:] |= values[by_document][1:] != values[by_document][:-1]
    rank = np.empty(len(counts), dtype=np.int64)
    rank[by_document] = np.cumsum(differs)
    # Rows that repeat a document have the same windows; one of them in a chunk is enough.
    chosen = np.zeros(len(counts), dtype=bool)
    chosen[by_document[:1]] = True
    chosen[by_document[np.flatnonzero(differs)]] = True
    valid = np.flatnonzero((inside(counts, window) & np.repeat(chosen, counts))[: len(names)])
    if len(valid) == 0:
        return None
    anchor_at = _anchors(small, window - base + 1)[valid]
    text = np.repeat(np.arange(len(counts)), counts)[valid]
    names = names[valid]
    place = valid - words.bounds[text]
    # A window settles the later ones of its name in this chunk; the earliest stays a candidate.
    when = (rank[text] << 32) | place
    order = np.lexsort((when, names))
    head = np.ones(len(order), dtype=bool)
    head[1:] = names[order[1:]] != names[order[:-1]]
    earliest = when[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    repeat = np.zeros(len(order), dtype=bool)
    repeat[order] = when[order] > earliest
    return text, place, names, anchor_at, small[anchor_at], repeat


def _loads(window: int, base: int):
    """How many windows a task would send for the anchors of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(BUCKETS, dtype=np.int64)
        for part in _parts(batches):
            if (found := _windows_of(part, window, base)) is not None:
                *_, anchor, repeat = found
                load += np.bincount(_bucket(anchor[~repeat]), minlength=BUCKETS)
        some = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(load[some])], names=["bucket", "windows"]
        )

    return run


def _candidates(window: int, base: int, hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.zeros(BUCKETS, dtype=bool)
        spread[hot.value] = True
        for part in _parts(batches):
            if (found := _windows_of(part, window, base)) is not None:
                yield from one(part, spread, *found)

    def one(part, spread, text, place, names, anchor_at, anchors, repeat) -> Iterator[pa.RecordBatch]:
        ids, digests = part.column("id").to_numpy(), part.column("digest").to_numpy()
        missing = part.column("last_id").to_numpy()
        for chosen, settled in ((np.flatnonzero(~repeat), False), (np.flatnonzero(repeat), True)):
            if len(chosen) == 0:
                continue
            if settled:
                heads = _runs(place[chosen], text[chosen])
            else:
                alone = spread[_bucket(anchors[chosen])]
                heads = _runs(place[chosen], text[chosen], anchor_at[chosen], np.where(alone, place[chosen], -1))
            length = np.diff(np.append(heads, len(chosen)))
            at = chosen[heads]
            rows = len(heads)
            if settled:
                packed = pa.nulls(rows, pa.binary())
                anchor = pa.nulls(rows, pa.int64())
            else:
                cut = np.zeros((len(chosen), 8), dtype=np.uint8)
                cut[:, :NAME_BYTES] = np.ascontiguousarray(names[chosen]).view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
                edges = np.zeros(rows + 1, dtype=np.int32)
                np.cumsum(length * NAME_BYTES, out=edges[1:])
                data = pa.py_buffer(np.ascontiguousarray(cut[:, :NAME_BYTES]))
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edges), data])
                own = joined(anchors[at], cut.view(np.uint64).ravel()[heads])
                anchor = pa.array(np.where(alone[heads], own, anchors[at]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    anchor,
                    pa.array(missing[text[at]]),
                    pa.array(ids[text[at]]),
                    pa.array(digests[text[at]]),
                    pa.array(place[at]),
                    packed,
                    pa.array(length.astype(np.int32)),
                ],
                names=["anchor", "last_id", "id", "digest", "start", "names", "covered"],
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and then by document, the windows whose name came before.

    Only the names of the anchor at hand are kept between batches. The row that brought a
    name first is known by its document and place, so that a twin of it is not covered.
    """
    open_anchor, seen = None, {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        anchors = batch.column(0).to_numpy()
        count = batch.column(6).to_numpy().astype(np.int64)
        packed = batch.column(5)
        edges = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
        data = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]]
        names = np.zeros((len(data) // NAME_BYTES, 8), dtype=np.uint8)
        names[:, :NAME_BYTES] = data.reshape(-1, NAME_BYTES)
        row = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = batch.column(4).to_numpy()[row] + within
        name = joined(anchors.view(np.uint64)[row], names.view(np.uint64).ravel())
        ids, digests = batch.column(2).to_numpy()[row], batch.column(3).to_numpy()[row]
        missing = batch.column(1).to_numpy(zero_copy_only=False)[row]
        distinct, first, group = np.unique(name, return_index=True, return_inverse=True)
        at = first[group]
        twin = (ids == ids[at]) & (digests == digests[at]) & (start == start[at]) & (missing == missing[at])
        again = ~twin
        if anchors[0] == open_anchor and seen:
            for i in np.flatnonzero(anchors[row] == open_anchor):
                known = seen.get(int(name[i]))
                if known is not None:
                    again[i] = known != (int(ids[i]), int(digests[i]), int(start[i]))
        if anchors[-1] != open_anchor:
            open_anchor, seen = anchors[-1], {}
        tail = first[anchors[row[first]] == open_anchor]
        for i in tail:
            seen.setdefault(int(name[i]), (int(ids[i]), int(digests[i]), int(start[i])))
        hit = np.flatnonzero(again)
        if len(hit):
            heads = hit[_runs(start[hit], row[hit])]
            length = np.diff(np.append(_runs(start[hit], row[hit]), len(hit)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[heads]),
                    pa.array(missing[heads]),
                    pa.array(digests[heads]),
                    pa.array(start[heads]),
                    pa.array(length.astype(np.int32)),
                ],
                names=["id", "last_id", "digest", "start", "covered"],
            )


def candidates(docs: DataFrame, window: int = WINDOW, base: int = BASE, limit: int = ANCHOR_WINDOWS) -> DataFrame:
    """Runs of windows by what they must meet on (``anchor``); without one they are settled already.

    At most ``limit`` different windows meet on one value. ``docs`` has the columns of
    ``KEY`` and ``text``.
    """
    docs = docs.select("id", "last_id", "digest", "text")
    loads = docs.mapInArrow(_loads(window, base), _LOAD).groupBy("bucket").agg(F.sum("windows").alias("windows"))
    hot = [row["bucket"] for row in loads.where(F.col("windows") > limit).select("bucket").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(hot, dtype=np.int64))
    return docs.mapInArrow(_candidates(window, base, shared), _CANDIDATE)


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, base: int = BASE, limit: int = ANCHOR_WINDOWS
) -> DataFrame:
    """Runs of windows (``start``, ``covered`` many) that also start earlier, by document.

    ``docs`` has the columns of ``KEY`` and ``text``.
    """
    found = candidates(docs, window, base, limit)
    settled = found.where("anchor IS NULL").select("id", "last_id", "digest", "start", "covered")
    compared = (
        found.where("anchor IS NOT NULL")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "last_id", "id", "digest", "start")
        .mapInArrow(_compare, _COVER)
    )
    return settled.unionByName(compared)


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            for first, last in chunks(batch.column("text")):
                yield one(table.slice(first, last - first).combine_chunks())

    def one(part: pa.Table) -> pa.RecordBatch:
        words = Words(part.column("text").combine_chunks())
        gone = np.zeros(len(words) + 1, dtype=np.int32)
        starts, lengths = part.column("starts").combine_chunks(), part.column("lengths").combine_chunks()
        number = np.diff(starts.offsets.to_numpy())
        first = starts.values.to_numpy()[starts.offsets[0].as_py() : starts.offsets[-1].as_py()]
        length = lengths.values.to_numpy()[lengths.offsets[0].as_py() : lengths.offsets[-1].as_py()]
        at = first + np.repeat(words.bounds[:-1], number)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + length + window - 1, -1)
        kept = np.cumsum(gone)[:-1] == 0
        # The kept words' bytes, each followed by a space.
        sizes = words.ends - words.starts
        letters = words.data[words.in_word][np.repeat(kept, sizes)]
        sizes = sizes[kept]
        ends = np.cumsum(sizes + 1)
        spaced = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
        is_letter = np.ones(len(spaced), dtype=bool)
        is_letter[ends - 1] = False
        spaced[is_letter] = letters
        left = np.concatenate(([0], np.cumsum(kept)))[words.bounds]
        edge = np.concatenate(([0], ends))[left]
        view = memoryview(spaced)
        texts = [bytes(view[edge[i] : max(edge[i], edge[i + 1] - 1)]) for i in range(len(edge) - 1)]
        columns = {name: part.column(name) for name in ("id", "last_id", "digest")}
        columns["n_words"] = pa.array(words.counts, pa.int64())
        columns["n_removed"] = pa.array(words.counts - np.diff(left), pa.int64())
        columns["kept_sha256"] = pa.array([hashlib.sha256(text).hexdigest() for text in texts], pa.string())
        columns["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.table(columns).combine_chunks().to_batches()[0]

    return run


def covers(texts: DataFrame, window: int = WINDOW, base: int = BASE, limit: int = ANCHOR_WINDOWS) -> DataFrame:
    """The list of ``repeated_windows`` of each document: one run for a start at most, however many rows repeat it."""
    return (
        repeated_windows(texts, window, base, limit)
        # Of runs that start at one place the longest covers the others.
        .groupBy(*KEY, "start")
        .agg(F.max("covered").alias("covered"))
        .groupBy(KEY)
        .agg(F.collect_list(F.struct("start", "covered")).alias("covers"))
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, base: int = BASE, limit: int = ANCHOR_WINDOWS
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` of each row of ``docs``."""
    texts = keyed(docs, whole_text())
    empty = F.array().cast("array<long>")
    return (
        texts.join(covers(texts, window, base, limit), KEY, "left")
        .select(
            *KEY,
            "text",
            F.coalesce(F.col("covers.start"), empty).alias("starts"),
            F.coalesce(F.col("covers.covered").cast("array<long>"), empty).alias("lengths"),
        )
        .mapInArrow(
            _kept(window),
            "id long, last_id boolean, digest long, n_words long, n_removed long, kept_sha256 string, kept_text string",
        )
        .select(doc_id(), "n_words", "n_removed", "kept_sha256", "kept_text")
    )
