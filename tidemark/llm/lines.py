"""Line dedup by a segment-partition edit join.

Lines are near copies if one turns into the other by insertions, deletions or substitutions
of code points, one for each ``PER_EDIT`` (8) code points of the shorter line and ``EDITS`` (2) at
most. So two lines of 16 code points or more may differ by two edits, shorter ones by one,
and those under 8 are near copies only if they are equal: ``1.`` and ``2.`` are different lines.

A line that may have e edits is cut into e + 1 segments of even length. If two lines are near
copies, one of the shorter's segments stands unchanged in the longer one, and at a place
that its number and the lines' lengths leave only a few choices for. Segments are indexed
by (length of the line, number, content); a line looks up, for every length from its own
down to e less, the pieces of it at those places. Lines that meet there are compared by a
banded bit-parallel edit distance, many pairs at once.

Of every component of near copies the first line stays (smallest document id, then first
in its text) and the others are removed from their texts. Lines without a word stay.

Equal lines have one node, named by a 64-bit hash, and are combined in each task before the
shuffle, so a line that a third of all texts repeat is sent once from each. With n different
lines, n^2 / 2^65 are expected to share a name with another.

Results for odd input: null counts as the empty text; a null id is larger than every other;
texts that share an id are in the order of a hash; rows that repeat id and text are one document
and each get its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.links import PACKED, buckets_for, few, linked, packed_signatures
from tidemark.llm.storage import KEY, doc_id, keyed, saved, whole_text
from tidemark.llm.words import Words, chunks, mix

EDITS = 2
#: A line may have an edit for each so many code points.
PER_EDIT = 8
#: Distinct lines that a task remembers before it starts afresh; results do not depend on it.
REMEMBERED = 500_000

LINES = "last_id boolean, id long, digest long, line int, node long"
TEXTS = "node long, text binary"
#: Bytes of lines in a block that is compared with others.
LINE_BLOCK = 4 << 20
#: Cells of text that one pass of the edit distance holds, unless a single line is longer.
CELLS = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and of each line: begin, end, its text's number, and whether it has a word."""
    words = Words(texts)
    data, offsets = words.data, words.offsets
    feeds = np.flatnonzero(data == 0x0A)
    # A text of n line feeds has n + 1 lines, the last of which may be empty.
    rows = np.arange(len(offsets) - 1)
    feed_row = np.searchsorted(offsets, feeds, side="right") - 1
    row = np.concatenate((rows, feed_row))
    begin = np.concatenate((offsets[:-1], feeds + 1))
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    last = np.ones(len(row), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    end = np.where(last, offsets[row + 1], np.append(begin[1:], 0) - 1)
    place = np.searchsorted(words.starts, begin)
    has_word = np.append(words.starts, len(data) + 1)[place] < end
    return data, begin, end, row, has_word


def _names(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))


def allowed(length: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    """How many edits lines whose shorter one has so many code points may be apart."""
    return np.minimum(length // per_edit, edits)


def code_points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes as numbers of code points, with the places of lines among these."""
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return data, begin, end
    places = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=places[1:])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(codes) != places[-1]:  # not UTF-8: the bytes as they are
        return data, begin, end
    return codes, places[begin], places[end]


def counts_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many code points of each of 8 kinds are in each line; an edit changes two counts by one at most."""
    kind = (data & 7).astype(np.int64)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(int((end - begin).sum())) + np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin)
    return np.bincount(owner * 8 + kind[at], minlength=8 * len(begin)).reshape(-1, 8)


class Pieces:
    """Hashes of any pieces of some bytes, from sums over all bytes before each place."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            # Each code point's number, scrambled; bytes stand for themselves in plain text.
            codes = mix(np.arange(1, 257, dtype=np.uint64))[data] if data.itemsize == 1 else mix(data + np.uint64(1))
            codes *= self._powers(BASE, len(data))
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(codes, out=self.sums[1:])
            del codes
            self.inverse = self._powers(pow(int(BASE), -1, 2**64), len(data) + 1)

    @staticmethod
    def _powers(base: int, count: int) -> np.ndarray:
        powers = np.full(count, base, dtype=np.uint64)
        powers[:1] = 1
        return np.cumprod(powers, out=powers)

    def hashes(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        # Divided by the power of the place, so that equal pieces have one hash wherever they stand.
        return mix((self.sums[begin + length] - self.sums[begin]) * self.inverse[begin])


def _segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of a segment: even lengths, the longer ones last."""
    parts = edits + 1
    short = length // parts
    longer = length % parts
    before = parts - longer  # segments of the short length
    begin = number * short + np.maximum(0, number - before)
    return begin, short + (number >= before)


def signatures_of(
    begin: np.ndarray, end: np.ndarray, pieces: Pieces, edits: int, per_edit: int
) -> tuple[np.ndarray, np.ndarray]:
    """The keys that lines are indexed by and look up, and for each key the line's number."""
    length = end - begin
    rows = np.arange(len(begin))
    keys, owners = [], []
    for less in range(edits + 1):
        target = length - less
        most = allowed(np.maximum(target, 0), edits, per_edit)
        for apart in range(max(less, 1), edits + 1):
            # Lines whose shorter one may be ``apart`` edits away have one segment more than that.
            some = np.flatnonzero((most == apart) & (target > apart))
            for number in range(apart + 1):
                at, size = _segment(target[some], number, apart)
                # A segment's number bounds the edits before it, and what is left those after it.
                after = apart - number
                for shift in range(max(-number, less - after), min(number, less + after) + 1):
                    ok = (at + shift >= 0) & (at + shift + size <= length[some])
                    content = pieces.hashes(begin[some[ok]] + at[ok] + shift, size[ok])
                    label = (target[some[ok]].astype(np.uint64) << np.uint64(8)) | np.uint64(number)
                    keys.append(mix(content + mix(label)))
                    owners.append(some[ok])
    if not keys:
        return np.zeros(0, dtype=np.uint64), rows[:0]
    return np.concatenate(keys), np.concatenate(owners)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in chunks(batch.column("text")):
            part = batch.slice(first, last - first)
            data, begin, end, row, has_word = lines_of(part.column("text"))
            line = np.arange(len(row)) - np.searchsorted(row, row)
            at = np.flatnonzero(has_word)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(name).take(pa.array(row[at])) for name in ("last_id", "id", "digest")),
                    pa.array(line[at].astype(np.int32)),
                    pa.array(_names(data, begin[at], end[at]).view(np.int64)),
                ],
                names=[field.split()[0] for field in LINES.split(", ")],
            )


def _distinct(batches: Iterator[pa.RecordBatch]):
    """Lines with a word, mostly once in a task: data, begin, end, names."""
    seen: set[int] = set()
    for batch in batches:
        for first, last in chunks(batch.column("text")):
            data, begin, end, _, has_word = lines_of(batch.column("text").slice(first, last - first))
            begin, end = begin[has_word], end[has_word]
            names = _names(data, begin, end)
            names, where = np.unique(names, return_index=True)
            new = np.array([name not in seen for name in names.tolist()], dtype=bool)
            if len(seen) > REMEMBERED:
                seen = set()
            seen.update(names[new].tolist())
            yield data, begin[where[new]], end[where[new]], names[new]


def _signatures(edits: int, per_edit: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, begin, end, names in _distinct(batches):
            if not len(names):
                continue
            codes, begin, end = code_points(data, begin, end)
            keys, owner = signatures_of(begin, end, Pieces(codes), edits, per_edit)
            if len(keys):
                yield from packed_signatures(keys, (end - begin)[owner], names[owner], buckets)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data, begin, end, names in _distinct(batches):
        view = memoryview(data)
        lines = [bytes(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(lines, pa.binary())], names=["node", "text"])


class Lines:
    """Some lines in UTF-8, compared by their edit distance."""

    def __init__(self, lines: list[bytes], edits: int, per_edit: int):
        self.edits, self.per_edit = edits, per_edit
        size = np.array([len(line) for line in lines], dtype=np.int64)
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(lines), np.uint8)
        codes, begin, end = code_points(data, end - size, end)
        self.length = end - begin
        self.counts = counts_of(codes, begin, end)
        self.lines = [codes[a:b] for a, b in zip(begin.tolist(), end.tolist())]

    def linkable(self, i: int, others: np.ndarray) -> np.ndarray:
        most = allowed(np.minimum(self.length[others], self.length[i]), self.edits, self.per_edit)
        near = (np.abs(self.length[others] - self.length[i]) <= most) & (most > 0)
        others, most = others[near], most[near]
        near = np.abs(self.counts[others] - self.counts[i]).sum(axis=1) <= 2 * most
        return others[near]

    def matches(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        most = allowed(np.minimum(self.length[left], self.length[right]), self.edits, self.per_edit)
        flags = np.zeros(len(left), dtype=bool)
        for edits in np.unique(most).tolist():
            at = np.flatnonzero(most == edits)
            x, y = left[at].tolist(), right[at].tolist()
            flags[at] = within_edits([self.lines[i] for i in x], [self.lines[i] for i in y], edits)
        return flags


def within_edits(lefts: list[np.ndarray], rights: list[np.ndarray], edits: int) -> np.ndarray:
    """Which pairs of arrays (of more than ``edits`` numbers) are at most ``edits`` edits apart."""
    rows, columns = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    result = np.abs(rows - columns) <= edits
    chosen = np.flatnonzero(result)
    chosen = chosen[np.argsort(columns[chosen], kind="stable")]
    while len(chosen):
        # Pairs of about the same length go together, within a bound on their table.
        cells = (columns[chosen] + 2 * edits) * np.arange(1, len(chosen) + 1)
        some, chosen = np.split(chosen, [max(1, min(4096, int(np.searchsorted(cells, CELLS))))])
        distance = _banded([lefts[i] for i in some], [rights[i] for i in some], edits)
        result[some] = distance <= edits
    return result


def _banded(lefts: list[np.ndarray], rights: list[np.ndarray], edits: int) -> np.ndarray:
    """The edit distance of each pair where it is at most ``edits``, else a larger number.

    The distance table is followed in a band around its diagonal. A column of the band is
    held as the bits of its vertical differences, the lowest row in the highest bit, and the
    band moves down by one row each column. The distance is counted along the band's lowest
    row while that is inside the table, then along the table's last row. All pairs go through
    their columns together, one word each.
    """
    rows, sizes = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    count, width, columns = len(lefts), 2 * edits + 2, int(sizes.max())
    text = np.full((columns, count), -2, dtype=np.int32)
    # Bit r of column j is row j + edits - (width - 1) + r; there is nothing outside the table.
    above = width - 1 - edits
    padded = np.full((above + max(int(rows.max()), columns) + width, count), -1, dtype=np.int32)
    for i in range(count):
        text[: sizes[i], i] = rights[i]
        padded[above : above + rows[i], i] = lefts[i]
    one, top, mask = np.uint64(1), np.uint64(1 << (width - 1)), np.uint64((1 << width) - 1)
    up = np.full(count, mask & ~np.uint64((1 << (width - edits - 1)) - 1), dtype=np.uint64)
    down = np.zeros(count, dtype=np.uint64)
    score = np.full(count, edits, dtype=np.int64)
    final = score.copy()
    for j in range(columns):
        match = np.zeros(count, dtype=np.uint64)
        for r in range(width):
            match |= (text[j] == padded[j + r]).astype(np.uint64) << np.uint64(r)
        zero = ((((match & up) + up) ^ up) | match | down) & mask
        across_up = (down | ~(zero | up)) & mask
        across_down = zero & up
        past = j - (rows - edits)
        bit = np.uint64(width - 2) - np.clip(past, 0, width - 2).astype(np.uint64)
        along = ((across_up >> bit) & one).astype(np.int64) - ((across_down >> bit) & one).astype(np.int64)
        score += np.where(past < 0, (zero & top) == 0, along)
        up = (across_down | ~((zero >> one) | across_up)) & mask
        down = (zero >> one) & across_up
        ends = sizes == j + 1
        final[ends] = score[ends]
    return final


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept_texts, counts, removed = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            lines, gone = text.split("\n"), set(gone)
            kept_texts.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
            counts.append(len(lines))
            removed.append(len(gone))
        digests = [hashlib.sha256(text.encode("utf-8", "replace")).hexdigest() for text in kept_texts]
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
            names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"],
        )


def line_components(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, lines: int = 0) -> DataFrame:
    """``node`` and ``component`` of every line that is a near copy of a different one.

    ``lines`` is about how many there are.
    """
    if per_edit < 2:
        raise ValueError("a line must be longer than the edits that it may have")
    texts = docs.select(whole_text())
    # Segments of a line's own length, and pieces at some places for every shorter one.
    buckets = buckets_for(docs.sparkSession, lines * (edits + 1) * (edits + 2))
    signatures = texts.mapInArrow(_signatures(edits, per_edit, buckets), PACKED)

    def texts_of(nodes: DataFrame) -> DataFrame:
        found = texts.mapInArrow(_texts, TEXTS).join(few(nodes), "node", "left_semi")
        return saved(found.dropDuplicates(["node"]), "texts")

    def fits(left: Column, right: Column) -> Column:
        return F.abs(left - right) <= edits

    return linked(signatures, fits, texts_of, lambda held: Lines(held, edits, per_edit), block_bytes=LINE_BLOCK, by_key=True)


def remove_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``kept_sha256`` and ``kept_text`` of each row of ``docs``.

    Texts and lines are taken whole, however long; an empty table gives an empty one; other
    columns are left alone, whatever their names.
    """
    texts = keyed(docs, whole_text())
    lines = saved(texts.mapInArrow(_line_rows, LINES), "lines")
    labels = line_components(texts, edits, per_edit, lines.count())
    component = F.coalesce("component", "node").alias("component")
    lines = saved(lines.join(labels, "node", "left").select(*KEY, "line", component), "lines")
    place = F.struct(*KEY, "line")
    first = lines.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = saved(first.where("n > 1").select("component", "first"), "first-lines")
    repeated = lines.join(first, "component").where(place != F.col("first"))
    gone = repeated.groupBy(KEY).agg(F.collect_set("line").alias("gone"))
    return (
        texts.join(gone, KEY, "left")
        .select(doc_id(), "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
        .mapInArrow(_apply, "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string")
    )
