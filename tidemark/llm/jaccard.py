"""Near duplicates by an exact n-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct 5-word shingles. Two documents link if their sets'
intersection is at least 75 % of their union. The join is exact:

* Shingles that at least one in ``FREQUENT_SHARE`` sets holds are frequent, all others rare.
  Every set is put in the same order: rare shingles first, each class by how often its
  shingles come about, then by hash. A passage or line that many sets share stands behind what is
  a set's own, and so brings together only sets that are mostly made of such.
* Take linked sets x and y that differ. If they share a rare shingle, the first one they
  share is among the first |x| - ceil(0.75 |x|) + 1 of x, and likewise for y. These prefixes'
  rare shingles are indexed one by one.
* Else all they share is frequent. With s shared, s >= 3/7 (|x| + |y|), at most
  |x| + |y| - 2s <= (|x| + |y|) / 7 shingles are in only one of the sets. Each can stand
  between two shared frequent shingles that follow each other at one place only, so among
  the first (|x| + |y|) / 7 + 2 shared ones two stand side by side in both orders. Those are
  within the first |x| / 2 + 2 frequent shingles of x. The combinations of two frequent
  neighbours in these extended prefixes are indexed. A set with more rare shingles than
  |x| - ceil(0.75 |x|) needs none.
* How far back an entry stands says how large a set may be that links by it, as ``steps_of``
  says. Sets that are too large for each other's entries are not compared with each other.
* Sets that share an entry of the index are compared in full, as ``links`` says.

Which shingles count as frequent decides how long the lists of the index are, not what is
found. They are counted over all documents with a lossy count: a shingle that is in less
than its share of every batch of sets is not frequent. There are at most FREQUENT_SHARE times
the mean size of a set, so the list that is broadcast does not grow with the corpus.
How often shingles come is counted in ``CELLS`` cells of hashes, also over all documents. A
cell's count is off by the other shingles in it, about as many in each cell, so a shingle stands out
once it is in more sets than a few times the root of the mean count; that grows with the root of
the corpus.

Equal sets have one node, named by a 64-bit hash of the set, and one of them in each task
goes on. With n different sets, n^2 / 2^65 are expected to share a name with another set.

Results for odd input: null and empty texts have an empty set and are a component alone; a
text with fewer words than a shingle has its whole sequence as one; rows that repeat a
document are in its component; a null id takes no part in the smallest id, and a component
of null ids alone has a null id.
Texts are read whole, however long; an empty table gives an empty result; other columns
are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.links import (
    BLOCK_BYTES,
    PACKED,
    STEP_BITS,
    STEPS,
    buckets_for,
    ends_of,
    few,
    linked,
    packed_signatures,
    verified,
)
from tidemark.llm.sketches import CountingSketches, counting_sketch
from tidemark.llm.storage import KEY, doc_id, keyed, saved, whole_text
from tidemark.llm.words import Words, chunks, joined, mix, windows

SHINGLE = 5
#: A shingle in one of so many sets is frequent.
FREQUENT_SHARE = 1000
#: The intersection is at least so many hundredths of the union.
SIMILARITY = 75
#: Shingles that are counted together before the counts are sent.
COUNT_AT_ONCE = 2_000_000
#: Cells in which all shingles are counted, a power of two.
CELLS = 1 << 20
#: Cells whose counts are sent and added up together.
PART_CELLS = 1 << 13

COUNTS = "part int, counts binary"
SETS = "last_id boolean, id long, digest long, n_shingles long, node long, sketch binary, token long, sets long, " + COUNTS


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, fold_ascii=True)
    hashes = words.hashes()
    whole = windows(hashes, SHINGLE)
    sets = []
    for begin, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if end - begin >= SHINGLE:
            sets.append(np.unique(whole[begin : end - SHINGLE + 1]))
        elif end > begin:
            sets.append(windows(hashes[begin:end], end - begin))
        else:
            sets.append(whole[:0])
    return sets


def _name(tokens: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0]


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _packed_counts(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The parts of the cells' counts that are not all zero, with their numbers."""
    parts = counts.astype(np.uint32).reshape(-1, PART_CELLS)
    numbers = np.flatnonzero(parts.any(axis=1))
    # Bytes of one weight stand together, as the high ones are mostly zero.
    planes = [parts[i].view(np.uint8).reshape(-1, 4).T.tobytes() for i in numbers.tolist()]
    packed = [pa.compress(p, codec="zstd", asbytes=True) for p in planes]
    return pa.array(numbers.astype(np.int32)), pa.array(packed, pa.binary())


def _unpacked_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * PART_CELLS, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part of the cells, from rows in the order of parts."""

    def row(part: int, total: np.ndarray) -> pa.RecordBatch:
        # A count beyond 32 bits is as high as any.
        full = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        raw = pa.compress(full.tobytes(), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw])], names=["part", "counts"])

    now, total = None, None
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != now:
                if now is not None:
                    yield row(now, total)
                now, total = part, np.zeros(PART_CELLS, dtype=np.uint64)
            total += _unpacked_counts(packed)
    if now is not None:
        yield row(now, total)


def _levels(collected: DataFrame) -> np.ndarray:
    """For each cell its place among the counts of all cells, the least first, in 16 bits."""
    parts = collected.where("part IS NOT NULL").select("part", "counts")
    counts = np.zeros((CELLS // PART_CELLS, PART_CELLS), dtype=np.uint32)
    for part, raw in parts.repartition("part").sortWithinPartitions("part").mapInArrow(_added, COUNTS).collect():
        counts[part] = np.frombuffer(pa.decompress(bytes(raw), 4 * PART_CELLS, codec="zstd", asbytes=True), np.uint32)
    distinct, place = np.unique(counts.ravel(), return_inverse=True)
    return (place // -(-len(distinct) // (1 << 16))).astype(np.uint16)


def _collect(share: int):
    names = [field.split()[0] for field in SETS.split(", ")]

    def blanks(rows: int, columns: range) -> list[pa.Array]:
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return [pa.nulls(rows, kinds[i]) for i in columns]

    def counts(held: list[np.ndarray], cells: np.ndarray) -> pa.RecordBatch:
        token, times = np.unique(np.concatenate(held), return_counts=True)
        cells += np.bincount(cells_of(token), times, CELLS).astype(np.uint32)
        often = times >= max(2, len(held) // share)
        token, times = token[often].view(np.int64), times[often]
        rows = len(token)
        columns = [*blanks(rows, range(6)), pa.array(token), pa.array(times), *blanks(rows, range(8, 10))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        cells = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for begin, end in chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                sets = shingle_sets(part.column("text"))
                nodes = np.array([_name(s) for s in sets], dtype=np.uint64)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                key = [part.column(name) for name in names[:3]]
                drawn = pa.array([counting_sketch(s) for s in sets], pa.binary())
                columns = [*key, pa.array(sizes), pa.array(nodes.view(np.int64)), drawn, *blanks(len(sets), range(6, 10))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                for tokens, node in zip(sets, nodes.tolist()):
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        held.append(tokens)
                        total += len(tokens)
                if total >= COUNT_AT_ONCE:
                    yield counts(held, cells)
                    held, total, seen = [], 0, set()
        if held:
            yield counts(held, cells)
        numbers, packed = _packed_counts(cells)
        if len(numbers):
            yield pa.RecordBatch.from_arrays([*blanks(len(numbers), range(8)), numbers, packed], names=names)

    return run


def signature(tokens: np.ndarray, is_frequent: np.ndarray) -> np.ndarray:
    """The index entries of a set in the order of all sets: rare shingles of its prefix, and combinations of frequent ones."""
    size = len(tokens)
    differing = size - -(-3 * size // 4)
    rare, frequent = tokens[~is_frequent], tokens[is_frequent]
    single = rare[: differing + 1]
    if len(rare) > differing:
        return single
    extended = frequent[: size // 2 + 2]
    return np.concatenate((single, joined(extended[:-1], extended[1:])))


def steps_of(size: int, rare: int, entries: int) -> np.ndarray:
    """For each entry of a set's index how far back it stands; ``rare`` of the set's shingles are rare.

    All that a pair shares stands from its first shared rare shingle on, or is frequent if it shares
    none. If i of the shingles of x stand before, it shares s <= |x| - i; and 7 s >= 3 (|x| + |y|) if it
    links. So |y| <= (4 |x| - 7 i) / 3, which ``links.reach`` takes from i in steps, rounded down.
    """
    place = np.arange(entries)
    place[min(rare, size - -(-3 * size // 4) + 1) :] = rare
    return np.minimum(place * STEPS // size, STEPS // 4)


def _signatures(frequent, levels, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level, seen = np.concatenate((frequent.value, [np.uint64(2**64 - 1)])), levels.value, set()
        for batch in batches:
            for begin, end in chunks(batch.column("text")):
                keys, sizes, nodes = [], [], []
                for tokens in shingle_sets(batch.column("text").slice(begin, end - begin)):
                    # Sets of one or two shingles are similar to equal ones only.
                    if len(tokens) < 3:
                        continue
                    node = _name(tokens)
                    if int(node) in seen:
                        continue
                    seen.add(int(node))
                    is_frequent = often[np.searchsorted(often, tokens)] == tokens
                    order = np.argsort(level[cells_of(tokens)], kind="stable")
                    entries = signature(tokens[order], is_frequent[order])
                    steps = steps_of(len(tokens), len(tokens) - np.count_nonzero(is_frequent), len(entries))
                    keys.append(entries)
                    sizes.append(len(tokens) + (steps << STEP_BITS))
                    nodes.append(np.full(len(entries), node))
                if len(seen) > 1_000_000:
                    seen.clear()
                if keys:
                    yield from packed_signatures(
                        np.concatenate(keys), np.concatenate(sizes), np.concatenate(nodes), buckets
                    )

    return run


def fits(left: Column, right: Column) -> Column:
    """Whether sets of two sizes could link."""
    return 100 * F.least(left, right).cast("long") >= SIMILARITY * F.greatest(left, right).cast("long")


def _prepare(texts: pa.Array) -> list[np.ndarray]:
    sets = []
    for begin, end in chunks(texts):
        sets += shingle_sets(texts.slice(begin, end - begin))
    return sets


def _similar(pivots: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Which sets have at least 75 % of the union with their pivot in common."""
    flags = np.zeros(len(others), dtype=bool)
    begin = 0
    while begin < len(others):
        pivot, end = pivots[begin], begin
        while end < len(others) and pivots[end] is pivot:
            end += 1
        sizes = np.array([len(o) for o in others[begin:end]])
        tokens = np.concatenate(others[begin:end])
        place = np.minimum(np.searchsorted(pivot, tokens), len(pivot) - 1)
        hits = np.concatenate(([0], np.cumsum(pivot[place] == tokens)))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        both = hits[edges[1:]] - hits[edges[:-1]]
        flags[begin:end] = 100 * both >= SIMILARITY * (sizes + len(pivot) - both)
        begin = end
    return flags


class Sets:
    """The sets of some texts, compared in full; their sketches rule out first."""

    def __init__(self, texts: list[str]):
        self.sets = _prepare(pa.array(texts, pa.string()))
        self.linkable = CountingSketches([counting_sketch(s) for s in self.sets], SIMILARITY).linkable

    def matches(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _similar([self.sets[i] for i in left.tolist()], [self.sets[i] for i in right.tolist()])


def near_duplicates(docs: DataFrame, frequent_share: int = FREQUENT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``KEY``, ``n_shingles``, ``component_id`` and ``component`` of each row of ``docs``.

    ``component`` names the component; it is null for a document without words.
    """
    texts = keyed(docs, whole_text())
    collected = saved(texts.mapInArrow(_collect(frequent_share), SETS), "sets")
    sets = collected.where("node IS NOT NULL").select(*KEY, "n_shingles", "node")
    total, shingles = sets.where("n_shingles > 0").agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    often = (
        collected.where("token IS NOT NULL")
        .groupBy("token")
        .agg(F.sum("sets").alias("sets"))
        .where((F.col("sets") > 2) & (F.col("sets") * frequent_share >= total))
        .select("token")
    )
    tokens = np.array([row[0] for row in often.collect()], dtype=np.int64).view(np.uint64)
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(tokens))
    levels = docs.sparkSession.sparkContext.broadcast(_levels(collected))
    # A set has about a quarter as many signatures as shingles.
    buckets = buckets_for(docs.sparkSession, (shingles or 0) // 4)
    signatures = texts.select("text").mapInArrow(_signatures(frequent, levels, buckets), PACKED)

    def texts_of(nodes: DataFrame) -> DataFrame:
        one = sets.join(few(nodes), "node").groupBy("node").agg(F.min(F.struct(*KEY)).alias("one"))
        one = saved(one.select("node", "one.*"), "nodes")
        return saved(texts.join(few(one), KEY).select("node", "text").dropDuplicates(["node"]), "texts")

    sketches = collected.where("n_shingles > 2").select("node", F.col("sketch").alias("text"))

    def sketches_of(nodes: DataFrame) -> DataFrame:
        return saved(sketches.join(few(nodes), "node", "left_semi").dropDuplicates(["node"]), "sketches")

    def confirm(pairs: DataFrame) -> DataFrame:
        return verified(pairs, texts_of(ends_of(pairs)), _prepare, _similar)

    def matcher(held: list[bytes]) -> CountingSketches:
        return CountingSketches(held, SIMILARITY)

    labels = linked(signatures, fits, sketches_of, matcher, confirm, texts_of, Sets, block_bytes, reaching=True)
    # Equal sets are one node; sets that are linked with no other are their own component.
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component")
    labelled = saved(sets.join(labels, "node", "left").select(*KEY, "n_shingles", component), "labelled")
    least = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min(doc_id()).alias("least"))
    of_component = labelled.join(saved(least, "smallest"), "component", "left")
    smallest = F.when(F.col("component").isNull(), doc_id()).otherwise(F.col("least"))
    return of_component.select(*KEY, "n_shingles", smallest.alias("component_id"), "component")
