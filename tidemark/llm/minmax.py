"""Near duplicates by min-max hashing: the least and the largest hash of a set under each permutation.

A document's set holds its distinct 2-word shingles. Two documents link if their sets'
intersection is at least 80 % of their union.

* Each of ``PERMUTATIONS`` scrambles a set's shingles once and keeps both ends, the least and
  the largest value. Both agree for two sets as often as their similarity says, so one
  evaluation gives two values of a signature. ``BAND`` values (both ends of two permutations)
  make a band: 40 bands of 4. Sets with a similarity of 0.8 share a band with a
  probability of at least 1 - 2e-8 (1 - 7e-10 for large sets).
* Sets that share a band are a bucket. The member that has most company in all its
  buckets is a bucket's pivot: of a group of copies it is the one closest to the original, to
  which nearly all that link at all do link. Every member is compared with its pivots only,
  so this step grows with the members and not with their square.
* Where the members of a pivot are then in different components, those of different
  components are compared inside tasks by sketches, in blocks of bounded size. Only pairs
  that their sketches allow come out, and are confirmed as well.
* Links are confirmed on the full sets, remade from the whole texts. A sketch is a bit for
  each of at least 16 cells a shingle: cells that only one of two sets fills say how many
  shingles at least are in it alone. Sketches rule out pairs that cannot link and no others.

Equal sets are one node, named by a 64-bit hash of the set. With n different sets,
n^2 / 2^65 are expected to share a name with another set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.links import BLOCK_BYTES, across_whole, as_bytes, central, ends_of, few, matched, verified
from tidemark.llm.sketches import Sketches, sketch
from tidemark.llm.storage import KEY, doc_id, keyed, saved, whole_text
from tidemark.llm.words import Words, chunks, joined, mix, windows

SHINGLE = 2
#: The intersection is at least so many hundredths of the union.
SIMILARITY = 80
PERMUTATIONS = 80
BAND = 4
SEED = 42
#: Cells of a sketch for each shingle, at least.
CELLS = 16
#: Shingles that are scrambled together.
AT_ONCE = 1 << 16

SETS = "last_id boolean, id long, digest long, n_shingles long, node long, bands array<long>"
SKETCH = "node long, size long, text binary"
NAMES = [field.split()[0] for field in SETS.split(", ")]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, fold_ascii=True)
    hashes = words.hashes()
    whole = windows(hashes, SHINGLE)
    sets = []
    for begin, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        sets.append(np.unique(whole[begin : end - SHINGLE + 1]) if end - begin >= SHINGLE else hashes[begin:end])
    return sets


def _prepare(texts: pa.Array) -> list[np.ndarray]:
    return [one for begin, end in chunks(texts) for one in shingle_sets(texts.slice(begin, end - begin))]


def node_of(tokens: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0]


def multipliers() -> np.ndarray:
    """An odd number for each permutation of the 32-bit numbers."""
    return np.random.default_rng(SEED).integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray], odd: np.ndarray) -> np.ndarray:
    """Both ends of each permutation, side by side, of sets that are not empty; one row a set."""
    found = np.empty((len(sets), 2 * len(odd)), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    upto = np.cumsum(sizes)
    first = 0
    while first < len(sets):
        # Few enough shingles to stay in a core's cache, unless one set has more.
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - sizes[first] + AT_ONCE, side="right")))
        tokens = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = upto[first:last] - sizes[first:last] - (upto[first] - sizes[first])
        for k, factor in enumerate(odd):
            value = tokens * factor
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x85EBCA6B)
            value ^= value >> np.uint32(13)
            found[first:last, 2 * k] = np.minimum.reduceat(value, starts)
            found[first:last, 2 * k + 1] = np.maximum.reduceat(value, starts)
        first = last
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    values = found.astype(np.uint64).reshape(len(found), -1, BAND)
    key = np.broadcast_to(np.arange(values.shape[1], dtype=np.uint64), values.shape[:2])
    for i in range(BAND):
        key = joined(key, values[:, :, i])
    return key


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd, seen = multipliers(), set()
    for batch in batches:
        for begin, end in chunks(batch.column("text")):
            part = batch.slice(begin, end - begin)
            sets = shingle_sets(part.column("text"))
            nodes = np.array([node_of(s) for s in sets], dtype=np.uint64)
            new = []
            for i, node in enumerate(nodes.tolist()):
                if len(sets[i]) and node not in seen:
                    seen.add(node)
                    new.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            keys = band_keys(signatures([sets[i] for i in new], odd)) if new else np.zeros((0, 0), np.uint64)
            # Of the rows with one set only the first has its bands.
            counts = np.zeros(len(sets), dtype=np.int32)
            counts[new] = keys.shape[1]
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
            sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
            columns = [*(part.column(name) for name in KEY), sizes, pa.array(nodes.view(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in chunks(batch.column("text")):
            part = batch.slice(begin, end - begin)
            sets = shingle_sets(part.column("text"))
            sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
            columns = [part.column("node"), sizes, pa.array([sketch(s, CELLS) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "text"])


def similar(pivots: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Which full sets link with their pivot; equal pivots stand in a row."""
    flags = np.zeros(len(others), dtype=bool)
    for i, (pivot, other) in enumerate(zip(pivots, others)):
        place = np.minimum(np.searchsorted(pivot, other), len(pivot) - 1)
        both = int((pivot[place] == other).sum())
        flags[i] = 100 * both >= SIMILARITY * (len(pivot) + len(other) - both)
    return flags


class Sets:
    """The sets of some texts, compared in full; their sketches rule out first."""

    def __init__(self, texts: list[str]):
        self.sets = _prepare(pa.array(texts, pa.string()))
        self.linkable = Sketches([sketch(s, CELLS) for s in self.sets], SIMILARITY).linkable

    def matches(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return similar([self.sets[i] for i in left.tolist()], [self.sets[i] for i in right.tolist()])


def stars(sets: DataFrame) -> DataFrame:
    """Pairs of a pivot ``a`` and another member ``b`` of one of its buckets."""
    rows = sets.select("node", F.explode("bands").alias("key"))
    # A set that several tasks read has a row of each.
    ends = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    keys = saved(ends.where("least != most").select("key"), "keys")
    alike = saved(rows.join(keys, "key").distinct(), "alike")
    pairs, _ = central(alike.withColumn("size", F.lit(0)))
    return pairs.select("a", "b")


def links(sets: DataFrame, texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``node`` and ``component`` of every node that links with another."""
    pairs = stars(sets)
    nodes = ends_of(pairs)
    # One row of each node has its text.
    one = sets.join(few(nodes), "node").groupBy("node").agg(F.min(F.struct(*KEY)).alias("one"))
    one = saved(one.select("node", "one.*"), "nodes")
    held = saved(texts.join(few(one), KEY).select("node", "text").dropDuplicates(["node"]), "texts")
    sketches = saved(held.mapInArrow(_sketches, SKETCH), "sketches")
    bits = sketches.select("node", "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return verified(pairs, held, _prepare, similar)

    def matcher(held: list[bytes]) -> Sketches:
        return Sketches(held, SIMILARITY)

    likely = verified(pairs, bits, as_bytes, matched(matcher))
    edges = confirmed(likely)
    labels = components(edges)

    # They have been compared with their pivot.
    members = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("node"))
    members = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return held.join(few(nodes), "node", "left_semi")

    found = across_whole(members, bits, matcher, texts_of, Sets, block_bytes)
    return labels if found is None or found.isEmpty() else components(edges.unionByName(found))


def near_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    ``component_id`` is the smallest id that links reach; a row is kept if it is its own.

    Null and empty texts have an empty set, link with nothing and are kept; a text of one word
    has that word as its set. Rows that repeat an id and a text are each a row of the result. Rows
    without an id have no smallest id to give: a component of such rows alone has null, and they
    are kept. Texts are read whole, however long. An empty table gives an empty one. Other
    columns are left alone, whatever their names.
    """
    texts = keyed(docs, whole_text())
    sets = saved(texts.mapInArrow(_collect, SETS), "sets")
    labels = links(sets.where("n_shingles > 0"), texts, block_bytes)
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component")
    own = sets.select(*KEY, "n_shingles", "node")
    labelled = saved(own.join(labels, "node", "left").select(*KEY, "n_shingles", component), "labelled")
    least = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min(doc_id()).alias("least"))
    of_component = labelled.join(saved(least, "smallest"), "component", "left")
    smallest = F.when(F.col("component").isNull(), doc_id()).otherwise(F.col("least"))
    found = of_component.select(doc_id(), "n_shingles", smallest.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
