"""Similarity components from signatures.

Two nodes may be similar only if they share a signature. Their components are found without
listing all pairs of those that share one:

1. Each signature gets a pivot: of its nodes the one with most company, which is the number
   of nodes in all signatures that it has. Of a group of near copies that is the one
   nearest to their origin, to which nearly all link that link at all. Every node is compared
   with its pivots, and the similar ones are joined into components.
2. Where the nodes of a pivot are then in different components, those of different
   components are compared inside tasks, in blocks of bounded size, by a matcher that works
   on arrays. Of what it finds only pairs that join components come out. Where the matcher only
   rules out, the nodes that it leaves come out, and their texts are compared in the same way.

Two nodes that share a signature share its pivot. So a pair that is never compared is in one
component already, and the components are exactly those of all similar pairs. The first step
grows with the nodes and their signatures. The second compares what is left of a group pairwise,
but lists no pairs that the matcher rules out.

Signatures are sent packed, in buckets of about a million by their high bits; a task holds one
bucket at a time.

A signature may say how large a node can be that is similar by it, its reach. Two members of a
pivot are not compared in the second step if one is larger than the other one's signatures there reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import saved

#: Members that one task compares with one pivot in a row; more are spread over salts.
PIVOT_ROWS = 256
#: Rows of a small table that stand for one pair whose texts are compared, so that a task has 5,000 of these.
PAIR_WORK = 50
#: Bytes in a block of members that are compared with each other.
BLOCK_BYTES = 16 << 20
#: Pairs that wait to be tested together.
TESTED = 1 << 15
#: Signatures in a bucket, about.
BUCKET_SIGNATURES = 1 << 20
#: A table of nodes (of a few numbers a row) with more rows is not broadcast.
FEW_ROWS = 300_000

#: Signatures of one chunk that go to one bucket, packed.
PACKED = "bucket int, packed binary"
STAR = "key long, a long, a_size long, b long, b_size long"
PAIR = "a long, b long"
MEMBER = "pivot long, node long, component long, size long, reach long"
#: How far back in its node a signature stands, in steps of which the node's size has so many, up to a quarter.
STEPS = 124
#: The steps stand over so many bits of a size; in a packed signature over the 27 bits of its place among the nodes.
STEP_BITS = 32


class Matcher(Protocol):
    """Some payloads, held for comparing them with each other."""

    def linkable(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the numbers ``others`` whose payloads may match the one numbered ``i``."""

    def matches(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of some such pairs do match, as far as the payloads tell."""


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


def packed_signatures(key: np.ndarray, size: np.ndarray, node: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The signatures of one chunk's nodes, combined and packed before the shuffle.

    Of the nodes that share a signature only the first by size, the head, goes to the
    signature's bucket; the others are packed with their heads and go anywhere. A bucket gets
    its signatures in order, with the places of their nodes in a list of the nodes. A
    signature's steps stand over its size.
    """
    order = np.lexsort((node, size, key))
    key, size, node = key[order], size[order].astype(np.int64), node[order]
    head = np.ones(len(key), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    new = head.copy()
    new[1:] |= node[1:] != node[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    rest = np.flatnonzero(new & ~head)
    parts = []
    if len(rest):
        at = np.concatenate((first[rest], rest))
        parts.append((int(key[0] % np.uint64(buckets)), _pack(key[rest], node[at], size[at])))
    key, size, node = key[head], size[head], node[head]
    # The high bits of a signature are its bucket, so buckets follow each other.
    bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(key))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        parts.append((int(bucket[begin]), _pack(key[begin:end], node[begin:end], size[begin:end])))
    yield pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
        names=["bucket", "packed"],
    )


def _pack(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> bytes:
    """Ascending keys as differences, the nodes once each, and every row's place among them."""
    nodes, first, place = np.unique(node, return_index=True, return_inverse=True)
    steps = np.diff(key, prepend=np.uint64(0))
    # Bytes of one weight stand together, where the high ones are mostly zero.
    planes = steps.view(np.uint8).reshape(-1, 8).T
    head = np.array([len(key), len(nodes), len(node)], dtype=np.uint32)
    sizes = size[first].astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    places = (place | size >> STEP_BITS << 27).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    raw = b"".join((head.tobytes(), planes.tobytes(), nodes.tobytes(), sizes.tobytes(), places.tobytes()))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    keys, nodes, rows = np.frombuffer(raw, np.uint32, 3).tolist()

    def planes(at: int, count: int, width: int) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, -1).T
        return np.ascontiguousarray(data).view(np.uint64 if width == 8 else np.uint32).ravel()

    key = np.cumsum(planes(12, keys, 8), dtype=np.uint64)
    node = np.frombuffer(raw, np.uint64, nodes, 12 + 8 * keys)
    at = 12 + 8 * keys + 8 * nodes
    size, place = planes(at, nodes, 4), planes(at + 4 * nodes, rows, 4)
    steps, place = (place >> np.uint32(27)).astype(np.int64), place & np.uint32((1 << 27) - 1)
    return key, node[place], size[place] + (steps << STEP_BITS)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed signatures in the order of their buckets: each node with the first one of its signature."""

    def star(key, a, a_size, b, b_size) -> pa.RecordBatch:
        return _batch(STAR, key.view(np.int64), a.view(np.int64), a_size, b.view(np.int64), b_size)

    def of_bucket(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, node, size = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[order[1:]] == key[order[:-1]]
        # Most signatures are one node's alone.
        order = order[same[1:] | same[:-1]]
        order = order[np.lexsort((node[order], size[order], key[order]))]
        key, node, size = key[order], node[order], size[order]
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        other = node != node[first]
        # Repeated rows of a node stand next to each other.
        other[1:] &= head[1:] | (node[1:] != node[:-1])
        at = np.flatnonzero(other)
        if len(at):
            yield star(key[at], node[first[at]], size[first[at]], node[at], size[at])

    bucket, parts = None, []
    for batch in batches:
        for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key, node, size = _unpack(packed)
            if len(node) > len(key):  # heads and the nodes that they stand for
                half = len(key)
                yield star(key, node[:half], size[:half], node[half:], size[half:])
                continue
            if number != bucket and parts:
                yield from of_bucket(parts)
                parts = []
            bucket = number
            parts.append((key, node, size))
    if parts:
        yield from of_bucket(parts)


def verified(pairs: DataFrame, texts: DataFrame, prepare: Callable, similar: Callable) -> DataFrame:
    """The pairs ``a``, ``b`` of a written table whose texts are similar. ``texts`` has ``node`` and ``text``.

    A pivot's text is sent once for every ``PIVOT_ROWS`` texts that it is compared with.
    ``prepare`` turns an Arrow array of texts into a list, ``similar`` takes a list of pivots,
    the same one in a row, and a list of what each is compared with, and gives flags.
    """
    total = pairs.count()
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PIVOT_ROWS))
    counted = pairs.join(saved(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "pivots", total), "a")
    salted = saved(counted.select("a", "b", salt.alias("salt")), "salted", total)
    rows = salted.select(F.col("a").alias("pivot"), "salt", F.col("b").alias("node")).unionByName(
        salted.select(F.col("a").alias("pivot"), "salt", F.col("a").alias("node")).distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            nodes = batch.column(2).to_numpy()
            items = prepare(batch.column(4))
            lefts, rights = [], []
            for key, item in zip(keys, items):
                if key != group:
                    group, pivot = key, item  # the pivot's own row is the first of its group
                    continue
                lefts.append(pivot)
                rights.append(item)
            if not rights:
                continue
            is_other = batch.column(3).to_numpy(zero_copy_only=False)
            flags = similar(lefts, rights)
            pivots = batch.column(0).to_numpy()[is_other]
            yield _batch(PAIR, pivots[flags], nodes[is_other][flags])

    compared = (
        rows.join(texts, "node")
        .select("pivot", "salt", "node", (F.col("pivot") != F.col("node")).alias("other"), "text")
        .repartition("pivot", "salt")
        .sortWithinPartitions("pivot", "salt", "other")
        .mapInArrow(run, PAIR)
    )
    return saved(compared, "edges", PAIR_WORK * total)


def matched(matcher: Callable[[list[bytes]], Matcher]) -> Callable:
    """A comparison for ``verified`` of pivots, the same one in a row, with others."""

    def similar(lefts: list[bytes], rights: list[bytes]) -> np.ndarray:
        flags = np.zeros(len(lefts), dtype=bool)
        starts = [i for i in range(len(lefts)) if i == 0 or lefts[i] is not lefts[i - 1]]
        # The pivots' payloads stand behind the others'.
        held = matcher([*rights, *(lefts[i] for i in starts)])
        pivots, found = [], []
        for number, (begin, end) in enumerate(zip(starts, [*starts[1:], len(lefts)]), len(rights)):
            found.append(held.linkable(number, np.arange(begin, end)))
            pivots.append(np.full(len(found[-1]), number))
        if found:
            at = np.concatenate(found)
            flags[at] = held.matches(np.concatenate(pivots), at)
        return flags

    return similar


def as_bytes(payloads: pa.Array) -> list[bytes]:
    return payloads.to_pylist()


def _blocks(matcher: Callable[[list], Matcher], of_blocks: Callable, block_bytes: int) -> Callable:
    """``of_blocks`` over rows (pivot, i, j, block, node, component, payload) of each two blocks i and j.

    ``size`` and ``reach`` may follow.

    Most pivots have a few members, and a matcher works best on many. So groups are held together
    until they have a quarter of a block's bytes, each node once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(groups: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = [row for _, of_group in groups for row in of_group]
            block, node, component, _, *more = zip(*rows)
            block, node, component, *more = (np.array(c, dtype=np.int64) for c in (block, node, component, *more))
            node, first, place = np.unique(node, return_index=True, return_inverse=True)
            held = matcher([rows[at][3] for at in first.tolist()])
            size, reach = more or (np.zeros(len(rows), dtype=np.int64),) * 2
            parts, end = [], 0
            for (pivot, i, j), of_group in groups:
                begin, end = end, end + len(of_group)
                at, of, far = place[begin:end], block[begin:end], reach[begin:end]
                parts.append((pivot, i == j, (at[of == i], far[of == i]), (at[of == j], far[of == j])))
            yield from of_blocks(parts, node, component[first], size[first], held)

        groups, size = [], 0
        for batch in batches:
            for pivot, i, j, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if not groups or groups[-1][0] != (pivot, i, j):
                    if 4 * size >= block_bytes:
                        yield from compared(groups)
                        groups, size = [], 0
                    groups.append(((pivot, i, j), []))
                groups[-1][1].append(row)
                size += len(row[3])
        if groups:
            yield from compared(groups)

    return run


def _met(groups: list[tuple], label: np.ndarray, size: np.ndarray) -> Iterator[Iterator[tuple]]:
    """For each group its members, each with those of other labels that it is compared with.

    Members are not compared if one's size is over the other's reach. The labels may change meanwhile.
    """

    def pairs(within: bool, left: np.ndarray, left_reach: np.ndarray, right: np.ndarray, right_reach: np.ndarray):
        sizes = size[right]
        for x, reach in zip(left.tolist(), left_reach.tolist()):
            others = right[(label[right] != label[x]) & (sizes <= reach) & (right_reach >= size[x])]
            yield x, others[others > x] if within else others

    for _, within, left, right in groups:
        yield pairs(within, *left, *right)


def _joining(groups: list[tuple], node, component, size, held: Matcher) -> Iterator[pa.RecordBatch]:
    """Pairs that match and join components which no earlier pair of these blocks has joined."""
    label = np.unique(component, return_inverse=True)[1]
    a, b, waiting = [], [], 0

    def tested() -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        # Two nodes may meet in several groups.
        pairs = np.unique(np.minimum(x, y) * len(node) + np.maximum(x, y))
        x, y = pairs // len(node), pairs % len(node)
        flags, found = held.matches(x, y) if len(x) else np.zeros(0, dtype=bool), []
        for one, other in zip(x[flags].tolist(), y[flags].tolist()):
            if label[one] != label[other]:
                label[label == label[other]] = label[one]
                found.append((min(node[one], node[other]), max(node[one], node[other])))
        return _batch(PAIR, *np.array(found, dtype=np.int64).reshape(-1, 2).T)

    for met in _met(groups, label, size):
        for x, others in met:
            found = held.linkable(x, others) if len(others) else others
            if len(found):
                a.append(np.full(len(found), x))
                b.append(found)
                waiting += len(found)
            if waiting > TESTED:
                yield tested()
                a, b, waiting = [], [], 0
    if waiting:
        yield tested()


def _plausible(groups: list[tuple], node, component, size, held: Matcher) -> Iterator[pa.RecordBatch]:
    """Members that may match one of another component, each once for its pivot in these blocks."""
    marked, reach = np.zeros(len(node), dtype=bool), np.zeros(len(node), dtype=np.int64)
    pivots, members, reaches = [], [], []
    for (pivot, _, *sides), met in zip(groups, _met(groups, component, size)):
        for at, far in sides:
            reach[at] = far
        for x, others in met:
            # Members that are both marked will be compared anyway.
            others = others[~marked[others]] if marked[x] else others
            found = held.linkable(x, others) if len(others) else others
            if len(found):
                marked[x] = marked[found] = True
        at = np.flatnonzero(marked)
        marked[at] = False
        pivots.append(np.full(len(at), pivot))
        members.append(at)
        reaches.append(reach[at])
    at = np.concatenate(members)
    yield _batch(MEMBER, np.concatenate(pivots), node[at], component[at], size[at], np.concatenate(reaches))


def _dealt(members: DataFrame, payloads: DataFrame, block_bytes: int, weight: int) -> DataFrame:
    """Members of pivots that have several components, in blocks by the bytes of their payloads, every two together.

    ``weight`` rows of a small table stand for one payload.
    """
    more = ["size", "reach"] if "reach" in members.columns else []
    ends = members.groupBy("pivot").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    total = members.count()
    unclear = saved(ends.where("least != most").select("pivot"), "unclear", total)
    rows = members.join(unclear, "pivot").join(payloads.select("node", F.col("text").alias("payload")), "node")
    rows = saved(rows, "members", weight * total)
    blocks = F.ceil(F.sum(F.octet_length("payload")) / block_bytes).cast("int")
    sizes = saved(rows.groupBy("pivot").agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "member-blocks", total)
    dealt = rows.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    dealt = dealt.select("pivot", i, j, "block", "node", "component", "payload", *more)
    return dealt.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "node")


def across(
    members: DataFrame,
    payloads: DataFrame,
    matcher: Callable[[list], Matcher],
    block_bytes: int = BLOCK_BYTES,
    weight: int = 10,
) -> DataFrame:
    """Pairs that match and join all members of one ``pivot`` in different components that matches join.

    ``members`` has ``pivot``, ``node`` and ``component``, and may have ``size`` and ``reach``, which
    is the largest size that a member matches; ``payloads`` has ``node`` and ``text``. The members of a
    pivot are cut into blocks by the bytes of their payloads; every two blocks meet in a task.
    Two blocks give fewer pairs than they have members, however many match.
    """
    dealt = _dealt(members, payloads, block_bytes, weight)
    return dealt.mapInArrow(_blocks(matcher, _joining, block_bytes), PAIR).distinct()


def across_whole(
    members: DataFrame,
    payloads: DataFrame,
    matcher: Callable[[list], Matcher],
    texts_of: Callable[[DataFrame], DataFrame],
    whole: Callable[[list[str]], Matcher],
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame | None:
    """The same where ``matcher`` only rules out, written; None if it rules out all.

    Members that it does not rule out come out once for two blocks, without pairs, and ``whole``
    compares their texts, in blocks again.
    """
    dealt = _dealt(members, payloads, block_bytes, 10)
    # A member comes out of each two blocks of its pivot.
    left = saved(dealt.mapInArrow(_blocks(matcher, _plausible, block_bytes), MEMBER).distinct(), "plausible")
    total = left.count()
    if not total:
        return None
    nodes = saved(left.select("node").distinct(), "nodes", total)
    return saved(across(left, texts_of(nodes), whole, block_bytes, 100), "edges", PAIR_WORK * total)


def buckets_for(spark: SparkSession, signatures: int) -> int:
    """So many buckets that one holds about a million signatures, and each task has one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-signatures // BUCKET_SIGNATURES))


def few(frame: DataFrame) -> DataFrame:
    """Hint to broadcast a written table if it has few rows; a larger one is shuffled."""
    return F.broadcast(frame) if frame.count() <= FEW_ROWS else frame


def reach(size: Column, steps: Column) -> Column:
    """How large a node can be that is similar by a signature so many steps back: (4 - 7 steps / STEPS) / 3 of the size."""
    return F.floor(size * (4 * STEPS - 7 * steps) / (3 * STEPS))


def ends_of(pairs: DataFrame) -> DataFrame:
    """The nodes of a written table of pairs, written."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return saved(ends.distinct(), "nodes", 2 * pairs.count())


def central(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of a pivot ``a`` and another node ``b`` of one of its signatures, with their sizes, written.

    Also each signature's pivot, as ``key``, ``a`` and ``a_size``, written. ``shared`` is a written table of ``key``, ``node`` and ``size``, one row for each node of a key,
    and may have ``reach``; of a pair ``b`` has the farthest.
    """
    reach = ["reach"] if "reach" in shared.columns else []
    total = shared.count()
    sizes = saved(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes", total)
    company = saved(shared.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("company")), "company", total)
    ranked = saved(shared.join(company, "node").select("key", "node", "size", "company", *reach), "ranked", total)
    pivots = ranked.groupBy("key").agg(F.max(F.struct("company", "node", "size")).alias("pivot"))
    pivots = pivots.select("key", F.col("pivot.node").alias("a"), F.col("pivot.size").alias("a_size"))
    pivots = saved(pivots, "pivots", total)
    pairs = ranked.join(pivots, "key")
    pairs = pairs.select("a", "a_size", F.col("node").alias("b"), F.col("size").alias("b_size"), *reach).where("a != b")
    once = pairs.groupBy("a", "a_size", "b", "b_size").agg(F.max("reach").alias("reach")) if reach else pairs.distinct()
    return saved(once, "pairs", total), pivots


def linked(
    signatures: DataFrame,
    fits: Callable[[Column, Column], Column],
    payloads_of: Callable[[DataFrame], DataFrame],
    matcher: Callable[[list[bytes]], Matcher],
    confirm: Callable[[DataFrame], DataFrame] | None = None,
    texts_of: Callable[[DataFrame], DataFrame] | None = None,
    whole: Callable[[list[str]], Matcher] | None = None,
    block_bytes: int = BLOCK_BYTES,
    by_key: bool = False,
    reaching: bool = False,
) -> DataFrame:
    """``node`` and ``component`` of every node that is similar to another.

    ``signatures`` has the rows of ``packed_signatures``. ``fits`` says of two sizes whether nodes of
    them could be similar. ``payloads_of`` gives ``node`` and ``text`` (some bytes) for a written
    table of distinct nodes, and ``matcher`` compares these. What is left after the first step is
    compared by pivot, which has each node once for all the signatures of a pivot, or ``by_key``, which
    has only nodes that share a signature and suits short signatures that much has in common. With ``confirm`` the matcher only rules
    out: it takes written pairs and gives those that are similar, written as well. Then ``texts_of`` gives
    ``node`` and ``text`` (the text) for a written table of distinct nodes, and ``whole`` compares these.
    ``reaching`` says that signatures have steps.
    """
    stars = signatures.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_stars, STAR)
    stars = saved(stars, "stars")
    shared = stars.select("key", F.col("a").alias("node"), F.col("a_size").alias("size")).unionByName(
        stars.select("key", F.col("b").alias("node"), F.col("b_size").alias("size"))
    )
    if reaching:
        size = F.col("size").bitwiseAND((1 << STEP_BITS) - 1)
        shared = shared.select("key", "node", size.alias("size"), reach(size, F.shiftright("size", STEP_BITS)).alias("reach"))
    shared = saved(shared.distinct(), "shared", 2 * stars.count())
    pairs, pivots = central(shared)
    payloads = payloads_of(ends_of(pairs))

    close = saved(pairs.where(fits(F.col("a_size"), F.col("b_size"))).select("a", "b"), "close", pairs.count())
    edges = verified(close, payloads, as_bytes, matched(matcher))
    if confirm is not None:
        edges = confirm(edges)
    labels = components(edges)

    # They have been compared with their pivot.
    if by_key:
        members = shared.join(pivots, "key").where("node != a").select(F.col("key").alias("pivot"), "node")
    else:
        more = [F.col("b_size").alias("size"), "reach"] if reaching else []
        members = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("node"), *more)
    members = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if whole is None:
        found = saved(across(members, payloads, matcher, block_bytes), "edges", PAIR_WORK * pairs.count())
    else:
        found = across_whole(members, payloads, matcher, texts_of, whole, block_bytes)
    return labels if found is None or found.isEmpty() else components(edges.unionByName(found))
