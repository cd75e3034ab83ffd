"""Alignment of two tokenizers' ids over the bytes of whole texts.

A text with a space in front is read by a byte-level tokenizer (A) and by a sentence piece
model (B). Matrices in compressed rows say which token holds which byte. The row products
A x B' are the overlap links. Where tokens of both end, the bytes are cut into groups; the
product of the incidences of A ids and groups and of groups and B ids gives the links that
share a group.

The same words come again and again, so texts are first cut into units: a space and what
follows, up to the next space that both tokenizers cannot join to what stands before it.
Every distinct unit of a chunk is read once, and a document's links are the product of
its units and the units' links.

The counts of id pairs (in how many documents they are linked) are sums over chunks, a
shuffle by pair. Each chunk gets the counts of its own pairs back and multiplies them
with its matrix of documents and pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.csr import Csr, matrix, product, ranges
from tidemark.llm.storage import saved
from tidemark.llm.tokens import byte_characters
from tidemark.llm.words import chunks, distinct_pieces, utf8

#: Bytes of text that share a list of id pairs; results do not depend on it.
PART_BYTES = 4 << 20
UNITS_AT_ONCE = 1024
SPACE, PIECE_SPACE = 0x20, "▁"

CHUNK = (
    "part long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "n_overlaps array<long>, groups_sha256 array<string>, matrix binary, pairs array<long>, holders array<long>"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_best long, count_sum long, "
    "groups_sha256 string"
)

GRAPH = np.zeros(256, dtype=bool)  # ASCII signs that are not white space
GRAPH[0x21:0x7F] = True
# Bytes that begin characters of two, three and four bytes of which none is white space.
LEAD_2, LEAD_3, LEAD_4 = (np.zeros(256, dtype=bool) for _ in range(3))
LEAD_2[0xC3:0xE0] = LEAD_3[0xE4:0xF0] = LEAD_4[0xF0:0xF5] = True


def unit_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the units begin in texts that stand end to end from ``texts`` on, each with a space in front.

    A space between two characters of which neither is white space begins a unit.
    """
    at = np.flatnonzero(data == SPACE)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, behind = data[at - 1], data[at + 1]
    trail = (before & 0xC0) == 0x80
    solid = GRAPH[before] | trail & (
        LEAD_2[data[at - 2]] | LEAD_3[data[np.maximum(at - 3, 0)]] | LEAD_4[data[np.maximum(at - 4, 0)]]
    )
    solid &= GRAPH[behind] | LEAD_2[behind] | LEAD_3[behind] | LEAD_4[behind]
    return np.union1d(at[solid], texts[texts < len(data)])


class Aligner:
    def __init__(self, a_definition: bytes, b_definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_definition)
        byte_of = {character: byte for byte, character in byte_characters().items()}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [
            bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token in tokens
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(PIECE_SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.a_length, self.b_length = (
            np.array([len(b) for b in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)
        )
        found = json.loads(a_definition)
        splitter = found.get("pre_tokenizer") or {}
        # Neither joins a space to what stands before it, so units can be read one by one.
        self.cuts = (
            found.get("normalizer") is None
            and splitter.get("type") == "ByteLevel"
            and bool(splitter.get("use_regex", True))
            and not splitter.get("add_prefix_space")
            and not any(PIECE_SPACE in piece.lstrip(PIECE_SPACE) for piece in pieces)
        )

    def _read(self, text: bytes) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text that begins with a space, unless one of them changes its bytes."""
        plain = text.decode("utf-8", "replace")
        a = self.a.encode(plain, add_special_tokens=False).ids
        b = self.b.encode(plain[1:], num_threads=1)
        if b"".join([self.a_bytes[i] for i in a]) != text or b"".join([self.b_bytes[i] for i in b]) != text:
            return None
        return a, b

    def read(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both for the units that they read without a change, end to end, and which units these are."""
        a_ids, b_ids, usable = [], [], np.ones(len(units), dtype=bool)
        for begin in range(0, len(units), UNITS_AT_ONCE):
            some = units[begin : begin + UNITS_AT_ONCE]
            # A unit with more spaces in front or behind is read by itself, so that none runs into the next.
            plain = self.cuts and all(len(u) > 1 and u[1] > SPACE and u[-1] > SPACE for u in some)
            both = self._read(b"".join(some)) if plain and self._apart(some) else None
            if both is not None:
                a_ids += both[0]
                b_ids += both[1]
                continue
            for i, unit in enumerate(some, begin):
                both = self._read(unit)
                usable[i] = both is not None
                if both is not None:
                    a_ids += both[0]
                    b_ids += both[1]
        return np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64), usable

    @staticmethod
    def _apart(units: list[bytes]) -> bool:
        """Whether the units' own beginnings are cut again when they stand end to end."""
        starts = np.cumsum([0, *map(len, units[:-1])])
        found = unit_starts(np.frombuffer(b"".join(units), np.uint8), np.zeros(1, dtype=np.int64))
        return len(found) == len(starts) and bool((found == starts).all())


def _incidence(bounds: np.ndarray, width: int) -> Csr:
    """Tokens and the bytes that they hold, for tokens that stand end to end."""
    return Csr(bounds, np.arange(width), np.ones(width, dtype=np.int64), width)


def _per(owner: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, minlength=rows).astype(np.int64)


def align(a_ids, b_ids, a_length, b_length, unit_ends: np.ndarray) -> dict:
    """Tokens, groups and links of units that stand end to end, as numbers and texts for each unit."""
    width, rows = int(unit_ends[-1]) if len(unit_ends) else 0, len(unit_ends)
    a_ends, b_ends = np.cumsum(a_length[a_ids]), np.cumsum(b_length[b_ids])
    a_bytes = _incidence(np.append(0, a_ends), width)
    # The other way round every byte is in one token.
    b_token = np.repeat(np.arange(len(b_ids)), b_length[b_ids])
    b_of_byte = Csr(np.arange(width + 1), b_token, np.ones(width, dtype=np.int64), len(b_ids))
    overlaps = product(a_bytes, b_of_byte)
    # A byte after which a token of both ends, ends a group.
    group_ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(group_ends, a_ends), np.searchsorted(group_ends, b_ends)
    group_unit = np.searchsorted(unit_ends, group_ends)
    groups = len(group_ends)
    ids_a, ids_b = (int(ids.max()) + 1 if len(ids) else 1 for ids in (a_ids, b_ids))
    of_group = matrix(a_group, a_ids, np.ones(len(a_ids), np.int64), groups, ids_a)  # groups and A ids
    # One row for each group and A id, with the group as its only column.
    spread = Csr(np.arange(len(of_group.indices) + 1), of_group.rows, of_group.data, groups)
    shared = product(spread, matrix(b_group, b_ids, np.ones(len(b_ids), np.int64), groups, ids_b))
    pair = (of_group.indices[shared.rows] << 32) | shared.indices
    unit = group_unit[of_group.rows[shared.rows]]
    pairs, place = np.unique(pair, return_inverse=True)

    decimal = [str(i) for i in range(max(ids_a, ids_b))]
    text_a, text_b = ([decimal[i] for i in ids.tolist()] for ids in (a_ids, b_ids))
    a_cut, b_cut = (np.append(0, np.searchsorted(ends, group_ends, side="right")).tolist() for ends in (a_ends, b_ends))
    texts = [
        ",".join(text_a[a_cut[g] : a_cut[g + 1]]) + "|" + ",".join(text_b[b_cut[g] : b_cut[g + 1]]) for g in range(groups)
    ]
    unit_cut = np.append(0, np.searchsorted(group_ends, unit_ends, side="right")).tolist()
    return {
        "n_a": _per(group_unit[a_group], rows),
        "n_b": _per(group_unit[b_group], rows),
        "n_groups": np.diff(unit_cut),
        "n_overlaps": _per(group_unit[a_group[overlaps.rows]], rows),
        "n_links": _per(unit, rows, shared.data),
        "links": matrix(unit, place, shared.data, rows, len(pairs)),
        "pairs": pairs,
        "texts": [";".join(texts[i:j]).encode() for i, j in zip(unit_cut[:-1], unit_cut[1:])],
    }


def _pack(found: Csr) -> bytes:
    """Row lengths, then steps between the columns of a row, then the entries; zstd."""
    steps = np.diff(found.indices, prepend=0)
    first = found.indptr[:-1][np.diff(found.indptr) > 0]
    steps[first] = found.indices[first]
    lengths = np.diff(found.indptr)
    # Bytes of one weight stand together, where the high ones are mostly zero.
    planes = [a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in (lengths, steps, found.data)]
    raw = np.array([len(lengths), len(steps), found.columns], dtype=np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> Csr:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    rows, entries, columns = np.frombuffer(raw, np.int64, 3).tolist()

    def numbers(at: int, count: int) -> np.ndarray:
        planes = np.frombuffer(raw, np.uint8, 4 * count, at).reshape(4, -1).T
        return np.ascontiguousarray(planes).view(np.uint32).ravel().astype(np.int64)

    lengths, steps, data = numbers(24, rows), numbers(24 + 4 * rows, entries), numbers(24 + 4 * (rows + entries), entries)
    indptr = np.append(0, np.cumsum(lengths))
    total = np.cumsum(steps)
    base = np.append(0, total)[indptr[:-1]]
    return Csr(indptr, total - np.repeat(base, lengths), data, columns)


def aligned(ids: pa.Array, texts: pa.Array, aligner: Aligner, part: int) -> pa.RecordBatch:
    """The row of ``CHUNK`` for some documents."""
    present = pc.greater(pc.binary_length(texts.fill_null("")), 0)
    spaced = pc.if_else(present, pc.binary_join_element_wise(" ", texts.fill_null(""), ""), "")
    data, offsets = utf8(spaced)
    starts = unit_starts(data, offsets[:-1]) if aligner.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
    number, distinct = distinct_pieces(data, np.diff(np.append(starts, len(data))))
    units = distinct.to_pylist()
    a_ids, b_ids, usable = aligner.read(units)
    sizes = np.array([len(u) for u, good in zip(units, usable.tolist()) if good], dtype=np.int64)
    found = align(a_ids, b_ids, aligner.a_length, aligner.b_length, np.cumsum(sizes))

    # A text of which one unit is changed has no tokens.
    owner = np.searchsorted(offsets, starts, side="right") - 1
    broken = np.zeros(len(texts), dtype=bool)
    broken[owner[~usable[number]]] = True
    stays = ~broken[owner]
    owner, number = owner[stays], (np.cumsum(usable) - 1)[number[stays]]
    rows = len(texts)
    held = matrix(owner, number, np.ones(len(owner), np.int64), rows, max(len(sizes), 1))
    linked = product(held, found["links"])
    columns = [pa.array([part])]
    columns.append(pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), ids.cast(pa.int64())))
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps"):
        columns.append(pa.array([_per(owner, rows, found[name][number])]))
    edges = np.searchsorted(owner, np.arange(rows + 1)).tolist()
    number, known = number.tolist(), found["texts"]
    named = [
        hashlib.sha256(b";".join([known[u] for u in number[i:j]])).hexdigest() if j > i else ""
        for i, j in zip(edges[:-1], edges[1:])
    ]
    columns.append(pa.array([named], pa.list_(pa.string())))
    columns.append(pa.array([_pack(linked)], pa.binary()))
    # Pairs of which every text is without tokens have no holders.
    holders = _per(linked.indices, len(found["pairs"]))
    columns += [pa.array([found["pairs"]]), pa.array([holders])]
    return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in CHUNK.split(", ")])


def _read_texts(a_definition, b_definition, part_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = None, 0
        for batch in batches:
            for begin, end in chunks(batch.column(1), part_bytes):
                aligner = aligner or Aligner(a_definition.value, b_definition.value)
                some = batch.slice(begin, end - begin)
                part = TaskContext.get().partitionId() << 32 | number
                yield aligned(some.column(0), some.column(1), aligner, part)
                number += 1

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in RESULT.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            found = _unpack(row["matrix"].as_py())
            count, best = (np.zeros(found.columns, dtype=np.int64) for _ in range(2))
            if row["slot"].values is not None:
                slot = row["slot"].values.to_numpy()
                count[slot] = row["count"].values.to_numpy()
                best[slot] = row["best"].values.to_numpy()
            sums = {
                name: pa.array(np.diff(np.append(0, np.cumsum(found.data * of[found.indices]))[found.indptr]))
                for name, of in (("n_best", best), ("count_sum", count))
            }
            yield pa.RecordBatch.from_arrays([sums[n] if n in sums else row[n].values for n in names], names=names)


def read_model(path: str) -> bytes:
    """A tokenizer's file; a few megabytes whatever the corpus."""
    with open(path, "rb") as file:
        return file.read()


def align_documents(docs: DataFrame, a_path: str, b_path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of ``docs``: tokens, groups, links and how usual the links are.

    ``n_overlaps`` counts pairs of tokens that share a byte, ``n_links`` those that share a
    group. An id pair's count is the number of documents that hold it linked; ``n_best`` are a
    document's links whose count is the highest of their A id in the corpus (ties included),
    ``count_sum`` is the sum of the counts of its links. ``groups_sha256`` names the groups.

    Null and empty texts have no tokens: zeros and an empty name; so do texts that a
    tokenizer changes. Rows that repeat are counted one by one, also those with a null id.
    Texts are read whole, a very long one in a part of its own. An empty table gives an empty
    one. Other columns are left alone, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    definitions = [context.broadcast(read_model(path)) for path in (a_path, b_path)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = saved(texts.mapInArrow(_read_texts(*definitions, part_bytes), CHUNK), "parts")

    # A part's pairs and in how many of its documents they are; most come in many parts.
    of_parts = parts.select("part", F.posexplode(F.arrays_zip("pairs", "holders")).alias("slot", "held"))
    of_parts = of_parts.select("part", "slot", F.col("held.pairs").alias("pair"), F.col("held.holders").alias("n"))
    of_parts = of_parts.where("n > 0")
    counts = saved(of_parts.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    a_id = F.shiftrightunsigned("pair", 32).alias("a_id")
    # At most as many rows as the first tokenizer has ids.
    highest = counts.groupBy(a_id).agg(F.max("count").alias("highest"))
    judged = counts.select("pair", "count", a_id).join(F.broadcast(highest), "a_id")
    judged = judged.select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    known = of_parts.join(judged, "pair").groupBy("part").agg(
        F.collect_list(F.struct("slot", "count", "best")).alias("known")
    )
    known = known.select("part", *[F.col(f"known.{name}").alias(name) for name in ("slot", "count", "best")])
    whole = parts.drop("pairs", "holders").join(known, "part", "left")
    return whole.mapInArrow(_scored, RESULT)
