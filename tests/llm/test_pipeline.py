"""The pipeline and its stages, against a plain version."""

import hashlib
import math
from collections import Counter, defaultdict

import brute
import pytest
from conftest import frame_of
from test_operators import ids_of

import corpus_pipeline


def mixed(rows):
    """How often each row is taken."""
    size = Counter()
    for row in rows:
        size[row["source"]] += len(brute.words(row["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stopped, share = sum(size.values()), set(), 0
    while len(stopped) < len(order):
        share = (total - sum(3 * size[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if share * weight[s] > 3 * size[s]}
        if more == stopped:
            break
        stopped = more
    copies = {}
    for source in order:
        target = min(share * weight[source], 3 * size[source])
        epochs = int(target // size[source]) if size[source] else 0
        left, before, drawn = target - epochs * size[source], 0, []
        for i, row in enumerate(rows):
            if row["source"] == source:
                n, text = len(brute.words(row["text"])), row["text"] or ""
                name = "null" if row["doc_id"] is None else str(row["doc_id"])
                code = int(hashlib.md5(f"42:{name}".encode()).hexdigest()[:13], 16)
                quality = n / (n + sum(c in "#*$%&|<>" for c in text)) if n else 1.0
                drawn.append((-math.log((code + 0.5) / 2.0**52) / quality, row["doc_id"] or -(2**63), n, i))
        for _, _, n, i in sorted(drawn):
            copies[i] = epochs + (2 * before + n <= 2 * left)
            before += n
    return copies


def plain_run(rows):
    rows = [row for row, verdict in zip(rows, brute.judged(rows, "source")) if verdict[-1]]
    largest = {}
    for row in rows:
        best = largest.get(row["text"])
        if best is None or (row["doc_id"] is not None and (best["doc_id"] is None or row["doc_id"] > best["doc_id"])):
            largest[row["text"]] = row
    rows = list(largest.values())
    components = defaultdict(list)
    sets = [brute.shingles(row["text"]) for row in rows]
    union = brute.Union()
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                union.join(i, j)
    for i, row in enumerate(rows):
        components[union.find(i)].append(row)
    rows = [min(group, key=brute.key) for group in components.values()]
    pieces = []
    for i, copies in mixed(rows).items():
        ids = ids_of(rows[i]["text"], 1)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            pieces += [(rows[i]["doc_id"], piece, start, len(part), brute.crc(part))] * copies
    return pieces


def check(found, rows, same):
    same(found, ["doc_id", "piece", "start", "length", "ids_crc32"], plain_run(rows))
    sequences = defaultdict(list)
    for row in found.collect():
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


def test_run(spark, data, same):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    rows = [row.asDict() for row in docs.collect()]
    check(corpus_pipeline.run(spark, data), rows, same)


def test_stages_on_odd_rows(spark, odd, same):
    docs, rows = odd
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.saved(stage(spark, docs, ""), "stage")
        if name != "best-fit packing":
            assert docs.columns == columns
    check(docs, rows, same)


@pytest.mark.parametrize("number", range(5))
def test_each_stage_alone(spark, odd, nothing, number):
    """A stage judges whatever rows it is given."""
    docs, rows = odd
    name, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, nothing, "").count() == 0
    found = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, "").collect()) if number < 4 else None
    if name == "exact dedup":
        assert all(n == 1 for n in found.values()) and len(found) == len({r["text"] or "" for r in rows})
    if name == "n-gram jaccard join":
        kept = Counter(c for _, _, c in brute.near([{"doc_id": i, "text": t} for i, t in found if brute.words(t)]))
        assert all(n == 1 for n in kept.values())
    if name == "source mixing":
        expected = Counter()
        for i, copies in mixed(rows).items():
            if copies:
                expected[rows[i]["doc_id"], rows[i]["text"]] += copies
        assert found == expected


def test_extra_copies_of_a_row(spark, same):
    text = " ".join(f"w{i}" for i in range(50))
    docs = frame_of(spark, [(1, text, "a")] * 5 + [(2, text, "b")] * 5)
    kept = corpus_pipeline.exact_dedup(spark, docs, "")
    same(kept, ["doc_id"], [(2,)])
