"""The operators on odd and on empty tables, against plain versions."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import frame_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import (
    chat,
    components,
    exact,
    jaccard,
    lines,
    links,
    mixing,
    packing,
    quality_model,
    rules,
    simple8b,
    sketches,
    substring,
    token_files,
    tokens,
)
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.storage import doc_id, keyed, whole_text
from tidemark.session import workspace


def test_substring(odd, same):
    docs, rows = odd
    found = substring.remove_repeats(docs)
    same(found, ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substring(rows))
    assert found.where(F.sha2("kept_text", 256) != F.col("kept_sha256")).isEmpty()


def test_substring_in_other_window_lengths(odd, same):
    docs, rows = odd
    found = substring.remove_repeats(docs, window=7, base=3)
    same(found, ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substring(rows, 7))


def test_substring_deals_out_the_windows_of_hot_anchors(spark, odd, same):
    """A phrase between words of each document's own: its anchors are shared, the windows are not."""
    phrase = " ".join(f"p{i}" for i in range(12))
    own = [" ".join(f"o{n}-{i}" for i in range(20)) for n in range(60)]
    rows = [(n, f"{text} {phrase} {text[::-1]}", None) for n, text in enumerate(own)]
    texts = keyed(frame_of(spark, rows), whole_text())
    whole = substring.candidates(texts).groupBy("anchor").agg(F.sum("covered").alias("n"))
    assert whole.agg(F.max("n")).first()[0] > 100
    dealt = substring.candidates(texts, limit=40).where("anchor IS NOT NULL").groupBy("anchor")
    assert dealt.agg(F.sum("covered").alias("n")).agg(F.max("n")).first()[0] <= 40
    docs, odd_rows = odd
    for limit in (1, 40):
        found = substring.remove_repeats(docs, limit=limit)
        same(found, ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substring(odd_rows))


def test_substring_of_repeated_rows(spark, same):
    """The list of a document is as long as its own runs, however many rows repeat it."""
    passage, tail = (" ".join(f"{k}{i}" for i in range(30)) for k in "pt")
    rows = [(1, f"a {passage} b", None), *((None, f"{passage} {tail}", None) for _ in range(50)), (2, tail, None)]
    docs = frame_of(spark, rows)
    assert substring.covers(keyed(docs, whole_text())).agg(F.max(F.size("covers"))).first()[0] <= 30
    expected = brute.substring([dict(zip(("doc_id", "text", "source"), row)) for row in rows])
    same(substring.remove_repeats(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], expected)


@pytest.mark.parametrize("block_bytes", [1, 8, 64, 4096])
def test_exact(odd, same, block_bytes):
    docs, rows = odd
    if block_bytes == 1:  # many levels; the long texts would have too many rows
        docs, rows = docs.where("length(text) < 700"), [r for r in rows if r["text"] is not None and len(r["text"]) < 700]
    check_exact(docs, rows, same, block_bytes, F.xxhash64)


def test_exact_with_colliding_fingerprints(odd, same):
    docs, rows = odd
    check_exact(docs, rows, same, 64, lambda block: F.length(block).cast("long") % 7)


def check_exact(docs, rows, same, block_bytes, fingerprint):
    groups = defaultdict(list)
    for row in rows:
        groups[row["text"] or ""].append(row["doc_id"])
    largest = {text: max((i for i in ids if i is not None), default=None) for text, ids in groups.items()}
    expected, seen = [], set()
    for row in rows:
        text = row["text"] or ""
        keep = largest[text]
        kept = row["doc_id"] == keep and text not in seen
        if kept:
            seen.add(text)
        expected.append((row["doc_id"], keep, len(groups[text]), kept, brute.sha(text)))
    found = exact.exact_duplicates(docs, block_bytes, fingerprint)
    same(found, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], expected)


def test_mixing_totals(odd):
    docs, rows = odd
    found = mixing.mix(docs).collect()
    size = Counter()
    for row in rows:
        size[row["source"]] += len(brute.words(row["text"]))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stopped = sum(size.values()), set()
    while True:
        share = (total - sum(3 * size[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if share * weight[s] > 3 * size[s]}
        if more == stopped:
            break
        stopped = more
    taken, largest = Counter(), defaultdict(int)
    for row in found:
        target = 3 * size[row["source"]] if row["source"] in stopped else share * weight[row["source"]]
        assert row["target"] == pytest.approx(target) and row["source_size"] == size[row["source"]]
        assert row["taken"] <= 3 * row["size"] and row["taken"] % max(row["size"], 1) == 0
        taken[row["source"]] += row["taken"]
        largest[row["source"]] = max(largest[row["source"]], row["size"])
    for row in found:
        assert abs(taken[row["source"]] - row["target"]) <= largest[row["source"]] / 2 + 1e-6
    assert len(found) == len(rows)
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_mixing_prefers_quality(spark):
    docs = frame_of(spark, [(i, "w " * 10, "s") for i in range(2000)] + [(5000 + i, "w " * 10, "t") for i in range(4000)])
    found = mixing.mix(docs, weights=(1, 5), quality=F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(1.0))
    good, bad = (found.where(f"source = 's' AND doc_id % 2 = {r} AND taken > 0").count() for r in (0, 1))
    assert good > 2 * bad


def test_rules(odd, same):
    docs, rows = odd
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = brute.judged(rows, "source")
    same(rules.judge(docs, "source"), columns, expected)
    kept = rules.accepted(docs, "source")
    assert kept.columns == docs.columns
    same(kept, ["doc_id", "text"], [(r["doc_id"], r["text"]) for r, e in zip(rows, expected) if e[-1]])


def test_rules_reject_a_bad_host(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "short", f"good{i % 8}") for i in range(400)]
    rows += [(1000 + i, good if i % 10 == 0 else "short", "bad") for i in range(60)] + [(2000, "short", "tiny")]
    found = {row["doc_id"]: row["kept"] for row in rules.judge(frame_of(spark, rows), "source").collect()}
    expected = {e[0]: e[-1] for e in brute.judged([dict(zip(("doc_id", "text", "source"), r)) for r in rows], "source")}
    assert found == expected
    assert not found[1000] and found[1]


def test_near(odd, same):
    docs, rows = odd
    found = jaccard.near_duplicates(docs)
    same(found.select(doc_id(), "n_shingles", "component_id"), ["doc_id", "n_shingles", "component_id"], brute.near(rows))


@pytest.mark.parametrize("share", [1, 5, 40])
def test_near_with_many_frequent_shingles(odd, same, share):
    """The smaller the share, the fewer shingles count as frequent."""
    docs, rows = odd
    found = jaccard.near_duplicates(docs, frequent_share=share)
    same(found.select(doc_id(), "n_shingles", "component_id"), ["doc_id", "n_shingles", "component_id"], brute.near(rows))


def test_signatures_meet():
    """Sets that link share a signature, whichever shingles count as frequent."""
    rng = random.Random(3)
    for _ in range(4000):
        size = rng.randint(3, 40)
        x = set(rng.sample(range(60), size))
        y = set(rng.sample(sorted(x), rng.randint(max(1, int(size * 0.7)), size)))
        y |= set(rng.sample(range(60), rng.randint(0, 4)))
        if x == y or 100 * len(x & y) < 75 * len(x | y):
            continue
        frequent = set(rng.sample(range(60), rng.choice((0, 10, 40, 55, 60))))
        found = []
        for tokens in (x, y):
            hashed = np.array(sorted((t * 0x9E3779B97F4A7C15 % 2**64, t) for t in tokens), dtype=object)
            values = np.array([h for h, _ in hashed], dtype=np.uint64)
            found.append(set(jaccard.signature(values, np.array([t in frequent for _, t in hashed])).tolist()))
        assert found[0] & found[1]


def test_links_are_in_reach():
    """Of the entries that two sets that link share, one lets each set reach the other's size, in any order."""
    rng = random.Random(8)
    linked = 0
    for _ in range(4000):
        x = set(rng.sample(range(90), rng.randint(3, 60)))
        y = set(rng.sample(sorted(x), rng.randint(max(1, int(len(x) * 0.75)), len(x))))
        y |= set(rng.sample(range(90), rng.randint(0, 8)))
        if x == y or 100 * len(x & y) < 75 * len(x | y):
            continue
        linked += 1
        frequent = set(rng.sample(range(90), rng.choice((0, 15, 60, 80, 90))))
        order, reaches = rng.sample(range(90), 90), []
        for tokens in (x, y):
            values = np.array([t for t in order if t in tokens], dtype=np.uint64)
            is_frequent = np.array([t in frequent for t in values.tolist()])
            entries = jaccard.signature(values, is_frequent)
            steps = jaccard.steps_of(len(tokens), int((~is_frequent).sum()), len(entries))
            assert steps.max() < 32
            reach = len(tokens) * (4 * links.STEPS - 7 * steps) // (3 * links.STEPS)
            reaches.append(dict(zip(entries.tolist(), reach.tolist())))
        shared = reaches[0].keys() & reaches[1].keys()
        assert any(reaches[0][e] >= len(y) and reaches[1][e] >= len(x) for e in shared)
    assert linked > 500


def test_a_shared_passage_brings_no_sets_together(spark, same, monkeypatch):
    """Texts of their own words with one passage in all: what the passage gives stands last, so nothing is compared."""
    passage = " ".join(f"p{i}" for i in range(16))
    own = [" ".join(f"o{n}-{i}" for i in range(60)) for n in range(80)]
    rows = [(n, f"{text} {passage}", None) for n, text in enumerate(own)]
    rows.append((100, rows[7][1] + " more", None))
    shared, linked = [], jaccard.linked

    def noted(signatures, *more, **others):
        stars = signatures.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(links._stars, links.STAR)
        shared.extend(row["a"] for row in stars.select("a").unionByName(stars.select(F.col("b").alias("a"))).distinct().collect())
        return linked(signatures, *more, **others)

    monkeypatch.setattr(jaccard, "linked", noted)
    found = jaccard.near_duplicates(frame_of(spark, rows), frequent_share=1)
    same(found.select(doc_id(), "component_id"), ["doc_id", "component_id"], [(r[0], 7 if r[0] == 100 else r[0]) for r in rows])
    assert len(shared) == 2


def test_members_out_of_reach_are_not_compared(spark, tmp_path):
    """Of a family those that stand far from its origin are not compared with each other, nor with larger ones."""
    payload = ("x" * 60).encode()
    # A component of 50, which reach the sizes of all; 150 others of their size, which reach smaller ones only; one small.
    rows = [(1, node, node if node >= 50 else 0, 100, 130 if node < 50 else 90, payload) for node in range(200)]
    rows.append((1, 200, 200, 80, 106, payload))
    held = spark.createDataFrame(rows, "pivot long, node long, component long, size long, reach long, text binary")
    log = str(tmp_path / "pairs")

    class Counting:
        def __init__(self, payloads):
            self.payloads = payloads

        def linkable(self, i, others):
            with open(log, "a") as file:
                file.write(f"{len(others)}\n")
            return others[:0]

    assert links.across(held.drop("text"), held.select("node", "text"), Counting).collect() == []
    with open(log) as file:
        # The small one with all others.
        assert sum(int(n) for n in file) == 200


@pytest.mark.parametrize("block_bytes", [300, links.BLOCK_BYTES])
def test_links_between_pivots(spark, same, block_bytes):
    """A chain whose ends are not similar, and a shared passage that many unlike texts have."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):  # each differs from the next by one word, from the last by many
        text = [f"v{j}" if j < 6 * i else w for j, w in enumerate(base)]
        rows.append((i, " ".join(text), None))
    for i in range(60):
        rows.append((100 + i, " ".join(base[:40] + [f"u{i}-{j}" for j in range(12)]), None))
    found = jaccard.near_duplicates(frame_of(spark, rows), frequent_share=4, block_bytes=block_bytes)
    expected = brute.near([dict(zip(("doc_id", "text", "source"), r)) for r in rows])
    same(found.select(doc_id(), "component_id"), ["doc_id", "component_id"], [(e[0], e[2]) for e in expected])


@pytest.mark.parametrize("block_bytes", [200, links.BLOCK_BYTES])
def test_members_that_match_come_out_in_proportion(spark, block_bytes):
    """A group whose members all match gives fewer pairs than its blocks have members, not all pairs."""
    rows = [(1, node, node, ("x" * 40 + f"{node:02}").encode()) for node in range(60)]
    held = spark.createDataFrame(rows, "pivot long, node long, component long, text binary")
    members, payloads = held.drop("text"), held.select("node", "text")
    found = links.across(members, payloads, lambda lines_: lines.Lines(lines_, 2, 8), block_bytes).collect()
    blocks = -(-42 * 60 // block_bytes)
    assert 59 <= len(found) <= 59 * max(1, blocks)
    union = brute.Union()
    for a, b in found:
        union.join(a, b)
    assert len({union.find(node) for node in range(60)}) == 1


def test_small_groups_are_compared_together(spark, tmp_path):
    """Many pivots of three members take few matchers, and a pair that meets twice comes out once."""
    rng = random.Random(4)
    rows, expected = [], set()
    for group in range(400):
        line = "".join(rng.choice("abcdefgh ") for _ in range(60))
        # The second and third are one edit apart, the first is not near them; every third group meets again.
        for i, text in enumerate((line[::-1], line, line[:30] + "x" + line[31:])):
            for pivot in (group, 1000 + group) if group % 3 == 0 else (group,):
                rows.append((pivot, 3 * group + i, 3 * group + i, text.encode()))
        expected.add((3 * group + 1, 3 * group + 2))
    held = spark.createDataFrame(rows, "pivot long, node long, component long, text binary")
    members, payloads = held.drop("text"), held.select("node", "text").distinct()
    log = str(tmp_path / "held")

    def matcher(payloads):
        with open(log, "a") as file:
            file.write(f"{len(payloads)}\n")
        return lines.Lines(payloads, 2, 8)

    found = links.across(members, payloads, matcher).collect()
    assert sorted(tuple(row) for row in found) == sorted(expected)
    with open(log) as file:
        sizes = [int(size) for size in file]
    # At most one for each task.
    assert len(sizes) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) >= 1200


def test_a_key_of_two_lines_is_compared_once(spark, same, monkeypatch):
    """Lines that share a segment have been compared with its pivot, which does not come in again."""
    rng = random.Random(6)
    texts, across, left = [], links.across, []
    for _ in range(40):
        line = "".join(rng.choice("abcdefgh ") for _ in range(60))
        texts += [line, line[:20] + line[:19:-1]]  # the first of three segments is the same

    def noted(members, *more):
        left.extend(row["count"] for row in members.groupBy("pivot").count().collect())
        return across(members, *more)

    monkeypatch.setattr(links, "across", noted)
    rows = [(i, text, None) for i, text in enumerate(texts)]
    expected = brute.line_dedup([dict(zip(("doc_id", "text", "source"), r)) for r in rows])
    found = lines.remove_lines(frame_of(spark, rows))
    same(found, ["doc_id", "n_lines", "n_removed", "kept_sha256"], expected)
    assert left and set(left) == {1}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(50)]
    union = brute.Union()
    for a, b in edges:
        union.join(a, b)
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    expected = {(x, union.find(x)) for edge in edges if edge[0] != edge[1] for x in edge}
    assert {tuple(row) for row in found.collect()} == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(odd, same):
    docs, rows = odd
    found = lines.remove_lines(docs)
    same(found, ["doc_id", "n_lines", "n_removed", "kept_sha256"], brute.line_dedup(rows))


@pytest.mark.parametrize("edits, per_edit", [(1, 8), (3, 10), (2, 2)])
def test_line_dedup_with_other_edits(spark, same, edits, per_edit):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé ") for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(60):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, edits + 1)):
            at = rng.randrange(len(line))
            line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        rows.append((i, "".join(line) + "\nown line of text number %d" % i, None))
    found = lines.remove_lines(frame_of(spark, rows), edits=edits, per_edit=per_edit)
    expected = brute.line_dedup([dict(zip(("doc_id", "text", "source"), r)) for r in rows], edits, per_edit)
    same(found, ["doc_id", "n_lines", "n_removed", "kept_sha256"], expected)


def test_lines_of_every_length_and_script(spark, same):
    """Lines of 1 to 40 code points, each with copies one and two edits away, also by characters of many bytes."""
    rng = random.Random(8)
    rows = []
    for n in range(1, 41):
        for letters in ("abcdef", "日本語の文章を書", "éàüß😀😁ñ"):
            line = [rng.choice(letters) for _ in range(n)]
            copies = [line]
            for edits in (1, 2, 3):
                copy = list(line)
                for _ in range(edits):
                    at = rng.randrange(len(copy) + 1)
                    copy[at : at + rng.randint(0, 1)] = [rng.choice("xyz語é")] * rng.randint(0, 1)
                copies.append(copy)
            rows += [(len(rows) + i, "".join(copy), None) for i, copy in enumerate(copies)]
    rows += [(9000, "short heading one", None), (9001, "short heading onx", None), (9002, "1.", None), (9003, "2.", None)]
    found = lines.remove_lines(frame_of(spark, rows))
    expected = brute.line_dedup([dict(zip(("doc_id", "text", "source"), r)) for r in rows])
    removed = {i for i, _, gone, _ in expected if gone}
    assert 9001 in removed and 9003 not in removed and len(removed) > 60
    same(found, ["doc_id", "n_lines", "n_removed", "kept_sha256"], expected)


def test_edit_distance_and_segments():
    rng = random.Random(2)
    for _ in range(1500):
        edits, letters = rng.choice((1, 2, 3)), rng.choice(("ab", "abcdef"))
        a = [ord(rng.choice(letters)) for _ in range(rng.randint(edits + 1, 25))]
        others = []
        for _ in range(4):
            b = list(a)
            for _ in range(rng.randint(0, edits + 2)):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 1)] = [ord(rng.choice(letters))] * rng.randint(0, 1)
            others.append(b if len(b) > edits else a)
        flags = lines.within_edits([np.array(a)] * 4, [np.array(b) for b in others], edits)
        for b, flag in zip(others, flags):
            assert flag == (brute.edit_distance(a, b) <= edits)
            if flag:
                # As many edits as the lines may have, if they have one for each code point.
                most = min(edits, len(a), len(b))
                held = lines.Lines([bytes(a), bytes(b)], most, 1)
                assert held.linkable(0, np.array([1])).tolist() == [1]
                assert held.matches(np.array([0]), np.array([1]))[0]
                begin, end = np.array([0, len(a)]), np.array([len(a), len(a) + len(b)])
                pieces = lines.Pieces(np.array(a + b, dtype=np.uint8))
                keys, owner = lines.signatures_of(begin, end, pieces, edits, 1)
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_pieces_have_one_hash_in_any_chunk():
    data = np.frombuffer(b"one text and another", dtype=np.uint8)
    first, second = lines.Pieces(data[4:]), lines.Pieces(np.concatenate((data, data)))
    at, size = np.array([0, 5]), np.array([4, 3])
    assert (first.hashes(at, size) == second.hashes(at + 4, size)).all()
    assert (first.hashes(at, size) == second.hashes(at + 24, size)).all()


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    cases = [
        np.zeros(0),
        np.zeros(1),
        np.zeros(1000),
        rng.integers(0, 49408, 30000),
        rng.integers(0, 2, 999),
        np.array([2**64 - 1, 5, 2**60, 0, 0, 2**60 - 1] * 77, dtype=np.uint64),
        rng.integers(0, 2**63, 500).astype(np.uint64) * 2 + 1,
        np.concatenate([np.zeros(130), rng.integers(0, 9, 50), np.zeros(200)]),
    ]
    for bits in range(1, 64):
        cases.append(rng.integers(0, 2**bits, 300, dtype=np.uint64))
    for values in cases:
        values = values.astype(np.uint64)
        code, offsets = simple8b.encode(values)
        assert (simple8b.decode(code, offsets, len(values)) == values).all()
        if len(values) > 200:  # a block alone
            last = np.uint64(offsets[-1])
            start = (len(offsets) - 1) * simple8b.BLOCK
            alone = simple8b.decode(code[int(last) :], np.zeros(1, dtype=np.uint32), len(values) - start)
            assert (alone == values[start:]).all()


def ids_of(text, end):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_the_tokenizer():
    texts = ["", "a b", "§→ mark → x", "`x ` → y", "é É ΣΣ İx", "a\x0b\x0cb\x1cc d e\x85f"]
    texts += ["<|endoftext|>a<|startoftext|>", "it's 'tis I'LL 12345 ...!!!", "x" * 3000, "\U0001f600‍\U0001f600 ﻿z"]
    rng = random.Random(9)
    alphabet = "abZ é'0→ \n\t́ßΣ<|>§"
    texts += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(200)]
    encoder = tokens.Encoder(tokens.read_tokenizer(tokenizer_path()))
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode(pa.array(texts), 2)
        assert ids.tolist() == [i for text in texts for i in ids_of(text, 2)]
        assert counts.tolist() == [len(ids_of(text, 2)) for text in texts]


@pytest.mark.parametrize("block_ids", [1, 100, 1 << 16])
def test_token_files(spark, odd, same, block_ids):
    docs, rows = odd
    folder = workspace(spark, "tokens")
    token_files.write(docs, folder, tokenizer_path(), 2, block_ids)
    start, expected = 0, []
    for row in sorted(rows, key=brute.key):
        ids = ids_of(row["text"], 2)
        expected.append((row["doc_id"], start, len(ids), brute.crc(ids)))
        start += len(ids)
    same(token_files.read(spark, folder), ["doc_id", "start", "n_tokens", "ids_crc32"], expected)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(odd, same, capacity):
    docs, rows = odd
    found = packing.pack(docs, tokenizer_path(), 1, capacity)
    expected, total = [], 0
    for row in rows:
        ids = ids_of(row["text"], 1)
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected.append((row["doc_id"], piece, start, len(part), brute.crc(part)))
    same(found, ["doc_id", "piece", "start", "length", "ids_crc32"], expected)
    sequences = defaultdict(list)
    for row in found.collect():
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= 1.25 * total / capacity + 1


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.choice((rng.randint(1, 100), rng.randint(30, 60))) for _ in range(rng.randint(0, 120))]
        room = []
        for length in sorted(lengths, reverse=True):
            fits = [i for i, left in enumerate(room) if left >= length]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= length
            else:
                room.append(100 - length)
        planned = packing.plan(Counter(lengths), 100)
        used = {first + i for _, _, first, _, count in planned for i in range(count)}
        assert len(used) == len(room) and used == set(range(len(room)))


def test_classifier(spark, same, odd):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice("abcdefghij") * rng.randint(2, 6) for _ in range(rng.randint(5, 300))]
        good = i % 3 > 0
        if not good:
            at = rng.randrange(len(text))
            text[at : at + 80] = ["###$$$"] * 80
        rows.append((i, " ".join(text), None))
        labels.append((i, int(good)))
    docs = frame_of(spark, rows)
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, label int")
    model = quality_model.learn(docs, known)
    found = {row["doc_id"]: row for row in quality_model.score(docs, model).collect()}
    held = [i for i, row in found.items() if row["held_out"]]
    assert set(held) == {i for i in found if brute.zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(found[i]["predicted"] == dict(labels)[i] for i in held) >= 0.95 * len(held)
    again = quality_model.score(docs.repartition(5), quality_model.learn(docs.repartition(4), known))
    assert {row["doc_id"]: row["score"] for row in again.collect()} == pytest.approx({i: r["score"] for i, r in found.items()})
    odd_docs, odd_all = odd
    scores = quality_model.score(odd_docs, model).collect()
    assert len(scores) == len(odd_all) and all(0 <= row["score"] <= 1 for row in scores)
    alike = [row["score"] for row in quality_model.score(odd_docs.where("doc_id = 2"), model).collect()]
    assert len(alike) == 2 and alike[0] == alike[1]


def test_classifier_learns_from_whole_texts(spark):
    """Texts of more than 256 passages have them all; too many passages mean fewer texts."""
    long = " ".join(f"w{i}" for i in range(300 * 64))
    ids = [i for i in range(40) if brute.zlib.crc32(str(i).encode()) % 5][:6]
    docs = frame_of(spark, [*((i, f"{long} {i}", None) for i in ids), (ids[0], f"{long} {ids[0]}", None)])
    known = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, label int")
    assert [len(bag) for _, _, bag in quality_model.training_bags(docs, known)] == [301] * 7
    assert [len(bag) for _, _, bag in quality_model.training_bags(docs, known, passages=700)] == [301] * 3
    assert quality_model.training_bags(docs, known.limit(0)) == []


def test_classifier_gradients():
    rng = np.random.default_rng(1)
    model = quality_model.Model(5, rng)
    rows, passages, labels = rng.normal(size=(9, 5)), np.array([2, 1, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = model.score(rows, passages)
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for name, gradient in model.gradients(rows, passages, labels).items():
        weight = model.weights[name]
        at = np.unravel_index(np.argmax(np.abs(gradient)), weight.shape)
        before = weight[at]
        weight[at] = before + 1e-6
        high = loss()
        weight[at] = before - 1e-6
        low = loss()
        weight[at] = before
        assert gradient[at] == pytest.approx((high - low) / 2e-6, rel=1e-4)


def test_classifier_without_labels(spark, odd):
    docs, rows = odd
    model = quality_model.learn(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {row["score"] for row in quality_model.score(docs, model).collect()} == {0.5}


CONVERSATIONS = [
    (1, 0, "system", "be <|end|> kind \\ <\\| <"),
    (1, 1, "user", "<|turn|>assistant<|text|>hi<|end|>"),
    (1, 2, "assistant", "one\\"),
    (1, 3, "user", None),
    (1, 4, "assistant", "<"),
    (1, 5, "user", "| trailing"),
    (2, 0, "user", "only\nuser"),
    (3, 0, "assistant", ""),
    (3, 0, "assistant", ""),
    (4, 1, None, "no role"),
    (4, None, "assistant", "no turn"),
    (None, 0, "assistant", "no conversation"),
    (5, 0, "tool<|text|>", "x" * 70000),
    (5, 1, "assistant", "é\U0001f600<|"),
]


def test_chat(spark):
    rows = spark.createDataFrame(
        [(*row, "extra") for row in CONVERSATIONS], "conv_id long, turn long, role string, text string, turns string"
    )
    written = chat.examples(rows)
    by = defaultdict(list)
    for conv, turn, role, text in CONVERSATIONS:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    expected, targets = {}, {}
    for conv, turns in by.items():
        turns.sort()
        plain = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        expected[conv] = (len(turns), brute.sha(plain), len(loss), brute.sha(loss))
        targets[conv] = [i + 1 for i, t in enumerate(turns) if t[2] == "assistant" or i + 1 == len(turns)]
    found = {row["conv_id"]: row for row in chat.summary(written).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in found.items()} == expected
    examples = written.withColumn("turns", chat.parsed(F.col("formatted"))).collect()
    for row in examples:
        upto = targets[row["conv_id"]][row["example"]]
        turns = by[row["conv_id"]][:upto]
        assert [(t["role"], t["text"]) for t in row["turns"]] == [t[2:] for t in turns]
        masked = row["formatted"][row["loss_start"] : row["loss_start"] + row["loss_length"]]
        own = turns[-1][3] if turns[-1][2] == "assistant" else ""
        assert masked.replace("<\\|", "<|").replace("\\\\", "\\") == own or "\\" in own
    assert len(examples) == sum(map(len, targets.values()))
    assert chat.summary(chat.examples(rows.limit(0))).count() == 0


def test_empty_tables(spark, nothing):
    folder = workspace(spark, "tokens")
    token_files.write(nothing, folder, tokenizer_path(), 2)
    model = quality_model.learn(nothing, spark.createDataFrame([], "doc_id long, label int"))
    for frame in (
        substring.remove_repeats(nothing),
        exact.exact_duplicates(nothing),
        mixing.mix(nothing),
        rules.judge(nothing, "source"),
        rules.accepted(nothing, "source"),
        jaccard.near_duplicates(nothing),
        lines.remove_lines(nothing),
        token_files.read(spark, folder),
        quality_model.score(nothing, model),
        packing.pack(nothing, tokenizer_path(), 1),
    ):
        assert frame.count() == 0


def test_packed_signatures_round_trip():
    rng = np.random.default_rng(6)
    key = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    key = np.concatenate((key, key[:700], key[:300]))
    node = rng.integers(0, 2**63, 90, dtype=np.uint64)[rng.integers(0, 90, len(key))]
    size = (node % np.uint64(700)).astype(np.int64) + 3
    found, heads = set(), {}
    for batch in links.packed_signatures(key, size, node, 16):
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys, nodes, sizes = links._unpack(packed)
            half = len(keys) if len(nodes) > len(keys) else 0
            for k, n, s in zip(keys.tolist(), nodes[half:].tolist(), sizes[half:].tolist()):
                found.add((k, s, n))
            if not half:
                assert all((k >> 40) * 16 >> 24 == bucket for k in keys.tolist())
                heads.update(zip(keys.tolist(), nodes.tolist()))
    assert found == set(zip(key.tolist(), size.tolist(), node.tolist()))
    assert set(heads) == set(key.tolist())


def test_packed_signatures_keep_their_steps():
    key = np.array([5, 5, 9, 2**60, 2**60], dtype=np.uint64)
    node = np.array([1, 2, 1, 1, 3], dtype=np.uint64)
    size = np.array([7, 400, 7, 7, 9]) + (np.array([0, 31, 3, 17, 1]) << links.STEP_BITS)
    found = set()
    for batch in links.packed_signatures(key, size, node, 4):
        for packed in batch.column(1).to_pylist():
            keys, nodes, sizes = links._unpack(packed)
            half = len(keys) if len(nodes) > len(keys) else 0
            found.update(zip(keys.tolist(), nodes[half:].tolist(), sizes[half:].tolist()))
    assert found == set(zip(key.tolist(), node.tolist(), size.tolist()))


def test_sketches_never_lose_a_link():
    plausible = links.matched(lambda held: sketches.CountingSketches(held, jaccard.SIMILARITY))
    rng = np.random.default_rng(7)
    for size in (3, 40, 700, 9000):
        base = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        others = []
        for _ in range(40):
            kept = base[rng.random(len(base)) < rng.choice((0.7, 0.85, 0.95))]
            others.append(np.unique(np.append(kept, rng.integers(0, 2**64, size // 10, dtype=np.uint64))))
        flags = plausible([sketches.counting_sketch(base)] * 40, [sketches.counting_sketch(o) for o in others])
        linked = jaccard._similar([base] * 40, others)
        assert not (linked & ~flags).any()
    unlike = [np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(50)]
    one, *rest = [sketches.counting_sketch(u) for u in unlike]
    assert not plausible([one] * 49, rest).any()
