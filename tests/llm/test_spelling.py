"""Spelling variants against plain counting and plain edit distances."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from conftest import frame_of

from tidemark.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {word: k for word, k in n.items() if len(word) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    n = counts(rows)
    form, near = {}, {}
    for a in n:
        near[a] = [b for b in n if one_edit(a, b)]
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 2 * n[a] else None
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        yield a, form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None


def made_rows():
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(120)}
    words |= {"x" * 200, "x" * 199, "y" + "x" * 199, "Straße", "straße", "straÿe", "naïve", "naive", "÷×÷×÷"}
    rows = []
    for word in sorted(words):
        rows += [(rng.randint(0, 900), word.upper() if word.isascii() and k % 2 else word) for k in range(rng.randint(2, 40))]
    for k, word in enumerate(["chain", "chaina", "chainab", "chainabc", "chainabcd"]):
        rows += [(j, word) for j in range(1000, 1000 + 900 // 3**k)]
    rng.shuffle(rows)
    # Several to a text, with signs that end a run.
    return [(rows[i][0], " ".join(w for _, w in rows[i : i + 4]) + rng.choice([".", "Ā", "1", ""])) for i in range(0, len(rows), 4)]


@pytest.mark.parametrize("pairs_of_chunk", [0, 40, spelling.PAIRS_OF_CHUNK])
def test_variants(spark, odd, same, pairs_of_chunk):
    rows = [(row["doc_id"], row["text"]) for row in odd[1]] + made_rows()
    expected = list(variants(rows))
    assert len({root for _, _, root, *_ in expected}) < len(expected)
    assert ("chainabcd", "chainabc", "chain") in {row[:3] for row in expected}
    found = spelling.spelling_variants(frame_of(spark, [(i, text, None) for i, text in rows]), pairs_of_chunk)
    assert found.dtypes == [(c, "string" if c in ("word", "form", "root") else "bigint") for c in COLUMNS]
    same(found, COLUMNS, expected)


def test_variants_of_no_documents(nothing):
    assert spelling.spelling_variants(nothing).isEmpty()


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_near_pairs_of_random_words(spark, letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(400)})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    expected = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    for limit in (0, 10**9):
        found = spelling.near_pairs(frame, limit).collect()
        assert len(found) == len(expected)
        assert {frozenset((row.a, row.b)) for row in found} == expected


def test_checksums_of_long_and_short_runs():
    runs = ["b" * n for n in (1, 2, 63, 64, 65, 300)] + ["é" * n for n in (5, 31, 32, 33)]
    for i in (0, -7, 123456789012):
        n = Counter()
        table = spelling.word_counts([i], pa.array([" ".join(runs)]), spelling.shift_tables())
        for word, k in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
            n[word] += k
        expected = Counter()
        for run in runs:
            h = zlib.crc32(f"{i}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
        assert n == Counter({w: k for w, k in expected.items() if len(w) >= 5})
