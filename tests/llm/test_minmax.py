"""Min-max near duplicates against all pairs of full sets."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import frame_of

from tidemark.llm import links, minmax, sketches

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def plain(rows):
    """Components by comparing all pairs of distinct sets."""
    sets = [brute.shingles(row["text"], 2) for row in rows]
    union = brute.Union()
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(b) >= 80 * len(a) and 100 * len(a & b) >= 80 * len(a | b):
                union.join(distinct.index(b), i)
    place = {s: union.find(i) for i, s in enumerate(distinct)}
    least = {}
    for row, s in zip(rows, sets):
        if s and row["doc_id"] is not None:
            least[place[s]] = min(least.get(place[s], row["doc_id"]), row["doc_id"])
    for row, s in zip(rows, sets):
        component = least.get(place[s]) if s else row["doc_id"]
        yield row["doc_id"], len(s), component, row["doc_id"] == component


def copies(n=150, length=70):
    """Copies of one text with more and more words of their own, from alike to just short of it."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(length), rng.randint(0, 9)):
            words[at] = f"own{i}-{at}"
        rows.append({"doc_id": 1000 + i, "text": " ".join(words), "source": None})
    # Short texts at the limit: 4 of 5 shingles, 8 of 10.
    rows += [{"doc_id": 3000 + i, "text": t, "source": None} for i, t in enumerate(
        ["a b c d e", "a b c d e f", "a b c d e f g", "q r s t u v w x y", "q r s t u v w x y z aa", "k l m", "k l m n"]
    )]
    return rows


@pytest.mark.parametrize("block_bytes", [500, links.BLOCK_BYTES])
def test_near_duplicates(spark, odd, same, block_bytes):
    rows = odd[1] + copies()
    docs = frame_of(spark, [(row["doc_id"], row["text"], row["source"]) for row in rows])
    expected = list(plain(rows))
    assert 1 < len({c for i, _, c, _ in expected if i is not None and 1000 <= i < 3000}) < 100
    same(minmax.near_duplicates(docs, block_bytes), COLUMNS, expected)


def test_near_duplicates_of_no_documents(nothing):
    assert minmax.near_duplicates(nothing).isEmpty()


def test_members_in_different_components_are_compared(spark, same):
    """Pairs whose pivots link with neither are found among the members."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = [{"doc_id": i, "text": " ".join(base), "source": None} for i in range(2)]
    for i in range(12):
        words = list(base)
        for at in rng.sample(range(100), 12):
            words[at] = f"x{i}-{at}"
        twin = list(words)
        twin[rng.randrange(100)] = "twin"
        rows += [{"doc_id": 10 + 2 * i + k, "text": " ".join(t), "source": None} for k, t in enumerate((words, twin))]
    expected = list(plain(rows))
    assert len({c for _, _, c, _ in expected}) > 5
    docs = frame_of(spark, [(row["doc_id"], row["text"], None) for row in rows])
    same(minmax.near_duplicates(docs), COLUMNS, expected)


def test_both_ends_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    odd = minmax.multipliers()
    assert len(set(odd.tolist())) == minmax.PERMUTATIONS
    for shared, own in [(400, 50), (160, 40), (90, 90)]:
        rates = []
        for _ in range(30):
            tokens = rng.integers(0, 2**64, shared + 2 * own, dtype=np.uint64)
            a, b = np.sort(tokens[: shared + own]), np.sort(np.concatenate((tokens[:shared], tokens[shared + own :])))
            found = minmax.signatures([a, b], odd)
            rates.append((found[0] == found[1]).mean())
        truth = shared / (shared + 2 * own)
        # Less spread than as many single hashes would have is not asked for, only no bias.
        assert abs(np.mean(rates) - truth) < 0.02
        one = minmax.signatures([a], odd)
        assert (one[:, 0::2] <= one[:, 1::2]).all()


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(2)
    ruled_out = 0
    for _ in range(400):
        shared, x, y = int(rng.integers(1, 300)), int(rng.integers(0, 60)), int(rng.integers(0, 60))
        tokens = rng.integers(0, 2**64, shared + x + y, dtype=np.uint64)
        a = np.unique(tokens[: shared + x])
        b = np.unique(np.concatenate((tokens[:shared], tokens[shared + x :])))
        is_link = bool(minmax.similar([a], [b])[0])
        assert is_link == (100 * shared >= 80 * (shared + x + y))
        per = int(rng.choice([1, 4, 16]))
        similar = links.matched(lambda held: sketches.Sketches(held, 80))
        flag = bool(similar([sketches.sketch(a, per)], [sketches.sketch(b, per)])[0])
        assert flag or not is_link
        ruled_out += not flag and not is_link
    assert ruled_out > 100


def test_sets_do_not_depend_on_how_texts_are_put_together():
    texts = ["A b c", "a B c", None, "", "one", " x \n y ", "x y"]
    sets = minmax.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1, 1, 1]
    assert (sets[0] == sets[1]).all() and (sets[5] == sets[6]).all()
    assert all((s == minmax.shingle_sets(pa.array([t], pa.string()))[0]).all() for t, s in zip(texts, sets))
