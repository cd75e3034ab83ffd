import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Names that the operators use inside; a caller's columns of these names must not matter.
CLASHING = "row_id id last_id digest size key step node component n name kept copies taken host document label n_words".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def frame_of(spark, rows):
    """Documents of (doc_id, text, source) with the other columns, null now and then."""
    full = [
        (i, text, None if n % 3 else "en", source, None if n % 4 else 1, *(None if n % 2 else "x" for _ in CLASHING))
        for n, (i, text, source) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage, line = prose(90), prose(40), prose(12)
    near = base.split()
    near[50] = "changed"
    long = prose(3000)
    rows = [
        (1, base, "a"),
        (2, base, "a"),
        (2, base, "a"),  # a repeated row
        (3, " ".join(near), "b"),
        (4, prose(30) + "\n" + passage + "\n" + prose(30), "b"),
        (5, prose(10) + " \t " + passage + "\x0b" + prose(25), None),
        (6, passage + " " + passage, "c"),
        (7, None, "a"),
        (8, "", "a"),
        (9, " \n\t\r\x0b\x0c ", None),
        (None, base.upper(), "c"),
        (None, None, None),
        (None, prose(60), "c"),
        (10, long, "d"),
        (11, long[:-1] + "é", "d"),
        (12, "one", "d"),
        (13, "one", "e"),
        (13, "two words", "e"),  # an id with another text
        (14, "ONE", None),
        (15, "a b c d", "e"),
        (16, "A b C d", "e"),
        (17, "# $ % & | < > * " + prose(20), "b"),
        (18, "\n".join([line, prose(15), line, line + "x", "", prose(9)]), "a"),
        (19, line[:-1] + "\n" + prose(20), "a"),
        (20, "été  nbsp space \U0001f600 ́x " + prose(20), "b"),
        (21, "<|endoftext|> " + "→ • ★ → " * 3 + prose(12), "c"),
        (22, "w " * 200, "z"),
        (23, "ab " * 60 + prose(5), "z"),
        (24, prose(3), "z"),
        (25, "x" * 5000, "z"),
        (-1, prose(25), "z"),
    ]
    # A group of near copies, each with a word of its own, and texts that share a passage.
    for i in range(40):
        copy = base.split()
        copy[20 + i] = f"copy{i}"
        rows.append((100 + i, " ".join(copy), "hot"))
    for i in range(25):
        rows.append((200 + i, prose(9) + " " + passage + " " + prose(8), "hot"))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    rows = odd_rows()
    docs = frame_of(spark, rows).cache()
    return docs, [{"doc_id": i, "text": text, "source": source} for i, text, source in rows]


@pytest.fixture(scope="session")
def nothing(spark):
    return frame_of(spark, []).limit(0)


def _key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.fixture(scope="session")
def same():
    def check(frame, columns, expected):
        found = [tuple(row) for row in frame.select(*columns).collect()]
        assert sorted(found, key=_key) == sorted(expected, key=_key)

    return check
