"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(text):
    """Spark's xxhash64 of a string."""
    value = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return value - 2**64 if value >= 2**63 else value


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, digest(row["text"]))


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def substring(rows, window=20):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    first = {}
    for row in sorted(rows, key=key):
        found = words(row["text"])
        for i in range(len(found) - window + 1):
            first.setdefault(tuple(found[i : i + window]), (key(row), i))
    result = []
    for row in rows:
        found = words(row["text"])
        gone = [False] * len(found)
        for i in range(len(found) - window + 1):
            if first[tuple(found[i : i + window])] < (key(row), i):
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(found, gone) if not g)
        result.append((row["doc_id"], len(found), sum(gone), sha(kept)))
    return result


def shingles(text, n=5):
    found = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(found) < n:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def near(rows):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(row["text"]) for row in rows]
    union = Union()
    holders = defaultdict(list)
    for i, tokens in enumerate(sets):
        for token in tokens:
            holders[token].append(i)
    common = Counter((a, b) for ids in holders.values() for b in ids for a in ids if a < b)
    for (a, b), both in common.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            union.join(a, b)
    least = {}
    for i, row in enumerate(rows):
        if row["doc_id"] is not None:
            root = union.find(i)
            least[root] = min(least.get(root, row["doc_id"]), row["doc_id"])
    return [(row["doc_id"], len(sets[i]), least.get(union.find(i))) for i, row in enumerate(rows)]


def edit_distance(a, b):
    # What begins and ends alike needs no edit.
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def line_dedup(rows, edits=2, per_edit=8):
    """(doc_id, n_lines, n_removed, kept_sha256) of each row."""
    places = defaultdict(set)
    for row in rows:
        for i, line in enumerate((row["text"] or "").split("\n")):
            if WORD.search(line):
                places[line].add((key(row), i))
    union = Union()
    lines = list(places)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = min(edits, min(len(a), len(b)) // per_edit)
            if abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most:
                union.join(a, b)
    first = {}
    for line, at in places.items():
        root = union.find(line)
        first[root] = min(first.get(root, min(at)), min(at))
    result = []
    for row in rows:
        found = (row["text"] or "").split("\n")
        kept = [
            line
            for i, line in enumerate(found)
            if not WORD.search(line) or first[union.find(line)] == (key(row), i)
        ]
        result.append((row["doc_id"], len(found), len(found) - len(kept), sha("\n".join(kept))))
    return result


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(map(len, found)), symbols, dups, len(covered)


def judged(rows, host):
    base = [(measures(row["text"]), row[host]) for row in rows]
    failed = [m[0] < 20 or 100 * m[4] > 30 * m[0] for m, _ in base]
    hosts = defaultdict(list)
    for (_, name), bad in zip(base, failed):
        if name is not None:
            hosts[name].append(bad)
    rates = [sum(v) / len(v) for v in hosts.values()]
    mean = sum(rates) / len(rates) if rates else 0
    variance = sum((r - mean) ** 2 for r in rates) / len(rates) if rates else 0
    strength = min(max(mean * (1 - mean) / variance - 1, 0), 1e6) if variance else 1e6
    rejected = {k for k, v in hosts.items() if (sum(v) + mean * strength) / (len(v) + strength) > 0.5}
    return [
        (row["doc_id"], *m, bad, not bad and name not in rejected) for row, (m, name), bad in zip(rows, base, failed)
    ]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
