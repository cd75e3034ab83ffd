"""Token ids of whole texts, for use inside Arrow tasks.

A text's ids are the ids of its words, one after the other: this holds for tokenizers that
drop white space and never join across it, which ``splits_at_white_space`` checks for the
kind it knows. Each distinct word of a chunk is encoded once.

Most words are letters with some punctuation behind. Tokenizers of that kind split there
and read letters in lower case, so the letters are one unit and the punctuation another,
and far fewer units than words are distinct. Letters alone need no normalizing or splitting
and go straight to the tokenizer's model. All other words are joined into one text with a
mark between them, which the whole tokenizer reads, and the ids are cut at the marks.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa

from tidemark.llm.words import Words, distinct_pieces

#: Signs of which one that is a single token becomes the mark.
MARKS = "→•★©§"
WORDS_AT_ONCE = 512
#: Bytes of words that an encoder remembers before it starts afresh; results do not depend on it.
REMEMBERED_BYTES = 6 << 20

# Fixed value: the pattern that words are split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

# Kinds of bytes: ASCII letters, the first byte of Latin-1 letters, and ASCII punctuation
# but the apostrophe, which can start a contraction.
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LATIN_LEAD = 0xC3
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True


def read_tokenizer(path: str) -> bytes:
    """The tokenizer's file; a few megabytes whatever the corpus."""
    with open(path, "rb") as file:
        return file.read()


def splits_at_white_space(definition: bytes) -> bool:
    found = json.loads(definition)
    steps = (found.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    normalizers = [n["type"] for n in (found.get("normalizer") or {}).get("normalizers") or []]
    return (
        steps[0].get("pattern", {}).get("Regex") == PATTERN
        and steps[0].get("behavior") == "Removed"
        and bool(steps[0].get("invert"))
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("use_regex")
        and not steps[1].get("add_prefix_space")
        and normalizers == NORMALIZERS
    )


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves; the others follow from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the units end to end, their lengths, the word that each is of, and which are letters.

    Letters with punctuation behind are two units, the letters in lower case; every other
    word is one unit as it stands.
    """
    data = words.data
    latin = np.zeros(len(data) + 1, dtype=bool)  # second bytes of Latin-1 letters
    lead = np.flatnonzero(data[:-1] == LATIN_LEAD)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    latin[lead + 1] = True
    latin = latin[: len(data)]
    letter = LETTER[data] | latin
    letter[lead] = True
    mark = PUNCTUATION[data]
    starts, ends = words.starts, words.ends
    # Not letters with punctuation behind: any other byte, or a letter right behind punctuation.
    other = ~(letter | mark) & words.in_word
    behind = letter[1:] & mark[:-1]
    # The first byte of a word may stand right behind another text's punctuation.
    behind[starts[starts > 0] - 1] = False
    other[1:] |= behind
    simple = ~np.logical_or.reduceat(other, starts)
    count = np.where(simple, np.add.reduceat(letter.view(np.uint8), starts, dtype=np.int32), 0)
    size = ends - starts
    split = (count > 0) & (count < size)
    packed = data[words.in_word]
    upper = (packed >= 0x41) & (packed <= 0x5A) | latin[words.in_word] & (packed <= 0x9E)
    packed = packed + (upper & np.repeat(count > 0, size)).view(np.uint8) * np.uint8(0x20)

    owner = np.repeat(np.arange(len(starts)), 1 + split)
    tail = np.zeros(len(owner), dtype=bool)
    tail[1:] = owner[1:] == owner[:-1]
    lengths = np.where(split[owner], np.where(tail, size[owner] - count[owner], count[owner]), size[owner])
    return packed, lengths, owner, (count[owner] > 0) & ~tail


class Encoder:
    def __init__(self, definition: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not splits_at_white_space(definition):
            raise ValueError("the tokenizer is of another kind, and may join tokens across white space")
        self.tokenizer = Tokenizer.from_buffer(definition)
        self.model = self.tokenizer.model
        self.characters = byte_characters()
        single = [(mark, self._plain(mark)) for mark in MARKS]
        usable = [(mark, ids[0]) for mark, ids in single if len(ids) == 1]
        if not usable:
            raise ValueError("the tokenizer has no single token for any of the marks")
        self.mark, self.mark_id = usable[0]
        self._forget()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.remembered = 0
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _of_letters(self, unit: bytes) -> list[int]:
        if unit.isascii():
            return [token.id for token in self.model.tokenize(unit.decode("ascii"))]
        return [token.id for token in self.model.tokenize(unit.decode("latin-1").translate(self.characters))]

    def _of_words(self, words: list[bytes]) -> list[list[int]]:
        marked, result = f" {self.mark} ", []
        groups = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        joined = [marked.join(word.decode("utf-8", "replace") for word in group) for group in groups]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = encoding.ids
            cut = [i for i, token in enumerate(ids) if token == self.mark_id]
            if len(cut) == len(group) - 1:
                result += [ids[a + 1 : b] for a, b in zip([-1, *cut], [*cut, len(ids)])]
            else:  # a word holds the mark itself
                result += [self._plain(word.decode("utf-8", "replace")) for word in group]
        return result

    def _learn(self, letters: list[bytes], others: list[bytes]) -> None:
        self.remembered += sum(map(len, letters)) + sum(map(len, others))
        found = [*map(self._of_letters, letters), *self._of_words(others)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, with ``end`` after each text, and how many each text has."""
        words = Words(texts)
        if not len(words):
            return np.full(len(texts), end, dtype=np.uint32), np.ones(len(texts), dtype=np.int64)
        data, lengths, owner, is_letters = units(words)
        numbers, distinct = distinct_pieces(data, lengths)
        # Equal units are of one kind.
        letters = np.zeros(len(distinct), dtype=bool)
        letters[numbers] = is_letters
        if self.remembered > REMEMBERED_BYTES:
            self._forget()
        known, pieces = self.slots, distinct.to_pylist()
        new: tuple[list[bytes], list[bytes]] = ([], [])
        for piece, plain in zip(pieces, letters.tolist()):
            if piece not in known:
                new[0 if plain else 1].append(piece)
        if new[0] or new[1]:
            known.update(zip(chain(*new), range(len(known), len(known) + len(new[0]) + len(new[1]))))
            self._learn(*new)
        slots = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        starts = np.cumsum(self.sizes) - self.sizes
        slot = slots[numbers]
        size = self.sizes[slot]
        before = np.cumsum(size) - size
        total = int(before[-1] + size[-1])
        ids = self.ids[np.arange(total) + np.repeat(starts[slot] - before, size)]
        edges = np.append(before, total)[np.searchsorted(owner, words.bounds)]
        counts = np.diff(edges) + 1
        out = np.empty(total + len(texts), dtype=np.uint32)
        last = np.cumsum(counts) - 1
        inner = np.ones(len(out), dtype=bool)
        inner[last] = False
        out[last] = end
        out[inner] = ids
        return out, counts

