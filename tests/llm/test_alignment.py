"""Tokenizer alignment against a version that reads whole texts token by token."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import frame_of

from tidemark.llm import alignment, csr
from tidemark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


class Plain:
    def __init__(self, a_path, b_path):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

    def tokens(self, text):
        """(id, bytes) of both, or nothing."""
        a = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in a.ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])

    @staticmethod
    def spans(tokens):
        end, found = 0, []
        for i, data in tokens:
            found.append((i, end, end + len(data)))
            end += len(data)
        return found

    def documents(self, texts):
        docs, counts = [], Counter()
        for text in texts:
            a, b = map(self.spans, self.tokens(text) if text else ([], []))
            cuts = sorted({end for _, _, end in a} & {end for _, _, end in b})
            groups = []
            for begin, end in zip([0, *cuts], cuts):
                groups.append([[i for i, s, e in side if begin <= s and e <= end] for side in (a, b)])
            overlaps = sum(s < e2 and s2 < e for _, s, e in a for _, s2, e2 in b) if len(a) < 3000 else None
            links = Counter((i, j) for left, right in groups for i in left for j in right)
            counts.update(links.keys())
            docs.append((a, b, groups, overlaps, links))
        highest = defaultdict(int)
        for (i, _), n in counts.items():
            highest[i] = max(highest[i], n)
        for a, b, groups, overlaps, links in docs:
            named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            yield (
                len(a),
                len(b),
                len(groups),
                sum(links.values()),
                overlaps,
                sum(n for pair, n in links.items() if counts[pair] == highest[pair[0]]),
                sum(n * counts[pair] for pair, n in links.items()),
                hashlib.sha256(named.encode()).hexdigest() if named else "",
            )


ODD = [
    "a  b   c \n\n d\te ",
    " leading and trailing ",
    "été café naïve   nbsp x 　 wide  em",
    "日本語 の 文章 \U0001f600 \U0001f600\U0001f468‍\U0001f469 x",
    "piece▁space here",
    "<|endoftext|> <s> </s> <unk> <0x0A> don't we'll I'm",
    "\u0000 \u0085 \u001c x́ ́y",
    "x" * 700 + " " * 90 + "1234567890" * 30,
    " line  narrow​zero ﻿bom  og",
    "نص عربي привет 你好",
]


@pytest.mark.parametrize("part_bytes", [300, 4 << 20])
def test_alignment(spark, odd, same, paths, part_bytes):
    rows = odd[1] + [{"doc_id": 500 + i, "text": text} for i, text in enumerate(ODD)]
    docs = frame_of(spark, [(row["doc_id"], row["text"], None) for row in rows])
    expected = [
        (row["doc_id"], *found) for row, found in zip(rows, Plain(*paths).documents([row["text"] for row in rows]))
    ]
    found = alignment.align_documents(docs, *paths, part_bytes=part_bytes)
    long = {row[0] for row in expected if row[5] is None}
    assert {c: t for c, t in found.dtypes if c != "groups_sha256"} == {c: "bigint" for c in COLUMNS[:-1]}
    if long:
        columns = [c for c in COLUMNS if c != "n_overlaps"]
        same(found, columns, [row[:5] + row[6:] for row in expected])
    same(found.where(~found.doc_id.isin(long) | found.doc_id.isNull()), COLUMNS, [r for r in expected if r[0] not in long])


def test_alignment_of_no_documents(nothing, paths):
    assert alignment.align_documents(nothing, *paths).isEmpty()


def test_whole_texts_where_units_may_not_be_cut(paths):
    """Reading unit by unit gives what reading whole texts gives."""
    import pyarrow as pa

    by_unit = alignment.Aligner(*map(alignment.read_model, paths))
    whole = alignment.Aligner(*map(alignment.read_model, paths))
    assert by_unit.cuts
    whole.cuts = False
    ids, texts = pa.array(range(len(ODD))), pa.array(ODD)
    a, b = (alignment.aligned(ids, texts, aligner, 0) for aligner in (by_unit, whole))
    assert [a.column(i) for i in range(8)] == [b.column(i) for i in range(8)]
    held = [{p: n for p, n in zip(*(x.column(c)[0].as_py() for c in ("pairs", "holders"))) if n} for x in (a, b)]
    assert held[0] == held[1]


def test_row_products_are_matrix_products():
    rng = np.random.default_rng(3)
    for rows, inner, columns in [(1, 1, 1), (7, 5, 9), (30, 40, 20), (4, 0, 3)]:
        left, right = rng.integers(0, 3, (rows, inner)), rng.integers(0, 3, (inner, columns))
        sparse = []
        for dense in (left, right):
            i, j = np.nonzero(dense)
            order = rng.permutation(len(i))
            sparse.append(csr.matrix(i[order], j[order], dense[i, j][order], *dense.shape))
        made = csr.product(*sparse)
        full = np.zeros((rows, columns), dtype=int)
        full[made.rows, made.indices] = made.data
        assert (full == left @ right).all() and (made.data > 0).all()
        packed = alignment._unpack(alignment._pack(made))
        assert all((x == y).all() for x, y in zip(packed[:3], made[:3])) and packed.columns == columns
