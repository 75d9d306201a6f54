"""Cross-tokenizer alignment against whole texts and overlapping ranges in plain Python."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as contract
from tremorline.llm import alignment
from tremorline.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER

from .tables import EDGE_TEXTS, SMALL, edge_docs, empty_docs, small

ODD_TEXTS = [
    "  two  spaces   and others \n\n then  ",
    " ",
    "   ",
    "x ",
    "a▁b",
    "<s> <unk> <0x0A> <|endoftext|> ▁",
    "naïve \U0001f469‍\U0001f4bb œuvre 東京 タワー  \tтест\u0085x 　 y",
    "\x00\x1f \x7f",
    "don't can't I'll  'tis",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(open(BYTE_TOKENIZER, "rb").read(), open(PIECE_TOKENIZER, "rb").read())


@pytest.fixture(scope="module")
def plain():
    """For a text: the ids of both, and all links by comparing all byte ranges."""
    a = Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_TOKENIZER)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {c: chr(c) for c in kept}
    letters |= {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if c not in kept)}
    byte_of = {letter: c for c, letter in letters.items()}

    def b_bytes(i: int) -> bytes:
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(parts):
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        return list(zip(ends[:-1], ends[1:], strict=True))

    def run(text: str | None):
        if not text:
            return [], [], [], ""
        a_ids = a.encode(" " + text, add_special_tokens=False).ids
        b_ids = b.encode(text)
        a_parts = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids]
        b_parts = [b_bytes(i) for i in b_ids]
        if b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
            return [], [], [], ""
        a_spans, b_spans = spans(a_parts), spans(b_parts)
        links = []
        first = 0
        for i, (low, high) in enumerate(a_spans):
            while b_spans[first][1] <= low:
                first += 1
            j = first
            while j < len(b_spans) and b_spans[j][0] < high:
                links.append((a_ids[i], b_ids[j]))
                j += 1
        ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        sides = []
        for ids, of in ((a_ids, a_spans), (b_ids, b_spans)):
            side = [[] for _ in ends]
            for i, (_, end) in zip(ids, of, strict=True):
                side[bisect.bisect_left(ends, end)].append(str(i))
            sides.append(side)
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True)]
        return a_ids, b_ids, links, ";".join(groups)

    return run


def expected(texts, plain):
    found = [plain(t) for t in texts]
    counts = Counter(pair for _, _, links, _ in found for pair in set(links))
    best: dict[int, int] = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (
            len(a),
            len(b),
            groups.count(";") + 1 if groups else 0,
            len(links),
            sum(counts[p] == best[p[0]] for p in links),
            sum(counts[p] for p in links),
            groups,
        )
        for a, b, links, groups in found
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_slices_and_links():
    a_ends, b_ends = np.array([2, 3, 7, 9]), np.array([1, 3, 5, 6, 9])
    common, a_past, b_past = alignment.common_slices(a_ends, b_ends)
    assert (common.tolist(), a_past.tolist(), b_past.tolist()) == ([3, 9], [2, 4], [2, 5])
    a, b, _ = alignment.slice_links(a_ends, b_ends)
    links = list(zip(a.tolist(), b.tolist(), strict=True))
    assert links == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (2, 4), (3, 4)]
    assert all(len(x) == 0 for x in alignment.common_slices(a_ends[:0], b_ends[:0]))


def _run_of(aligner, texts):
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return alignment._Run(aligner, np.frombuffer(b"".join(raw), np.uint8), offsets)


def test_spans_give_what_whole_texts_give(aligner, plain):
    rng = random.Random(3)
    alphabet = " " * 6 + "ab\n\t'sé東  　\u0085  ▁.,1​"
    texts = ODD_TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    assert aligner.space_starts_pieces
    run = _run_of(aligner, texts)
    for i, text in enumerate(texts):
        a, b, links, groups = plain(text)
        assert run.groups[i] == groups, repr(text)
        assert run.numbers[i].tolist() == [
            len(a), len(b), groups.count(";") + 1 if groups else 0, len(links)
        ]


def test_invalid_text_has_no_tokens(aligner):
    run = _run_of(aligner, [b"ab \xff c", b"fine"])
    assert run.groups[0] == "" and run.numbers[0].tolist() == [0, 0, 0, 0]
    assert run.numbers[1][0] > 0


def test_query_equals_plain_python(spark, plain):
    docs = small("documents", "doc_id", "text")
    got = contract.queries()["op13_token_alignment"](spark, SMALL).collect()
    assert len(got) == len(docs)
    rows = {r.doc_id: r.asDict() for r in got}
    for (doc_id, _), want in zip(docs, expected([t for _, t in docs], plain), strict=True):
        row = rows[doc_id]
        assert tuple(row[c] for c in COLUMNS[:-1]) == want[:-1]
        digest = hashlib.sha256(want[-1].encode()).hexdigest() if want[0] else ""
        assert row["groups_sha256"] == digest


@pytest.mark.parametrize("chunk_bytes", [1, 8 << 20])
def test_edge_rows(spark, plain, monkeypatch, chunk_bytes):
    """Nulls, empty and long texts, repeated rows, columns with the results' names."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk_bytes)
    texts = EDGE_TEXTS + ODD_TEXTS
    docs = edge_docs(spark, texts).withColumnRenamed("labels", "groups")
    aligned = alignment.align_texts(docs, BYTE_TOKENIZER, PIECE_TOKENIZER)
    got = alignment.count_links(aligned).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(expected(texts, plain))
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())


def test_empty_table(spark):
    aligned = alignment.align_texts(empty_docs(spark), BYTE_TOKENIZER, PIECE_TOKENIZER)
    assert alignment.count_links(aligned).collect() == []
