"""Best-fit packing against a plain search, and its pieces against the tokenizer's ids."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from tremorline.llm import packing
from tremorline.llm.queries import WORD_TOKENIZER

from .tables import EDGE_TEXTS, SMALL, edge_docs, empty_docs, small


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_room_tree_finds_the_tightest():
    rng = random.Random(5)
    tree, rooms = packing.RoomTree(100), Counter()
    for step in range(3000):
        need = rng.randrange(1, 101)
        fits = [r for r, n in rooms.items() if n and r >= need]
        found = tree.tightest(need)
        assert found == (min(fits) if fits else None)
        if found is not None and rng.random() < 0.6:
            tree.take(found)
            rooms[found] -= 1
        else:
            tree.add(need, step)
            rooms[need] += 1


def best_fit(sizes: list[int], window: int) -> list[int]:
    """The used lengths of best fit decreasing, by looking at every sequence."""
    used: list[int] = []
    for size in sorted((s % window for s in sizes if s % window), reverse=True):
        fits = [i for i, u in enumerate(used) if u + size <= window]
        if fits:
            used[max(fits, key=lambda i: used[i])] += size
        else:
            used.append(size)
    return sorted(used)


def padding(length: int, window: int) -> int:
    return 0 if length.bit_count() == 1 else window - length


@pytest.mark.parametrize("seed", range(30))
def test_pack(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 4096])
    sizes = [rng.randrange(1, rng.choice([5, window, 4 * window])) for _ in range(rng.randrange(200))]
    # No gap is filled: plain best fit, with the full windows before it.
    plain = packing.pack(sizes, window, least_gap=window)
    full = sum(s // window for s in sizes)
    assert sorted(sum(p[2] for p in s) for s in plain[full:]) == best_fit(sizes, window)

    sequences = packing.pack(sizes, window, least_gap=2)
    covered = defaultdict(list)
    for sequence in sequences:
        assert 1 <= sum(p[2] for p in sequence) <= window
        assert padding(sum(p[2] for p in sequence), window) < 2
        for doc, start, length in sequence:
            covered[doc].append((start, length))
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at and length > 0
            at += length
        assert at == size


def check(pieces, texts, ids_of) -> list[int]:
    """Every id of every text in exactly one piece; sequences without gaps. Their lengths."""
    wanted = Counter(tuple(ids_of(t)) for t in texts)
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids)
        sequences[p.sequence_id].append(p)
    lengths = []
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
        lengths.append(at)
    # Pieces of equal documents under one id may be swapped: compare by content.
    starts = Counter()
    for ids, n in wanted.items():
        for cut in range(len(ids)):
            starts[(cut, ids[cut], len(ids))] += n
    found = Counter(
        (p.start + k, i, p.doc_tokens) for p in pieces for k, i in enumerate(p.ids)
    )
    assert found == starts
    return lengths


@pytest.mark.parametrize("group_tokens", [1, 5000, 1 << 21])
def test_edge_rows(spark, ids_of, monkeypatch, group_tokens):
    monkeypatch.setattr(packing, "GROUP_TOKENS", group_tokens)
    docs = edge_docs(spark).withColumnRenamed("labels", "offset").withColumn("start", docs_one())
    pieces = packing.pack_documents(docs, WORD_TOKENIZER)
    lengths = check(pieces.collect(), EDGE_TEXTS, ids_of)
    assert max(padding(n, packing.WINDOW) for n in lengths) < packing.LEAST_GAP
    rows = packing.sequences_of(pieces).collect()
    assert sorted(len(r.ids) for r in rows) == sorted(lengths)
    assert all(sum(r.pieces) == len(r.ids) for r in rows)


def docs_one():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_empty_table(spark):
    assert packing.pack_documents(empty_docs(spark), WORD_TOKENIZER).collect() == []


def test_query_equals_plain_python(spark, ids_of):
    texts = dict(small("documents", "doc_id", "text"))
    got = contract.queries()["op11_packing"](spark, SMALL).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert pieces.keys() == texts.keys()
    for doc_id, found in pieces.items():
        ids, at = ids_of(texts[doc_id]), 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            part = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    lengths = []
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths.append(at)
    total = sum(lengths)
    assert max(lengths) <= 4096
    assert sum(padding(n, 4096) for n in lengths) < 0.002 * total
