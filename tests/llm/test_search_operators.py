"""Fingerprints, licenses, Jaccard join, leaks and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tremorline.llm.bytetext import text_bytes
from tremorline.llm import decontaminate, jaccard_join, license_scan, order_minhash
from tremorline.llm.components import connected_components
from tremorline.llm.license_rules import STEMS, all_rules

from .tables import EDGE_TEXTS, SMALL, edge_docs, empty_docs, small


def run(spark, name):
    return [r.asDict() for r in contract.queries()[name](spark, SMALL).collect()]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Order MinHash ------------------------------------------------------------


def check_fingerprints(rows, docs):
    """``docs``: (id, text) in order."""
    prints = {}
    assert len(rows) == len(docs)
    for k, (doc, text) in enumerate(docs):
        follow = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        match = [r for r in rows if r["doc_id"] == doc and r["n_chars"] == len(text)]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        r = next(r for r in match if r["edited_sha256"] == digest)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        parts = [re.findall("." * 8, r[c]) for c in ("fingerprint", "edited_fingerprint")]
        same = sum(a == b for a, b in zip(*parts, strict=True))
        assert r["near_edited"] == same / order_minhash.BINS
        assert 0 <= r["near_next"] <= 1
    return prints


def xx64(values):
    """Spark's xxhash64 of numbers and texts, one after the other."""
    state = 42
    for value in values:
        if isinstance(value, str):
            data = value.encode()
        else:
            data = int(value).to_bytes(8 if isinstance(value, np.int64) else 4, "little", signed=True)
        state = xxhash.xxh64_intdigest(data, state)
    return np.int64(state - (1 << 64) if state >> 63 else state)


def plain_fingerprint(text):
    """Order MinHash written out: occurrence-numbered k-mers, two smallest of a bin, in text order."""
    words = [xx64([w]) for w in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)]
    kmers = [xx64(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    low = (1 << 30) - 1
    seen, hashed = Counter(), []
    for place, kmer in enumerate(kmers):
        number = seen[int(kmer) & ~low]
        seen[int(kmer) & ~low] += 1
        hashed.append((int(xx64([kmer, number])) & ~low) | place)
    bins = defaultdict(list)
    for value in sorted(hashed):
        if len(bins[value >> 58]) < 2:
            bins[value >> 58].append(value)
    chosen = sorted(v for values in bins.values() for v in values)
    parts = []
    for number in range(-32, 32):
        at = sum(v >> 58 < number for v in chosen)
        picked = {(at + j) % len(chosen) for j in range(2)} if chosen else set()
        places = sorted(chosen[i] & low for i in picked)
        parts.append(int(xx64([kmers[p] for p in places])) & 0xFFFFFFFF if chosen else 0)
    return "".join(f"{p:08x}" for p in parts)


def test_fingerprints_equal_plain_python(spark):
    docs = sorted(small("documents", "doc_id", "text"))
    rows = run(spark, "op2_order_minhash")
    texts = dict(docs)
    rng = random.Random(5)
    odd = [*(t or "" for t in EDGE_TEXTS), "a b " * 400, "x\u00a0y \U0001f600 \u4e00" * 30, "one", "one two"]
    odd += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    for r in rows:
        assert r["fingerprint"] == plain_fingerprint(texts[r["doc_id"]] or ""), r["doc_id"]
    parts = frame(spark, odd).select(
        "text", order_minhash.as_text(order_minhash.components(F.col("text"))).alias("p")
    )
    for r in parts.collect():
        assert r["p"] == plain_fingerprint(r["text"]), r["text"][:50]


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    """Ranges of few documents, ids beyond what a double holds, repeated and null ids."""
    monkeypatch.setattr(order_minhash, "ROWS_PER_RANGE", 3)
    rng = random.Random(6)
    ids = [(1 << 62) + i for i in range(40)] + [-(1 << 62) - i for i in range(40)]
    ids += [None] * 20 + [5] * 20 + [(1 << 63) - 1] * 3 + list(range(40))
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(20))) for i in ids]
    rng.shuffle(docs)
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = [r.asDict() for r in order_minhash.fingerprints(made).collect()]
    for r in rows:
        r["doc_id"] = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
    check_fingerprints(rows, sorted((-(1 << 63) if d is None else d, t) for d, t in docs))


def test_fingerprint_query(spark):
    rows = run(spark, "op2_order_minhash")
    check_fingerprints(rows, sorted(small("documents", "doc_id", "text")))
    long = [r for r in rows if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9


def test_fingerprint_edges(spark):
    docs = [(-(1 << 63) if d is None else d, t or "") for d, t in _pairs(EDGE_TEXTS)]
    rows = [r.asDict() for r in order_minhash.fingerprints(edge_docs(spark)).collect()]
    for r in rows:
        r["doc_id"] = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
    check_fingerprints(rows, sorted(docs))
    assert order_minhash.fingerprints(empty_docs(spark)).collect() == []
    (one,) = order_minhash.fingerprints(frame(spark, ["a b c d e"])).collect()
    assert one["near_next"] == 1.0


def _pairs(texts):
    return [(None if i == 1 else min(i, 9), t) for i, t in enumerate(texts)]


def test_fingerprints_follow_order_and_occurrence(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    moved = words[150:] + words[:150]
    changed = [w if rng.random() > 0.05 else "new" for w in words]
    twice = words + words
    texts = [" ".join(w) for w in (words, words, moved, changed, twice)]
    parts = frame(spark, texts).select("doc_id", order_minhash.components(F.col("text")).alias("p"))
    p = {r["doc_id"]: r["p"] for r in parts.collect()}

    def like(a, b):
        return sum(x == y for x, y in zip(p[a], p[b], strict=True)) / len(p[a])

    assert like(0, 1) == 1
    # The halves in another order have the same k-mers, but not the same pairs in order.
    assert 0.3 < like(0, 2) < 0.75
    assert 0.4 < like(0, 3) < 1
    # Second occurrences are k-mers of their own.
    assert like(0, 4) < 0.6


# Licenses -----------------------------------------------------------------


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places_of(words, phrase):
    parts = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(parts)] == parts]


def labels_of(words, rules):
    joined = f" {' '.join(words)} "
    hits = [
        (m.start(), m.end(), r.priority, k, r.label)
        for k, r in enumerate(rules)
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined)
    ]

    def covered(d):
        return any(
            e[0] <= d[0]
            and e[1] >= d[1]
            and (
                e[2] < d[2]
                or e[2] == d[2]
                and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3])
            )
            for e in hits
        )

    return {d[4] for d in hits if not covered(d)}


def check_licenses(rows, docs):
    rules = all_rules()
    expected = defaultdict(list)
    for doc, text in docs:
        words = words_of(text)
        places = {label: places_of(words, p) for p, label in license_scan.PHRASES}
        starts = sum(places.values(), [])
        base = {label for label, found in places.items() if found}
        expected[doc].append(
            (
                len(words),
                len(starts),
                min(starts, default=None),
                max(starts, default=None),
                ",".join(sorted(base)),
                ",".join(sorted(base | labels_of(words, rules))),
            )
        )
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(tuple(r[c] for c in names))
        assert 0 <= r["score"] <= 1
    assert {k: sorted(v, key=str) for k, v in found.items()} == {
        k: sorted(v, key=str) for k, v in expected.items()
    }


def test_license_query(spark):
    check_licenses(run(spark, "op4_license_scan"), small("documents", "doc_id", "text"))


LICENSES = [
    *EDGE_TEXTS,
    "CC-BY cc by CC\nBY, cc.by-sa 4.0",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "GNU Lesser General Public License version 2.1 or later; GNU GPL v3",
    "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: BSD-3-Clause",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 and CC0 1.0 Universal",
    "general public license general public license",
    "Copyright 2020 Foo Bar. All rights reserved. Without warranty of any kind.",
    "licence libre; la licencia MIT; publicdomain; released into the public domain",
    "All rights reserved. " * 3000,
    "acc bye cc bys",
]


def test_license_edges(spark):
    docs = edge_docs(spark, LICENSES)
    rows = [r.asDict() for r in license_scan.scan_licenses(docs).collect()]
    check_licenses(rows, [(None if i == 1 else min(i, 9), t) for i, t in enumerate(LICENSES)])
    assert rows[0].keys() >= {"ids", "lang", "hits"}
    assert license_scan.scan_licenses(empty_docs(spark)).collect() == []


def test_rules_pass_their_gates():
    """Every rule's match has its keyword and one of the stems, tried on a sample match."""
    rules = all_rules()
    assert len(rules) >= 300
    for rule in rules:
        text = rule.pattern
        while True:  # take the first of each group, nothing of what is optional
            new = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?|\{[0-9,]+\})?", _first, text)
            if new == text:
                break
            text = new
        text = re.sub(r"\[sc\]", "s", text).replace("\\S+", "x").replace("?", "")
        text = text.split("|")[0]
        assert re.search(rule.pattern, text), (rule, text)
        assert any(all(part in text for part in stem) for stem in STEMS), (rule, text)


def matches(parsed):
    """Texts that a parsed pattern matches: every alternative, with and without options."""
    texts = [""]
    for kind, value in parsed:
        if kind is re._constants.LITERAL:
            more = [chr(value)]
        elif kind is re._constants.IN:
            more = [chr(value[0][1])] if value[0][0] is re._constants.LITERAL else ["x"]
        elif kind is re._constants.NOT_LITERAL:
            more = ["x"]
        elif kind is re._constants.BRANCH:
            more = [t for branch in value[1] for t in matches(branch)]
        elif kind is re._constants.SUBPATTERN:
            more = matches(value[3])
        else:
            assert kind is re._constants.MAX_REPEAT
            more = [t * n for n in {value[0], value[0] + 1} for t in matches(value[2])]
        texts = [t + m for t in texts for m in more]
    return texts


def test_keywords_stand_in_every_alternative():
    """The rule's own, or that of a rule that is as strong and takes the same text (mpl, psf)."""
    rules = all_rules()
    for rule in rules:
        for text in matches(re._parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text), (rule, text)
            assert f" {rule.keyword} " in f" {text} " or any(
                f" {r.keyword} " in f" {text} " and re.fullmatch(r.pattern, text)
                for r in rules
                if r.priority <= rule.priority
            ), (rule, text)


def test_licenses_by_each_name(spark):
    texts = {
        "SPDX-License-Identifier: EUPL-1.2": "eupl-1.2",
        "under the ODbL license": "odbl",
        "the Open RAIL-M license": "openrail",
        "the Open RAIL license": "openrail",
        "General Public License version 2": "gpl,gpl-2",
        "GNU Lesser General Public License 3.0": "gpl,lgpl-3.0",
        "Affero General Public License version 2": "agpl-2,gpl",
    }
    rows = license_scan.scan_licenses(frame(spark, list(texts))).collect()
    assert {r["text"]: r["labels"] for r in rows} == texts
    check_licenses([r.asDict() for r in rows], list(enumerate(texts)))


BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:\n1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions "
    "in binary form must reproduce the above copyright notice, this list of conditions."
)
ADVERTISING = (
    " 3. All advertising materials mentioning features or use of this software must display the "
    "following acknowledgement: This product includes software developed by the Org."
)
ENDORSE = (
    " Neither the name of the Org nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction"
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted"
)
GNU = (
    "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version."
)


def test_licenses_by_their_texts(spark):
    texts = {
        MIT: "mit",
        MIT.split(" and associated")[0]: "mit",
        MIT.replace("deal in", "deal with"): "ncsa",
        BSD_2.split(" are permitted")[0]: "bsd",
        BSD_2: "bsd-2-clause",
        BSD_2 + ENDORSE: "bsd-3-clause",
        BSD_2 + ADVERTISING + ENDORSE: "bsd-4-clause",
        ENDORSE: "bsd-3-clause",
        ISC + ".": "0bsd",
        ISC + ", provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose": "hpnd",
        "You may obtain a copy of the License at\n\n   http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "obtain a copy of the License at apache.org/licenses/LICENSE-2.0": "apache-2.0",
        GNU.format("General Public", 2): "gpl,gpl-2.0-or-later",
        GNU.format("Lesser General Public", "2.1"): "gpl,lgpl-2.1-or-later",
        GNU.format("Affero General Public", 3): "agpl-3.0-or-later,gpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, "
        "but changing it is not allowed.": "gnu",
        "No part of this book may be reproduced.": "reserved",
        # Only parts, or the words in another order.
        "permission is granted to any person; use in source and binary forms": "",
        "binary forms and source in use and redistribution": "",
        "good software, not evil": "",
    }
    rows = license_scan.scan_licenses(frame(spark, list(texts))).collect()
    assert {r["text"]: r["labels"] for r in rows} == texts
    check_licenses([r.asDict() for r in rows], list(enumerate(texts)))


def test_texts_between_other_words(spark):
    """Repeated starts without an end, and texts in the midst of long ones."""
    rng = random.Random(8)
    noise = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(400)) for _ in range(3)]
    texts = [
        "redistribution and use in source and binary forms " * 200,
        f"{noise[0]} {BSD_2}{ENDORSE} {noise[1]} {MIT} {noise[2]}",
        f"{BSD_2} {noise[0]} {ENDORSE}",
        f"{MIT} " * 50,
    ]
    rows = [r.asDict() for r in license_scan.scan_licenses(frame(spark, texts)).collect()]
    check_licenses(rows, list(enumerate(texts)))
    assert [r["labels"] for r in rows] == ["", "bsd-3-clause,mit", "bsd-2-clause,bsd-3-clause", "mit"]


def _first(m):
    return "" if m[2] == "?" else m[1]


# Jaccard join -------------------------------------------------------------


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(docs):
    """(n, component) per row, by all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[find(i)].append(doc)
    return [
        (doc, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None))
        for i, (doc, _) in enumerate(docs)
    ]


def found_components(docs):
    rows = jaccard_join.jaccard_components(docs).collect()
    return sorted(((r[0], r[1], r[2]) for r in rows), key=str)


def test_jaccard_query(spark):
    rows = run(spark, "op6_jaccard_join")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert found == sorted(brute_components(small("documents", "doc_id", "text")))


def near_texts(seed=1):
    """Families of near copies, large and small, shared passages, chains of edits."""
    rng = random.Random(seed)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]

    def edit(text, share):
        return [w if rng.random() > share else f"e{rng.randint(0, 9999)}" for w in text]

    passage = words(60)
    texts = []
    for size, copies, share in ((40, 60, 0.01), (300, 50, 0.008), (90, 6, 0.02), (700, 5, 0.01)):
        base = words(size)
        texts += [edit(base, share * rng.random() * 2) for _ in range(copies)]
    texts += [words(rng.randint(5, 20)) + passage for _ in range(60)]
    texts += [words(rng.randint(100, 200)) + passage for _ in range(40)]
    chain = words(120)
    for _ in range(25):
        chain = edit(chain, 0.012)
        texts.append(chain)
    texts += [passage, passage, passage[:58], words(3), [], words(200)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("size", "block"), [(32, 1 << 19), (3, 2000), (1, 300)])
def test_jaccard_near_copies(spark, monkeypatch, size, block):
    monkeypatch.setattr(jaccard_join, "LIST_SIZE", size)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    texts = near_texts(size)
    docs = list(enumerate(texts))
    expected = sorted(brute_components(docs), key=str)
    assert found_components(frame(spark, texts).repartition(5)) == expected


def passages_in_long_lists(low: int, high: int, seed: int, hosts: int) -> list[str]:
    """Passages of about so many shingles, alone and with own words up to the limit of
    similarity; overlapping thirds of each stand in ``hosts`` other documents."""
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    texts = []
    for _ in range(5):
        n = rng.randint(low, high)
        passage = words(n + 4)
        third = -(-n // 3)
        texts.append(passage)
        # 100 * n >= 80 * (n + own)
        for own in (n // 4, n // 4 - rng.randint(0, n // 20), n // 4 + 1):
            texts.append(passage + words(own))
        for at in range(0, n, third):
            texts += [passage[at : at + third + 4] + words(15) for _ in range(hosts)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("bounds", [(40, 70), (240, 330), (480, 650), (1900, 2600)])
def test_jaccard_around_the_steps_of_the_part(spark, monkeypatch, bounds):
    """Links that stand in long lists alone, between sets compared on parts of other shares."""
    monkeypatch.setattr(jaccard_join, "LIST_SIZE", 3)
    docs = list(enumerate(t for seed in range(2) for t in passages_in_long_lists(*bounds, seed, 5)))
    expected = sorted(brute_components(docs), key=str)
    assert len({c for _, _, c in expected}) < len(docs)
    assert found_components(frame(spark, [t for _, t in docs]).repartition(3)) == expected


def test_jaccard_partner_that_is_compared_on_a_smaller_part(spark):
    """A passage whose shingles are all long, and a longer text that finds its own partners:
    it has few long lists on the part that it asks in, enough on the one it is listed on."""
    rng = random.Random(4)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    passage = words(54)
    known = set(_shingles(passage))
    while True:
        longer = passage + words(12)
        own = np.array(sorted(set(_shingles(longer)) - known))
        if (own < jaccard_join._under(62 + 62 // 4 + 1)).sum() >= 8:
            break
    texts = [passage, longer]
    texts += [passage[a:b] + words(15) for a, b in ((0, 22), (18, 40), (32, 54)) for _ in range(40)]
    found = found_components(frame(spark, [" ".join(t) for t in texts]))
    assert [c for i, _, c in found if i in (0, 1)] == [0, 0]
    assert len({c for _, _, c in found}) == len(texts) - 1


def _shingles(words):
    data, offsets = text_bytes(pa.array([" ".join(words)]))
    return next(jaccard_join.shingle_sets(data, offsets)).tolist()


def test_jaccard_edges(spark):
    docs = _pairs(EDGE_TEXTS)
    expected = sorted(brute_components(docs), key=str)
    found = found_components(edge_docs(spark))
    assert found == expected
    assert found_components(empty_docs(spark)) == []


def test_merge_count():
    assert jaccard_join.merge_count([[1, 3, 9], [3, 4], [3, 9]], 2) == [(3, 3), (9, 2)]


def test_components_of_a_long_chain(spark):
    rng = random.Random(0)
    names = rng.sample(range(-500, 500), 300)
    links = list(zip(names[:200], names[1:200], strict=False))
    links += list(zip(names[200:], names[201:], strict=False)) + [(names[0], names[0])]
    roots = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {n: min(names[:200]) for n in names[:200]}
    expected |= {n: min(names[200:]) for n in names[200:]}
    assert {r["node"]: r["root"] for r in roots} == expected


# Leaks --------------------------------------------------------------------


def leak_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_leak_query(spark):
    items = {i: leak_words(t) for i, t in small("benchmark", "item_id", "text")}
    expected = set()
    for doc, text in small("documents", "doc_id", "text"):
        joined = f" {' '.join(leak_words(text))} "
        expected |= {(doc, i) for i, w in items.items() if f" {' '.join(w)} " in joined}
    found = {(r["doc_id"], r["item_id"]) for r in run(spark, "op8_decontamination")}
    assert expected and expected <= found
    assert {d for d, _ in found} == {d for d, _ in expected}


def test_paraphrased_leaks(spark):
    """Items with every seventh word replaced are found; unrelated texts are not."""
    rng = random.Random(8)
    items = [(i, t) for i, t in small("benchmark", "item_id", "text")]
    pool = [w for _, t in items for w in t.split()]
    docs = []
    for i, text in items:
        words = [w if k % 7 else "changed" for k, w in enumerate(text.split(), 1)]
        filler = [rng.choice(pool) for _ in range(150)]
        docs.append((i, " ".join([*filler[:75], *words, *filler[75:]]).upper()))
    docs += [(1000 + i, " ".join(rng.choice(pool) for _ in range(200))) for i in range(100)]
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    right = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}
    assert len(right) >= 0.9 * len(items)
    assert not [r for r in found if r["doc_id"] >= 1000]


def test_leaks_of_a_large_benchmark(spark):
    """Far more items than a latent space has room for, verbatim and with words replaced."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(20, 50)))) for i in range(1000)]
    docs = []
    for i, text in items[::5]:
        words = [w if (i // 5) % 2 or k % 7 else "changed" for k, w in enumerate(text.split(), 1)]
        docs.append((i, " ".join([*rng.choices(pool, k=70), *words, *rng.choices(pool, k=90)])))
    docs += [(5000 + i, " ".join(rng.choices(pool, k=200))) for i in range(50)]
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i, _ in items[::5]}


def test_leaks_of_short_and_long_items(spark):
    rng = random.Random(13)
    pool = [f"w{i}" for i in range(3000)]
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 70, 130, 300, 450, 600, 1500] * 4
    items = [(i, " ".join(f"{w}x" if n < 4 else w for w in rng.choices(pool, k=n)))
             for i, n in enumerate(sizes)]
    docs = []
    for i, text in items:
        words = text.split()
        if len(words) > 64 and i % 2:  # a paraphrase with no eight words in a row
            words = [w if k % 7 else "changed" for k, w in enumerate(words, 1)]
        docs.append((i, " ".join([*rng.choices(pool, k=205), *words, *rng.choices(pool, k=331)])))
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i, _ in items}
    assert all(r["cosine"] > 0 for r in found)


def test_space_is_fitted_on_all_documents(spark):
    """All windows of more documents than were once sampled, with few main directions."""
    rng = random.Random(14)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=n)) for n in (9, 33, 70, 200) * 10]
    docs = spark.createDataFrame(
        [(i, texts[i % len(texts)]) for i in range(2000)] + [(2000, None)],
        "doc_id long, text string",
    )
    idf = np.random.default_rng(1).uniform(1, 5, decontaminate.BUCKETS)
    right, windows = np.zeros((decontaminate.BUCKETS, 5)), 0
    probe = np.random.default_rng(2).standard_normal(right.shape)
    for text in texts:
        words = decontaminate._of_text(text)
        ends = np.array([0, len(words)])
        starts, first, past = decontaminate._windows(ends)
        stops = np.append(starts, len(words))
        for a, b in zip(stops[first], stops[past], strict=True):
            cells = decontaminate._bucket(words[a:b])
            row = np.zeros(decontaminate.BUCKETS)
            np.add.at(row, cells, idf[cells])
            row /= np.sqrt((idf[cells] ** 2).sum())  # as windows are weighted in a scan
            right += 50 * np.outer(row, row @ probe)
            windows += 50
    factor, n = decontaminate.fit_corpus(docs, idf)
    assert n == windows > 2000
    got = factor.astype(float) @ (factor.T @ probe)
    assert np.linalg.norm(got - right) < 0.2 * np.linalg.norm(right)


def test_sum_over_windows(monkeypatch):
    """The product with the thin matrix, whatever the steps, of texts of all lengths."""
    rng = random.Random(15)
    texts = [" ".join(rng.choices("abcdefghij", k=n)) for n in (0, 1, 15, 16, 17, 33, 64, 65, 300)]
    monkeypatch.setattr(decontaminate, "STEP", 8)
    monkeypatch.setattr(decontaminate, "SPACE_BLOCKS", 3)
    parts = [decontaminate._of_text(t) for t in texts]
    words = decontaminate._Words(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    idf = np.random.default_rng(1).uniform(1, 5, decontaminate.BUCKETS)
    thin = decontaminate._thin(idf)
    total = np.zeros((decontaminate.BUCKETS, thin.shape[1] - 1), np.float32)
    n = decontaminate.add_passages(words, thin, total)
    starts, first, past = decontaminate._windows(words.ends)
    stops, right = np.append(starts, len(words.hashes)), np.zeros(total.shape)
    for a, b in zip(stops[first], stops[past], strict=True):
        cells = decontaminate._bucket(words.hashes[a:b])
        vector = thin[cells].sum(axis=0)
        np.add.at(right, cells, idf[cells, None] * vector[:-1] / vector[-1])
    assert n == len(first)
    assert np.allclose(total, right, rtol=1e-3, atol=1e-2)


def test_near_windows(monkeypatch):
    """All pairs of a window and an item, whatever the steps, for windows of all lengths."""
    rng = random.Random(16)
    monkeypatch.setattr(decontaminate, "STEP", 8)
    pool = [f"w{i}" for i in range(60)]
    sizes = [20, 30, 100, 150, 300]
    items = decontaminate.read_items([(i, " ".join(rng.choices(pool, k=n))) for i, n in enumerate(sizes)])
    parts = [
        decontaminate._of_text(" ".join(rng.choices(pool, k=n)))
        for n in (0, 1, 15, 16, 17, 33, 64, 65, 3, 300, 20, 1000)
    ]
    words = decontaminate._Words(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    idf = np.random.default_rng(1).uniform(1, 5, decontaminate.BUCKETS)
    thin = decontaminate._thin(idf)
    product = np.zeros((decontaminate.BUCKETS, thin.shape[1] - 1), np.float32)
    n = decontaminate.add_passages(words, thin, product)
    space, groups, _, _ = decontaminate._prepared(product, n, items, idf)
    # No more columns than items, however many directions the spaces have.
    assert space.shape == (decontaminate.BUCKETS + 1, len(items) + 1)
    found, cosines = decontaminate.near_windows(words, space, groups, near=0.3)
    got = {tuple(row): c for row, c in zip(found.tolist(), cosines.tolist(), strict=True)}
    right = {}
    for level, numbers in decontaminate._shares(items):
        own = [items[k] for k in numbers.tolist()]
        turn = decontaminate.fit_space(product, n, own, idf)
        starts, first, past = decontaminate._windows(words.ends, level)
        stops = np.append(starts, len(words.hashes))
        for a, b in zip(stops[first].tolist(), stops[past].tolist(), strict=True):
            cells = decontaminate._bucket(words.hashes[a:b])
            place = idf[cells] @ turn[cells].astype(float) / np.sqrt((idf[cells] ** 2).sum())
            for k, item in zip(numbers.tolist(), own, strict=True):
                cell, weight = decontaminate._weighted(item.words, idf)
                right[a, b, k] = float(place @ (weight @ turn[cell]))
    assert got and got.keys() <= right.keys()
    assert all(abs(right[key] - c) < 1e-3 for key, c in got.items())
    assert all(c < 0.3 + 1e-3 for key, c in right.items() if key not in got)


def test_overlapping_windows():
    """Groups are those of a walk over the windows of a text and an item."""
    rng = np.random.default_rng(17)
    ends = np.array([0, 50, 50, 300])
    for _ in range(50):
        text = rng.choice([0, 2], 40)
        first = np.where(text == 0, rng.integers(0, 40, 40), rng.integers(50, 280, 40))
        past = np.minimum(first + rng.integers(1, 20, 40), ends[text + 1])
        item = rng.integers(0, 3, 40)
        order = np.lexsort((first, item, text))
        text, first, past, item = text[order], first[order], past[order], item[order]
        around = np.array([2, 9, 30])[item]
        right, before, end = [], None, 0
        for i in range(40):
            if (text[i], item[i]) != before or first[i] - around[i] >= end:
                right.append([i, i, max(first[i] - around[i], ends[text[i]]), 0])
                before, end = (text[i], item[i]), 0
            end = max(end, past[i] + around[i])
            right[-1][1], right[-1][3] = i + 1, min(end, ends[text[i] + 1])
        got = decontaminate._surroundings(text, item, first, past, around, ends)
        assert [list(row) for row in zip(*got, strict=True)] == right


def test_rows_without_leaks(spark, monkeypatch):
    """A row is judged where it is read: no copy of the texts, no shuffle; also in blocks of items."""
    items = small("benchmark", "item_id", "text")[:30]
    docs = [(None if i % 3 else 1, f"before {t} after", i) for i, (_, t) in enumerate(items)]
    docs += [(1, "nothing of the kind", 100), (None, None, 101), (2, "", 102)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, own int")
    few = spark.createDataFrame(items[:10], "item_id long, text string")
    stored = []
    monkeypatch.setattr(corpus_pipeline, "stored", lambda *args: stored.append(args))
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda *_: few)
    kept = corpus_pipeline.not_in_benchmark(spark, docs, "")
    assert not stored
    assert "Exchange" not in kept._jdf.queryExecution().toString()
    assert kept.schema == docs.schema
    assert sorted(r["own"] for r in kept.collect()) == [*range(10, 30), 100, 101, 102]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    assert sorted(r["own"] for r in decontaminate.without_leaks(docs, few).collect()) == [
        *range(10, 30), 100, 101, 102
    ]


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = (
                    table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
                )
        found = decontaminate.common_subsequence(np.array(a, int), np.array(b, int))
        assert found == table[-1][-1]


def test_leak_edges(spark):
    docs = edge_docs(spark, [*EDGE_TEXTS, "It is said: the same text twice, it is."])
    items = spark.createDataFrame(
        [(1, None, 2), (2, "", 2), (3, "... !", 2), (4, "The same text twice.", 2), (None, "a", 2)],
        "item_id long, text string, doc_id int",
    )
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {(4, 4), (5, 4), (9, 4), (3, None)}
    assert decontaminate.find_leaks(empty_docs(spark), items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []


# Pipeline -----------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.withColumns({"score": F.lit(7), "lang_pred": F.lit("own")})
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        kept = stage(spark, docs, SMALL)
        if number == len(corpus_pipeline.STAGES) - 1:
            assert kept.count() == len(rows)
            break
        assert kept.columns == columns, name
        path = str(tmp_path / str(number))
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        assert set(after) <= set(rows)
        if name == "near-duplicates":
            groups = brute_components([(r["doc_id"], r["text"]) for r in rows])
            assert {r["doc_id"] for r in after} == {g[2] for g in groups}
        else:
            assert len(after) >= 0.6 * len(rows)
    assert len(corpus_pipeline.STAGES) == 5
    final = contract.queries()["pipeline"](spark, SMALL)
    assert final.columns == ["doc_id", "n_tokens", "ids"] and final.count() > 100


def test_pipeline_keeps_rows_that_share_an_id(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    other = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, other[0]), (None, other[1]), (None, ""), (7, other[2]), (7, other[3])]
    rows += [(7, other[0]), (3, other[3]), (9, other[4]), (9, other[4]), (None, other[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()
    expected = [(None, other[1]), (None, ""), (7, other[2]), (3, other[3])]
    expected += [(7, other[0]), (9, other[4]), (None, other[5])]
    assert sorted(map(tuple, kept), key=str) == sorted(expected, key=str)
    leaked = [*rows, (7, f"x y {passage} z"), (None, passage)]
    docs = spark.createDataFrame(leaked, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.not_in_benchmark(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows, key=str)


def test_pipeline_edges(spark, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items = spark.createDataFrame([(1, "Nothing of the sort.")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        n = docs.count()
        assert corpus_pipeline.token_ids(spark, docs, str(tmp_path)).count() == n


@pytest.mark.parametrize("contracted", [1, 7, 1 << 18])
def test_components_of_random_links(spark, monkeypatch, contracted):
    from tremorline.llm import components

    monkeypatch.setattr(components, "CONTRACTED", contracted)
    rng = random.Random(contracted)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)]
    links += [(5, 5), (None, 3), (4, None), (200, 201), (200, 201)]
    least = {n: n for pair in links if None not in pair and pair[0] != pair[1] for n in pair}
    for _ in least:
        for a, b in links:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(links, "a long, b long").repartition(4)
    found = connected_components(table).collect()
    assert {r.node: r.root for r in found} == least and len(found) == len(least)
