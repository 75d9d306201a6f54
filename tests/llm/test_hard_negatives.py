"""Hard negatives against all inner products in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tremorline.llm import hard_negatives as hn

from .tables import SMALL, small

SCHEMA = "vec_id long, label int, embedding array<float>, v string, leaf int, row int"


def brute_force(rows, is_anchor):
    """``rows`` of (id, label, components); anchors, positives and windows as they are defined."""
    clean = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, (anchor, label, a) in enumerate(clean):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = []
        for j, (vec_id, other, b) in enumerate(clean):
            if i != j:
                score = sum(x * y for x, y in zip(a, b))
                scored.append((-score, math.inf if vec_id is None else vec_id, j, other))
        scored.sort()
        for minus, positive, _, _ in [s for s in scored if s[3] == label][:5]:
            best = -minus
            window = [s for s in scored if s[3] != label and 80 * best <= -100 * s[0] <= 100 * best]
            for rank, (score, negative, _, _) in enumerate(window[:5], 1):
                out.append((anchor, positive, rank, negative, best, -score))
    return sorted(out)


def mined(spark, rows, is_anchor):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = hn.mine(docs.repartition(3), is_anchor).collect()
    return sorted(
        tuple(math.inf if x is None else x for x in r) for r in got
    )


def clustered(n: int, seed: int, width: int = 8, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(6))
        v = centres[label if rng.random() < 0.7 else rng.integers(6)] + 0.3 * rng.normal(size=width)
        rows.append((i if ids is None else ids(i), label, [float(x) for x in v.astype(np.float32)]))
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    """Deep trees and many blocks on few rows."""
    for name, value in {
        "LEAF_ROWS": 20, "LEAF_SAMPLE": 4, "FANOUT": 4, "LEAST_BLOCK": 7, "ANCHOR_BLOCK": 3,
        "SAMPLE_ROWS": 150, "_STEP": 2,
    }.items():
        monkeypatch.setattr(hn, name, value)


def test_equals_all_products(spark, small_blocks):
    rows = clustered(500, 1)
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    assert got == brute_force(rows, lambda i: i % 10 == 0) and got


def test_ties_copies_and_bad_rows(spark, small_blocks):
    """A third of all rows is one vector, ids repeat or are null, vectors lack parts."""
    rng = random.Random(2)
    rows = clustered(240, 3, 4)
    one = rows[0][2]
    rows += [(1000 + i, i % 3, one) for i in range(160)]
    rows += [(5, 1, one), (5, 1, one), (None, 1, one), (None, 2, one), (10, 0, rows[10][2])]
    rows += [
        (2000, None, one), (2001, 1, None), (2002, 1, [1.0, None, 0.0, 0.0]),
        (2003, 1, [float("nan")] * 4), (2004, 2, [float("inf"), 0.0, 0.0, 0.0]), (2010, 1, []),
        (2020, 2, [0.5]), (2030, 1, [-0.5, 0.0, 0.0, 0.0]), (2040, 1, [3e38, 0.0, 0.0, 0.0]),
    ]
    rng.shuffle(rows)
    kept = [(i, l, (v + [0.0] * 4)[:4] if v is not None else v) for i, l, v in rows]
    kept = [r for r in kept if r[0] != 2040]  # its squared length does not fit a long
    assert mined(spark, rows, F.col("vec_id") % 5 == 0) == brute_force(kept, lambda i: i % 5 == 0)


def test_large_components_are_exact(spark, small_blocks):
    rows = [(i, l, [x * 2.0**18 for x in v]) for i, l, v in clustered(60, 4, 3)]
    assert mined(spark, rows, F.col("vec_id") % 5 == 0) == brute_force(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("rows", [[], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(3, None, None)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows, F.col("vec_id") % 5 == 0) == []


def test_tree_leaves_nothing_out():
    """Every row of an annulus is in a reached leaf; far leaves are left out."""
    x = np.array([v for _, _, v in clustered(2000, 6)]) * 100
    x = np.floor(x).astype(np.int64)
    most = float((x * x).sum(axis=1).max()) + 1
    lifted = hn._lifted(x, most)
    tree = hn.fit_tree(lifted[::4], most, 16)
    leaf, met = hn.descend(tree, lifted)
    bounds = [np.full((2, *(len(t.points),) * 2), np.inf) for t in tree.nodes]
    for b in bounds:
        b[1] = -np.inf
    for node, child, distance in met:
        for k in np.unique(child).tolist():
            bounds[node][0][:, k] = distance[child == k].min(axis=0)
            bounds[node][1][:, k] = distance[child == k].max(axis=0)
    tree = tree._replace(ranges=bounds)
    visits = []
    for a in range(0, 2000, 40):
        scores = x @ x[a]
        high = int(np.sort(scores[leaf != leaf[a]])[-20])
        low = int(0.95 * high)
        near, far = hn._annuli(x[a], most, np.array([low], float), np.array([high], float))
        found = hn.reached(tree, hn._flat(x[a : a + 1])[0], near, far)
        inside = (scores >= low) & (scores <= high)
        assert set(leaf[inside].tolist()) <= set(found)
        visits.append(len(found))
    assert np.mean(visits) < 0.8 * len(np.unique(leaf))


def test_query_equals_plain_python(spark):
    rows = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, v)
        for i, v, label in small("embeddings", "vec_id", "embedding", "label")
    ]
    got = sorted(tuple(r) for r in contract.queries()["op12_hard_negatives"](spark, SMALL).collect())
    assert got == brute_force(rows, lambda i: i % 100 == 0) and got
