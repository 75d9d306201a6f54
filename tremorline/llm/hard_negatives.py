"""Hard negatives: rows of other labels that score a little below an anchor's positives.

Vectors are rounded down to integers, a score is an inner product. One more
coordinate gives all rows the same length; then a higher score with an anchor
is a smaller distance from it, and a window of scores is an annulus.

The index is a multiway hyperplane tree after GNAT. A node has a few split points
that lie far apart, and a row goes to the nearest. For each split point and
each sibling subtree the node knows the least and the largest distance from the
point to the rows of the subtree. A subtree is left out if, by the range of any split
point and the triangle inequality, it has no row in any of an anchor's annuli. The tree is fitted
on a bounded sample; all rows are placed in it, and its ranges hold over all.

Leaves are searched exactly: a leaf's rows and the anchors that reach it are dealt into blocks
of bounded size, and each block of anchors meets each block of rows. So a leaf
with a third of all rows, or one that all anchors reach, is many small tasks.

First the positives are found, the best of an anchor's label, then the negatives in the
windows under them. The sample also bounds both from below: once it has enough
rows in a window, lower scores cannot be among the first.

Edge cases: rows with a null label or vector, or with a null or non-finite
component, take no part, nor do those whose squared length is 2**62 or more, as
their scores would not fit a long. Shorter vectors are filled up with zeros.
Repeated rows are rows of their own, also as anchors; those that differ in neither
score nor id rank in any order. A null id ranks last and is no anchor. An
empty table gives none. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import stored

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
LOWEST = 80  # of 100, the least share of the positive's score

# The sample is collected and broadcast: at most so many rows and bytes, about.
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 8 << 20

FANOUT = 8
LEAF_ROWS = 1024  # that a leaf should have, as far as the sample can tell
LEAF_SAMPLE = 32  # rows of the sample in a leaf at least

# Rows and anchors that meet in one task.
ROW_BLOCKS = 256  # at least so many in all, if they have ...
LEAST_BLOCK, MOST_BLOCK = 512, 8192  # ... no fewer and no more rows than this
ANCHOR_BLOCK = 1024
_STEP = 128

_MOST_SQUARE = 2.0**62
_EXACT = 2.0**53
_NO_ID = np.iinfo(np.int64).max

_ROW = "row long, vec_id long, label long, v binary"
_MEETING = "leaf int, row long, vec_id long, label long, v binary, windows array<long>, floors array<long>"
_MET = "row long, positive int, score long, vec_id long, met_row long"


class Node(NamedTuple):
    """Split points, and for each the number of its child (leaves count from -1 down)."""

    points: np.ndarray
    children: list[int]


class Tree(NamedTuple):
    """``ranges[node][i, j]`` is the least and largest distance from split point i to subtree j."""

    nodes: list[Node]
    ranges: list[np.ndarray]
    most: float  # the square of the length that all rows are brought to


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The integer vectors of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0), np.int64)
    _, ends, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(ends, width)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.int64, count=(ends[-1] - ends[0]) // 8, offset=ends[0]).reshape(n, -1)


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Rows with the coordinate that gives them all the same length."""
    v = v.astype(np.float64)
    rest = np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))
    return np.concatenate([v, rest[:, None]], axis=1)


def _flat(v: np.ndarray) -> np.ndarray:
    """Anchors in the same space, without the further coordinate."""
    return np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def _slack(most: float) -> float:
    """More than rounding can add to a distance."""
    return 1e-6 * (1 + np.sqrt(most))


def fit_tree(sample: np.ndarray, most: float, leaf_sample: int) -> Tree:
    """Split points for a sample of lifted rows; no node below ``leaf_sample`` rows is split."""
    rng = np.random.default_rng(7)
    nodes: list[Node] = []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        candidates = rows[rng.permutation(len(rows))[: 4 * FANOUT]] if len(rows) > leaf_sample else []
        points = _far_apart(sample[candidates]) if len(candidates) else np.zeros((0, 0))
        if len(points) < 2:
            leaves += 1
            return -leaves
        nearest = _distances(sample[rows], points).argmin(axis=1)
        number = len(nodes)
        nodes.append(Node(points, []))
        nodes[number].children.extend(split(rows[nearest == k]) for k in range(len(points)))
        return number

    split(np.arange(len(sample)))
    return Tree(nodes, [], most)


def _far_apart(candidates: np.ndarray) -> np.ndarray:
    """Up to ``FANOUT`` of the candidates, each the farthest from those before."""
    chosen = [0]
    nearest = _distances(candidates, candidates[:1])[:, 0]
    while len(chosen) < FANOUT:
        k = int(nearest.argmax())
        if nearest[k] <= 1e-3:
            break
        chosen.append(k)
        nearest = np.minimum(nearest, _distances(candidates, candidates[k : k + 1])[:, 0])
    return candidates[chosen]


def descend(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The leaf of each row; and per node its rows' children and distances to its split points."""
    leaf, met = np.full(len(x), -1, np.int64), []
    waiting = [(0, np.arange(len(x)))] if tree.nodes else []
    while waiting:
        number, rows = waiting.pop()
        if not len(rows):
            continue
        distance = _distances(x[rows], tree.nodes[number].points)
        nearest = distance.argmin(axis=1)
        met.append((number, nearest, distance))
        for k, child in enumerate(tree.nodes[number].children):
            if child < 0:
                leaf[rows[nearest == k]] = child
            else:
                waiting.append((child, rows[nearest == k]))
    return leaf, met


def reached(tree: Tree, anchor: np.ndarray, near: np.ndarray, far: np.ndarray) -> list[int]:
    """Leaves that may have a row at a distance of an annulus (``near`` to ``far``, in pairs)."""
    if not len(near):
        return []
    if not tree.nodes:
        return [-1]
    slack, out, waiting = _slack(tree.most), [], [0]
    while waiting:
        node = tree.nodes[number := waiting.pop()]
        distance = _distances(anchor[None], node.points)[0]
        least, largest = tree.ranges[number]  # by split point and subtree
        closest = np.maximum(least - distance[:, None], distance[:, None] - largest).max(axis=0)
        farthest = (distance[:, None] + largest).min(axis=0)
        for k, child in enumerate(node.children):
            if ((closest[k] <= far + slack) & (farthest[k] >= near - slack)).any():
                (waiting if child >= 0 else out).append(child)
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products: in floating point while all sums are below 2**53."""
    if most < _EXACT:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def _first(scores: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Of ``places`` in order of id the ``n`` with the highest scores, those first."""
    if len(places) > n:
        least = np.partition(scores[places], len(places) - n)[len(places) - n]
        above = places[scores[places] > least]
        places = np.concatenate([above, places[scores[places] == least][: n - len(above)]])
    return places[np.lexsort((places, -scores[places]))]


def _in_window(scores: np.ndarray, other: np.ndarray, positive: int) -> np.ndarray:
    if positive < 0:
        return np.zeros(0, np.int64)
    least = -(-LOWEST * positive // 100)
    return np.flatnonzero(other & (scores <= positive) & (scores >= least))


def _clean(vectors: DataFrame, scale: int) -> DataFrame:
    """The rows that take part, numbered, their vectors as bytes of integers."""
    finite = F.forall(
        F.col("embedding").cast("array<double>"),
        lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x),
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("label").isNotNull() & finite)
    width = max(rows.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            ends = lists.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            v = np.zeros((len(sizes), width))
            text = np.repeat(np.arange(len(sizes)), sizes)
            v[text, np.arange(ends[0], ends[-1]) - ends[text]] = lists.values.to_numpy()[
                ends[0] : ends[-1]
            ]
            with np.errstate(over="ignore"):
                v = np.floor(scale * v)
                square = (v * v).sum(axis=1)
            fits = np.flatnonzero(square < _MOST_SQUARE)
            v = v[fits].astype(np.int64)
            kept = batch.take(pa.array(fits))
            yield pa.RecordBatch.from_arrays(
                [
                    *(kept.column(c) for c in ("row", "vec_id", "label")),
                    pa.array([x.tobytes() for x in v], pa.binary()),
                    pa.array(square[fits]),
                ],
                names=["row", "vec_id", "label", "v", "square"],
            )

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return stored(numbered.mapInArrow(run, f"{_ROW}, square double"), "vectors")


def _fit(rows: DataFrame) -> tuple[Tree, tuple, int]:
    """A tree without ranges, the sample (row, id, label, vector), the number of rows."""
    n, square = rows.agg(F.count("*"), F.max("square")).first()
    one = rows.select(F.length("v")).first()
    wanted = min(SAMPLE_ROWS, SAMPLE_BYTES // max(one[0] if one else 8, 1))
    steps = 1 << 30
    share = min(steps, -(-steps * wanted // max(n, 1)))
    # By a hash of the row number; about ``wanted`` rows however many there are.
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(steps)) < share).drop("square").toArrow()
    ids = np.array([_NO_ID if x is None else x for x in sample.column("vec_id").to_pylist()], np.int64)
    order = np.lexsort((sample.column("row").to_numpy(), ids))
    v = _matrix(sample.column("v"))[order]
    known = (sample.column("row").to_numpy()[order], ids[order], sample.column("label").to_numpy()[order], v)
    # One more than the largest square: rounding must not leave a negative rest.
    most = float(square or 0) + 1
    leaf_sample = max(LEAF_SAMPLE, LEAF_ROWS * len(v) // max(n, 1))
    return fit_tree(_lifted(v, most) if len(v) else np.zeros((0, 1)), most, leaf_sample), known, n


def _placed(rows: DataFrame, tree: Tree) -> tuple[DataFrame, Tree]:
    """All rows with their leaves, and the tree with the ranges of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(0, np.int64)
            if batch.num_rows:
                leaf, _ = descend(shared.value, _lifted(_matrix(batch.column("v")), shared.value.most))
            columns = [batch.column(c) for c in ("row", "vec_id", "label", "v")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), *columns], names=["leaf", "row", "vec_id", "label", "v"]
            )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest distances of this task's rows."""
        tree = shared.value
        least = [np.full((len(x.points),) * 2, np.inf) for x in tree.nodes]
        largest = [np.full((len(x.points),) * 2, -np.inf) for x in tree.nodes]
        for batch in batches:
            if not batch.num_rows:
                continue
            for node, child, distance in descend(tree, _lifted(_matrix(batch.column("v")), tree.most))[1]:
                for k in np.unique(child).tolist():
                    part = distance[child == k]
                    least[node][:, k] = np.minimum(least[node][:, k], part.min(axis=0))
                    largest[node][:, k] = np.maximum(largest[node][:, k], part.max(axis=0))
        found = [
            (node, i, k, low[i, k], high[i, k])
            for node, (low, high) in enumerate(zip(least, largest, strict=True))
            for i, k in zip(*np.nonzero(np.isfinite(low)), strict=True)
        ]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = [pa.int32()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["node", "point", "child", "least", "largest"],
        )

    ranges = rows.select("v").mapInArrow(
        measure, "node int, point int, child int, least double, largest double"
    )
    ranges = ranges.groupBy("node", "point", "child").agg(
        F.min("least").alias("least"), F.max("largest").alias("largest")
    )
    # A subtree without rows keeps an empty range, which nothing meets.
    bounds = [np.full((2, *(len(x.points),) * 2), np.inf) for x in tree.nodes]
    for x in bounds:
        x[1] = -np.inf
    for r in ranges.collect():  # nodes of the tree by FANOUT squared at most
        bounds[r.node][:, r.point, r.child] = r.least, r.largest
    placed = stored(rows.drop("square").mapInArrow(place, f"leaf int, {_ROW}"), "placed")
    return placed, tree._replace(ranges=bounds)


def _annuli(anchor: np.ndarray, most: float, low: np.ndarray, high: np.ndarray):
    """Distances of rows whose scores are between ``low`` and ``high``."""
    square = float(anchor.astype(np.float64) @ anchor) + most
    near, far = (np.sqrt(np.maximum(square - 2.0 * x, 0)) for x in (high, low))
    return near, far


def _meetings(anchors: DataFrame, tree: Tree, known: tuple, chosen: Callable) -> DataFrame:
    """A row for each leaf that an anchor has to be compared with.

    ``chosen`` gives, for an anchor and its scores in the sample, the positive
    scores it has windows under (None while it seeks positives), and the score from which rows matter.
    """
    shared = anchors.sparkSession.sparkContext.broadcast((tree, known))
    names = [f.split()[0] for f in _MEETING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (rows, _, labels, sample) = shared.value
        for batch in batches:
            v, out = _matrix(batch.column("v")), []
            plain = [batch.column(c).to_pylist() for c in ("row", "vec_id", "label", "v")]
            windows = batch.column("windows").to_pylist()
            for a in range(0, len(v), _STEP):
                scores = _scores(v[a : a + _STEP], sample, tree.most) if len(sample) else None
                for k in range(a, min(a + _STEP, len(v))):
                    own = scores[k - a] if scores is not None else np.zeros(0, np.int64)
                    same = labels == plain[2][k]
                    high, low = chosen(own, same, rows == plain[0][k], windows[k])
                    near, far = _annuli(v[k], tree.most, low, high)
                    floors = [max(int(x), -(2**63)) for x in np.maximum(low, -(2.0**62))]
                    values = [p[k] for p in plain]
                    for leaf in reached(tree, _flat(v[k : k + 1])[0], near, far):
                        out.append((leaf, *values, windows[k], floors))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.int32()] + [pa.int64()] * 3 + [pa.binary()] + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
            )

    return stored(anchors.mapInArrow(run, _MEETING), "meetings")


def _seek_positives(scores, same, itself, windows):
    """All scores from the last of the first positives that the sample has."""
    found = scores[same & ~itself]
    enough = len(found) >= POSITIVES
    low = np.partition(found, -POSITIVES)[-POSITIVES] if enough else -np.inf
    return np.array([np.inf]), np.array([low], np.float64)


def _seek_negatives(scores, same, itself, windows):
    """For each positive its window, from the last of the first negatives that the sample has."""
    high = [p for p in windows if p >= 0]
    low = []
    for positive in high:
        found = scores[_in_window(scores, ~same, positive)]
        least = -(-LOWEST * positive // 100)
        low.append(np.partition(found, -NEGATIVES)[-NEGATIVES] if len(found) >= NEGATIVES else least)
    return np.array(high, np.float64), np.array(low, np.float64)


def _met(placed: DataFrame, meetings: DataFrame, n: int, most: float) -> DataFrame:
    """For each anchor and block that it meets, the first rows of the block."""
    rows_per_block = min(max(n // ROW_BLOCKS, LEAST_BLOCK), MOST_BLOCK)

    def blocks(frame: DataFrame, name: str, size: int) -> DataFrame:
        # A row per leaf; the tree bounds their number.
        return frame.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    leaves = blocks(placed, "row_blocks", rows_per_block).join(
        blocks(meetings, "anchor_blocks", ANCHOR_BLOCK), "leaf"
    )
    leaves = stored(leaves, "leaves")

    def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
        numbers = F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)
        frame = frame.join(F.broadcast(leaves), "leaf")
        frame = frame.withColumn(f"{own}_block", F.pmod(F.xxhash64("id"), f"{own}_blocks"))
        frame = frame.withColumn(f"{other}_block", F.explode(numbers.cast("array<bigint>")))
        return frame.drop("row_blocks", "anchor_blocks")

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        return _meet(rows, anchors, most)

    keys = ("leaf", "row_block", "anchor_block")
    rows = dealt(placed.withColumnRenamed("row", "id"), "row", "anchor")
    anchors = dealt(meetings.withColumnRenamed("row", "id"), "anchor", "row")
    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(meet, _MET)


def _meet(rows: pa.Table, anchors: pa.Table, most: float) -> pa.Table:
    """A block of rows against a block of anchors.

    Without windows an anchor takes the first rows of its own label, else for
    each window the first rows of other labels in it.
    """
    rows = rows.sort_by([("vec_id", "ascending"), ("id", "ascending")])  # null ids last
    v, ids = _matrix(rows.column("v")), rows.column("vec_id").to_pylist()
    numbers, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    own, own_labels = anchors.column("id").to_pylist(), anchors.column("label").to_pylist()
    windows, floors = anchors.column("windows").to_pylist(), anchors.column("floors").to_pylist()
    wanted, out = _matrix(anchors.column("v")), []
    for a in range(0, len(wanted) if len(v) else 0, _STEP):
        scores = _scores(wanted[a : a + _STEP], v, most)
        for k, score in enumerate(scores, a):
            same = labels == own_labels[k]
            if windows[k] is None:
                places = np.flatnonzero(same & (numbers != own[k]) & (score >= floors[k][0]))
                found = [(-1, _first(score, places, POSITIVES))]
            else:
                asked = [(i, p) for i, p in enumerate(windows[k]) if p >= 0]
                found = [
                    (i, _first(score, _in_window(score, ~same & (score >= floor), p), NEGATIVES))
                    for (i, p), floor in zip(asked, floors[k], strict=True)
                ]
            out += [
                (own[k], i, int(score[x]), ids[x], int(numbers[x]))
                for i, places in found
                for x in places.tolist()
            ]
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
        names=[f.split()[0] for f in _MET.split(", ")],
    )


def _ranked(met: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """The first ``most`` per key; Spark cuts each task's rows to as many before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("met_row")
    )
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, is_anchor: Column, scale: int = SCALE) -> DataFrame:
    """Hard negatives of the rows for which ``is_anchor`` (on ``vec_id``) holds.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``. Per anchor and
    positive, the first negatives in order, with their scores.
    """
    rows = _clean(vectors, scale)
    tree, known, n = _fit(rows)
    placed, tree = _placed(rows, tree)
    anchors = placed.where(is_anchor).drop("leaf")

    asked = anchors.withColumn("windows", F.lit(None).cast("array<long>"))
    met = _met(placed, _meetings(asked, tree, known, _seek_positives), n, tree.most)
    positives = _ranked(met, ("row",), POSITIVES).select(
        "row",
        (F.col("rank") - 1).alias("positive"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    positives = stored(positives, "positives")
    windows = positives.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("positive", "positive_score"))).alias("found")
    )
    windows = windows.select("row", F.col("found.positive_score").alias("windows"))
    asked = anchors.join(windows, "row")
    met = _met(placed, _meetings(asked, tree, known, _seek_negatives), n, tree.most)
    negatives = _ranked(met, ("row", "positive"), NEGATIVES)
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return (
        negatives.select(
            "row",
            "positive",
            "rank",
            F.col("vec_id").alias("negative_id"),
            F.col("score").alias("negative_score"),
        )
        .join(positives, ["row", "positive"])
        .join(named, "row")
        .select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
    )
