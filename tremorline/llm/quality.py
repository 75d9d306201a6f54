"""Quality of a text: naive Bayes support vectors over n-gram indicators.

Every n-gram is present or absent. Its indicator is scaled by the log ratio of
the n-gram's share in good and in bad texts, the indicators of one kind are brought
to a fixed length, whatever their number, and a linear model with hinge loss is
fitted by dual coordinate descent. The score is the margin passed through a
logistic curve fitted to the labels.

The n-grams are hashed: single words and pairs of words (ASCII lower case);
four characters in a row, letters and digits taken as one each, which tells
running text from markup, capitals and junk; and whether a word is repeated
at once, or twice.

Edge cases: null and empty texts are scored by the constant term alone. Case
matters for the character n-grams only. Without labels of both kinds every
score is 0.5. Labelled ids that occur with both labels, and null ids, are not
learned from; a repeated label counts once, repeated rows of a text as often as
they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import (
    HASH_RUN_BYTES,
    NOT_SPACE,
    mix,
    runs,
    sequence_hashes,
    span_hashes,
    text_bytes,
    word_spans,
)
from .frames import add_from_text, lean

WORD_BITS, SHAPE_BITS = 17, 12
SHAPES = 1 << SHAPE_BITS
REPEAT, CONSTANT = SHAPES, SHAPES + 2  # cells after the shapes: two for repeats, one constant
FEATURES = SHAPES + 3 + (1 << WORD_BITS)

# Labelled rows to fit the model on, about (chosen by a hash of the id).
SAMPLE_ROWS = 12_000

# A row is predicted to be good from this score on.
THRESHOLD = 0.3

_COST = 1.0
_EPOCHS = 12

# Length of a text's part of the vector: character n-grams, words; the few cells
# between them are not scaled to a length.
_LENGTHS = (1.0, 0.5)


class QualityModel(NamedTuple):
    weights: np.ndarray  # per cell, with the log count ratio in it
    ratios: np.ndarray
    slope: float
    shift: float


def _shape_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x30:0x3A] = ord("0")
    table[0x41:0x5B] = ord("A")
    table[0x61:0x7B] = table[0x80:] = ord("a")
    return table


_SHAPE = _shape_table()


def cells_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and cell of every n-gram present, sorted and without repeats."""
    n = len(offsets) - 1
    dense = np.zeros((n, SHAPES + 3), bool)
    dense[:, CONSTANT] = True
    text = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) >= 4:
        shape = _SHAPE[data].astype(np.uint64)
        key = np.zeros(len(data) - 3, np.uint64)
        for k in range(4):
            key = (key << np.uint64(8)) | shape[k : len(data) - 3 + k]
        whole = text[:-3] == text[3:]
        found = (mix(key) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)
        dense[text[:-3][whole], found[whole]] = True

    starts, ends, words = word_spans(data, offsets, NOT_SPACE)
    hashes = span_hashes(data, starts, ends)
    of_word = np.repeat(np.arange(n), np.diff(words))
    pair_text = of_word[1:] == of_word[:-1]
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = (hashes[1:] == hashes[:-1]) & pair_text
    dense[of_word[same[:-1]], REPEAT] = True
    twice = same[1:] & same[:-1]
    dense[of_word[twice], REPEAT + 1] = True

    pairs = sequence_hashes(hashes, 2)[pair_text]
    shift = np.uint64(64 - WORD_BITS)
    key = np.concatenate(
        [
            of_word << WORD_BITS | (hashes >> shift).astype(np.int64),
            of_word[1:][pair_text] << WORD_BITS | (pairs >> shift).astype(np.int64),
        ]
    )
    key = np.unique(key)
    row, cell = np.nonzero(dense)
    row = np.concatenate([row, key >> WORD_BITS])
    cell = np.concatenate([cell, SHAPES + 3 + (key & ((1 << WORD_BITS) - 1))])
    order = np.argsort(row, kind="stable")
    return row[order], cell[order]


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for first, last in runs(offsets, HASH_RUN_BYTES):
            row, cell = cells_of(
                data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            )
            ends = np.searchsorted(row, np.arange(last - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
            label = batch.column("label").slice(first, last - first)
            yield pa.RecordBatch.from_arrays([label, lists], names=["label", "cells"])


def fit_cells(label: np.ndarray, cells: np.ndarray, ends: np.ndarray) -> QualityModel:
    """Model of rows with a label (0 or 1) and the cells ``cells[ends[i]:ends[i + 1]]``."""
    good = label == 1
    if not good.any() or good.all():
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0)
    row = np.repeat(np.arange(len(label)), np.diff(ends))
    p = np.bincount(cells[good[row]], minlength=FEATURES) + 1.0
    q = np.bincount(cells[~good[row]], minlength=FEATURES) + 1.0
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    ratios[CONSTANT] = 1.0
    value = ratios[cells]
    for part, size in zip(_parts(cells), _LENGTHS, strict=True):
        length = np.sqrt(np.bincount(row[part], value[part] ** 2, len(label)))
        value[part] *= size / np.maximum(length, 1e-12)[row[part]]
    # Dual coordinate descent: one dual variable per row, kept between 0 and the cost,
    # which is larger for the rarer label.
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean())) * _COST
    dual = np.zeros(len(y))
    weights = np.zeros(FEATURES)
    rng = np.random.default_rng(7)
    for _ in range(_EPOCHS):
        for i in rng.permutation(len(y)):
            at, x = cells[ends[i] : ends[i + 1]], value[ends[i] : ends[i + 1]]
            new = min(max(dual[i] - (y[i] * (weights[at] @ x) - 1.0), 0.0), cost[i])
            if new != dual[i]:
                weights[at] += (new - dual[i]) * y[i] * x
                dual[i] = new
    margin = np.add.reduceat(weights[cells] * value, ends[:-1])
    slope, shift = _logistic(margin, good)
    return QualityModel(weights * ratios, ratios, slope, shift)


def _parts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cells < SHAPES, cells > CONSTANT


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margin to probability (Newton steps)."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(at):
        z = at[0] * margin + at[1]
        return (np.logaddexp(0, z) - target * z).sum() + 1e-3 * (at[0] - 1) ** 2

    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -30, 30)))
        error, w = p - target, p * (1 - p) + 1e-9
        slope = np.array([(error * margin).sum() + 2e-3 * (at[0] - 1), error.sum()])
        cross = (w * margin).sum()
        curve = np.array([[(w * margin * margin).sum() + 2e-3, cross], [cross, w.sum()]])
        step = np.linalg.solve(curve, slope)
        now = loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 0.0), float(at[1])


def fit_quality_model(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Learn from the texts of ``docs`` whose id has a quality in ``labels``.

    ``learn`` selects label rows by ``doc_id``. About ``sample_rows`` labels are
    used, chosen by a hash of the id, so the cost of fitting is fixed. Their
    n-grams are found in parallel; the descent runs in one task over them.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("label"), F.max("quality").alias("_most")
    )
    known = known.where(F.col("label") == F.col("_most")).select("doc_id", "label")
    steps = 1 << 20
    n = max(known.count(), 1)
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < min(steps, -(-steps * sample_rows // n))
    # The bounded sample of labels is what is broadcast.
    rows = (
        docs.select("doc_id", "text")
        .where(chosen)
        .join(F.broadcast(known.where(chosen)), "doc_id")
        .select("label", "text")
    )
    cells = rows.mapInArrow(lean(_cell_batches), "label int, cells array<int>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, at, ends = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(1, np.int64)]
        for batch in batches:
            lists = batch.column("cells")
            label.append(batch.column("label").to_numpy(zero_copy_only=False))
            at.append(lists.flatten().to_numpy(zero_copy_only=False))
            sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
            ends.append(np.cumsum(sizes) + ends[-1][-1])
        model = fit_cells(np.concatenate(label), np.concatenate(at), np.concatenate(ends))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([model.weights.tobytes()], pa.binary()),
                pa.array([model.ratios.tobytes()], pa.binary()),
                pa.array([model.slope]),
                pa.array([model.shift]),
            ],
            names=["weights", "ratios", "slope", "shift"],
        )

    fitted = cells.repartition(1).mapInArrow(
        lean(fit), "weights binary, ratios binary, slope double, shift double"
    )
    row = fitted.collect()[0]
    return QualityModel(
        np.frombuffer(row["weights"]), np.frombuffer(row["ratios"]), row["slope"], row["shift"]
    )


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        square = model.ratios * model.ratios

        def compute(texts: pa.Array):
            data, offsets = text_bytes(texts)
            scores = [np.zeros(0)]
            for first, last in runs(offsets, HASH_RUN_BYTES):
                row, cell = cells_of(
                    data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                )
                n, weight = last - first, model.weights[cell]
                shapes, words = _parts(cell)
                plain = ~(shapes | words)
                margin = np.bincount(row[plain], weight[plain], n)
                for part, size in zip((shapes, words), _LENGTHS, strict=True):
                    length = np.sqrt(np.bincount(row[part], square[cell[part]], n))
                    total = np.bincount(row[part], weight[part], n)
                    margin += size * total / np.maximum(length, 1e-12)
                z = np.clip(model.slope * margin + model.shift, -700, 700)
                scores.append(1 / (1 + np.exp(-z)))
            score = np.concatenate(scores)
            return pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))

        return compute

    return add_from_text(docs, make, "score double, predicted int", keep)
