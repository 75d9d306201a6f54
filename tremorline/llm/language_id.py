"""Language of a text: multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log probabilities, a row per hash bucket and a
column per language, broadcast to the tasks. A batch of texts is scored as a
sparse matrix product in numpy: the rows of all its n-grams are gathered and
added up text by text.

Edge cases: a null text and a text without a letter are ``und`` with score 0;
so is everything if nothing could be learned. Case, digits and punctuation do
not matter. Rows without a language or an id are not learned from. Repeated rows
count as often as they occur. Of equally likely languages the first by name wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import HASH_RUN_BYTES, code_points, mix, runs, text_bytes
from .frames import add_from_text, lean

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"

# The broadcast matrix has BUCKETS rows of this many doubles at most (128 MB).
MAX_LANGUAGES = 256

# Rows to learn from, per language, about (they are chosen by a hash of the id).
SAMPLE_ROWS = 20_000

_SMOOTHING = 0.5
_SPACE = 32


class LanguageModel(NamedTuple):
    languages: list[str]
    log_prob: np.ndarray  # (BUCKETS + 1, languages); the last row is zero
    log_prior: np.ndarray


@cache
def _folded() -> np.ndarray:
    """By code point: its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded text with each run of non-letters as one space, and its offsets."""
    points, ends = code_points(data, offsets)
    folded = _folded()[points]
    keep = np.ones(len(folded) + 1, bool)
    keep[1:-1] = (folded[1:] != _SPACE) | (folded[:-1] != _SPACE)
    keep[ends] = True
    kept = np.zeros(len(folded) + 1, np.int64)
    np.cumsum(keep[:-1], out=kept[1:])
    return folded[keep[:-1]], kept[ends]


def _buckets(letters: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Hash bucket of the n-gram at each position; BUCKETS where there is none."""
    n = len(letters)
    found = np.full(n, BUCKETS, np.int64)
    if n < order:
        return found
    key = np.full(n - order + 1, order, np.uint64)
    for k in range(order):
        key = (key << np.uint64(21)) | letters[k : n - order + 1 + k].astype(np.uint64)
    found[: n - order + 1] = mix(key) >> np.uint64(48)
    if order == 1:
        found[letters == _SPACE] = BUCKETS
    for k in range(1, order):  # those that would reach into the next text
        last = ends[1:] - k
        found[last[last >= ends[:-1]]] = BUCKETS
    return found


def fit_language_model(
    docs: DataFrame,
    learn: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
    id_column: str = "doc_id",
) -> LanguageModel:
    """Learn from the rows of ``docs`` that ``learn`` selects and that have a language.

    Languages are counted over all of them; the n-grams of about ``sample_rows``
    of each language are, chosen by a hash of the id, so this cost is fixed.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col(id_column).isNotNull())
    if learn is not None:
        known = known.where(learn)
    counts = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would not be bounded")
    languages = [row["lang"] for row in counts]
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    steps = 1 << 20
    share = F.create_map(
        *(
            F.lit(v)
            for row in counts
            for v in (row["lang"], min(steps, -(-steps * sample_rows // row["count"])))
        )
    )
    sample = known.where(F.pmod(F.xxhash64(id_column), F.lit(steps)) < share[F.col("lang")])
    width = BUCKETS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * width, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            of_text = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])
            for first, last in runs(offsets, HASH_RUN_BYTES):
                part = data[offsets[first] : offsets[last]]
                letters, ends = _letters(part, offsets[first : last + 1] - offsets[first])
                base = np.repeat(of_text[first:last] * width, np.diff(ends))
                for order in ORDERS:
                    found = base + _buckets(letters, ends, order)
                    total += np.bincount(found, minlength=len(total))
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["cell", "n"]
        )

    # Few tasks, so that few partial counts are shuffled; the sample is bounded.
    spread = sample.select("lang", "text").repartition(16)
    cells = spread.mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = cells.toArrow()  # at most languages x buckets rows
    matrix = np.zeros(len(languages) * width)
    matrix[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    matrix = matrix.reshape(len(languages), width)[:, :BUCKETS].T + _SMOOTHING
    log_prob = np.zeros((width, len(languages)))
    log_prob[:BUCKETS] = np.log(matrix / matrix.sum(axis=0))
    rows = np.array([row["count"] for row in counts], float)
    return LanguageModel(languages, log_prob, np.log(rows / rows.sum()))


def _score(model: LanguageModel, data: np.ndarray, offsets: np.ndarray):
    """Best language (index, -1 for unknown) and its probability, per text."""
    letters, ends = _letters(data, offsets)
    n = len(offsets) - 1
    total = np.tile(model.log_prior, (n, 1))
    has = np.zeros(len(letters) + 1, np.int64)
    np.cumsum(letters != _SPACE, out=has[1:])
    known = has[ends[1:]] > has[ends[:-1]]
    if model.languages and known.any():
        for order in ORDERS:
            rows = model.log_prob[_buckets(letters, ends, order)]
            total[known] += np.add.reduceat(rows, ends[:-1][known], axis=0)
    if not model.languages:
        return np.full(n, -1), np.zeros(n)
    best = np.where(known, total.argmax(axis=1), -1)
    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return best, np.where(known, share, 0.0)


def predict_language(
    docs: DataFrame, model: LanguageModel, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN], pa.string())

        def compute(texts: pa.Array):
            data, offsets = text_bytes(texts)
            best, score = [np.zeros(0, int)], [np.zeros(0)]
            for first, last in runs(offsets, HASH_RUN_BYTES):
                part = data[offsets[first] : offsets[last]]
                found = _score(model, part, offsets[first : last + 1] - offsets[first])
                best.append(found[0])
                score.append(found[1])
            index = np.concatenate(best)
            index[index < 0] = len(names) - 1
            return names.take(pa.array(index)), pa.array(np.concatenate(score))

        return compute

    return add_from_text(docs, make, "lang_pred string, score double", keep)
