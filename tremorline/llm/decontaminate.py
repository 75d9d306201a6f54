"""Benchmark passages in documents, by latent semantic retrieval.

Words are hashed to buckets and weighted by inverse document frequency, counted
over all documents. A randomised singular value decomposition of the weighted
passages (all windows of all documents, and all benchmark items,
which weigh more) gives a latent space: Spark multiplies the documents'
passages by a thin random matrix in one scan, in parallel, and the driver takes
their main directions from the small product. Every window of every document is projected and compared with all
items by cosine. What is near is read word by word: the longest common
subsequence with the item, and whether the item's last sentence, its answer,
stands in it.

Windows are as long as the items they are compared with, by powers of two; the
items of a space share them. Besides, ``SHORT`` words of an item in a row, and
all of an item that has fewer, are looked up in an index, whatever the cosine of
the text around them: what stands there word by word is always read.

The items are the query set. They are broadcast in blocks of about ``BLOCK_ITEMS``
against all documents. A block has a latent space for every ``RANK`` items, as a
space has room for no more: the cosine of an item outside it falls to nothing.

Edge cases: null and empty texts, and items without words, match nothing. Items
of fewer than ``SHORT`` words must stand there whole. Case and punctuation do
not matter. Repeated rows of a document or item give repeated results. Extra
columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove, scratch_dir
from .bytetext import (
    ALNUM,
    HASH_RUN_BYTES,
    ranges,
    runs,
    sequence_hashes,
    span_hashes,
    text_bytes,
    word_spans,
)
from .frames import lean

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
RANK = 112
OVERSAMPLE = 16

BLOCK_WORDS = 16
WINDOW_BLOCKS = (2, 4)  # windows of 32 and 64 words, every 16 words; twice that per level

# Tasks of the fit at most, and rows of what each of them sends: one matrix (8 MB), whatever they read.
SPACE_TASKS = 64
SPACE_PARTS = 16
SPACE_BLOCKS = 128  # at a time, whose words are added to the matrix
BLOCK_ITEMS = 4 * RANK  # as many spaces are side by side in a scan
STEP = 1024  # blocks or windows at a time: what is gathered for them fits a core's cache
ITEM_WEIGHT = 10.0  # of all items, against the documents: the space is to tell items apart

NEAR = 0.25  # cosine from which a window is read
SAME = 0.8  # share of an item's words, in order, that makes a leak
PARAPHRASE = 0.5  # the same if the answer stands there, too
SHORT = 8
INDEX_BITS = 20

_LEAKS = "doc_id long, item_id long, cosine double, common double, answered boolean"


class Item(NamedTuple):
    item_id: int
    words: np.ndarray
    answer: np.ndarray
    counts: dict[int, int]  # of its words


class Group(NamedTuple):
    """Items that share a latent space, and where it stands beside the others."""

    columns: slice
    items: np.ndarray  # their numbers in the block
    level: int


class Index(NamedTuple):
    """Hashes of ``size`` words in a row, in order, with their items and places there."""

    size: int
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filled: np.ndarray  # by the first bits of a hash


class _Words(NamedTuple):
    hashes: np.ndarray
    ends: np.ndarray  # n + 1 word offsets of the texts


def _words(data: np.ndarray, offsets: np.ndarray) -> _Words:
    starts, ends, words = word_spans(data, offsets, ALNUM)
    return _Words(span_hashes(data, starts, ends), words)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The same in 16 bits."""
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


def _text_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, _Words]]:
    data, offsets = text_bytes(pc.utf8_lower(batch.column("text")))
    for first, last in runs(offsets, HASH_RUN_BYTES):
        part = data[offsets[first] : offsets[last]]
        yield first, last, _words(part, offsets[first : last + 1] - offsets[first])


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """Per bucket, log of all documents over those that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for first, last, words in _text_runs(batch):
                text = np.repeat(np.arange(last - first), np.diff(words.ends))
                keys = np.unique(text << BUCKET_BITS | _bucket(words.hashes))
                total[:-1] += np.bincount(keys & (BUCKETS - 1), minlength=BUCKETS)
                total[-1] += last - first
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["cell", "n"]
        )

    counted = docs.select("text").mapInArrow(lean(count), "cell long, n long")
    rows = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 at most
    total = np.zeros(BUCKETS + 1)
    total[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return np.log((total[-1] + 1) / (total[:-1] + 1)) + 1e-3


def _windows(ends: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block starts (word numbers), and the first and past-last block of every window."""
    blocks = -(-np.diff(ends) // BLOCK_WORDS)
    at = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(blocks)), blocks)
    number = np.arange(int(blocks.sum())) - at[text]
    starts = ends[text] + number * BLOCK_WORDS
    first, past = [], []
    for size in WINDOW_BLOCKS:
        size <<= level
        # Full windows of a text, the last one too, or the one that holds all of a shorter text.
        last = blocks[text] - size
        whole = (number % (1 << level) == 0) & (number <= last) | (number == last) | (number == 0)
        if size != WINDOW_BLOCKS[0] << level:
            whole &= blocks[text] > WINDOW_BLOCKS[0] << level
        begin = np.flatnonzero(whole)
        first.append(begin)
        past.append(np.minimum(begin + size, (at + blocks)[text[begin]]))
    return starts, np.concatenate(first), np.concatenate(past)


def _level(n: int) -> int:
    """How often the windows are doubled for items of n words: the long ones hold an item."""
    return max(0, (-(-n // (BLOCK_WORDS * max(WINDOW_BLOCKS))) - 1).bit_length())


def _thin(idf: np.ndarray) -> np.ndarray:
    """What each word adds to a window's product with a fixed random matrix."""
    rows = scan_matrix(RANK + OVERSAMPLE, idf)
    random = np.random.default_rng(11)
    for a in range(0, BUCKETS, STEP):
        part = random.standard_normal((STEP, RANK + OVERSAMPLE), np.float32)
        rows[a : a + STEP, :-1] = part * idf[a : a + STEP, None]
    return rows


def _block_sums(words: _Words, starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The rows of ``space`` of each block's words, added up."""
    sums = np.zeros((len(starts), space.shape[1]), np.float32)
    stops = np.append(starts, len(words.hashes))
    # One more cell, after the last, for the places past the end of a short block.
    cells = np.append(_bucket(words.hashes), BUCKETS)
    for a in range(0, len(starts), STEP):
        begin, end = starts[a : a + STEP], stops[a + 1 : a + STEP + 1]
        for k in range(BLOCK_WORDS):
            at = np.where(begin + k < end, begin + k, len(words.hashes))
            sums[a : a + STEP] += space.take(cells[at], axis=0)
    return sums


def _by_size(
    first: np.ndarray, past: np.ndarray, level: int = 0
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size in blocks, first and past-last block of windows of one size, some at a time, in order."""
    step = max(1, STEP >> level)  # that stand in about STEP blocks
    back = np.flatnonzero(np.diff(first) <= 0)  # windows of another size start there
    cuts = [0, *(back + 1).tolist(), len(first)]
    for size, a, b in zip(WINDOW_BLOCKS, cuts[:-1], cuts[1:], strict=False):
        for low in range(a, b, step):
            rows = slice(low, min(low + step, b))
            yield size << level, first[rows], past[rows]


def _window_vectors(
    sums: np.ndarray, first: np.ndarray, past: np.ndarray, size: int
) -> np.ndarray:
    """Rows of ``sums`` added up over each window; windows of ``size`` blocks or shorter, in order.

    Sums of twice as many blocks are made of two, for all places side by side.
    """
    low = first[0]
    added, width = sums[low : past.max()].copy(), 1
    while width < size:
        added[:-width] += added[width:]
        width *= 2
    vectors = added[first - low]
    short = np.flatnonzero(past - first < size)
    if len(short):
        vectors[short] = sums[first[short]]
        for k in range(1, int((past - first)[short].max())):
            more = short[first[short] + k < past[short]]
            vectors[more] += sums[first[more] + k]
    return vectors


def _spread(
    vectors: np.ndarray, first: np.ndarray, past: np.ndarray, size: int, added: np.ndarray
) -> None:
    """Adds the vector of each window to the row of each of its blocks, the other way round."""
    whole = past - first == size
    low, high = first[0], past.max()
    rows, width = np.zeros((high - low, vectors.shape[1]), np.float32), 1
    rows[first[whole] - low] = vectors[whole]
    while width < size:
        rows[width:] += rows[:-width].copy()
        width *= 2
    added[low:high] += rows
    short = np.flatnonzero(~whole)
    for k in range(int((past - first)[short].max(initial=0))):
        more = short[first[short] + k < past[short]]
        added[first[more] + k] += vectors[more]


def add_passages(words: _Words, thin: np.ndarray, total: np.ndarray) -> int:
    """Adds a (a . random) over all windows a of the texts to ``total``; returns their number.

    ``thin`` is as ``_thin`` makes it. What a window adds is the same for all words of a block.
    """
    starts, first, past = _windows(words.ends)
    if not len(starts):
        return 0
    sums = _block_sums(words, starts, thin)
    added = np.zeros((len(starts), total.shape[1]), np.float32)
    for size, f, p in _by_size(first, past):
        vectors = _window_vectors(sums, f, p, size)
        _spread(vectors[:, :-1] / np.maximum(vectors[:, -1:], 1e-12), f, p, size, added)
    weight = np.sqrt(thin[:, -1])
    cells, stops = _cells(words.hashes), np.append(starts, len(words.hashes))
    for a in range(0, len(starts), SPACE_BLOCKS):
        alike = added[a : a + SPACE_BLOCKS]
        blocks = np.arange(len(alike))
        own = cells[stops[a] : stops[a + len(alike)]]
        order = np.argsort(own, kind="stable")  # numbers of 16 bits are dealt, not compared
        own, place = own[order], np.repeat(blocks, np.diff(stops[a : a + len(alike) + 1]))[order]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        times = np.diff(at, append=len(own))
        # Most words stand there once or twice.
        rows = alike.take(place[at], axis=0)
        (twice,) = np.nonzero(times == 2)
        rows[twice] += alike.take(place[at[twice] + 1], axis=0)
        (more,) = np.nonzero(times > 2)
        shape = len(more), len(alike)
        word = np.repeat(np.arange(len(more)) * len(alike), times[more])
        often = word + place[ranges(at[more], times[more])]
        often = np.bincount(often, minlength=shape[0] * shape[1]).reshape(shape)
        rows[more] = often.astype(np.float32) @ alike
        total[own[at]] += rows * weight[own[at], None]
    return len(first)


def fit_corpus(docs: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """Main directions of all documents' weighted windows, with their lengths, and how many windows.

    The matrix (buckets by width) times its own transpose is about the sum of a a' over
    all windows a. One scan: the sum times a random matrix fixes it (Nystroem's method).
    """
    width = RANK + OVERSAMPLE
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    size = BUCKETS // SPACE_PARTS
    kind = "part int, m binary, n long"

    def rows(parts: list[int], arrays: list[np.ndarray], n: int) -> pa.RecordBatch:
        sent = pa.array([a.tobytes() for a in arrays], pa.binary())
        numbers = [pa.array(parts, pa.int32()), sent, pa.array([n] * len(parts), pa.int64())]
        return pa.RecordBatch.from_arrays(numbers, names=["part", "m", "n"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thin, total, n = None, None, 0
        for batch in batches:
            if thin is None:
                thin, total = _thin(shared.value), np.zeros((BUCKETS, width), np.float32)
            for _, _, words in _text_runs(batch):
                n += add_passages(words, thin, total)
        if n:
            for part in range(SPACE_PARTS):
                yield rows([part], [total[part * size : (part + 1) * size]], n)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size * width, np.float32)
        for sent in table.column("m"):
            total += np.frombuffer(sent.as_buffer(), np.float32)
        part = table.column("part")[0].as_py()
        return pa.Table.from_batches([rows([part], [total], pc.sum(table.column("n")).as_py())])

    sent = docs.select("text").coalesce(SPACE_TASKS).mapInArrow(lean(multiply), kind)
    product, n = np.zeros((BUCKETS, width), np.float32), 0
    for row in sent.groupBy("part").applyInArrow(add, kind).toLocalIterator():
        part = np.frombuffer(row["m"], np.float32).reshape(size, width)
        product[row["part"] * size : (row["part"] + 1) * size], n = part, row["n"]
    inner, random = np.zeros((width, width)), np.random.default_rng(11)
    for a in range(0, BUCKETS, STEP):
        part = random.standard_normal((STEP, width), np.float32)
        inner += part.T.astype(np.float64) @ product[a : a + STEP]
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    kept = values > 1e-7 * max(values[-1], 1e-12)
    turn = (vectors * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0)).astype(np.float32)
    for a in range(0, BUCKETS, STEP):
        product[a : a + STEP] = product[a : a + STEP] @ turn
    return product, n


def _weighted(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, n = np.unique(_bucket(hashes), return_counts=True)
    weight = n * idf[cell]
    return cell, weight / max(np.sqrt(weight @ weight), 1e-12)


def fit_space(corpus: np.ndarray, n: int, items: list[Item], idf: np.ndarray) -> np.ndarray:
    """Right singular vectors (buckets by rank) of the corpus's ``n`` windows and the items.

    ``corpus`` is as ``fit_corpus`` returns it.
    """
    scale = np.sqrt(ITEM_WEIGHT * max(n, 1) / max(len(items), 1))
    width = corpus.shape[1]
    rows = np.zeros((BUCKETS, width + len(items)), np.float32)
    rows[:, :width] = corpus
    for k, item in enumerate(items):
        cell, weight = _weighted(item.words, idf)
        rows[cell, width + k] = scale * weight
    blocks = [rows[a : a + STEP].astype(np.float64) for a in range(0, BUCKETS, STEP)]
    values, vectors = np.linalg.eigh(sum(b.T @ b for b in blocks))
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    # Directions that are not there: no passage has a part in them.
    kept = values > 1e-10 * max(values[0], 1e-12)
    turn = vectors * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0)
    return np.concatenate([(b @ turn).astype(np.float32) for b in blocks])


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of words (bits of a number per item word)."""
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in text.tolist():
        met = row & places.get(word, 0)
        row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


def _stands_in(part: np.ndarray, text: np.ndarray) -> bool:
    n, m = len(text), len(part)
    if m == 0 or n < m:
        return False
    at = np.flatnonzero(text[: n - m + 1] == part[0])
    return any((text[i : i + m] == part).all() for i in at.tolist())


def _may_hold(item: Item, text: list[int]) -> bool:
    """Whether a text has enough of the item's words, in any order."""
    met = item.counts.keys() & text
    return sum(item.counts[word] for word in met) >= PARAPHRASE * len(item.words)


def _judge(item: Item, text: np.ndarray) -> tuple[float, bool] | None:
    """Share of common words and whether the answer stands there; None for no leak."""
    if not _may_hold(item, text.tolist()):
        return None
    share = common_subsequence(item.words, text) / len(item.words)
    answered = _stands_in(item.answer, text)
    if len(item.words) < SHORT:
        return (share, True) if _stands_in(item.words, text) else None
    leak = share >= SAME or (share >= PARAPHRASE and answered)
    return (share, answered) if leak else None


def read_items(rows: list[tuple[int, str]]) -> list[Item]:
    items = []
    for item_id, text in rows:
        sentences = [s for s in _sentences(text or "") if len(_of_text(s))]
        words = _of_text(text or "")
        if len(words):
            items.append(
                Item(item_id, words, _of_text(sentences[-1]), dict(Counter(words.tolist())))
            )
    return items


def _sentences(text: str) -> list[str]:
    for mark in "?!\n":
        text = text.replace(mark, ".")
    return text.split(".")


def _of_text(text: str) -> np.ndarray:
    data, offsets = text_bytes(pc.utf8_lower(pa.array([text], pa.string())))
    return _words(data, offsets).hashes


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id`` and ``item_id`` of leaks, with cosine, share of common words, answer."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], _LEAKS)
    for shared in _shared_blocks(docs, benchmark):
        found = found.unionByName(_scan(docs, shared))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    A row is judged where it is read, so ids do not matter and no text is shuffled. A scan
    holds one block of items: between two of them the rows that are left are stored.
    """
    spark, before = docs.sparkSession, None
    kept = docs
    for number, shared in enumerate(_shared_blocks(docs, benchmark)):
        if number:
            path = f"{scratch_dir(spark, 'without-leaks')}/rows"
            kept.write.parquet(path)
            kept = spark.read.schema(kept.schema).parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
        kept = _clean_rows(kept, shared)
    return kept


def _shared_blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Broadcast]:
    """What scans for a block of items need, block by block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    idf = inverse_frequency(docs)
    corpus = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in part.toLocalIterator()]
        wanted = read_items(rows)
        if wanted:
            corpus = corpus or fit_corpus(docs, idf)
            yield docs.sparkSession.sparkContext.broadcast(_prepared(*corpus, wanted, idf))


def _shares(items: list[Item]) -> list[tuple[int, np.ndarray]]:
    """Level and numbers of items of like size, in equal shares that a space has room for.

    Items of fewer than ``SHORT`` words are left to the index.
    """
    by_level: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        if len(item.words) >= SHORT:
            by_level.setdefault(_level(len(item.words)), []).append(k)
    out = []
    for level, numbers in sorted(by_level.items()):
        n = -(-len(numbers) // RANK)
        out += [(level, np.array(numbers[k::n])) for k in range(n)]
    return out


def sequence_index(items: list[Item]) -> list[Index]:
    """Items of fewer than ``SHORT`` words as a whole, all runs of ``SHORT`` words of others."""
    rows: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, item in enumerate(items):
        size = min(len(item.words), SHORT)
        rows.setdefault(size, []).append((sequence_hashes(item.words, size), k))
    out = []
    for size, found in sorted(rows.items()):
        hashes = np.concatenate([h for h, _ in found])
        owner = np.concatenate([np.full(len(h), k) for h, k in found])
        places = np.concatenate([np.arange(len(h)) for h, _ in found])
        order = np.argsort(hashes, kind="stable")
        filled = np.zeros(1 << INDEX_BITS, bool)
        filled[hashes >> np.uint64(64 - INDEX_BITS)] = True
        out.append(Index(size, hashes[order], owner[order], places[order], filled))
    return out


def indexed_windows(words: _Words, indexes: list[Index], items: list[Item]) -> np.ndarray:
    """First and past-last word and item of the passages that have an item's words in a row."""
    found = [np.zeros((0, 3), np.int64)]
    sizes = np.array([len(item.words) for item in items])
    for index in indexes:
        hashes = sequence_hashes(words.hashes, index.size)
        at = np.flatnonzero(index.filled[hashes >> np.uint64(64 - INDEX_BITS)])
        low = np.searchsorted(index.hashes, hashes[at])
        met = np.searchsorted(index.hashes, hashes[at], side="right") - low
        text = np.searchsorted(words.ends, at, side="right") - 1
        met[at + index.size > words.ends[text + 1]] = 0  # goes on in the next text
        key = ranges(low, met)
        at, text, item = np.repeat(at, met), np.repeat(text, met), index.items[key]
        # Where the item starts and ends if it goes on as it does there: one passage per copy.
        first = at - index.places[key]
        past = np.minimum(first + sizes[item], words.ends[text + 1])
        rows = np.stack([np.maximum(first, words.ends[text]), past, item], axis=1)
        found.append(np.unique(rows, axis=0))
    return np.concatenate(found)


def _prepared(corpus: np.ndarray, n: int, items: list[Item], idf: np.ndarray) -> tuple:
    shares = _shares(items)
    weighted, groups, end = scan_matrix(sum(len(numbers) for _, numbers in shares), idf), [], 0
    for level, numbers in shares:
        own = [items[k] for k in numbers.tolist()]
        space = fit_space(corpus, n, own, idf)
        queries = np.stack([w @ space[c] for c, w in (_weighted(i.words, idf) for i in own)])
        columns = slice(end, end := end + len(own))
        groups.append(Group(columns, numbers, level))
        # Windows are sums of words, so their products with the queries are sums of the words' own.
        products = space @ queries.astype(np.float32).T
        np.multiply(products, idf[:, None], out=weighted[:-1, columns], casting="same_kind")
        del space
    return weighted, groups, items, sequence_index(items)


def _scan(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = shared.value
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for base, _, words in _text_runs(batch):
                out += [
                    (ids[base + text].as_py(), *rest) for text, *rest in _leaks_of(words, *prepared)
                ]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[field.split()[0] for field in _LEAKS.split(", ")],
            )

    return docs.mapInArrow(lean(run), _LEAKS)


def _clean_rows(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for base, _, words in _text_runs(batch):
                clean[[base + text for text, *_ in _leaks_of(words, *prepared)]] = False
            yield batch if clean.all() else batch.filter(pa.array(clean))

    return docs.mapInArrow(lean(run), docs.schema)


def scan_matrix(width: int, idf: np.ndarray) -> np.ndarray:
    """What each word adds to a window: room for its products in the spaces, its squared weight."""
    rows = np.zeros((BUCKETS + 1, width + 1), np.float32)
    rows[:-1, -1] = idf**2
    return rows


def near_windows(words: _Words, space: np.ndarray, groups: list[Group], near: float = NEAR):
    """First and past-last word, item and cosine of all windows near an item.

    ``space`` has a word's product, in the latent space, with each item; its last column
    holds the squared weight of a word, its last row is that of no word. The cosine is
    that of the projections, with the lengths of the whole vectors: what a window
    has outside the latent space makes it less near.
    """
    starts, _, _ = _windows(words.ends)
    found, cosines = [np.zeros((0, 3), np.int64)], [np.zeros(0)]
    if not len(starts) or not groups:
        return found[0], cosines[0]
    sums = _block_sums(words, starts, space)
    stops = np.append(starts, len(words.hashes))
    for level in sorted({group.level for group in groups}):
        alike = [group for group in groups if group.level == level]
        _, first, past = _windows(words.ends, level)
        for size, f, p in _by_size(first, past, level):
            length = np.sqrt(np.maximum(_window_vectors(sums[:, -1:], f, p, size), 1e-12))
            for group in alike:
                product = _window_vectors(sums[:, group.columns], f, p, size)
                window, item = np.divmod(
                    np.flatnonzero(product >= near * length), len(group.items)
                )
                found.append(
                    np.stack([stops[f[window]], stops[p[window]], group.items[item]], axis=1)
                )
                cosines.append(product[window, item] / length[window, 0])
    return np.concatenate(found), np.concatenate(cosines)


def _cosine(item: Item, text: np.ndarray, space: np.ndarray) -> float:
    """Of whole vectors: what stands in the space does not matter."""
    idf = np.sqrt(space[:-1, -1])
    sides = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for side, hashes in zip(sides, (item.words, text), strict=True):
        cell, weight = _weighted(hashes, idf)
        side[cell] = weight
    return float(sides[0] @ sides[1])


def _leaks_of(
    words: _Words, space, groups: list[Group], items: list[Item], indexes: list[Index]
) -> list[tuple]:
    """Text number, item id, cosine, share and answer of each text's leaks, once per item.

    Windows of one text near one item that overlap are first tried together: if
    all their words are too few, no window of them needs to be read.
    """
    found, cosines = near_windows(words, space, groups)
    more = indexed_windows(words, indexes, items)
    found = np.concatenate([found, more])
    cosines = np.concatenate([cosines, np.full(len(more), np.nan)])  # as far as it is needed
    if not len(found):
        return []
    text = np.searchsorted(words.ends, found[:, 0], side="right") - 1
    order = np.lexsort((found[:, 0], found[:, 2], text))
    text, (first, past, item), cosines = text[order], found[order].T, cosines[order]
    around = np.array([len(item.words) for item in items])[item]
    begins, ends, lows, highs = _surroundings(text, item, first, past, around, words.ends)
    listed, out = words.hashes.tolist(), {}
    for a, b, low, high in zip(begins, ends, lows, highs, strict=True):
        i, one = int(text[a]), items[item[a]]
        if not _may_hold(one, listed[low:high]):
            continue
        for row in range(a, b):
            left = max(first[row] - around[row], words.ends[i])
            right = min(past[row] + around[row], words.ends[i + 1])
            judged, cosine = _judge(one, words.hashes[left:right]), float(cosines[row])
            if judged and np.isnan(cosine):
                cosine = _cosine(one, words.hashes[first[row] : past[row]], space)
            if judged:
                best = out.get((i, item[a]), (cosine, *judged))
                out[i, item[a]] = (
                    max(best[0], cosine), max(best[1], judged[0]), best[2] or judged[1]
                )
    return [(i, items[k].item_id, *best) for (i, k), best in out.items()]


def _surroundings(
    text: np.ndarray,
    item: np.ndarray,
    first: np.ndarray,
    past: np.ndarray,
    around: np.ndarray,
    ends: np.ndarray,
) -> tuple[list[int], list[int], list[int], list[int]]:
    """Windows in order of text, item and first word, in groups whose surroundings overlap.

    First and past-last row of each group, first and past-last word of its surroundings.
    """
    new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))
    # Those of a text and an item lie behind those of the ones before.
    shift = np.cumsum(new) * int((past + around).max() + 1)
    reach = np.maximum.accumulate(past + around + shift)
    new[1:] |= (first - around + shift)[1:] >= reach[:-1]
    begin = np.flatnonzero(new)
    low = np.maximum(first[begin] - around[begin], ends[text[begin]])
    high = np.maximum.reduceat(past + around, begin)
    stops = np.append(begin[1:], len(text))
    high = np.minimum(high, ends[text[begin] + 1])
    return begin.tolist(), stops.tolist(), low.tolist(), high.tolist()
