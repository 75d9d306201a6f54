"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

A text is cut into pre-tokens; each is looked up whole in a minimal perfect
hash of the vocabulary, and those that are no vocabulary entry are merged with
a heap of pairs over a linked list of their bytes. All of a batch's pre-tokens
are cut, hashed and looked up at once in numpy; the merge runs once for each
distinct miss and its result is kept for the next batches of the worker.

The pre-tokens are those of the public pattern (see ``PATTERN``), found from
character classes in place of a regular expression engine.

Edge cases: null and empty texts have no ids and decode to no bytes. Special
tokens' strings are ordinary text. Pre-tokens of any length are merged in
n log n steps. Pre-tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytetext import code_points, mix, ranges, runs, span_hashes, text_bytes
from .frames import add_from_text

# Fixed value: the pattern whose matches are merged separately.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The vocabulary is broadcast; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20

# Merged pre-tokens that a worker keeps.
KEPT_MERGES = 1 << 18

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_SAME = np.arange(256, dtype=np.uint8)

# The characters with the property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
_WHITE += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Vocabulary(NamedTuple):
    """Entries by id, and a minimal perfect hash from entry to id."""

    data: np.ndarray  # bytes of all entries, by id
    offsets: np.ndarray
    displace: np.ndarray  # per bucket: a seed, or -1 - slot
    slot_hash: np.ndarray
    slot_id: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """A rank file: per line an entry in base 64 and its rank, 0 to n - 1."""
    with open(path, "rb") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than MAX_VOCABULARY_BYTES")
    return _vocabulary(raw)


@lru_cache(maxsize=2)
def _vocabulary(raw: bytes) -> Vocabulary:
    pairs = (line.split() for line in raw.splitlines() if line)
    ranks = {base64.b64decode(entry): int(rank) for entry, rank in pairs}
    entries = sorted(ranks, key=ranks.get)
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks must be 0 to n - 1")
    data = np.frombuffer(b"".join(entries), np.uint8)
    offsets = np.cumsum([0, *map(len, entries)])
    hashes = span_hashes(data, offsets[:-1], offsets[1:], _SAME)
    return Vocabulary(data, offsets, *_perfect_hash(hashes))


def _seeded(hashes: np.ndarray, seed, slots: int) -> np.ndarray:
    seeds = np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(hashes ^ seeds) % np.uint64(slots)).astype(np.int64)


def _perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and displace: the large buckets choose seeds first, single keys fill the gaps."""
    n = len(hashes)
    buckets = max(n // 4, 1)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sizes = np.diff(first)
    displace = np.zeros(buckets, np.int64)
    slot_hash, slot_id = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        keys = order[first[b] : first[b + 1]]
        if len(keys) < 2:
            break
        seed = 0
        while True:
            seeds = np.arange(seed, seed + 64).reshape(-1, 1)
            slots = _seeded(hashes[keys], seeds, n)
            free = (slot_id[slots] < 0).all(axis=1)
            good = [k for k in np.flatnonzero(free) if len(set(slots[k])) == len(keys)]
            if good:
                displace[b] = seed + good[0]
                slot_id[slots[good[0]]] = keys
                slot_hash[slots[good[0]]] = hashes[keys]
                break
            seed += 64
    gaps = iter(np.flatnonzero(slot_id < 0))
    for b in np.flatnonzero(sizes == 1):
        key, slot = order[first[b]], next(gaps)
        displace[b] = -1 - slot
        slot_id[slot], slot_hash[slot] = key, hashes[key]
    return displace, slot_hash, slot_id


def whole_entries(vocabulary: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    """Id of the entry with each hash, -1 where there is none."""
    n = len(vocabulary.slot_id)
    seed = vocabulary.displace[(hashes % np.uint64(len(vocabulary.displace))).astype(np.int64)]
    slot = np.where(seed < 0, -1 - seed, _seeded(hashes, np.maximum(seed, 0), n))
    return np.where(vocabulary.slot_hash[slot] == hashes, vocabulary.slot_id[slot], -1)


def _pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """For any two entries that together are an entry: its id, by both their ids."""
    found = {}
    for entry, rank in ranks.items():
        for cut in range(1, len(entry)):
            left, right = ranks.get(entry[:cut]), ranks.get(entry[cut:])
            if left is not None and right is not None:
                found[left << 32 | right] = rank
    return found


def merge_bytes(pairs: dict[int, int], single: list[int], word: bytes) -> list[int]:
    """Ids of a pre-token: the lowest-ranked pair is merged first, the leftmost of equals.

    ``part`` holds the ids of the list's nodes, -1 for nodes merged into their
    left neighbour; ``after`` and ``before`` are its links. The heap has rank
    and place in one number; an entry whose pair is no longer there is skipped.
    """
    n = len(word)
    part = [single[b] for b in word]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    heap = []
    for i in range(n - 1):
        rank = get(part[i] << 32 | part[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if part[i] < 0 or j >= n or get(part[i] << 32 | part[j]) != rank:
            continue
        part[i], part[j] = rank, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            new = get(rank << 32 | part[k])
            if new is not None:
                push(heap, new << 32 | i)
        h = before[i]
        if h >= 0:
            new = get(part[h] << 32 | rank)
            if new is not None:
                push(heap, new << 32 | h)
    return [p for p in part if p >= 0]


@cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = _LETTER
        elif kind == "N":
            table[point] = _NUMBER
    table[_WHITE] = _SPACE
    return table


def pre_token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts, for texts with the given offsets.

    Runs of one class are pre-tokens, with these exceptions: of white space
    before something else, the last character stands alone, or goes with what
    follows if it is a plain space; and an apostrophe that has no space before
    it takes one of the known endings.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[ends] = True
    change = np.ones(n + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= text_start
    space = kind == _SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 0x20) & ~text_start[1:-1]
    start = change[:-1] & (space | ~after_blank)
    # The last of a run of white space that something follows in the same text.
    start |= space & change[1:] & ~text_start[1:]

    quote = np.flatnonzero((points == 0x27) & start & change[1:])
    text_end = ends[np.searchsorted(ends, quote, side="right")]
    padded = np.concatenate([points, [0, 0]])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(quote), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    size = np.where(long, 3, np.where(short, 2, 0))
    size[quote + size > text_end] = 0
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    stop = quote + size
    start[stop[stop < n]] = True
    return np.flatnonzero(start)


class _Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        raw, at = vocabulary.data.tobytes(), vocabulary.offsets.tolist()
        ranks = {raw[a:b]: i for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs = _pairs(ranks)
        self.kept: dict[int, bytes] = {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and the offsets of the texts in them."""
        points, point_ends = code_points(data, offsets)
        starts = pre_token_starts(points, point_ends)
        if len(points) != int(((data & 0xC0) != 0x80).sum()):
            raise ValueError("texts must be valid UTF-8")
        starts = np.flatnonzero((data & 0xC0) != 0x80)[starts] if len(starts) else starts
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = span_hashes(data, starts, stops, _SAME)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = whole_entries(self.vocabulary, distinct)
        sizes = np.ones(len(distinct), np.int64)
        missing = np.flatnonzero(found < 0)
        merged = self._merge(data, distinct[missing], starts[first[missing]], stops[first[missing]])
        sizes[missing] = [len(ids) // 4 for ids in merged]
        begin = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        flat[begin[found >= 0]] = found[found >= 0]
        flat[ranges(begin[missing], sizes[missing])] = np.frombuffer(b"".join(merged), np.int32)
        ids = flat[ranges(begin[which], sizes[which])]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes[which], out=total[1:])
        return ids, total[np.searchsorted(starts, offsets)]

    def _merge(self, data, hashes, starts, stops) -> list[bytes]:
        """Ids (as bytes of 32-bit integers) of each of the given distinct misses."""
        kept, out = self.kept, []
        if len(kept) > KEPT_MERGES:
            kept.clear()
        pairs, single = self.pairs, self.single
        raw = data.tobytes()
        for key, a, b in zip(hashes.tolist(), starts.tolist(), stops.tolist(), strict=True):
            ids = kept.get(key)
            if ids is None:
                ids = array("i", merge_bytes(pairs, single, raw[a:b])).tobytes()
                if b - a <= 64:
                    kept[key] = ids
            out.append(ids)
        return out


_encoders: list[_Encoder] = []


def _encoder(shared) -> _Encoder:
    """One per worker process and broadcast vocabulary; tasks share its merges."""
    vocabulary = shared.value
    if not _encoders or _encoders[0].vocabulary is not vocabulary:
        _encoders[:] = [_Encoder(vocabulary)]
    return _encoders[0]


def share_vocabulary(spark: SparkSession, path: str):
    """The rank file at ``path``, read by the driver and broadcast."""
    return spark.sparkContext.broadcast(load_vocabulary(path))


def encode(docs: DataFrame, shared, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the token ids of its text."""

    def make():
        encoder = _encoder(shared)

        def compute(texts: pa.Array):
            data, offsets = text_bytes(texts)
            ids, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for first, last in runs(offsets):
                part = data[offsets[first] : offsets[last]]
                found, at = encoder(part, offsets[first : last + 1] - offsets[first])
                ids.append(found)
                ends.append(at[1:] + ends[-1][-1])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(ids))
            )
            return (lists,)

        return compute

    return add_from_text(docs, make, "ids array<int>", keep)


def decode(tokens: DataFrame, shared, keep: list[str] | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of its ``ids``; null ids are empty."""

    def make():
        vocabulary = shared.value
        sizes = np.diff(vocabulary.offsets)

        def compute(lists: pa.ListArray):
            lists = lists.fill_null([]) if lists.null_count else lists
            at = lists.offsets.to_numpy().astype(np.int64)
            out = [np.zeros(0, np.uint8)]
            ends = [np.zeros(1, np.int64)]
            values = lists.values.to_numpy(zero_copy_only=False)
            for first, last in runs(at, 1 << 20):
                ids = values[at[first] : at[last]]
                lengths = sizes[ids]
                out.append(vocabulary.data[ranges(vocabulary.offsets[ids], lengths)])
                total = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(lengths, out=total[1:])
                ends.append(total[at[first + 1 : last + 1] - at[first]] + ends[-1][-1])
            offsets = pa.array(np.concatenate(ends), pa.int32())
            data = np.concatenate(out)
            binary = pa.Array.from_buffers(
                pa.binary(), len(lists), [None, offsets.buffers()[1], pa.py_buffer(data)]
            )
            return (binary,)

        return compute

    return add_from_text(tokens, make, "decoded binary", keep, text="ids")


def count_tokens(docs: DataFrame, shared, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, the number of ids of its text."""

    def make():
        encoder = _encoder(shared)

        def compute(texts: pa.Array):
            data, offsets = text_bytes(texts)
            sizes = [np.zeros(0, np.int64)]
            for first, last in runs(offsets):
                part = data[offsets[first] : offsets[last]]
                sizes.append(np.diff(encoder(part, offsets[first : last + 1] - offsets[first])[1]))
            return (pa.array(np.concatenate(sizes)),)

        return compute

    return add_from_text(docs, make, "n_tokens long", keep)
