"""Documents packed into sequences of a fixed number of tokens, best fit decreasing.

Texts are encoded and packed in groups of bounded size, in the order in which a task
reads them, so nothing is shuffled. Documents longer than a sequence are first cut
into full sequences and a rest. The rests go, the longest first, each into the
open sequence with the least room that still holds it. A segment tree over the
possible amounts of room finds it: a node says whether any open sequence has
an amount of room in its range.

What is left open at the end of a group is filled up: the emptiest sequences are
taken apart and their documents cut to the others' gaps of ``LEAST_GAP`` or more. The one that
remains is cut into sequences whose lengths are powers of two, as those are not padded. So only gaps
under ``LEAST_GAP`` tokens are padding, whatever the documents' lengths.

A group's sequences are numbered after the task and the group, so numbers never
meet, and a repeated task gives the same ones.

Edge cases: null and empty texts are the end id alone. Documents may share an id
or have none; their pieces belong together by ``start`` within one group. Repeated
rows are packed as often as they occur; equal lengths go in the order of the rows. An
empty table gives no piece. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import runs, text_bytes
from .token_files import MAX_TOKENIZER_BYTES, _encoder

END_ID = 2
WINDOW = 4096

# Tokens of a group, or one document.
GROUP_TOKENS = 1 << 21
LEAST_GAP = 8

_PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "ids array<int>"
)

# A piece: number of the document in its group, first token, length.
Piece = tuple[int, int, int]


class RoomTree:
    """Open sequences by the room they have; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()  # more than ``most``
        self.filled = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.leaves
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, room: int) -> int:
        """Remove and return a sequence with exactly this room."""
        sequence = self.open[room].pop()
        node = room + self.leaves
        if not self.open[room]:
            self.filled[node] = 0
            while node > 1 and not self.filled[node ^ 1]:
                node >>= 1
                self.filled[node] = 0
        return sequence

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that an open sequence has."""
        node = need + self.leaves
        while not self.filled[node]:
            # Up to the next subtree on the right.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.filled[2 * node])
        return node - self.leaves


def pack(sizes: list[int], window: int = WINDOW, least_gap: int = LEAST_GAP) -> list[list[Piece]]:
    """Sequences of pieces for documents of these sizes (each at least 1)."""
    done: list[list[Piece]] = []
    rests = []
    for doc, size in enumerate(sizes):
        full = size - size % window
        done += [[(doc, at, window)] for at in range(0, full, window)]
        if size > full:
            rests.append((full - size, doc, full))
    rests.sort()
    tree, sequences, room = RoomTree(window), [], []
    for negative, doc, start in rests:
        size = -negative
        found = tree.tightest(size)
        if found is None:
            at = len(sequences)
            sequences.append([])
            room.append(window)
        else:
            at = tree.take(found)
        sequences[at].append((doc, start, size))
        room[at] -= size
        if room[at]:
            tree.add(room[at], at)
    order = sorted(range(len(sequences)), key=lambda i: (room[i], i))
    last = _fill([sequences[i] for i in order], [room[i] for i in order], least_gap)
    return done + last


def _fill(sequences: list[list[Piece]], room: list[int], least_gap: int) -> list[list[Piece]]:
    """Sequences in order of their room, the gaps of the first filled from the last."""
    first, out = 0, []
    while first < len(sequences):
        if room[first] < least_gap:
            out.append(sequences[first])
            first += 1
        elif first == len(sequences) - 1:
            out += _powers(sequences[first])
            first += 1
        else:
            doc, start, size = sequences[-1].pop()
            moved = min(size, room[first])
            # The end of a piece moves, so what is left keeps its start.
            sequences[first].append((doc, start + size - moved, moved))
            room[first] -= moved
            if moved < size:
                sequences[-1].append((doc, start, size - moved))
            elif not sequences[-1]:
                sequences.pop()
                room.pop()
    return out


def _powers(sequence: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into sequences whose lengths are distinct powers of two."""
    total, pieces, out = sum(p[2] for p in sequence), sequence[::-1], []
    for bit in range(total.bit_length() - 1, -1, -1):
        want = total & 1 << bit
        if want:
            out.append([])
        while want:
            doc, start, size = pieces.pop()
            taken = min(size, want)
            out[-1].append((doc, start, taken))
            want -= taken
            if taken < size:
                pieces.append((doc, start + taken, size - taken))
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = END_ID,
    window: int = WINDOW,
    least_gap: int = LEAST_GAP,
) -> DataFrame:
    """A row per piece: its document, its place there, its sequence, its place there, its ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        raw = file.read(MAX_TOKENIZER_BYTES + 1)
    if len(raw) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is larger than MAX_TOKENIZER_BYTES")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(shared.value), TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in runs(offsets):
                found, ends = encoder(
                    data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                )
                ids.append(np.insert(found, ends[1:], end_id))
                sizes.append(np.diff(ends) + 1)
                names.append(batch.column("doc_id").slice(first, last - first))
                held += len(ids[-1])
                if held >= GROUP_TOKENS:
                    group = _group(names, ids, sizes, number, window, least_gap)
                    number += yield from group
                    ids, sizes, names, held = [], [], [], 0
        if held:
            yield from _group(names, ids, sizes, number, window, least_gap)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, _PIECES)


# Tokens of an output batch.
_BATCH_TOKENS = 1 << 19


def _group(names, ids, sizes, number: int, window: int, least_gap: int):
    """The pieces of a group in batches; returns how many sequences it has."""
    names, ids = pa.concat_arrays(names), np.concatenate(ids)
    sizes = np.concatenate(sizes)
    begin = np.cumsum(sizes) - sizes
    sequences = pack(sizes.tolist(), window, least_gap)
    pieces = np.array([p for s in sequences for p in s], np.int64).reshape(-1, 3)
    counts = np.array([len(s) for s in sequences], np.int64)
    doc, start, length = pieces.T
    sequence = np.repeat(np.arange(len(sequences)), counts)
    past = np.cumsum(length)
    offset = past - length
    offset -= np.repeat(offset[np.cumsum(counts) - counts], counts)
    places = begin[doc] + start
    cuts = np.unique(np.searchsorted(past, np.arange(0, past[-1], _BATCH_TOKENS)))
    for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
        of = doc[a:b]
        ends = np.cumsum(length[a:b])
        own = np.repeat(places[a:b] - (ends - length[a:b]), length[a:b]) + np.arange(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(of)),
                pa.array(start[a:b]),
                pa.array(length[a:b]),
                pa.array(sizes[of]),
                pa.array(number + sequence[a:b]),
                pa.array(offset[a:b]),
                pa.ListArray.from_arrays(
                    pa.array(np.r_[0, ends], pa.int32()), pa.array(ids[own].astype(np.int32))
                ),
            ],
            names=[f.split()[0] for f in _PIECES.split(", ")],
        )
    return len(sequences)


def sequences_of(pieces: DataFrame) -> DataFrame:
    """A row per sequence: its ``ids``, and the lengths of the ``pieces`` in it."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("pieces")
    )


def with_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids (little-endian, 4 bytes) in place of the ids."""
    schema = pieces.drop("ids").schema.add("ids_crc32", "long")
    names = pieces.drop("ids").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = 4 * lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            found = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column(c) for c in names] + [pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids_crc32"])

    return pieces.mapInArrow(run, schema)
