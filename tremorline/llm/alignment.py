"""Two tokenizers' ids of the same texts, aligned by the bytes they stand for.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces,
which put that space there themselves) the text. Where a token of A and one of
B end at the same byte, both id lists are cut: a dictionary from end to index
is made for each list, the keys that both have are sorted, and neighbouring
keys slice the lists into groups. Inside a group the tokens whose byte ranges
overlap are linked.

Neither tokenizer looks across a space that follows a visible character: A
splits there before it merges, and no piece of B has a space after another
character (checked when it is loaded). So both lists are cut there in any case, and
the spans between these places are encoded and aligned once for all texts of a
run that have them. A text that one of the tokenizers does not give back
byte by byte is encoded as a whole, and has no tokens if its bytes still differ.

The count of an id pair is the number of documents of the whole corpus that
hold it linked. Documents are dealt into chunks of bounded size; a document keeps
its pairs as numbers in its chunk's list of pairs. Only these lists are
exploded, summed over the corpus and sent back, so a pair that all documents
have crosses the network once a chunk.

Edge cases: null and empty texts have no tokens, as have texts that are not
valid UTF-8 or that hold U+2581, which B reads as a space; their counts are 0
and their groups the empty string. Strings of special tokens are plain text. Repeated rows
are documents of their own, and null ids stay. An empty table gives none. Extra
columns are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ranges, runs, span_hashes, text_bytes
from .frames import stored

# Text of a chunk, and spans that are encoded in a row.
CHUNK_BYTES = 8 << 20
ROW_SPANS = 1024

# Both files are broadcast; larger ones are refused.
MAX_FILE_BYTES = 64 << 20

_SPACE = 0x20

# Bytes that end a visible character for certain. Unicode's other spaces end in
# one of the bytes left out.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0x80:] = True
_VISIBLE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False

_EXACT = np.arange(256, dtype=np.uint8)

# An A id in the upper bits of a pair, a B id in the lower ones.
_ID_BITS = 32

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "at array<int>, times array<int>, keys array<long>, docs array<int>"
)


def common_slices(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ends that both have, and the past-last index in A and in B of the slices up to them."""
    in_a = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1), strict=True))
    in_b = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1), strict=True))
    common = sorted(in_a.keys() & in_b.keys())
    return tuple(
        np.array(x, np.int64)
        for x in (common, [in_a[end] for end in common], [in_b[end] for end in common])
    )


def slice_links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Index in A, index in B and end of each link.

    The ends of both lists together cut a slice into stretches; each lies in one
    token of A and one of B, and no two in the same two.
    """
    stretches = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, stretches), np.searchsorted(b_ends, stretches), stretches


def _plain_bytes() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies are written in."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(kept))
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligned(NamedTuple):
    """What is known of a list of spans."""

    good: np.ndarray  # whether both tokenizers give a span back
    numbers: np.ndarray  # tokens of A and B, groups and links of each span
    pairs: np.ndarray  # linked ids, span by span
    groups: list[str]  # each group ends in a semicolon


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.source = (a_file, b_file)
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        plain = _plain_bytes()
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=False).items()}
        a_bytes = [
            bytes(map(plain.__getitem__, names.get(i, ""))) for i in range(max(names, default=0) + 1)
        ]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        b_bytes, self.space_starts_pieces = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                b_bytes.append(piece.replace("▁", " ").encode())
                self.space_starts_pieces &= "▁" not in piece.lstrip("▁")
        self.bytes = (a_bytes, b_bytes)
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        # Each id as text: within and at the end of a group's A ids, then its B ids.
        self.texts = [
            f"{i}{mark}"
            for side, marks in zip(self.bytes, (",|", ",;"), strict=True)
            for mark in marks
            for i in range(len(side))
        ]
        self.space = [self.b.piece_to_id("▁")]

    def distinct(self, texts: Sequence[bytes]) -> Aligned:
        """Spans that begin with a space, each as if it stood alone.

        Those that end in a visible character are encoded many at a time, in a row:
        neither tokenizer looks across such an end.
        """
        a_parts, b_parts = [], []
        odd = [k for k, t in enumerate(texts) if not _VISIBLE[t[-1]]]
        cuts = [0, *(k + d for k in odd for d in (0, 1)), len(texts)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            step = ROW_SPANS if self.space_starts_pieces else 1
            for k in range(low, high, step):
                text = b"".join(texts[k : min(k + step, high)]).decode("utf-8", "replace")
                a_parts.append(self.a.encode(text, add_special_tokens=False).ids)
                # A lone space is a space before nothing, for which B has no ids.
                b_parts.append(self.space if text == " " else self.b.encode(text[1:]))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_parts, b_parts))
        wanted = b"".join(texts)
        if all(
            b"".join(map(side.__getitem__, ids.tolist())) == wanted
            for ids, side in zip((a, b), self.bytes, strict=True)
        ):
            return self.align(a, b, np.ones(len(texts), bool), texts)
        return self.each(texts)

    def each(self, texts: Sequence[bytes]) -> Aligned:
        """The same one by one; spans whose bytes do not come back have no ids."""
        good, a_parts, b_parts = [], [], []
        for span in texts:
            text = span.decode("utf-8", "replace")
            a_ids = self.a.encode(text, add_special_tokens=False).ids
            b_ids = self.space if text == " " else self.b.encode(text[1:])
            sides = zip((a_ids, b_ids), self.bytes, strict=True)
            good.append(all(b"".join([side[i] for i in ids]) == span for ids, side in sides))
            a_parts.append(a_ids if good[-1] else [])
            b_parts.append(b_ids if good[-1] else [])
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_parts, b_parts))
        return self.align(a, b, np.array(good, bool), texts)

    def align(self, a: np.ndarray, b: np.ndarray, good: np.ndarray, texts) -> Aligned:
        """The groups and links of each good span, from the ids of all in a row."""
        a_ends, b_ends = (
            np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b), strict=True)
        )
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        span_ends = np.cumsum(np.where(good, lengths, 0))
        common, a_past, b_past = common_slices(a_ends, b_ends)
        i, j, stretches = slice_links(a_ends, b_ends)
        pairs = a[i] << _ID_BITS | b[j]
        past = [
            np.searchsorted(ends, span_ends, side="right")
            for ends in (a_ends, b_ends, common, stretches)
        ]
        numbers = np.diff(np.stack(past), axis=1, prepend=0).T
        groups = self._written(a, b, a_past, b_past, past[0] + past[1])
        return Aligned(good, numbers, pairs, groups)

    def _written(self, a, b, a_past, b_past, span_ends: np.ndarray) -> list[str]:
        """Groups as text, span by span."""
        n_a, n_b = len(self.bytes[0]), len(self.bytes[1])
        a_code, b_code = a.copy(), b + 2 * n_a
        a_code[a_past - 1] += n_a
        b_code[b_past - 1] += n_b
        codes = np.empty(len(a) + len(b), np.int64)
        # The A ids of a group come after the B ids of those before it.
        a_sizes, b_sizes = np.diff(a_past, prepend=0), np.diff(b_past, prepend=0)
        codes[np.arange(len(a)) + np.repeat(b_past - b_sizes, a_sizes)] = a_code
        codes[np.arange(len(b)) + np.repeat(a_past, b_sizes)] = b_code
        written = list(map(self.texts.__getitem__, codes.tolist()))
        ends = span_ends.tolist()
        return ["".join(written[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]


_aligners: list[Aligner] = []


def _aligner(files: tuple[bytes, bytes]) -> Aligner:
    """One per worker process, as the files take a while to load."""
    if not _aligners or _aligners[0].source != files:
        _aligners[:] = [Aligner(*files)]
    return _aligners[0]


def _with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A run whose texts begin with a space."""
    spaced = offsets + np.arange(len(offsets))
    out = np.full(int(spaced[-1]), _SPACE, np.uint8)
    own = np.ones(len(out), bool)
    own[spaced[:-1]] = False
    out[own] = data
    return out, spaced


class _Run:
    """The texts of a run: numbers, groups, and pairs as places in a sorted list of pairs."""

    def __init__(self, aligner: Aligner, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        texts = data.tobytes()
        spaced, begin = _with_space(data, offsets)
        cut = np.zeros(len(spaced), bool)
        cut[begin[:-1]] = True
        if aligner.space_starts_pieces:
            cut[1:] |= (spaced[1:] == _SPACE) & _VISIBLE[spaced[:-1]]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(spaced))
        hashes = span_hashes(spaced, starts, ends, _EXACT)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = spaced.tobytes()
        found = aligner.distinct(
            [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        )
        span_ends = np.searchsorted(starts, begin)
        text_of = np.repeat(np.arange(n), np.diff(span_ends))

        # Texts to be taken as a whole have no other spans; empty ones have none at all.
        alone = np.diff(offsets) == 0
        odd = np.setdiff1d(text_of[~found.good[which]], np.flatnonzero(alone))
        alone[odd] = True
        keep = ~alone[text_of]
        which, text_of = which[keep], text_of[keep]
        numbers, pairs, parts = [found.numbers], [found.pairs], found.groups
        for i in odd.tolist():
            one = aligner.each([b" " + texts[offsets[i] : offsets[i + 1]]])
            at = np.searchsorted(text_of, i)
            which = np.insert(which, at, len(parts))
            text_of = np.insert(text_of, at, i)
            numbers.append(one.numbers)
            pairs.append(one.pairs)
            parts = parts + one.groups
        numbers, flat = np.concatenate(numbers), np.concatenate(pairs)

        totals = np.zeros((len(which) + 1, 4), np.int64)
        np.cumsum(numbers[which], axis=0, out=totals[1:])
        at = np.searchsorted(text_of, np.arange(n + 1))
        self.numbers = totals[at[1:]] - totals[at[:-1]]
        listed, at = list(map(parts.__getitem__, which.tolist())), at.tolist()
        self.groups = ["".join(listed[a:b])[:-1] for a, b in zip(at[:-1], at[1:], strict=True)]

        self.keys, place = np.unique(flat, return_inverse=True)
        sizes = numbers[:, 3]
        links = place[ranges((np.cumsum(sizes) - sizes)[which], sizes[which])]
        of = np.repeat(text_of, sizes[which])
        cells, self.times = np.unique(of << 32 | links, return_counts=True)
        self.at = cells & 0xFFFFFFFF
        self.ends = np.searchsorted(cells >> 32, np.arange(n + 1))


def _chunk_batch(chunk: int, ids: list[pa.Array], held: list[_Run]) -> pa.RecordBatch:
    """A row per document, and one with the pairs of all and how many documents have each."""
    keys = np.unique(np.concatenate([run.keys for run in held]))
    at = np.concatenate([np.searchsorted(keys, run.keys)[run.at] for run in held])
    docs = np.bincount(at, minlength=len(keys))
    sizes = np.concatenate([np.diff(run.ends) for run in held])
    n = len(sizes)
    ends = pa.array(np.r_[0, np.cumsum(sizes), len(at)], pa.int32())
    numbers = np.concatenate([run.numbers for run in held])
    lists = [None] * n
    arrays = [
        pa.array(np.full(n + 1, chunk, np.int64)),
        pa.concat_arrays([*(x.cast(pa.int64()) for x in ids), pa.nulls(1, pa.int64())]),
        *(pa.array(np.append(numbers[:, k], 0)) for k in range(4)),
        pa.array([text for run in held for text in run.groups] + [None], pa.string()),
        pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
        pa.ListArray.from_arrays(
            ends, pa.array(np.concatenate([run.times for run in held]).astype(np.int32))
        ),
        pa.array([*lists, keys], pa.list_(pa.int64())),
        pa.array([*lists, docs.astype(np.int32)], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _ALIGNED.split(", ")])


def align_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Numbers of tokens, groups and links of each document, and the groups themselves.

    ``groups`` has the ids of A and B, group by group (``a1,a2|b1;a3|b2,b3``).
    The other columns are for ``count_links``: a document's pairs (``at``, ``times``)
    are places in the list ``keys`` of its ``chunk``, which is a row of its own.
    """
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as file:
            files.append(file.read(MAX_FILE_BYTES + 1))
        if len(files[-1]) > MAX_FILE_BYTES:
            raise ValueError("a tokenizer file is larger than MAX_FILE_BYTES")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        held: list[_Run] = []
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in runs(offsets):
                part = data[offsets[first] : offsets[last]]
                held.append(_Run(aligner, part, offsets[first : last + 1] - offsets[first]))
                ids.append(batch.column("doc_id").slice(first, last - first))
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield _chunk_batch(chunk, ids, held)
                    chunk, size, ids, held = chunk + 1, 0, [], []
        if held:
            yield _chunk_batch(chunk, ids, held)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, _ALIGNED)


def count_links(aligned: DataFrame) -> DataFrame:
    """The documents of ``align_texts`` with what their links count in the whole corpus.

    ``n_best`` is the number of links whose count is the highest that their A id
    has anywhere, ``count_sum`` the sum of the counts of all links. Columns of
    ``aligned`` may have been added or, but for those it is counted from, left out.
    """
    rows = stored(aligned, "aligned")
    lists = rows.where("keys is not null").select(
        "chunk", F.posexplode(F.arrays_zip("keys", "docs")).alias("at", "cell")
    )
    lists = lists.select("chunk", "at", F.col("cell.keys").alias("key"), F.col("cell.docs").alias("docs"))
    counts = lists.groupBy("key").agg(F.sum("docs").cast("long").alias("count"))
    a_id = F.shiftright("key", _ID_BITS)
    # As many rows as tokenizer A has ids.
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("highest"))
    judged = (
        counts.withColumn("a_id", a_id)
        .join(F.broadcast(highest), "a_id")
        .select("key", "count", (F.col("count") == F.col("highest")).alias("best"))
    )
    known = lists.join(judged, "key").select(F.col("chunk").alias("of"), "at", "count", "best")

    left = [c for c in rows.columns if c not in ("chunk", "at", "times", "keys", "docs")]
    names = [*left, "n_best", "count_sum"]
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in left]

    def add(docs: pa.Table, cells: pa.Table) -> pa.Table:
        """Both sides of one chunk: its documents, and the counts of its pairs."""
        count = np.zeros(cells.num_rows, np.int64)
        best = np.zeros(cells.num_rows, np.int64)
        at = cells.column("at").to_numpy()
        count[at] = cells.column("count").to_numpy()
        best[at] = cells.column("best").to_numpy(zero_copy_only=False)
        docs = docs.combine_chunks()
        lists = docs.column("at").combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        times = docs.column("times").combine_chunks().values.to_numpy()
        sums = []
        for values in (best, count):
            total = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(values[flat] * times, out=total[1:])
            sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
        return pa.Table.from_arrays([docs.column(c) for c in left] + sums, names=names)

    documents = rows.where("keys is null").drop("keys", "docs").groupBy("chunk")
    schema = ", ".join([*fields, "n_best long", "count_sum long"])
    return documents.cogroup(known.groupBy("of")).applyInArrow(add, schema)
