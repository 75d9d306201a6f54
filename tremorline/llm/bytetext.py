"""Words and their hashes, computed over the bytes of a whole Arrow column at once.

Texts stay in Arrow's UTF-8 buffers: no Python string is made per text or word.
All functions work on a run of texts, given as one byte array and the offsets
of its texts. Memory follows the bytes of the run, so callers cut their batches
with ``runs``; a text is never cut, so the least is that of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 21

# Where words are hashed: their tables and sums take about 60 bytes for each byte of a run.
HASH_RUN_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Every byte but white space; bytes of non-ASCII characters are in words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

# Letters and digits of ASCII, and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``most`` bytes, or one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a public finaliser for hash values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        size = max(1 << n.bit_length(), HASH_RUN_BYTES) + 1
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def word_spans(
    data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 word offsets of the texts."""
    n = len(data)
    member = np.zeros(n + 2, dtype=bool)
    member[1:-1] = in_word[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(member[1:] & (cut | ~member[:-1]))
    ends = np.flatnonzero(member[:-1] & (cut | ~member[1:]))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER
) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    values = table.astype(np.uint64) + np.uint64(1)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words that stand in a row, by first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _WORD_MIX + words[k : k + n]
    return mix(total)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unicode code points of a run and the offsets of its texts in them."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        return points, lead[offsets]
    except UnicodeDecodeError:  # stray bytes count as U+FFFD, text by text
        texts = [
            raw[a:b].decode("utf-8", "replace")
            for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ]
        ends = np.cumsum([0, *map(len, texts)])
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), ends


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)
