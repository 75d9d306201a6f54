"""Token ids of documents in Parquet files, in document order.

Files hold one row per document: its id, the number of its ids, where they
start, and the ids as a list column. Ids are dictionary encoded, or delta
encoded where the dictionary would grow too large; the number columns are delta
encoded. Row groups and pages are small and have page indexes, so single
documents, or the numbers without the ids, can be read without the rest. A
second, small table holds the total of each part, from which the places in
the whole corpus follow.

The text is encoded by the ``tokenizers`` library. Spans between white space
are encoded once per worker for all the texts that have them, as the
vocabulary's normaliser and splitter never look across white space, nor
across a border between an ASCII letter or digit and ASCII punctuation other
than the apostrophe.

Edge cases: null and empty texts have the end id alone. Documents go by id (null
first), those with one id by a hash of their text; repeated rows are written
as often as they occur. Extra columns are left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import LOWER, NOT_SPACE, ranges, runs, span_hashes, text_bytes

END_ID = 1

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000

# The tokenizer file is broadcast; larger ones are refused.
MAX_TOKENIZER_BYTES = 64 << 20

KEPT_SPANS = 1 << 20

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK &= ~_ALNUM
_MARK[ord("'")] = False

_TOKENS = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans that can be encoded one by one."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = NOT_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    alnum, mark = _ALNUM[data], _MARK[data]
    cut[1:n] |= (alnum[1:] & mark[:-1]) | (mark[1:] & alnum[:-1])
    starts = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    return starts, ends


class _Encoder:
    def __init__(self, raw: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.source = raw
        self.tokenizer = Tokenizer.from_str(raw)
        self.tokenizer.encode_special_tokens = True
        self.kept: dict[int, bytes] = {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and the offsets of the texts in them."""
        starts, ends = spans_of(data, offsets)
        hashes = span_hashes(data, starts, ends, LOWER)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = self._ids(data, distinct, starts[first], ends[first])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        begin = np.cumsum(sizes) - sizes
        ids = flat[ranges(begin[which], sizes[which])]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes[which], out=total[1:])
        return ids, total[np.searchsorted(starts, offsets)]

    def _ids(self, data, hashes, starts, ends) -> list[bytes]:
        kept = self.kept
        if len(kept) > KEPT_SPANS:
            kept.clear()
        keys = hashes.tolist()
        missing = [i for i, key in enumerate(keys) if key not in kept]
        raw = data.tobytes()
        texts = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in missing]
        for k in range(0, len(texts), 4096):
            for i, encoding in zip(
                missing[k : k + 4096],
                self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False),
                strict=True,
            ):
                kept[keys[i]] = np.array(encoding.ids, np.int32).tobytes()
        return [kept[key] for key in keys]


_encoders: list[_Encoder] = []


def _encoder(raw: str) -> _Encoder:
    """One per worker process; its tasks share the spans it has encoded."""
    if not _encoders or _encoders[0].source != raw:
        _encoders[:] = [_Encoder(raw)]
    return _encoders[0]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``) to ``path``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        raw = file.read(MAX_TOKENIZER_BYTES + 1)
    if len(raw) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is larger than MAX_TOKENIZER_BYTES")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(raw)
    order = (F.col("doc_id"), F.xxhash64("text"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, written = _encoder(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in runs(offsets):
                ids, ends = encoder(
                    data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                )
                n = last - first
                sizes = np.diff(ends) + 1
                ends = ends + np.arange(n + 1)
                full = np.full(int(ends[-1]), end_id, np.int32)
                own = np.ones(len(full), bool)
                own[ends[1:] - 1] = False
                full[own] = ids
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        batch.column("doc_id").slice(first, n),
                        pa.array(ends[:-1] + written),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(full)),
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                written += int(ends[-1])

    writer = ordered.mapInArrow(run, _TOKENS).write.mode("overwrite")
    for key, value in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start")},
    }.items():
        writer = writer.option(key, value)
    writer.parquet(f"{path}/tokens")

    # One row per part file: the running total over them is small.
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts.write.mode("overwrite").parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` in the whole corpus, ``n_tokens`` and ``ids``."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    return (
        spark.read.schema(_TOKENS)
        .parquet(f"{path}/tokens")
        .join(F.broadcast(parts), "part")  # a row per file
        .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of the ids (little-endian, 4 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().astype(np.int64)
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            view = memoryview(raw)
            found = [
                zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)
            ]
            names = ["doc_id", "start", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(found, pa.int64())],
                names=[*names, "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
