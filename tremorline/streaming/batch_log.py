"""What a query notes about its batches in its checkpoint, before it runs them."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..storage import exists, list_dir, read_text


def watermark_ms(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """The watermark that a batch runs with; it lets go of windows that end by it."""
    return json.loads(_lines(spark, checkpoint, batch_id)[1])["batchWatermarkMs"]


def late_ms(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """What is too late for a batch: windows that end by the watermark of the batch before it.

    For the first batch that is the start of 1970, before which Spark counts nothing in a stream.
    """
    return watermark_ms(spark, checkpoint, batch_id - 1) if batch_id else 0


def last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """Number of the last batch that is done."""
    done = [e.name for e in list_dir(spark, f"{checkpoint}/commits") if e.name.isdigit()]
    return max(map(int, done), default=None)


def new_files(spark: SparkSession, checkpoint: str, batch_id: int) -> list[str]:
    """Paths of the files that a batch reads, of all its file sources.

    Spark plans a batch from the same list. Special signs are escaped, as paths to read are patterns.
    """
    now = _lines(spark, checkpoint, batch_id)[2:]
    before = _lines(spark, checkpoint, batch_id - 1)[2:] if batch_id else []
    paths = []
    for source, offset in enumerate(now):
        earlier = before[source] if source < len(before) else "-"
        for entry in range(_entry(earlier) + 1, _entry(offset) + 1):
            paths += _entry_paths(spark, f"{checkpoint}/sources/{source}/{entry}", entry)
    return paths


def _lines(spark: SparkSession, checkpoint: str, batch_id: int) -> list[str]:
    lines = (read_text(spark, f"{checkpoint}/offsets/{batch_id}") or "").splitlines()
    if len(lines) < 2:
        raise ValueError(f"no entry for batch {batch_id} in {checkpoint}")
    return lines


def _entry(offset: str) -> int:
    """Number of the source's last entry; "-" stands for none yet."""
    return -1 if offset == "-" else json.loads(offset)["logOffset"]


def _entry_paths(spark: SparkSession, path: str, entry: int) -> list[str]:
    # Every tenth entry also repeats all before it, so it is filtered where it is read.
    if not exists(spark, path):
        path += ".compact"
    listed = spark.read.schema("path string, batchId long").json(path)
    found = listed.where(f"batchId = {entry}").select("path").collect()
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(row["path"])) for row in found]
