"""Which folders make up a changelog table.

A batch lies in ``out/batch_id=<n>``. Compaction writes merged batches to a folder
of its own under ``out/_merged`` and then commits a version: a small file under
``out/_versions`` that names this folder and the last batch in it. It is
written beside its place and renamed, so a version is there as a whole or not
at all. A reader takes the newest version's folder and all later batches. What
a version no longer needs stays until the next one, for readers that began
before it, and is removed then, with anything that an interrupted call left.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import exists, list_dir, make_dir, read_text, remove, rename, write_text

BATCH = "batch_id"

_VERSIONS = "_versions"
_MERGED = "_merged"


class Version(NamedTuple):
    number: int
    up_to_batch: int
    folder: str  # under _merged

    def path(self, out: str) -> str:
        return f"{out}/{_MERGED}/{self.folder}"


def batches(spark: SparkSession, out: str, after: int = -1) -> list[int]:
    """Numbers of the batch folders after a batch."""
    names = [entry.name for entry in list_dir(spark, out) if entry.is_dir]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}=")]
    return sorted(n for n in numbers if n > after)


def current_version(spark: SparkSession, out: str) -> Version | None:
    return next(iter(_versions(spark, out)), None)


def _versions(spark: SparkSession, out: str) -> list[Version]:
    """The newest first."""
    entries = list_dir(spark, f"{out}/{_VERSIONS}")
    numbers = sorted((int(e.name) for e in entries if e.name.isdigit()), reverse=True)
    texts = [(n, read_text(spark, f"{out}/{_VERSIONS}/{n}")) for n in numbers]
    # One that went meanwhile is older than those that are kept.
    return [Version(n, **json.loads(text)) for n, text in texts if text is not None]


def read_batches(
    spark: SparkSession, out: str, schema: StructType, up_to_batch: int | None = None
) -> DataFrame:
    """All rows with the batch they are of; merged ones are of the last batch merged."""
    reader = spark.read.schema(with_batch(schema))
    version = current_version(spark, out)
    live = batches(spark, out, -1 if version is None else version.up_to_batch)
    if up_to_batch is not None:
        live = [n for n in live if n <= up_to_batch]
    parts = []
    if version is not None:
        base = version.path(out)
        merged = f"{base}/{BATCH}={version.up_to_batch}"
        parts.append(reader.option("basePath", base).parquet(merged))
    if live:
        folders = [f"{out}/{BATCH}={n}" for n in live]
        parts.append(reader.option("basePath", out).parquet(*folders))
    if not parts:
        return reader.parquet(out)  # appended files, or none
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BATCH, LongType(), True)])


def partitioning(spark: SparkSession, out: str) -> list[str]:
    """Columns that the table's folders are named after, from its newest batch with any."""
    version = current_version(spark, out)
    folders = [f"{out}/{BATCH}={n}" for n in reversed(batches(spark, out))]
    if version is not None:
        folders.append(f"{version.path(out)}/{BATCH}={version.up_to_batch}")
    for folder in folders:
        found: list[str] = []
        while True:
            inner = [e for e in list_dir(spark, folder) if e.is_dir and "=" in e.name]
            if not inner:
                break
            found.append(inner[0].name.split("=")[0])
            folder = inner[0].path
        if found:
            return found
    return []


def new_folder() -> str:
    return uuid.uuid4().hex


def merged_path(out: str, folder: str, up_to_batch: int) -> str:
    return f"{out}/{_MERGED}/{folder}/{BATCH}={up_to_batch}"


def commit(spark: SparkSession, out: str, up_to_batch: int, folder: str) -> None:
    """Make a merged folder part of the table, in place of all batches up to one."""
    versions = _versions(spark, out)
    number = versions[0].number + 1 if versions else 0
    make_dir(spark, f"{out}/{_VERSIONS}")
    target = f"{out}/{_VERSIONS}/{number}"
    draft = f"{out}/{_VERSIONS}/.{folder}"
    write_text(spark, draft, json.dumps({"up_to_batch": up_to_batch, "folder": folder}))
    if exists(spark, target):
        raise OSError(f"{out} was compacted by another call meanwhile")
    rename(spark, draft, target)


def clean(spark: SparkSession, out: str, kept: int = 2) -> None:
    """Remove what none of the newest ``kept`` versions needs."""
    versions = _versions(spark, out)
    needed, old = versions[:kept], versions[kept:]
    if len(versions) >= kept:
        oldest = needed[-1].up_to_batch
        for batch in batches(spark, out):
            if batch <= oldest:
                remove(spark, f"{out}/{BATCH}={batch}")
    folders = {v.folder for v in needed}
    for entry in list_dir(spark, f"{out}/{_MERGED}"):
        if entry.name not in folders:
            remove(spark, entry.path)
    for version in old:
        remove(spark, f"{out}/{_VERSIONS}/{version.number}")
