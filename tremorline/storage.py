"""Folder calls on whatever file system a path names, through Hadoop's client.

Only names and times pass through the driver, never file contents.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


SCRATCH_SETTING = "spark.tremorline.scratch"


class FileEntry(NamedTuple):
    path: str
    name: str
    modified_ms: int
    is_dir: bool


def _locate(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _locate(spark, path)
    return fs.exists(jpath)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, jpath = _locate(spark, path)
    fs.mkdirs(jpath)


def list_dir(spark: SparkSession, path: str) -> list[FileEntry]:
    """Entries directly in ``path``; none where it does not exist."""
    fs, jpath = _locate(spark, path)
    if not fs.exists(jpath):
        return []
    return [
        FileEntry(
            status.getPath().toString(),
            status.getPath().getName(),
            status.getModificationTime(),
            status.isDirectory(),
        )
        for status in fs.listStatus(jpath)
    ]


def set_modified(spark: SparkSession, path: str, modified_ms: int) -> None:
    fs, jpath = _locate(spark, path)
    fs.setTimes(jpath, modified_ms, -1)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs, jpath = _locate(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, jpath = _locate(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, jpath = _locate(spark, old)
    if not fs.rename(jpath, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _locate(spark, path)
    fs.delete(jpath, True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """New folder for one run, removed when the session's JVM ends.

    It lies in the folder that driver and executors share: ``spark.checkpoint.dir``
    or, where the session has none, ``SCRATCH_SETTING``. Without either it fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH_SETTING, None)
    if not base:
        raise ValueError(
            f"set spark.checkpoint.dir or {SCRATCH_SETTING} to a folder that all executors share"
        )
    path = f"{base.rstrip('/')}/tremorline/{label}-{uuid.uuid4().hex}"
    make_dir(spark, path)
    fs, jpath = _locate(spark, path)
    fs.deleteOnExit(jpath)
    return path
