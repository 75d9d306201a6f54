from __future__ import annotations

import csv
import os
import sys
import time

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tremorline.schema import FEED_COLUMNS  # noqa: E402
from tremorline.session import use_utc  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", False)
        .config("spark.sql.shuffle.partitions", 4)
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield use_utc(session)
    session.stop()


@pytest.fixture(params=[True, False], ids=["ansi", "legacy"])
def ansi(request, spark):
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, before)


@pytest.fixture
def feed(spark):
    """Makes feed rows from dicts; columns not given are null."""

    def make(*rows: dict):
        schema = ", ".join(f"{name} string" for name in FEED_COLUMNS)
        return spark.createDataFrame([[r.get(c) for c in FEED_COLUMNS] for r in rows], schema)

    return make


@pytest.fixture
def deliver():
    """Writes one landing file; ``age`` seconds old, so older ones come first."""

    def write(folder, name: str, rows: list[dict], age: float = 0) -> None:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        with open(path, "w", newline="") as out:
            writer = csv.DictWriter(out, FEED_COLUMNS)
            writer.writeheader()
            writer.writerows(rows)
        stamp = time.time() - age
        os.utime(path, (stamp, stamp))

    return write


def as_set(frame) -> set[tuple]:
    """Rows as a set of tuples, times as text."""
    rows = [tuple(str(v) if hasattr(v, "isoformat") else v for v in row) for row in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)
