"""Batch counts, grid, recent rows and top groups."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tremorline.operators import (
    enrich,
    group_counts,
    keep_recent,
    top_groups,
    top_groups_chained,
    window_counts,
    with_grid,
)
from tremorline.schema import FEED_COLUMNS, RESULT_SCHEMA

from .conftest import as_set


def _timed(spark, rows):
    """(time text, region) pairs as a frame with ``event_ts``."""
    return spark.createDataFrame(rows, "t string, region string").select(
        F.col("t").cast("timestamp").alias("event_ts"), "region"
    )


def test_enrich_keeps_inputs_and_adds_columns(feed):
    frame = enrich(feed({"id": "1", "time": "0", "mag": "5", "place": "a, B"}))
    assert frame.columns == [*FEED_COLUMNS, "event_ts", "region", "mag_d", "magnitude_band"]
    row = frame.first()
    assert (row["time"], row["mag"], row["place"]) == ("0", "5", "a, B")


def test_result_schema(feed):
    counts = window_counts(enrich(feed({"time": "0"})))
    assert [(f.name, f.dataType) for f in counts.schema] == [
        (f.name, f.dataType) for f in RESULT_SCHEMA
    ]


def test_window_edges(spark):
    counts = window_counts(
        _timed(
            spark,
            [
                ("2026-01-01 00:00:00", "A"),
                ("2026-01-01 00:14:59.999", "A"),
                ("2026-01-01 00:15:00", "A"),
                ("1969-12-31 23:59:59", "A"),
                ("1970-01-01 00:00:00", "A"),
                (None, "A"),
                (None, "only without time"),
            ],
        ),
        ("region",),
    )
    assert as_set(counts) == {
        ("2026-01-01 00:00:00", "2026-01-01 00:15:00", "A", 2),
        ("2026-01-01 00:15:00", "2026-01-01 00:30:00", "A", 1),
        ("1969-12-31 23:45:00", "1970-01-01 00:00:00", "A", 1),
        ("1970-01-01 00:00:00", "1970-01-01 00:15:00", "A", 1),
    }


def _random_events(seed, rows=2000):
    """A third of the rows share one region and time, and a sixth have no time."""
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    events = []
    for _ in range(rows):
        if rng.random() < 1 / 3:
            events.append((start, "hot"))
        elif rng.random() < 1 / 4:
            events.append((None, f"r{rng.randrange(5)}"))
        else:
            moment = start + timedelta(milliseconds=rng.randrange(6 * 3600 * 1000))
            events.append((moment, f"r{rng.randrange(40)}"))
    return events


def _brute_force(events, length, slide):
    counts = Counter()
    epoch = datetime(1970, 1, 1)
    for moment, region in events:
        if moment is None:
            continue
        begin = epoch + (moment - epoch) // slide * slide
        while begin + length > moment:
            counts[begin, begin + length, region] += 1
            begin -= slide
    return counts


@pytest.mark.parametrize(
    "length, slide",
    [(15, None), (30, 10), (25, 10), (60, 5), (10, 10)],
)
def test_windows_against_brute_force(spark, length, slide):
    events = _random_events(length)
    frame = spark.createDataFrame(
        [(t and t.replace(tzinfo=timezone.utc), r) for t, r in events],
        "event_ts timestamp, region string",
    ).repartition(6)
    counts = window_counts(
        frame, ("region",), f"{length} minutes", slide and f"{slide} minutes"
    )
    wanted = _brute_force(
        events, timedelta(minutes=length), timedelta(minutes=slide or length)
    )
    assert as_set(counts) == {(str(a), str(b), r, n) for (a, b, r), n in wanted.items()}


def test_sliding_with_a_duration_only_spark_reads(spark):
    frame = _timed(spark, [("2026-01-01 00:05:00", "A")])
    counts = window_counts(frame, ("region",), "interval 30 minutes", "interval 10 minutes")
    assert counts.count() == 3


def test_group_counts(feed):
    rows = [{"time": None, "place": "x, A", "mag": "1"}] * 3 + [{"place": "x, A", "mag": "7"}]
    assert as_set(group_counts(enrich(feed(*rows)))) == {("A", "[0-2)", 3), ("A", "6+", 1)}


def test_grid_columns(feed):
    row = with_grid(feed({"latitude": "38.8", "longitude": "-122.8"}), 10).first()
    assert (row["lat_cell"], row["lon_cell"]) == (30.0, -130.0)


def test_keep_recent(feed):
    now = datetime(2026, 1, 10, tzinfo=timezone.utc)
    day = 86_400_000
    rows = [
        {"id": "edge", "time": "2026-01-08T00:00:00Z"},
        {"id": "before", "time": "2026-01-07T23:59:59.999Z"},
        {"id": "millis", "time": str(int(now.timestamp() * 1000) - day)},
        {"id": "unreadable", "time": "soon"},
        {"id": "none"},
    ]
    ids = {row["id"] for row in keep_recent(feed(*rows), 2, now).collect()}
    assert ids == {"edge", "millis"}
    assert keep_recent(feed(*rows), 2, now.replace(tzinfo=None)).count() == 2
    assert keep_recent(feed(*rows), 0, now).count() == 5
    with pytest.raises(ValueError):
        keep_recent(feed(*rows), -1)


def _brute_force_top(counts, n):
    by_window = {}
    for (begin, end, region), count in counts.items():
        by_window.setdefault((begin, end), []).append((-count, region))
    return {
        (str(begin), str(end), rank, region, -negated)
        for (begin, end), groups in by_window.items()
        for rank, (negated, region) in enumerate(sorted(groups)[:n], 1)
    }


@pytest.mark.parametrize("n", [1, 3, 100])
def test_top_groups_against_brute_force(spark, n):
    events = _random_events(7)
    frame = spark.createDataFrame(
        [(t and t.replace(tzinfo=timezone.utc), r) for t, r in events],
        "event_ts timestamp, region string",
    ).repartition(6)
    quarter = timedelta(minutes=15)
    wanted = _brute_force_top(_brute_force(events, quarter, quarter), n)
    by_band = frame.withColumn("band", F.length("region"))
    assert as_set(top_groups(window_counts(frame, ("region",)), n)) == wanted
    assert as_set(top_groups(window_counts(by_band, ("region", "band")), n)) == wanted
    for buckets in (1, 3, 1024):
        chained = top_groups_chained(frame, n, buckets=buckets)
        assert as_set(chained) == wanted


def test_top_groups_needs_a_positive_number(spark):
    frame = _timed(spark, [("2026-01-01", "A")])
    for call in (lambda: top_groups(frame, 0), lambda: top_groups_chained(frame, 0)):
        with pytest.raises(ValueError):
            call()
