"""Late events kept whole, windows made of panes, the state checked, bounded lists."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tremorline.operators import enrich, pane_counts, top_groups, top_groups_chained, window_counts
from tremorline.sources import read_feed
from tremorline.streaming import (
    ClosedSlidingWindows,
    LateEvents,
    callback,
    open_counts,
    read_changelog,
    read_final,
    read_late,
    reconcile,
    start,
    start_sliding,
    stream_counts,
    stream_events,
    versioned_table,
    wait_for_all,
)

from .conftest import as_set
from .test_streaming import HOUR, MINUTE, event, run

SLIDING = {"length": "1 hour", "slide": "20 minutes"}
FILES = 13  # more than ten, so that the source's log is merged


@pytest.fixture
def paths(tmp_path):
    return {"out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "checkpoint")}


@pytest.fixture
def untidy(tmp_path, deliver):
    """Files whose events go on by an hour each, with some of up to six hours before.

    The folder's and the files' names hold signs that paths encode and patterns use.
    """
    landing = tmp_path / "a b%[1]"
    made = random.Random(3)
    for number in range(FILES):
        rows = []
        for i in range(60):
            back = made.choice((0, 0, 0, 1, 2, 6))
            at = (number - back) * HOUR + made.randrange(60) * MINUTE
            rows.append({**event(at, made.choice("AB")), "id": f"{number}-{i}"})
        rows.append({"id": f"{number}-none", "time": "?", "place": "x, A"})
        deliver(landing, f"{number} {{x}}*.csv", rows, age=100 - number)
    return str(tmp_path / "a b%?1?")


def too_late(spark, landing, length_ms, slide_ms, delay_ms=30 * MINUTE):
    """Events and windows by the rule written out: file by file in order, a batch each."""
    rows = read_feed(spark, landing).select("id", "time").collect()
    by_file: dict[int, list] = {}
    for row in rows:
        if row["time"] != "?":
            by_file.setdefault(int(row["id"].split("-")[0]), []).append((row["id"], int(row["time"])))
    late, latest, before, mark = Counter(), 0, 0, 0
    for number in sorted(by_file):
        for name, at in by_file[number]:
            start = at // slide_ms * slide_ms
            while start + length_ms > at:
                if start + length_ms <= before:
                    late[(name, start)] += 1
                start -= slide_ms
        latest = max(latest, *(at for _, at in by_file[number]))
        before, mark = mark, max(mark, latest - delay_ms)
    return late


def kept(frame):
    rows = frame.select("id", F.unix_millis("window_start").alias("start")).collect()
    return Counter((r["id"], r["start"]) for r in rows)


@pytest.mark.parametrize("options, length, slide", [({}, 15, 15), (SLIDING, 60, 20)])
def test_late_events_are_kept(spark, untidy, paths, tmp_path, options, length, slide):
    late = LateEvents(str(tmp_path / "late"), **options)
    run(stream_counts(spark, untidy, max_files=1, **options), paths, late, mode="changelog")
    found = read_late(spark, str(tmp_path / "late"))
    expected = too_late(spark, untidy, length * MINUTE, slide * MINUTE)
    assert len(expected) > 20
    assert kept(found) == expected
    # What was counted and what was dropped are all.
    counted = read_changelog(spark, paths["out"]).agg(F.sum("count")).first()[0]
    everything = window_counts(enrich(read_feed(spark, untidy)), **options)
    assert counted + found.count() == everything.agg(F.sum("count")).first()[0]


def test_late_events_through_a_failure(spark, untidy, paths, tmp_path):
    broken = [True]

    def fail_once(frame, batch):
        if batch == 8 and broken:
            broken.clear()
            raise RuntimeError("writer broke")

    def go():
        late = LateEvents(str(tmp_path / "late"))
        counts = stream_counts(spark, untidy, max_files=1)
        run(counts, paths, late, callback(fail_once), mode="changelog")

    with pytest.raises(StreamingQueryException):
        go()
    for _ in range(2):
        go()
    found = read_late(spark, str(tmp_path / "late"))
    assert kept(found) == too_late(spark, untidy, 15 * MINUTE, 15 * MINUTE)


def test_batches_that_are_late_as_a_whole(spark, tmp_path, deliver, paths):
    """Nothing before 1970 is counted in a stream; it is late, too."""
    landing = str(tmp_path / "in")
    times = (-HOUR, 9 * HOUR, 1, HOUR, 2 * HOUR)
    for number, at in enumerate(times):
        deliver(landing, f"{number}.csv", [event(at)], age=9 - number)
    late = LateEvents(str(tmp_path / "late"))
    run(stream_counts(spark, landing, max_files=1), paths, late, mode="changelog")
    rows = read_late(spark, str(tmp_path / "late")).collect()
    assert {(r["batch_id"], r["time"]) for r in rows} == {
        (0, str(-HOUR)), (3, str(HOUR)), (4, str(2 * HOUR))
    }
    assert read_changelog(spark, paths["out"]).agg(F.sum("count")).first()[0] == 2


@pytest.mark.parametrize("max_files", [None, 1, 3])
def test_windows_from_panes(spark, untidy, paths, tmp_path, max_files):
    """Every batch closes the same windows with the same counts as a query by window."""
    own = {k: f"{v}-window" for k, v in paths.items()}
    query = start_sliding(
        stream_events(spark, untidy, max_files=max_files), paths["out"], paths["checkpoint"],
        until_caught_up=True, state_partitions=2, **SLIDING,
    )
    wait_for_all([query])
    run(stream_counts(spark, untidy, max_files=max_files, **SLIDING), own)
    ours, theirs = as_set(read_final(spark, paths["out"])), as_set(read_final(spark, own["out"]))
    assert ours == theirs and len(ours) > 50


def test_windows_from_panes_through_a_failure(spark, untidy, paths, tmp_path):
    own = {k: f"{v}-window" for k, v in paths.items()}
    broken = [True]

    def fail_once(frame, batch):
        if batch == 4 and broken:
            broken.clear()
            raise RuntimeError("writer broke")

    def go():
        panes = pane_counts(stream_events(spark, untidy, max_files=2), ("region", "magnitude_band"), **SLIDING)
        closing = ClosedSlidingWindows(versioned_table(paths["out"]), paths["out"], **SLIDING)
        wait_for_all([start(panes, closing, callback(fail_once), mode="changelog",
                            until_caught_up=True, checkpoint=paths["checkpoint"], state_partitions=2)])

    with pytest.raises(StreamingQueryException):
        go()
    go()
    run(stream_counts(spark, untidy, max_files=2, **SLIDING), own)
    assert as_set(read_final(spark, paths["out"])) == as_set(read_final(spark, own["out"]))


def test_a_pane_is_one_state_row(spark, tmp_path, deliver, paths):
    landing = str(tmp_path / "in")
    deliver(landing, "a.csv", [event(i * MINUTE, region) for i in range(60) for region in "AB"])
    start_sliding(stream_events(spark, landing), paths["out"], paths["checkpoint"],
                  until_caught_up=True, state_partitions=2, **SLIDING).awaitTermination()
    # 29 minutes is the watermark: no window of the panes has closed; three panes, two regions.
    assert open_counts(spark, paths["checkpoint"]).count() == 6


def test_panes_must_fit(spark, feed):
    with pytest.raises(ValueError, match="multiple"):
        pane_counts(enrich(feed(event(0))), ("region",), "1 hour", "25 minutes")


def test_panes_of_a_table_are_its_tumbling_windows(spark, feed):
    events = enrich(feed(*(event(i * MINUTE) for i in range(90))))
    panes = pane_counts(events, ("region",), **SLIDING)
    assert sorted(r["count"] for r in panes.collect()) == [10, 20, 20, 20, 20]


def test_state_and_table_agree(spark, untidy, paths):
    run(stream_counts(spark, untidy, max_files=2), paths, mode="changelog")
    rows = reconcile(spark, paths["out"], paths["checkpoint"])
    assert rows.count() > 3 and rows.where("not agrees").count() == 0
    # A batch folder that is lost shows as keys which the table lacks or has older.
    last = sorted(
        r["batch_id"] for r in spark.read.parquet(paths["out"]).select("batch_id").distinct().collect()
    )[-1]
    spark.read.parquet(paths["out"]).where(F.col("batch_id") != last).write.partitionBy(
        "batch_id"
    ).parquet(paths["out"] + "-damaged")
    damaged = reconcile(spark, paths["out"] + "-damaged", paths["checkpoint"])
    assert damaged.where("not agrees").count() > 0


def test_no_finished_batch(spark, tmp_path):
    with pytest.raises(ValueError, match="no finished batch"):
        reconcile(spark, str(tmp_path / "out"), str(tmp_path / "checkpoint"))


GROUPS = 100_000


def test_lists_of_the_chained_top_are_bounded(spark, feed, tmp_path, deliver, paths):
    """100 000 groups in one window: no list holds more than ``n * buckets`` of them."""
    landing = str(tmp_path / "in")
    rows = spark.range(GROUPS).select(
        F.col("id").cast("string"), F.lit("0").alias("time"),
        *(F.lit("0").alias(c) for c in ("latitude", "longitude", "depth", "mag", "magType")),
        F.concat(F.lit("x; R"), F.col("id")).alias("place"), F.lit("e").alias("type"),
    )
    rows = rows.withColumn("place", F.regexp_replace("place", ";", ","))
    rows = rows.unionByName(rows.where("cast(id as int) in (7, 77, 777, 7777)"))
    rows.coalesce(1).write.option("header", True).csv(f"{landing}/a")
    n, buckets, levels = 3, 64, 3

    def go():
        events = stream_events(spark, f"{landing}/*")
        run(top_groups_chained(events, n, buckets=buckets, levels=levels), paths)

    go()
    deliver(f"{landing}/b", "late.csv", [event(10 * HOUR)])
    # Each level passes its rows on in the batch after the one in which they come.
    for _ in range(2):
        go()
    found = {(r["rank"], r["region"], r["count"]) for r in spark.read.parquet(paths["out"]).collect()}
    assert found == {(1, "R7", 2), (2, "R77", 2), (3, "R777", 2)}
    leaf = F.pmod(F.xxhash64(F.concat(F.lit("R"), F.col("id").cast("string"))), F.lit(buckets**levels))
    leaves = spark.range(GROUPS).groupBy(leaf.alias("leaf")).count()
    assert leaves.agg(F.max("count")).first()[0] <= n * buckets
    expected = top_groups(window_counts(enrich(read_feed(spark, f"{landing}/*")), ("region",)), n)
    assert found <= {(r["rank"], r["region"], r["count"]) for r in expected.collect()}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_the_tree_equals_the_window(spark, feed, levels):
    made = random.Random(levels)
    events = enrich(feed(*(event(made.randrange(4) * HOUR, f"R{made.randrange(40)}") for _ in range(500))))
    tree = top_groups_chained(events, 3, buckets=4, levels=levels)
    assert as_set(tree) == as_set(top_groups(window_counts(events, ("region",)), 3))


def test_the_tree_needs_levels(spark, feed):
    with pytest.raises(ValueError, match="levels"):
        top_groups_chained(enrich(feed(event(0))), 3, levels=0)
