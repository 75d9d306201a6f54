"""What Spark makes of the queries: pruned scans, shuffles, no Python."""

from __future__ import annotations

import re
from datetime import datetime, timezone

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
from tremorline.sources import feed_columns, read_feed, read_raw, write_microfiles
from tremorline.streaming import read_changelog, read_final, write_parquet

from .conftest import as_set


@pytest.fixture
def landing(spark, feed, tmp_path):
    write_microfiles(feed({"id": "1", "time": "0", "place": "a, B", "mag": "1"}), str(tmp_path))
    return str(tmp_path)


@pytest.fixture
def plan(spark):
    """The final physical plan, as it starts out."""

    def show(frame) -> str:
        return frame._jdf.queryExecution().executedPlan().toString()

    before = spark.conf.get("spark.sql.maxPlanStringLength")
    yield show
    spark.conf.set("spark.sql.maxPlanStringLength", before)


def _read_columns(text: str) -> list[str]:
    return re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", text)[1])


def test_counts_read_three_columns_and_shuffle_once(spark, landing, plan):
    text = plan(window_counts(enrich(read_feed(spark, landing))))
    assert _read_columns(text) == ["time", "mag", "place"]
    assert text.count("Exchange ") == 1
    assert "partial_count" in text
    assert "Python" not in text and "Pandas" not in text


def test_batch_counts_parse_the_time_once(spark, landing, plan):
    for options in ({}, {"length": "30 minutes", "slide": "10 minutes"}):
        text = plan(window_counts(enrich(read_feed(spark, landing)), **options))
        assert text.count("timestamp_millis") == 1


def test_sliding_counts_expand_counts_not_rows(spark, landing, plan):
    text = plan(
        window_counts(enrich(read_feed(spark, landing)), length="30 minutes", slide="10 minutes")
    )
    assert text.index("Expand") < text.index("partial_count")


def test_grid_counts_read_the_coordinates(spark, landing, plan):
    text = plan(group_counts(with_grid(read_feed(spark, landing)), ("lat_cell", "lon_cell")))
    assert _read_columns(text) == ["latitude", "longitude"]


def test_recent_rows_need_no_shuffle(spark, landing, plan):
    text = plan(keep_recent(feed_columns(read_raw(spark, landing)), 1))
    assert "Exchange" not in text


def test_top_groups_are_limited_before_the_shuffle(spark, landing, plan):
    counts = window_counts(enrich(read_feed(spark, landing)))
    text = plan(top_groups(counts, 3))
    assert text.count("WindowGroupLimit") == 2
    final, partial = (m.start() for m in re.finditer("WindowGroupLimit", text))
    assert "Exchange" in text[final:partial]
    direct = plan(top_groups(window_counts(enrich(read_feed(spark, landing)), ("region",)), 3))
    assert direct.count("Exchange ") == 2


def test_chained_top_groups_collect_per_bucket(spark, landing, plan):
    text = plan(top_groups_chained(enrich(read_feed(spark, landing)), 3))
    assert len(re.findall(r"functions=\[collect_list", text)) == 2
    assert text.count("Exchange hashpartitioning(window") == 3
    assert "pmod(xxhash64(region" in text


def test_filters_reach_the_stored_results(spark, feed, tmp_path, plan):
    counts = window_counts(enrich(feed({"time": "0", "place": "a, B"})))
    out = str(tmp_path / "out")
    write_parquet(counts, f"{out}/batch_id=0", 1, ("window_day", "region"))
    for read in (read_final, read_changelog):
        frame = read(spark, out).where("region = 'B' and window_start >= timestamp'1970-01-01'")
        text = plan(frame)
        assert "PartitionFilters: [isnotnull(region" in text
        assert "GreaterThanOrEqual(window_start" in text
    assert "SortAggregate" not in plan(read_changelog(spark, out))
    assert "count" not in _read_columns(plan(read_final(spark, out).select("window_start")))


@pytest.mark.parametrize("partition_by", [("window_day",), ("window_day", "region"), ("region",), ()])
def test_days_outside_are_not_read(spark, feed, tmp_path, plan, partition_by):
    hour = 3_600_000
    rows = [{"time": str(h * hour), "place": f"a, {h % 3}"} for h in range(240)]
    counts = window_counts(enrich(feed(*rows))).persist()
    out = str(tmp_path / "out")
    for batch in range(2):
        part = counts.where(F.dayofyear("window_start") % 2 == batch)
        write_parquet(part, f"{out}/batch_id={batch}", 120, partition_by)
    start, end = (datetime(1970, 1, d, 6, tzinfo=timezone.utc) for d in (4, 5))
    frame = read_final(spark, out, start=start, end=end)
    inside = (F.col("window_start") >= F.lit(start)) & (F.col("window_start") < F.lit(end))
    assert frame.columns == counts.columns
    assert as_set(frame) == as_set(counts.where(inside)) and frame.count() == 24
    assert as_set(read_final(spark, out, start=start)) == as_set(
        counts.where(F.col("window_start") >= F.lit(start))
    )
    if "window_day" in partition_by:
        assert re.search(r"PartitionFilters: \[[^]]*window_day", plan(frame))
        days = {re.search(r"window_day=([0-9-]+)", f)[1] for f in frame.inputFiles()}
        read = frame.select("_metadata.file_path").distinct().collect()
        assert days and {re.search(r"day=([0-9-]+)", r[0])[1] for r in read} <= {
            "1970-01-04", "1970-01-05"
        }
    counts.unpersist()
