"""The engine's queries over the ``events`` table, one function each.

Each takes ``(spark, data_dir)`` and returns a frame. Streaming ones write the
table's rows out as feed files, run a query over them until it has caught up,
and return what a reader of its output table sees.
"""

from __future__ import annotations

import sys
import threading
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import event_time as event_time_of
from ..operators import (
    enrich,
    group_counts,
    keep_recent,
    top_groups,
    top_groups_chained,
    window_counts,
    with_event_time,
    with_grid,
    with_region_and_magnitude,
)
from ..schema import FEED_COLUMNS, RESULT_SCHEMA
from ..session import use_utc
from ..sources import (
    feed_columns,
    feed_from_events,
    read_events,
    read_feed,
    read_rejects,
    write_microfiles,
)
from ..storage import exists, list_dir, scratch_dir, set_modified
from ..streaming import (
    LateEvents,
    LateRecorder,
    build_stream,
    compact,
    late_report,
    read_changelog,
    read_final,
    read_late,
    reconcile,
    start_sliding,
    start_table,
    stream_counts,
    stream_events,
    top_table,
    wait_for_all,
)
from ..streaming.batch_log import last_batch
from .prepare import deliver_ranges, prepare_microfiles, prepare_replay

TOP_N = 3
SLIDING = {"length": "30 minutes", "slide": "10 minutes"}
GRID = ("lat_cell", "lon_cell")
RECENT_DAYS = 7
RECENT_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)

# Events up to here are there when the restarted stream runs first.
RESTART_AT = datetime(2024, 1, 16, tzinfo=timezone.utc)

# Files and ranges of a replay: fixed sizes, so their number follows the data. A feed that makes more
# ranges than this has larger ones, as each is two batches of a stream.
ROWS_PER_FILE = 10_000
ROWS_PER_RANGE = 50_000
FEW_RANGES = 32

# New batches, as a share of those merged before, that are merged while a query runs.
COMPACT_SHARE = 0.5

# State partitions of these runs; a cluster's jobs choose their own.
STATE_PARTITIONS = 8

# The second files of the old-file query are this much older than the first.
OLDER_MS = 30 * 24 * 3600 * 1000

# One event in ten arrives after all others in the late-data queries.
LATE = "cast(id as bigint) % 10 = 0"

TOP_SCHEMA = StructType(
    [
        RESULT_SCHEMA["window_start"],
        RESULT_SCHEMA["window_end"],
        StructField("rank", IntegerType(), True),
        RESULT_SCHEMA["region"],
        RESULT_SCHEMA["count"],
    ]
)


# Batch queries ------------------------------------------------------------


def event_time(spark: SparkSession, data_dir: str) -> DataFrame:
    feed = feed_from_events(use_utc(spark), data_dir)
    return with_event_time(feed).select("id", "time", "event_ts")


def event_time_forms(spark: SparkSession, data_dir: str) -> DataFrame:
    """Signed, fractional, exponent, padded, offset and 16-digit times, in microseconds."""
    events = read_events(use_utc(spark), data_dir)
    number, instant = F.col("event_id"), F.col("event_ts")
    millis = F.unix_millis(instant).cast("string")
    kind = F.pmod(number, F.lit(8))
    local = F.date_format(instant + F.expr("interval '5:30' hour to minute"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(kind == 0, F.concat(F.lit("+"), millis))
        .when(kind == 1, F.concat(millis, F.lit(".9996")))
        .when(kind == 2, F.concat(F.lit("0" * 40), millis))
        .when(kind == 3, F.concat(F.unix_seconds(instant).cast("string"), F.lit("e3")))
        .when(kind == 4, F.concat(F.lit("-"), millis))
        .when(kind == 5, F.concat(local, F.lit("+05:30")))
        .when(kind == 6, F.concat(millis, F.lit("000")))
        .otherwise("1e-100")
    )
    micros = F.unix_micros(event_time_of(text))
    return events.select(number.cast("string").alias("id"), micros.alias("event_us"))


def region_mag(spark: SparkSession, data_dir: str) -> DataFrame:
    feed = feed_from_events(use_utc(spark), data_dir)
    return with_region_and_magnitude(feed).select("id", "region", "mag_d", "magnitude_band")


def window_count_report(spark: SparkSession, data_dir: str) -> DataFrame:
    return window_counts(_events(spark, data_dir))


def sliding_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    return window_counts(_events(spark, data_dir), **SLIDING)


def region_band_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    return group_counts(_events(spark, data_dir))


def grid_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    return group_counts(with_grid(feed_from_events(use_utc(spark), data_dir)), GRID)


def grid_window_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    return window_counts(with_grid(_events(spark, data_dir)), (*GRID, "magnitude_band"))


def topn_batch(spark: SparkSession, data_dir: str) -> DataFrame:
    return top_groups(window_counts(_events(spark, data_dir), ("region",)), TOP_N)


def recent_days(spark: SparkSession, data_dir: str) -> DataFrame:
    feed = feed_from_events(use_utc(spark), data_dir)
    return keep_recent(feed, RECENT_DAYS, RECENT_NOW).select("id", "time", "place")


# File layouts -------------------------------------------------------------


def microfile_roundtrip(spark: SparkSession, data_dir: str) -> DataFrame:
    """Raw files with other columns in another order, cut into microfiles."""
    base = scratch_dir(use_utc(spark), "microfiles")
    feed = feed_from_events(spark, data_dir)
    raw = feed.select(F.lit("x").alias("extra"), *reversed(FEED_COLUMNS))
    raw.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/raw")
    prepare_microfiles(spark, f"{base}/raw", f"{base}/landing")
    return read_feed(spark, f"{base}/landing")


def feed_rejects(spark: SparkSession, data_dir: str) -> DataFrame:
    """Lines with a value too many or with too few, of files that also hold whole ones."""
    base = scratch_dir(use_utc(spark), "rejects")
    number = F.col("event_id")
    kind = F.pmod(number, F.lit(10))
    values = (
        F.when(kind == 0, ",1,0,0,0,2,ml,near x, CA,earthquake")
        .when(kind == 1, ",1,0")
        .otherwise(",1,0,0,0,2,ml,near x; CA,earthquake")
    )
    lines = read_events(spark, data_dir).select(
        F.concat(number.cast("string"), values).alias(",".join(FEED_COLUMNS))
    )
    # A separator that stands in no line, so that lines are written as they are.
    lines.write.option("header", True).option("sep", "\u0001").csv(f"{base}/feed")
    return read_rejects(spark, f"{base}/feed")


def replay_roundtrip(spark: SparkSession, data_dir: str) -> DataFrame:
    base, source = _replay(use_utc(spark), data_dir, "replay")
    deliver_ranges(spark, f"{base}/prepared", f"{base}/all")
    return read_feed(spark, source["landing"])


def replay_order(spark: SparkSession, data_dir: str) -> DataFrame:
    """Whether each event comes no earlier than all events of the ranges before its own."""
    base, source = _replay(use_utc(spark), data_dir, "replay-order")
    deliver_ranges(spark, f"{base}/prepared", f"{base}/all")
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder")
    events = with_event_time(read_feed(spark, source["landing"]).select("id", "time", folder))
    spans = events.groupBy("folder").agg(F.max("event_ts").alias("latest"))
    # A row per range.
    earlier = Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.max("latest").over(earlier))
    in_order = F.coalesce(F.col("event_ts") >= F.col("before"), F.col("before").isNull())
    return events.join(spans, "folder").select("id", in_order.alias("in_order"))


# Streaming queries --------------------------------------------------------


def stream_final(spark: SparkSession, data_dir: str) -> DataFrame:
    return _final(spark, data_dir, "final")


def stream_changelog(spark: SparkSession, data_dir: str) -> DataFrame:
    base, source = _replay(use_utc(spark), data_dir, "changelog")
    _run(stream_counts(spark, **source), base, mode="changelog")
    return read_changelog(spark, f"{base}/out")


def changelog_compacted(spark: SparkSession, data_dir: str) -> DataFrame:
    """A partitioned changelog table that is compacted while its query runs, and after it.

    The result is read before the last compaction removes what it was read from.
    """
    base, source = _replay(use_utc(spark), data_dir, "compacted")
    out, counts = f"{base}/out", stream_counts(spark, **source)
    query = start_table(
        counts,
        out,
        f"{base}/checkpoint",
        partition_by=("region",),
        mode="changelog",
        state_partitions=STATE_PARTITIONS,
    )
    done = threading.Event()

    def keep_compact() -> None:
        while not done.wait(1):
            # The batch that is being written is left alone.
            committed = last_batch(spark, f"{base}/checkpoint")
            if committed is not None:
                compact(spark, out, committed, share=COMPACT_SHARE)

    compacting = threading.Thread(target=keep_compact)
    compacting.start()
    try:
        _delivered(spark, base, [query])
    finally:
        done.set()
        compacting.join()
    last = query.lastProgress.batchId
    compact(spark, out, last - 1)
    read = read_changelog(spark, out)
    compact(spark, out, last)
    return read


def append_readback(spark: SparkSession, data_dir: str) -> DataFrame:
    base, source = _replay(use_utc(spark), data_dir, "append")
    _run(stream_counts(spark, **source), base, table="append")
    return read_final(spark, f"{base}/out")


def window_day_readback(spark: SparkSession, data_dir: str) -> DataFrame:
    base, source = _replay(use_utc(spark), data_dir, "window-day")
    _run(stream_counts(spark, **source), base, partition_by=("window_day",))
    return read_final(spark, f"{base}/out")


def window_day_pruned(spark: SparkSession, data_dir: str) -> DataFrame:
    """The later windows of the same table; folders of earlier days are not read."""
    base, source = _replay(use_utc(spark), data_dir, "window-day-pruned")
    _run(stream_counts(spark, **source), base, partition_by=("window_day",))
    return read_final(spark, f"{base}/out", start=RESTART_AT)


def stream_sliding_final(spark: SparkSession, data_dir: str) -> DataFrame:
    return _final(spark, data_dir, "sliding", **SLIDING)


def stream_sliding_panes(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same windows from a query that counts by pane."""
    base, source = _replay(use_utc(spark), data_dir, "panes")
    query = start_sliding(
        stream_events(spark, **source),
        f"{base}/out",
        f"{base}/checkpoint",
        state_partitions=STATE_PARTITIONS,
        **SLIDING,
    )
    _delivered(spark, base, [query])
    return read_final(spark, f"{base}/out")


def stream_grid_final(spark: SparkSession, data_dir: str) -> DataFrame:
    """By coordinate cell in place of region."""
    base, source = _replay(use_utc(spark), data_dir, "grid")
    cells = window_counts(with_grid(stream_events(spark, **source)), (*GRID, "magnitude_band"))
    _run(cells, base)
    return read_final(spark, f"{base}/out", cells.schema)


def partitioned_readback(spark: SparkSession, data_dir: str) -> DataFrame:
    base, source = _replay(use_utc(spark), data_dir, "partitioned")
    _run(stream_counts(spark, **source), base, partition_by=("region",))
    return read_final(spark, f"{base}/out")


def topn_regions(spark: SparkSession, data_dir: str) -> DataFrame:
    """Ranked in the callback of the query that also keeps the counts."""
    base, source = _replay(use_utc(spark), data_dir, "topn")
    _run(stream_counts(spark, **source), base, top_table(f"{base}/top", TOP_N))
    return read_final(spark, f"{base}/top", TOP_SCHEMA)


def topn_regions_chained(spark: SparkSession, data_dir: str) -> DataFrame:
    base, source = _replay(use_utc(spark), data_dir, "chained")
    _run(top_groups_chained(stream_events(spark, **source), TOP_N), base)
    return read_final(spark, f"{base}/out", TOP_SCHEMA)


def topn_regions_tree(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same by lists that are cut to the best in two levels."""
    base, source = _replay(use_utc(spark), data_dir, "tree")
    _run(top_groups_chained(stream_events(spark, **source), TOP_N, buckets=32, levels=2), base)
    return read_final(spark, f"{base}/out", TOP_SCHEMA)


def console_and_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """The standard job: changes to the console, closed windows to a table, from one query."""
    base, source = _replay(use_utc(spark), data_dir, "job")
    queries = build_stream(
        spark,
        out=f"{base}/out",
        checkpoint=f"{base}/checkpoint",
        console_out=sys.stderr,
        state_partitions=STATE_PARTITIONS,
        **source,
    )
    _delivered(spark, base, queries[:1])
    return read_final(spark, f"{base}/out")


def stream_restart(spark: SparkSession, data_dir: str) -> DataFrame:
    """Half of the files, then all, then nothing new, on one checkpoint."""
    return _restarted(use_utc(spark), data_dir, "restart")


def stream_old_file(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same with second files that carry much older file times."""
    return _restarted(use_utc(spark), data_dir, "old-file", OLDER_MS)


def _restarted(spark: SparkSession, data_dir: str, label: str, older_ms: int = 0) -> DataFrame:
    base = scratch_dir(spark, label)
    events = with_event_time(feed_from_events(spark, data_dir))
    early = F.coalesce(F.col("event_ts") < F.lit(RESTART_AT), F.lit(True))
    write_microfiles(feed_columns(events.where(early)), f"{base}/landing/first")
    _run(stream_counts(spark, f"{base}/landing/*"), base)
    write_microfiles(feed_columns(events.where(~early)), f"{base}/landing/second")
    if older_ms:
        for entry in list_dir(spark, f"{base}/landing/second"):
            set_modified(spark, entry.path, entry.modified_ms - older_ms)
    for _ in range(2):
        _run(stream_counts(spark, f"{base}/landing/*"), base)
    return read_final(spark, f"{base}/out")


def stream_late(spark: SparkSession, data_dir: str) -> DataFrame:
    """Counts when one event in ten comes after the watermark has passed it."""
    base, _ = _late_runs(use_utc(spark), data_dir)
    return read_changelog(spark, f"{base}/out")


def late_batches(spark: SparkSession, data_dir: str) -> DataFrame:
    """The report of the same runs."""
    _, queries = _late_runs(use_utc(spark), data_dir)
    return _late_columns(late_report(spark, queries))


def late_recorded(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same report, from the table that a recorder has written."""
    recorder = LateRecorder(use_utc(spark), f"{scratch_dir(spark, 'late-report')}/rows", held=2)
    spark.streams.addListener(recorder)
    try:
        _, queries = _late_runs(spark, data_dir)
        batches = sum(len(query.recentProgress) for query in queries)
        # The listener is called in the background, shortly after each batch.
        deadline = time.monotonic() + 60
        while recorder.report().count() < batches and time.monotonic() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(recorder)
    return _late_columns(recorder.report())


def late_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """The events that the same runs drop, each with the window that it missed."""
    base, _ = _late_runs(use_utc(spark), data_dir, keep_late=True)
    return read_late(spark, f"{base}/late").select("id", "time", "window_start", "window_end")


def state_reconciled(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same runs' open windows as their state and their table have them."""
    base, _ = _late_runs(use_utc(spark), data_dir)
    return reconcile(spark, f"{base}/out", f"{base}/checkpoint")


def _late_columns(report: DataFrame) -> DataFrame:
    return report.select(
        "batch_id",
        "input_rows",
        "watermark",
        (F.col("late_groups_dropped") > 0).alias("late_dropped"),
        "state_rows",
    )


def _events(spark: SparkSession, data_dir: str) -> DataFrame:
    return enrich(feed_from_events(use_utc(spark), data_dir))


def _replay(spark: SparkSession, data_dir: str, label: str) -> tuple[str, dict]:
    """Feed files by range of event time, and where a stream finds them when they are delivered."""
    base = scratch_dir(spark, label)
    feed = feed_from_events(spark, data_dir)
    prepare_replay(
        feed,
        f"{base}/prepared",
        ROWS_PER_FILE,
        fixed_order=True,
        range_records=ROWS_PER_RANGE,
        few_ranges=FEW_RANGES,
    )
    return base, {"landing": f"{base}/all/*"}


def _delivered(spark: SparkSession, base: str, queries) -> None:
    """Hand the prepared ranges to running queries and end them."""
    try:
        deliver_ranges(
            spark, f"{base}/prepared", f"{base}/all", queries, archive=f"{base}/taken"
        )
    finally:
        for query in queries:
            query.stop()


def _run(results: DataFrame, base: str, *also, **options):
    """Read what was prepared in ``base`` range by range, or else all that is there at once."""
    spark = results.sparkSession
    prepared = exists(spark, f"{base}/prepared")
    query = start_table(
        results,
        f"{base}/out",
        f"{base}/checkpoint",
        *also,
        until_caught_up=not prepared,
        state_partitions=STATE_PARTITIONS,
        **options,
    )
    if prepared:
        _delivered(spark, base, [query])
    else:
        wait_for_all([query])
    return query


def _final(spark: SparkSession, data_dir: str, label: str, **counts) -> DataFrame:
    base, source = _replay(use_utc(spark), data_dir, label)
    _run(stream_counts(spark, **source, **counts), base)
    return read_final(spark, f"{base}/out")


def _late_runs(spark: SparkSession, data_dir: str, keep_late: bool = False):
    base = scratch_dir(spark, "late")
    feed = feed_from_events(spark, data_dir)
    queries = []
    for folder, rows in (("first", f"not ({LATE})"), ("second", LATE)):
        write_microfiles(feed_columns(feed.where(rows)), f"{base}/landing/{folder}")
        results = stream_counts(spark, f"{base}/landing/*")
        also = [LateEvents(f"{base}/late")] if keep_late else []
        queries.append(_run(results, base, *also, mode="changelog"))
    return base, queries


QUERIES = {
    "window_counts": window_count_report,
    "sliding_counts": sliding_counts,
    "region_band_counts": region_band_counts,
    "event_time": event_time,
    "event_time_forms": event_time_forms,
    "region_mag": region_mag,
    "grid_counts": grid_counts,
    "grid_window_counts": grid_window_counts,
    "topn_batch": topn_batch,
    "recent_days": recent_days,
    "microfile_roundtrip": microfile_roundtrip,
    "feed_rejects": feed_rejects,
    "replay_roundtrip": replay_roundtrip,
    "replay_order": replay_order,
    "stream_final": stream_final,
    "stream_changelog": stream_changelog,
    "changelog_compacted": changelog_compacted,
    "append_readback": append_readback,
    "window_day_readback": window_day_readback,
    "window_day_pruned": window_day_pruned,
    "stream_old_file": stream_old_file,
    "late_recorded": late_recorded,
    "late_events": late_events,
    "state_reconciled": state_reconciled,
    "stream_sliding_panes": stream_sliding_panes,
    "topn_regions_tree": topn_regions_tree,
    "stream_sliding_final": stream_sliding_final,
    "stream_grid_final": stream_grid_final,
    "partitioned_readback": partitioned_readback,
    "topn_regions": topn_regions,
    "topn_regions_chained": topn_regions_chained,
    "console_and_table": console_and_table,
    "stream_restart": stream_restart,
    "stream_late": stream_late,
    "late_batches": late_batches,
}
