"""What happens to the output of each micro-batch.

A writer is called as ``writer(batch_df, batch_id, rows)`` with the number of
rows, which is never 0 unless it ``takes_empty`` batches. ``each_batch`` runs any number of them on one result,
so several outputs cost one scan and one aggregation.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..operators import flatten_window, time_after_pane, top_groups
from ..schema import RESULT_SCHEMA
from ..storage import exists, read_text, remove, write_text
from . import batch_log, versions

Writer = Callable[[DataFrame, int, int], None]

ROWS_PER_FILE = 1_000_000

_RUN = "_run"


def each_batch(*writers: Writer) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each non-empty batch to all writers.

    The batch is persisted first: every action on it would otherwise repeat the
    scan and the state update. Counting it also makes sure that all partitions,
    and so all of the state, are computed even if a writer reads a few rows.
    """

    def process(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.persist()
        try:
            rows = batch_df.count()
            for write in writers:
                if rows or getattr(write, "takes_empty", False):
                    write(batch_df, batch_id, rows)
        finally:
            batch_df.unpersist()

    return process


def callback(function: Callable[[DataFrame, int], None]) -> Writer:
    """A writer that calls the user's ``function(batch_df, batch_id)``."""
    return lambda batch_df, batch_id, rows: function(batch_df, batch_id)


def console(rows_shown: int = 20, out: TextIO | None = None) -> Writer:
    """Print the first rows of each batch.

    Spark's own console sink brings a whole batch to the driver before it
    prints the first rows; here only the printed rows travel.
    """

    def write(batch_df: DataFrame, batch_id: int, rows: int) -> None:
        head = batch_df.limit(rows_shown).toPandas()
        text = [f"Batch {batch_id}: {rows} rows", head.to_string(index=False)]
        if rows > rows_shown:
            text.append(f"only the first {rows_shown} rows are shown")
        print("\n".join(text), file=out or sys.stdout, flush=True)

    return write


def append_table(
    out: str, partition_by: Sequence[str] = (), rows_per_file: int = ROWS_PER_FILE
) -> Writer:
    """Append each batch to the Parquet files in ``out``.

    A batch that is repeated after a failure is written a second time; use
    ``versioned_table`` where that matters.
    """

    def write(batch_df: DataFrame, batch_id: int, rows: int) -> None:
        write_parquet(batch_df, out, rows, partition_by, rows_per_file, mode="append")

    return write


def versioned_table(
    out: str, partition_by: Sequence[str] = (), rows_per_file: int = ROWS_PER_FILE
) -> Writer:
    """Write each batch to its own folder, ``out/batch_id=<n>``.

    A repeated batch replaces its folder, so the table is the same however
    often batches are retried. Read it with ``read_final`` or ``read_changelog``.
    """

    def write(batch_df: DataFrame, batch_id: int, rows: int) -> None:
        folder = f"{out}/{versions.BATCH}={batch_id}"
        write_parquet(batch_df, folder, rows, partition_by, rows_per_file, mode="overwrite")

    write.versioned_out = out
    return write


def top_table(out: str, n: int, key: str = "region", rows_per_file: int = ROWS_PER_FILE) -> Writer:
    """Write the top ``n`` groups of each window of a batch, versioned.

    For queries in final mode, others are refused: only there does a batch hold
    whole windows.
    """
    table = versioned_table(out, rows_per_file=rows_per_file)

    def write(batch_df: DataFrame, batch_id: int, rows: int) -> None:
        table(top_groups(batch_df, n, key), batch_id, rows)

    write.versioned_out = out
    write.whole_windows = True
    return write


class ClosedWindows:
    """Hands the windows that close in a batch of changes to another writer, each window once.

    For queries in changelog mode, which so serve both kinds of output with one
    scan and one state. The counts of windows that are still open lie in
    ``out/_open``, a folder per batch, which is written from that of the batch
    before and the batch's changes; a repeated batch writes the same again. A
    window is closed when the watermark that Spark noted for the batch has passed its end: the
    batch's own changes still count, later ones Spark drops.
    """

    takes_empty = True  # a batch without changes can close windows, too

    def __init__(self, writer: Writer, out: str, value: str = "count") -> None:
        self._writer, self._out, self._value = writer, out, value
        self.versioned_out = getattr(writer, "versioned_out", None)
        self.checkpoint: str | None = None  # set when the query starts

    def __call__(self, batch_df: DataFrame, batch_id: int, rows: int) -> None:
        spark = batch_df.sparkSession
        watermark = batch_log.watermark_ms(spark, self.checkpoint, batch_id)
        kept = f"{self._out}/_open/{versions.BATCH}="
        latest = batch_df
        if exists(spark, f"{kept}{batch_id - 1}"):
            before = spark.read.schema(batch_df.schema).parquet(f"{kept}{batch_id - 1}")
            keys = [c for c in batch_df.columns if c != self._value]
            # Counts only grow, so the larger one is the later.
            latest = before.unionByName(batch_df).groupBy(*keys).agg(
                F.max(self._value).alias(self._value)
            )
            latest = latest.select(*batch_df.columns)
        latest = latest.persist()
        try:
            done, still_open = self._split(latest, batch_id, watermark)
            done = done.persist()
            try:
                if closed := done.count():
                    self._writer(done, batch_id, closed)
            finally:
                done.unpersist()
            write_parquet(still_open, f"{kept}{batch_id}", still_open.count())
        finally:
            latest.unpersist()
        # The one before is needed again if this batch is repeated.
        remove(spark, f"{kept}{batch_id - 2}")

    def _split(self, latest: DataFrame, batch_id: int, watermark: int):
        """Results of the windows that close, and what is kept for later batches."""
        closed = F.unix_millis("window_end") <= F.lit(watermark)
        return latest.where(closed), latest.where(~closed)


class ClosedSlidingWindows(ClosedWindows):
    """The same for overlapping windows, from a query that counts by pane.

    A pane (``pane_counts``) is a part as long as the slide, so state and changes hold a row
    per pane and group where ``window_counts`` holds one per window. A window's count is the sum of its
    panes when it closes: events that come later for a pane still count in its later
    windows, as they do in a query by window.
    """

    def __init__(
        self, writer: Writer, out: str, length: str, slide: str, value: str = "count"
    ) -> None:
        super().__init__(writer, out, value)
        self._length, self._slide = length, slide

    def _split(self, latest: DataFrame, batch_id: int, watermark: int):
        keys = [c for c in latest.columns if c not in ("window_start", "window_end", self._value)]
        end = F.unix_millis("window.end")
        before = batch_log.late_ms(latest.sparkSession, self.checkpoint, batch_id)
        due = (end > F.lit(before)) & (end <= F.lit(watermark))
        windows = latest.withColumn("window", F.window("window_start", self._length, self._slide))
        sums = windows.where(due).groupBy("window", *keys).agg(
            F.sum(self._value).alias(self._value)
        )
        last_end = F.unix_millis("window_end") + F.lit(time_after_pane(self._length, self._slide))
        return flatten_window(sums), latest.where(last_end > F.lit(watermark))


def write_parquet(
    results: DataFrame,
    path: str,
    rows: int,
    partition_by: Sequence[str] = (),
    rows_per_file: int = ROWS_PER_FILE,
    mode: str = "overwrite",
) -> None:
    """Write ``rows`` rows in files of about ``rows_per_file``, at most twice that.

    ``partition_by`` may name any column, or ``window_day``, the date of
    ``window_start``, which makes fewer folders than ``window_start`` itself.
    The rows are then cut into ranges of equal size by those columns and the
    rest: a folder that holds much of the data is written by many tasks, and
    one task writes few folders.
    """
    files = max(1, -(-rows // rows_per_file))
    if "window_day" in partition_by:
        results = results.withColumn("window_day", F.to_date("window_start"))
    if partition_by:
        rest = [name for name in results.columns if name not in partition_by]
        results = results.repartitionByRange(files, *partition_by, *rest)
    else:
        results = results.coalesce(files)
    writer = results.write.mode(mode).option("maxRecordsPerFile", 2 * rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_final(
    spark: SparkSession,
    out: str,
    schema: StructType = RESULT_SCHEMA,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Rows of a table written in append mode: one per window and group.

    The schema is given, so a folder like ``region=007`` stays text. With ``start``
    or ``end`` only windows that start in between (``end`` itself is out); of a table with a
    folder per ``window_day``, only those days' folders are read.
    """
    days = "window_day" in versions.partitioning(spark, out) and "window_day" not in schema.names
    fields = [*schema.fields, StructField("window_day", DateType())] if days else schema.fields
    rows = spark.read.schema(StructType(fields)).parquet(out)
    # A day more on either side: the table may be written in another time zone.
    if start is not None:
        rows = rows.where(F.col("window_start") >= F.lit(start))
        if days:
            rows = rows.where(F.col("window_day") >= F.date_sub(F.to_date(F.lit(start)), 1))
    if end is not None:
        rows = rows.where(F.col("window_start") < F.lit(end))
        if days:
            rows = rows.where(F.col("window_day") <= F.date_add(F.to_date(F.lit(end)), 1))
    return rows.select(*schema.fieldNames())


def read_changelog(
    spark: SparkSession,
    out: str,
    schema: StructType = RESULT_SCHEMA,
    value: str = "count",
) -> DataFrame:
    """Latest ``value`` of each key of a table written in update mode.

    The other columns of ``schema`` are the key. A filter on them reaches the
    scan; add it to the result. Appended tables have no batch numbers; there
    the largest value is taken, which is the latest as counts only grow.
    """
    return _latest(versions.read_batches(spark, out, schema), schema, value)


def _latest(rows: DataFrame, schema: StructType, value: str) -> DataFrame:
    keys = [name for name in schema.fieldNames() if name != value]
    return rows.groupBy(*keys).agg(
        F.max_by(value, F.coalesce(versions.BATCH, value)).alias(value)
    )


def refuse_foreign_batches(
    spark: SparkSession, writers: Iterable[Writer], checkpoint: str
) -> None:
    """Fail if a versioned table holds batches of another run than ``checkpoint``'s.

    A new checkpoint counts its batches from 0 again and would replace them
    one by one, leaving a mixture.
    """
    known = read_text(spark, f"{checkpoint}/metadata")
    run = json.loads(known)["id"] if known else None
    for out in versioned_folders(writers):
        owner = read_text(spark, f"{out}/{_RUN}")
        if owner is not None:
            foreign = owner != run
        else:
            foreign = run is None and bool(versions.batches(spark, out))
        if foreign:
            raise ValueError(
                f"{out} holds batches of another run; use its checkpoint or a new folder"
            )


def versioned_folders(writers: Iterable[Writer]) -> list[str]:
    return [w.versioned_out for w in writers if getattr(w, "versioned_out", None)]


def claim(spark: SparkSession, writers: Iterable[Writer], run: str) -> None:
    """Note in each versioned table which query writes it."""
    for out in versioned_folders(writers):
        if read_text(spark, f"{out}/{_RUN}") is None:
            write_text(spark, f"{out}/{_RUN}", run)


def compact(
    spark: SparkSession,
    out: str,
    up_to_batch: int,
    schema: StructType = RESULT_SCHEMA,
    value: str = "count",
    kept_versions: int = 2,
    share: float = 0,
) -> None:
    """Replace the batches of an update-mode table up to one by their latest values.

    Call it for batches that the query has committed, one call at a time; the
    query and readers may go on meanwhile. The result keeps the table's
    partitioning and becomes part of the table in one step; a call that ends
    before it changes nothing. What it replaces is removed by the
    next call, for readers that have begun; ``kept_versions=1`` removes it at once.

    Each merge writes the whole table. For calls at short intervals, ``share`` leaves new batches where
    they are while they are fewer than that share of those merged before: all calls
    together then write a few times what the batches hold, not its square.
    """
    version = versions.current_version(spark, out)
    done = -1 if version is None else version.up_to_batch
    merged = [n for n in versions.batches(spark, out, done) if n <= up_to_batch]
    if len(merged) < share * (done + 1):
        return
    if len(merged) + (version is not None) > 1:
        latest = _latest(versions.read_batches(spark, out, schema, up_to_batch), schema, value)
        latest = latest.persist()
        folder = versions.new_folder()
        try:
            path = versions.merged_path(out, folder, merged[-1])
            write_parquet(latest, path, latest.count(), versions.partitioning(spark, out))
        finally:
            latest.unpersist()
        versions.commit(spark, out, merged[-1], folder)
    versions.clean(spark, out, kept_versions)
