"""Whether a query's state and its table tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import flatten_window
from ..schema import RESULT_SCHEMA
from . import batch_log
from .sinks import read_changelog


def open_counts(spark: SparkSession, checkpoint: str, value: str = "count") -> DataFrame:
    """Counts of the windows that a query holds in its state, which Spark reads as a table.

    As of the last batch that is done. The query counts by window and keys and has no other state.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return flatten_window(state.select("key.*", F.col(f"value.{value}").alias(value)))


def reconcile(
    spark: SparkSession,
    out: str,
    checkpoint: str,
    schema: StructType = RESULT_SCHEMA,
    value: str = "count",
) -> DataFrame:
    """Open windows as a changelog table and its query's state have them, row by row.

    ``table_count`` and ``state_count`` are null where one side has no such key, ``agrees`` tells whether
    they are equal. Call it when the query has ended: otherwise the table may be a batch ahead. One shuffle
    of the state, as both sides are grouped by the key.
    """
    batch = batch_log.last_batch(spark, checkpoint)
    if batch is None:
        raise ValueError(f"{checkpoint} has no finished batch")
    mark = batch_log.watermark_ms(spark, checkpoint, batch)
    keys = [name for name in schema.names if name != value]
    table = read_changelog(spark, out, schema, value).where(
        F.unix_millis("window_end") > F.lit(mark)
    )
    both = table.select(*keys, F.col(value).alias("table_count"), F.lit(None).cast("long").alias("state_count"))
    both = both.unionByName(
        open_counts(spark, checkpoint, value).select(
            *keys, F.lit(None).cast("long").alias("table_count"), F.col(value).alias("state_count")
        )
    )
    # Keys may be null, so the sides are grouped and not joined.
    sides = both.groupBy(*keys).agg(
        F.max("table_count").alias("table_count"), F.max("state_count").alias("state_count")
    )
    return sides.withColumn("agrees", F.col("table_count").eqNullSafe(F.col("state_count")))
