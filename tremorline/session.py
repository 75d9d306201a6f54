"""Spark session with the settings the timestamps rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Read and show times without a zone as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def open_session(app_name: str = "tremorline", conf: dict[str, str] | None = None) -> SparkSession:
    """Session by name, with optional extra settings.

    For streams whose state outgrows executor memory pass ``ROCKSDB_STATE``.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return use_utc(spark)


ROCKSDB_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
