"""Event feeds in CSV files, read as a table or as a stream, and written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import FEED_COLUMNS, FEED_SCHEMA

# Fixed value: default number of rows in a microfile.
MAX_RECORDS = 10_000

# Bytes of a micro-batch unless the caller chooses, so that a first batch does
# not take all that has landed.
MAX_BYTES = 1 << 30

# Moving a file keeps its time, so no age makes a delivered file too old.
MAX_FILE_AGE = "36500d"

# Standard CSV: a quote inside a quoted value is doubled, a backslash is a backslash.
_CSV = {"quote": '"', "escape": '"'}


# A line that does not have the feed's number of values.
_LINE = "_line"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw feed files: columns by header name, all text.

    The header of one file names the columns of all; a file whose header
    differs fails the job instead of loading values under the wrong names.
    """
    reader = spark.read.options(**_CSV).option("header", True)
    return reader.option("enforceSchema", False).csv(path)


def feed_columns(raw: DataFrame) -> DataFrame:
    """The feed's columns in file order; others are left out."""
    return raw.select(*FEED_COLUMNS)


def read_feed(spark: SparkSession, path: str, check_header: bool = True) -> DataFrame:
    """Feed files (as ``write_microfiles`` writes them) as a table."""
    return _feed_options(spark.read, check_header).csv(path)


def read_rejects(spark: SparkSession, path: str, check_header: bool = True) -> DataFrame:
    """Lines of feed files that have more or fewer values than the feed has columns.

    ``line`` is as it stands in the file, ``id`` its first value. ``read_feed``
    loads such lines with values under wrong names or missing; ``read_whole_rows`` does not.
    """
    rows = _with_rejects(spark.read, check_header).csv(path)
    return rows.where(_is_whole(False)).select("id", F.col(_LINE).alias("line"))


def read_whole_rows(spark: SparkSession, path: str, check_header: bool = True) -> DataFrame:
    """Feed files as a table, without the lines that ``read_rejects`` gives."""
    rows = _with_rejects(spark.read, check_header).csv(path)
    return rows.where(_is_whole(True)).select(*FEED_COLUMNS)


def _is_whole(wanted: bool) -> Column:
    # Spark refuses to read that column alone, so the condition needs another one, too.
    whole = F.col(_LINE).isNull() if wanted else F.col(_LINE).isNotNull()
    return whole & (F.length(F.coalesce("id", F.lit(""))) >= 0)


def _with_rejects(reader, check_header: bool):
    # All values of a line are counted, so columns cannot be pruned.
    return (
        _feed_options(reader, check_header)
        .schema(StructType([*FEED_SCHEMA.fields, StructField(_LINE, StringType())]))
        .option("columnNameOfCorruptRecord", _LINE)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
    )


def stream_feed(
    spark: SparkSession,
    landing: str,
    max_files: int | None = None,
    max_bytes: int | None = None,
    check_header: bool = True,
    max_file_age: str = MAX_FILE_AGE,
    archive: str | None = None,
    whole_rows: bool = False,
) -> DataFrame:
    """Feed files arriving in the folder (or glob) ``landing``, as a stream.

    Each file is read once per checkpoint, oldest modification time first.
    ``max_files`` or ``max_bytes`` bounds a micro-batch, by default ``MAX_BYTES``. Files
    are never too old, unless ``max_file_age`` says so: Spark ignores files that
    are older than the newest by more. It also forgets the names of such files;
    to bound that list, and the listing of each batch, name a folder outside
    ``landing`` as ``archive``, to which files are moved when they are done. With ``check_header`` a file whose header is not
    the feed's fails the query; without, it is read by position as it is. ``whole_rows``
    leaves out lines with too many or too few values, which ``read_rejects`` lists.
    """
    options = _with_rejects if whole_rows else _feed_options
    reader = options(spark.readStream, check_header).option("maxFileAge", max_file_age)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", MAX_BYTES if max_bytes is None else max_bytes)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.csv(landing)
    return rows.where(_is_whole(True)).select(*FEED_COLUMNS) if whole_rows else rows


def _feed_options(reader, check_header: bool):
    reader = reader.schema(FEED_SCHEMA).options(**_CSV).option("header", True)
    return reader.option("enforceSchema", not check_header)


def write_microfiles(
    feed: DataFrame,
    path: str,
    max_records: int = MAX_RECORDS,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """CSV files with a header and at most ``max_records`` rows each.

    Columns of ``partition_by`` name folders and are not in the files.

    Every task starts a new file when its current one is full, so nothing is
    shuffled. Outer spaces of values are kept. Line breaks inside values become
    spaces, so that a row is a line and large files can be read in pieces.
    """
    if max_records < 1:
        raise ValueError("max_records must be at least 1")
    one_line = [
        F.regexp_replace(f"`{f.name}`", r"\r\n|[\r\n]", " ").alias(f.name)
        if f.dataType == StringType()
        else f"`{f.name}`"
        for f in feed.schema
    ]
    (
        feed.select(*one_line)
        .write.mode(mode)
        .partitionBy(*partition_by)
        .options(**_CSV)
        .option("header", True)
        .option("maxRecordsPerFile", max_records)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
