"""Reading the given tables, adding columns computed from a text column, storing steps."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import scratch_dir


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again.

    Cuts the lineage: a lost executor costs no step before this one, and what
    is read twice is computed once.
    """
    path = f"{scratch_dir(frame.sparkSession, label)}/rows"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_crc32(name: str = "doc_id") -> Column:
    """Unsigned CRC-32 of the id as decimal text; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def lean(run: Callable) -> Callable:
    """A task's function over batches that hands freed memory back when the task ends.

    Spark keeps idle Python workers for a minute, beside those of the next tasks.
    """

    @functools.wraps(run)
    def run_and_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return run_and_trim


def add_from_text(
    docs: DataFrame,
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    fields: str,
    keep: Sequence[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """``docs`` with columns computed from its text, batch by batch in Arrow.

    ``make`` is called once per task and returns the function that maps a batch
    of texts to one array per field of ``fields`` (a DDL string). ``keep`` names
    the columns to carry over, by default all; one that has the name of a new
    field is replaced by it. Rows stay as they are, in number and order.
    """
    added = StructType.fromDDL(fields)
    names = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    schema = StructType([docs.schema[c] for c in names] + added.fields)
    types = [_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            new = compute(batch.column(text))
            new = [a if a.type == t else a.cast(t) for a, t in zip(new, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + new, names=[*names, *added.names]
            )

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(lean(run), schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
