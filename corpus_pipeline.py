"""From raw documents to token ids, stage by stage.

Each stage takes the documents its predecessor kept, is written as Parquet to
the shared folder and read again as the next one's input. All but the last
return the columns of ``documents``.

Edge cases: extra columns stay as they are, whatever their names. Null and empty texts
have no recognisable language and go in the first stage. Rows with null or
repeated ids are rows of their own; of repeated rows, as of all near-duplicates, one stays: that
with the smallest id (null last), any of those with the same. An empty
table stays empty through all stages.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.bpe import encode, share_vocabulary
from tremorline.llm.decontaminate import without_leaks
from tremorline.llm.frames import read_table, stored
from tremorline.llm.jaccard_join import jaccard_components
from tremorline.llm.language_id import UNKNOWN, fit_language_model, predict_language
from tremorline.llm.quality import fit_quality_model, score_quality
from tremorline.llm.queries import BYTE_RANKS

# A document whose likeliest language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


# Bytes that pass between Spark and a Python worker at a time, unless the session says otherwise.
# Stages follow each other in the same executors, whose workers hold a batch or two each.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _in_small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH_SETTING, None) is None:
            spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _apart(docs: DataFrame, *taken: str) -> DataFrame:
    """The documents with columns that an operator would replace under other names."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in taken if c in docs.columns})


def _together(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    own = set(judged.columns)
    return judged.select(
        *(F.col(f"_own_{c}" if f"_own_{c}" in own else c).alias(c) for c in docs.columns)
    )


@_in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no recognisable language."""
    rows = _apart(docs, "lang_pred", "score")
    judged = predict_language(rows, fit_language_model(docs))
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _together(judged.where(kept), docs)


@_in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier predicts to be bad."""
    model = fit_quality_model(docs, read_table(spark, sf_dir, "labels"))
    judged = score_quality(_apart(docs, "score", "predicted"), model)
    return _together(judged.where("predicted = 1"), docs)


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    """The documents with a number per row, as ids may be null or repeated.

    Stored, so that a row has the same number whenever it is read.
    """
    return stored(_apart(docs, "_row").withColumn("_row", F.monotonically_increasing_id()), label)


def _by_number(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_row").alias("doc_id"), "text")


@_in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near-duplicates."""
    rows = _numbered(docs, "pipeline-rows")
    found = jaccard_components(_by_number(rows)).withColumnRenamed("doc_id", "_row")
    named = found.select("_row", "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select("first._row")
    return _together(rows.join(kept, "_row", "left_semi"), docs)


@_in_small_batches
def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage of the benchmark."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


@_in_small_batches
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids that are trained on."""
    tokens = encode(docs, share_vocabulary(spark, BYTE_RANKS), keep=["doc_id"])
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("tokens", token_ids),
]

# A model is fitted on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
