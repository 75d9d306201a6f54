"""The registered queries of these operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_dir
from .alignment import align_texts, count_links
from .bpe import decode, encode, share_vocabulary
from .chat import chat_windows, conversation_digests
from .decontaminate import find_leaks
from .frames import id_crc32, read_table
from .hard_negatives import mine
from .jaccard_join import jaccard_components
from .language_id import fit_language_model, predict_language
from .license_scan import scan_licenses
from .order_minhash import fingerprints
from .packing import pack_documents, with_checksums
from .quality import fit_quality_model, score_quality
from .token_files import checksums, read_tokens, write_tokens
from .url_rules import judge_urls

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
        "conv_id long, turn long, role string, text string",
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    windows = chat_windows(turns.unionByName(extra), share_vocabulary(spark, BYTE_RANKS))
    return conversation_digests(windows)


def order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc32() % 4 == 2, F.lit(False))
    model = fit_language_model(docs, ~held_out)
    return predict_language(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "hits")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = share_vocabulary(spark, BYTE_RANKS)
    tokens = encode(read_table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    return decode(tokens, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc32() % 5 == 0, F.lit(False))
    model = fit_quality_model(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), path, WORD_TOKENIZER)
    return checksums(read_tokens(spark, path))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_checksums(pack_documents(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(vectors, F.col("vec_id") % 100 == 0)


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    aligned = align_texts(docs, BYTE_TOKENIZER, PIECE_TOKENIZER)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    counted = count_links(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES = {
    "op1_chat_formatting": chat_formatting,
    "op2_order_minhash": order_minhash,
    "op3_language_id": language_id,
    "op4_license_scan": license_scan,
    "op5_byte_bpe": byte_bpe,
    "op6_jaccard_join": jaccard_join,
    "op7_quality_classifier": quality_classifier,
    "op8_decontamination": decontamination,
    "op9_url_filters": url_filters,
    "op10_token_files": token_files,
    "op11_packing": packing,
    "op12_hard_negatives": hard_negatives,
    "op13_token_alignment": token_alignment,
}

SQL: dict[str, str] = {
    "op12_hard_negatives": """
        WITH vectors AS (
            SELECT vec_id,
                CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT * FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id,
            CAST(row_number() OVER (
                PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id
            ) AS INTEGER) AS "rank",
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY "rank" <= 5
    """,
}
