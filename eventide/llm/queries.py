"""The registered query of each training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .align import align
from .bpe import bpe
from .decontaminate import decontaminate
from .hard_negatives import hard_negatives, quantised, usable
from .licenses import license_scan
from .line_dedup import line_dedup
from .main_text import extract_main_text
from .minhash import near_dedup
from .packing import pack
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .substrings import substring_dedup
from .warc import warc_round_trip


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(C.table(spark, sf_dir, "pages"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(C.table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).drop("text")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(C.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(C.table(spark, sf_dir, "documents")).drop("key")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(C.table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    shaped = rows.select("vec_id", label.alias("label"), quantised("embedding", 256).alias("vector"))
    return hard_negatives(shaped, F.col("vec_id") % 100 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=False)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


QUERIES = {f.__name__: f for f in (op1_warc_normaliser, op2_main_text, op3_license_scan, op4_benchmark_decontamination, op5_substring_dedup, op6_byte_bpe, op7_line_dedup, op8_minhash_near_dedup, op9_quality_classifier, op10_quality_rules, op11_hard_negatives, op12_token_alignment, op13_best_fit_packing)}
