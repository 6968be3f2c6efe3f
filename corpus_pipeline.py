"""The corpus pipeline: raw documents to token ids, a stage per decision.

Each stage takes (spark, docs, sf_dir) and gives the documents it kept, with the columns of documents; the last gives
token ids.  A stage's result is written as Parquet before the next one reads it, so a lost executor costs tasks of one
stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import common as C
from eventide.llm.bpe import bpe
from eventide.llm.decontaminate import decontaminate
from eventide.llm.line_dedup import line_dedup
from eventide.llm.minhash import near_dedup
from eventide.llm.quality_classifier import quality_scores


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality_scores(docs, C.table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten documents or more; n_chars counts what is left."""
    cleaned = line_dedup(docs)
    kept = cleaned.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles at a similarity of 0.8."""
    decided = C.written(near_dedup(docs, width=5), "near-copies")
    gone = decided.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__k", C.text_key(C.whole("text")))
    kept = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["__id"]) & (keyed["__k"] == gone["__key"]), "left_anti").select(*docs.columns)
    # a row that is repeated as a whole is in its own group several times
    twice = decided.where("kept AND n_shingles > 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate(docs, C.table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the text that they decode to."""
    import public_tokenizers

    coded = bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_frequent_lines),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: The classifier is trained, so SQL can't express the rows; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's own tables are removed once its result is written, and that once the next is."""
    docs, before = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with C.cleaned(spark) as kept:
            docs = C.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.add(docs.written_to)
        if before:
            C.remove(spark, before)
        before = docs.written_to
    return docs
