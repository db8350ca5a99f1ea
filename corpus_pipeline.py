"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import decontaminate, language_id, line_dedup, neardup, packing
from furlong.llm.shared import held_out, written

#: A document whose likeliest language is less likely than this among the learned ones is rejected.
MIN_SCORE = 0.5
#: Copies of a document on many sites consist of lines that are on many sites; the near-duplicate
#: stage tells them by whole texts, so the line stage does not cut them to pieces first.
MAX_SHARE = 0.5

#: Bytes from which a Python worker's arrays are mapped by themselves, and so given back once they are freed. Without
#: it the C library raises the limit as arrays grow, and idle workers hold a stage's peak through the stages after it.
MAPPED_BYTES = 256 * 1024


def lean_workers(spark: SparkSession) -> None:
    """Have Python workers that start from now on give back what they free; the same for all stages, which share workers."""
    for name in ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_"):
        spark.sparkContext.environment.setdefault(name, str(MAPPED_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that no learned language fits well."""
    lean_workers(spark)
    model = language_id.train(docs.where(~held_out("doc_id")), public_tokenizers.path("piece_bpe_32k.model"))
    known = language_id.identify(docs, model).where((F.col("language.lang_pred") != "und") & (F.col("language.score") >= MIN_SCORE))
    return known.select(*docs.columns)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the lines that many sites share out of the texts; all documents stay.

    A document of which more than ``MAX_SHARE`` would go is a copy of others, and left whole for the next stage.
    """
    cleaned = line_dedup.remove_spread_lines(docs, max_share=MAX_SHARE)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of copies."""
    lean_workers(spark)
    return neardup.one_of_each(docs)


def remove_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark passages are a twentieth or more."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all token ids in sequences of 4096."""
    lean_workers(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_documents),
    ("packing", pack_sequences),
]

#: The language model and the sampled candidates of the near-duplicate stage are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
