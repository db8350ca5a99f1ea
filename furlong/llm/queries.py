"""The registered queries of the text operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bestfit, conversations, decontaminate, language_id, line_dedup, neardup, packing, quality, records, token_counts, toxicity, variants, warc
from furlong.llm.shared import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~held_out("doc_id")), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = quality.train(docs.where(~held_out("doc_id")), table(spark, sf_dir, "labels"))
    return quality.judged(docs, field).select("doc_id", "quality.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_spread_lines(documents(spark, sf_dir)).select("doc_id", "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, docs.where(~held_out("doc_id")), table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model).withColumnRenamed("toxicity", "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit.pack_whole(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.audited(conversations.damaged(rows), rows)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_records": op7_records,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_best_fit": op11_best_fit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_decontaminate": f"WITH {decontaminate.JUDGED_SQL.format(docs='documents')} SELECT * FROM judged",
    "op8_line_dedup": f"WITH {line_dedup.CLEANED_SQL.format(docs='documents')} SELECT doc_id, text FROM cleaned",
}
