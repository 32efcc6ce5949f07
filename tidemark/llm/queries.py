"""The queries of this package, one for each operator over its whole table, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audio, licenses, linededup, packing, pii, quality, simhash, treebpe, warc, wrapper
from tidemark.llm.common import checkpointed, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = checkpointed(quality.counts(table(spark, sf_dir, "documents")))
    kept = quality.judged(counted, quality.fit(counted))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.read(audio.store(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages")))
    return found.withColumnsRenamed({"record_id": "page_id", "digest": "payload_sha256", "size": "n_chars"})


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer()))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(pii.scan(table(spark, sf_dir, "documents")))
    return pii.report(found, pii.train(found)).withColumnRenamed("id", "doc_id")


def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer()).withColumnRenamed("id", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_wrapper_induction": op2_wrapper_induction,
    "op3_telephony": op3_telephony,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_spread": op6_line_spread,
    "op7_personal_data": op7_personal_data,
    "op8_tree_bpe": op8_tree_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_simhash": op10_simhash,
}
ORACLE_SQL: dict[str, str] = {"op4_warc_revisits": warc.ORACLE_SQL, "op6_line_spread": linededup.ORACLE_SQL}
