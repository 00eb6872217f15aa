"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia.llm import (
    decontamination, fill_middle, line_dedup, minhash, mixing, neighbours, packing, periodic_runs, pii,
    quality_rules, substring_dedup, token_output, warc,
)
from stipendia.llm.tables import given_id, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.listed(table(spark, folder, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op3_token_output(spark: SparkSession, folder: str) -> DataFrame:
    stored = token_output.write(table(spark, folder, "documents"), TOKENIZER, END)
    return token_output.read(spark, stored, summary=True)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write(table(spark, folder, "pages"))
    return warc.summary(warc.records(warc.index(archives)))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(quality_rules.measured(table(spark, folder, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return neighbours.scored(docs, neighbours.fitted(docs, table(spark, folder, "labels")))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digests(table(spark, folder, "documents"))


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.groups(table(spark, folder, "documents"), width=2).select(
        "doc_id", "n_shingles", given_id("component").alias("component_id"), "kept")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mixed(docs).select(
        F.col("c0").alias("doc_id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, counted=True).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.summary(packing.packed(table(spark, folder, "documents"), TOKENIZER, end=0))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return fill_middle.transformed(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"))


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """Gives a tenth of the texts a periodic end: the word to take for each place."""
    if doc is None or not n or (h := zlib.crc32(str(doc).encode())) % 10:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < first, places, first + (places - first) % period)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic_runs.collapsed(docs, order=planted).withColumn(
        "best", periodic_runs.strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_token_output": op3_token_output,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash": op8_minhash,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_packing": op11_packing,
    "op12_fill_middle": op12_fill_middle,
    "op13_periodic_runs": op13_periodic_runs,
}
