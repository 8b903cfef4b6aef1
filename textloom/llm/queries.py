"""Registered queries of the llm subpackage: ``pN_...`` for problem N, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import p01_pair_defects as p1
from textloom.llm import p02_sentences as p2
from textloom.llm import p03_consistent_form as p3
from textloom.llm import p04_split_oversized as p4
from textloom.llm import p05_alignment as p5
from textloom.llm import p06_format_duplicates as p6
from textloom.llm import p07_term_frequency as p7
from textloom.llm import p08_byte_bpe as p8
from textloom.llm import p09_packing as p9
from textloom.llm import p10_truncation as p10
from textloom.session import table

TOKENIZERS = "/opt/tokenizers"


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return p1.pair_labels(table(spark, d, "paragraph_memory"), table(spark, d, "memory_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1.pair_defects(table(spark, d, "paragraph_memory"), table(spark, d, "memory_files"))


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    return p2.split_sentences(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2.split_sentences(table(spark, d, "documents"), with_text=False).select("doc_id", "start_pos", "end_pos")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paragraph_memory").select("rec_id", "source_surface")
    return p3.consistent_form(rows, "source_surface").select("rec_id", "canonical").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    memory = table(spark, d, "paragraph_memory")
    records = p3.look_alike_records(memory).select(F.lit("source_surface").alias("field"), "left_id", "right_id")
    terms = p3.look_alike_terms(memory, table(spark, d, "glossary")).select(F.lit("terms").alias("field"), "left_id", "right_id")
    return records.unionByName(terms)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p4.split_oversized(table(spark, d, "paragraph_memory"), table(spark, d, "memory_files"), table(spark, d, "model_backends"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where(F.col("piece") == 0).select("rec_id", "cut_kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5.align_segments(table(spark, d, "memory_sentences"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return p6.format_groups(table(spark, d, "memory_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6.format_copies(table(spark, d, "memory_lines"))


def p7_frequency(spark: SparkSession, d: str) -> DataFrame:
    return p7.term_frequency(table(spark, d, "paragraph_memory"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7.mark_terms(table(spark, d, "paragraph_memory")).where("mark is not null").select("field", "term", "mark")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return p8.token_ids(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return p9.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_specs"), TOKENIZERS)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return p9.fill_rates(p9_packed(spark, d), table(spark, d, "pack_specs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10.judge_endings(table(spark, d, "documents")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return p10.truncation_rates(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_labels": p1_labels,
    "p1_found": p1_found,
    "p2_units": p2_units,
    "p2_found": p2_found,
    "p3_forms": p3_forms,
    "p3_found": p3_found,
    "p4_pieces": p4_pieces,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_records": p6_records,
    "p6_found": p6_found,
    "p7_frequency": p7_frequency,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
