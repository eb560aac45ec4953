"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import copies, leaks, lookalikes, packing, pairs, scans, shapes, sketching, splitting
from sextant.llm.sql import SQL
from sextant.runtime import materialise
from sextant.sources.tables import table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "lines"), table(spark, d, "wordlist"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "lines"), table(spark, d, "wordlist"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sketching.near_duplicates(table(spark, d, "chunks"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return sketching.duplicate_classes(table(spark, d, "chunks"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return sketching.duplicate_groups(table(spark, d, "chunks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.renumbered(splitting.split_oversized(table(spark, d, "chunks")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "chunks"))
    return pieces.filter((F.col("piece") == 1) & (F.col("n_pieces") > 1)).select("chunk_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_found(table(spark, d, "chunks"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.one_record_each(table(spark, d, "chunks"))


def p4_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.group_counts(table(spark, d, "chunks"))


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(*[table(spark, d, t) for t in ("answers", "requests", "wordlist")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.main_defect(p5_defects(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.affected(table(spark, d, "chunks"), table(spark, d, "hyphen_decisions"))


def p6_normalised(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalised_chunks(table(spark, d, "chunks"))


def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The tokenizer's vocabulary is the file ``sextant.tokenizer`` names in the session, else that of the box."""
    return packing.assign(table(spark, d, "documents"), tokenizer=spark.conf.get("sextant.tokenizer", packing.TOKENIZER))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_assignment(spark, d))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    return packing.checked(materialise(p8_assignment(spark, d)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_queries"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_queries")).withColumn("covered", F.bround("covered", 6))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    common = shapes.common_words(table(spark, d, "wordlist"))
    rounded = ["mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share"]
    s = shapes.statistics(table(spark, d, "documents"), common, ["n_words", *rounded])
    return s.select("doc_id", "n_words", *[F.bround(c, 6).alias(c) for c in rounded])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shapes.shaped(table(spark, d, "documents"), table(spark, d, "wordlist")).filter("shape <> 'prose'").select("doc_id", "shape")


QUERIES = {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_classes, p2_groups, p3_pieces, p3_found, p4_found, p4_records, p4_group_counts, p5_defects, p5_found, p6_found, p6_normalised, p8_assignment, p8_fill, p8_check, p9_found, p9_leaks, p10_statistics, p10_found)}
