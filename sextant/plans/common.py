"""Inputs that several queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.runtime import latest
from sextant.sources.tables import table


def chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per chunk (the latest delivery), with ``cols``."""
    return latest(table(spark, d, "chunks").select("chunk_id", *[c for c in cols if c != "chunk_id"], "ingested_at"), "chunk_id", ["ingested_at", cols[-1]]).drop("ingested_at")


def units(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "units"), "unit_id", ["added_at", "deleted_at"])


def items(spark: SparkSession, d: str) -> DataFrame:
    """One row per evaluation item; equal ids take the greatest name and query."""
    return latest(table(spark, d, "eval_queries"), "item_id", ["id", "query"])


ITEMS = "i AS (SELECT * FROM eval_queries WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY id DESC NULLS LAST, query DESC NULLS LAST) = 1)"
C = "c AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, text DESC NULLS LAST) = 1)"
NORM = "trim(regexp_replace(translate({0}, '‘’“”–—' || chr(160), chr(39) || chr(39) || chr(34) || chr(34) || '-- '), '\\s+', ' ', 'g'))"
TOKENS = "regexp_extract_all(lower(" + NORM + "), '[a-z0-9]+(?:[._-][a-z0-9]+)*')"
DOC_TOKENS = "list_concat(" + TOKENS + ", flatten(list_transform(list_filter(" + TOKENS + ", lambda w: regexp_matches(w, '[-_]')), lambda w: list_filter(regexp_split_to_array(w, '[-_]'), lambda p: p <> ''))))"
