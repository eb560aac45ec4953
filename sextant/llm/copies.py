"""Copies hidden by formatting: progressive partition refinement (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import broadcast_below, materialise

#: Labels of the fields of an action.
LABELS = ["suggested action", "risks", "actors", "evidence"]
#: Letters whose counts split a class of one length.
LETTERS = "eatn"
_AT_START = r"(?:^|[\n|])[ \t*\x{2022}\x{b7}>-]*(?=(?:" + "|".join(LABELS) + r")\b)"
_ANYWHERE = _AT_START + r"|(?<=\s)(?=(?:" + "|".join(LABELS) + r")\s*:)"


def bare(text: Column) -> Column:
    """Lower case, letters and digits only; ASCII texts take the cheaper of two equal patterns."""
    low = F.lower(text)
    ascii_only = F.regexp_replace(low, "[^a-z0-9]+", "")
    return F.when(F.octet_length(text) == F.length(text), ascii_only).otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}]+", ""))


def histogram(b: Column) -> Column:
    """Counts of a few letters of a bare text as one number; the order of fields does not matter to it."""
    return F.xxhash64(*[F.octet_length(b) - F.octet_length(F.replace(b, F.lit(x), F.lit(""))) for x in LETTERS])


def identity(text: Column, unit_type: Column) -> Column:
    """Key of the record a text stands for: its bare text, for actions with the labelled fields in sorted order."""
    low = F.lower(text)

    def cut(pattern: str) -> Column:
        return F.array_sort(F.filter(F.transform(F.split(low, pattern), bare), lambda x: x != ""))

    # labels inside a line count only in texts that have lost their line breaks
    fields = F.when(F.size(cut(_AT_START)) > 1, cut(_AT_START)).otherwise(cut(_ANYWHERE))
    return F.when(unit_type == "action", F.concat(F.lit("fields:"), F.array_join(fields, "|"))).otherwise(F.concat(F.lit("text:"), bare(text)))


def newest_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, at, size, hist): the newest delivery of each chunk by its time and digest ``at``, with its cheap invariants.

    Of deliveries of one time the greatest digest is the newest. Chunks whose newest text is null, and null ids, are left
    out. No text is shuffled: ids, digests and invariants are.
    """
    b = bare(F.col("text"))
    # what a text gives goes through a generator, so that the text is stripped once and not for each invariant
    read = chunks.select("chunk_id", "ingested_at", "text").filter(F.col("chunk_id").isNotNull()).select(
        "chunk_id", "ingested_at", F.md5("text").alias("digest"), F.explode(F.array(b)).alias("b")
    )
    slim = read.select("chunk_id", F.struct("ingested_at", "digest").alias("at"), F.length("b").alias("size"), histogram(F.col("b")).alias("hist"))
    newest = slim.groupBy("chunk_id").agg(F.max_by(F.struct("at", "size", "hist"), "at").alias("x"))
    return newest.filter("x.at.digest IS NOT NULL").select("chunk_id", "x.at", "x.size", "x.hist")


def _several(df: DataFrame, *key: str) -> DataFrame:
    """The rows of ``df`` whose key more rows have; counted map-side, so a hot key costs a row per task."""
    shared = df.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select(*key)
    return df.join(shared, list(key), "left_semi")


def refined_classes(chunks: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """(record, chunk_id) for the chunks that share their record with another one; ``record`` is a digest.

    Progressive refinement of the newest deliveries: classes of one stripped length, inside those with several members
    classes of one letter histogram, and only inside those again the costly key, for which their texts are read. A text
    without a letter or digit (empty texts too) is the record of no letters. Chunks delivered twice count once.
    """
    newest = materialise(newest_texts(chunks)) if newest is None else newest
    left = materialise(_several(_several(newest, "size"), "size", "hist").select("chunk_id", "at"))
    texts = chunks.select("chunk_id", F.struct("ingested_at", F.md5("text").alias("digest")).alias("at"), "unit_type", "text")
    # ids and digests of what is left choose the texts; a delivery that comes twice is one
    kept = texts.join(broadcast_below(left, 64 << 20), ["chunk_id", "at"], "left_semi")
    keyed = kept.select("chunk_id", F.sha2(identity(F.col("text"), F.col("unit_type")), 256).alias("record"))
    one = materialise(keyed.groupBy("chunk_id").agg(F.max("record").alias("record")))
    return _several(one.select("record", "chunk_id"), "record")


def grouped(classes: DataFrame) -> DataFrame:
    """(record, first_chunk_id, n_copies) of records with two or more chunks; a hot record is counted map-side."""
    return classes.groupBy("record").agg(F.min("chunk_id").alias("first_chunk_id"), F.count("*").alias("n_copies")).filter("n_copies > 1")


def copies_found(chunks: DataFrame) -> DataFrame:
    """(first_chunk_id, copy_chunk_id): each further chunk of a record beside the smallest one."""
    c = refined_classes(chunks)
    return c.join(grouped(c), "record").filter(F.col("chunk_id") != F.col("first_chunk_id")).select("first_chunk_id", F.col("chunk_id").alias("copy_chunk_id"))


def one_record_each(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_copies): one chunk per record with the number of chunks that are it (1 where single)."""
    newest = materialise(newest_texts(chunks))
    c = refined_classes(chunks, newest)
    several = grouped(c).select(F.col("first_chunk_id").alias("chunk_id"), "n_copies")
    single = newest.select("chunk_id").join(c.select("chunk_id"), "chunk_id", "left_anti").withColumn("n_copies", F.lit(1).cast("long"))
    return several.unionByName(single)


def group_counts(chunks: DataFrame) -> DataFrame:
    """(basis, n_groups, n_chunks) of groups of two or more, by equal raw texts and by equal records."""
    newest = materialise(newest_texts(chunks))
    raw = newest.groupBy(F.col("at.digest").alias("raw")).agg(F.count("*").alias("n_copies")).filter("n_copies > 1")

    def total(df: DataFrame, basis: str) -> DataFrame:
        return df.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n_chunks")).select(F.lit(basis).alias("basis"), "n_groups", "n_chunks")

    return total(raw, "raw_identity").unionByName(total(grouped(refined_classes(chunks, newest)), "normalised_identity"))
