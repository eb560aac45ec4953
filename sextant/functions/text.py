"""Column functions for normalising, tokenising and cutting text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters and what comparison reads for them.
TYPOGRAPHIC, PLAIN = "‘’“”–— ", "''\"\"-- "
#: Spaces folded at ingest.
SPACES = "    "
TOKEN = "[a-z0-9]+(?:[._-][a-z0-9]+)*"
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["e.g", "i.e", "cf", "etc", "vs", "approx", "no", "nos", "art", "arts", "sec", "secs", "fig", "figs", "para", "paras", "pp"]
#: Fixed value: what starts a list line.
LIST_MARKER = r"^\s*(?:[-*]|\(?[0-9]{1,2}[.)]|\(?[a-zA-Z][.)])\s+"
#: Fixed value: the answer that abstains.
MARKER = "I do not have enough information to answer this question."


def normalize_spaces(x: Column) -> Column:
    return F.translate(x, SPACES, " " * len(SPACES))


def normalize_block(x: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_spaces(x), r"(?U)\s+", " "))


def norm_comparison(x: Column) -> Column:
    """Typographic quotes, dashes and no-break spaces as ASCII, white space collapsed; for comparing only."""
    return F.trim(F.regexp_replace(F.translate(x, TYPOGRAPHIC, PLAIN), r"\s+", " "))


def primary_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(norm_comparison(x)), F.lit(f"({TOKEN})"), 1)


def document_tokens(x: Column) -> Column:
    """Tokens as indexed: hyphenated and underscored ones also by part. Their number is not the document's length."""
    t = primary_tokens(x)
    parts = F.flatten(F.transform(F.filter(t, lambda w: w.rlike("[-_]")), lambda w: F.filter(F.split(w, "[-_]"), lambda p: p != "")))
    return F.concat(t, parts)


def lexical_form(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(norm_comparison(x)), "[^a-z0-9 ]", " "), " +", " "))


def match_form(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def segments(x: Column) -> Column:
    """Pieces between sentence ends or line breaks, trimmed, none empty."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?;])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def is_alphabetic(norm: Column) -> Column:
    return F.exists(F.split(norm, " "), lambda t: t.rlike("^[a-z]+$"))


def sentences(x: Column) -> Column:
    """Sentences; full stops inside numbers and behind closed abbreviations end none."""
    shield = r"(?i)(?<![A-Za-z.])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.(?=\s|$)"
    parts = F.split(F.regexp_replace(x, shield, "$1\u0001"), r"(?<=[.?!])(?U)\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: s != "")


def claim_units(answer: Column) -> Column:
    """Units of an answer: each list line is one, without its marker; runs of other lines are cut into sentences.

    The abstention marker and its variants are none. Null gives null.
    """
    # the separators make a run of prose lines one string and each list line another
    coded = F.transform(F.split(answer, "\n"), lambda l: F.when(F.trim(l) == "", "\u0002").when(l.rlike(LIST_MARKER), F.concat(F.lit("\u0002\u0003"), F.trim(F.regexp_replace(l, LIST_MARKER, "")), F.lit("\u0002"))).otherwise(F.concat(F.trim(l), F.lit(" "))))
    runs = F.filter(F.transform(F.split(F.array_join(coded, ""), "\u0002"), F.trim), lambda r: r != "")
    units = F.flatten(F.transform(runs, lambda r: F.when(r.startswith("\u0003"), F.array(F.substring(r, 2, 1 << 30))).otherwise(sentences(r))))
    return F.filter(units, lambda u: (F.trim(u) != "") & (response_class(u) == "answered"))


def response_class(x: Column) -> Column:
    """abstained, marker_variant or answered: the whole response against the marker, never a part of it."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(flat == MARKER, "abstained").when(F.rtrim(F.lower(flat), F.lit(".")) == MARKER.rstrip(".").lower(), "marker_variant").otherwise("answered")


def unit_of(chunk_id: Column) -> Column:
    """The unit of a chunk: its id up to the first ``#``."""
    return F.substring_index(chunk_id, "#", 1)


def answer_text(response: Column) -> Column:
    """The text blocks of a response in one string; null without a response."""
    blocks = F.filter(response["message"]["content"], lambda b: b["type"] == "text")
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
