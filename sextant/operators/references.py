"""Printed references with their places: found, kept or dropped, composed to units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Printed kinds of reference, the prefix of the unit meant, and the pattern of what is printed.
GRAMMAR = [
    ("art", r"\b(?:Articles?|Art\.)\s+\d{1,3}\b"), ("anx", r"\b(?:Annexe?s?|Ann\.)\s+(?:\d{1,3}|[IVXLC]{1,6})\b"), ("rct", r"\b(?:Recitals?|Rec\.)\s+\d{1,3}\b"),
    ("sec", r"\b(?:Sections?|Sec\.)\s+\d+\.\d+\b"), ("act", r"\b[A-Z]{2}-?\d+\.\d+-+\d{3}\b"), ("sub", r"\b[A-Z]{4,}\s+\d+\.\d+\b"),
]
#: What makes the reference before it one to an outside instrument, within so many characters.
QUALIFIER, LOOKAHEAD = r"(?i)^\s*(?:\([^)]*\)\s*)*of\s+(?:the\s+)?(?:Directive|Regulation|Norm|Bulletin|Charter|Convention|Treaty|Decision)\b", 40


def places(text: Column, pattern: str) -> Column:
    """(surface, start) of every match in order; ``start`` counts characters from 0.

    What stands between the matches gives the places: the lengths before a match add up to its start.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern, -1)
    total = lambda a, k: F.aggregate(F.slice(a, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(F.element_at(found, i).alias("surface"), (total(between, i) + total(found, i - 1)).alias("start")))).otherwise(F.array().cast("array<struct<surface:string,start:int>>"))


def printed(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, surface, start, external) of all printed references; null texts have none."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(places(F.col(text), pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x["surface"].alias("surface"), x["start"].alias("start")))

    each = F.concat(*[of(k, p) for k, p in GRAMMAR])
    x = texts.filter(F.col(text).isNotNull()).select(*keys, text, F.explode(each).alias("x"))
    behind = F.substring(F.col(text), F.col("x.start") + F.length("x.surface") + 1, F.lit(LOOKAHEAD))
    return x.select(*keys, "x.kind", "x.surface", "x.start", (F.col("x.kind").isin("art", "anx", "rct", "sec") & behind.rlike(QUALIFIER)).alias("external"))


def arabic(numeral: Column) -> Column:
    """Value of a Roman numeral up to C; letters before a greater one count down."""
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
    digit = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in value.items()], F.lit(0))
    letters = F.filter(F.split(numeral, ""), lambda c: c != "")
    step = F.transform(letters, lambda c, i: F.when(digit(c) < digit(F.coalesce(F.get(letters, i + 1), F.lit(""))), -digit(c)).otherwise(digit(c)))
    return F.aggregate(step, F.lit(0), lambda n, x: n + x)


def unit_name(kind: Column, surface: Column) -> Column:
    """The unit's name inside a document: Roman annexes in figures, actions with one hyphen at each joint."""
    last = F.regexp_extract(surface, r"(\S+)$", 1)
    action = F.concat(F.substring(surface, 1, 2), F.lit("-"), F.regexp_extract(surface, r"(\d+\.\d+)", 1), F.lit("-"), F.regexp_extract(surface, r"(\d{3})$", 1))
    number = F.when(last.rlike("^[IVXLC]+$"), arabic(last).cast("string")).otherwise(last)
    sub = F.concat(F.regexp_extract(surface, r"^([A-Z]+)", 1), F.lit("_"), last)
    return F.concat(kind, F.lit("_"), F.when(kind == "act", action).when(kind == "sub", sub).otherwise(number))
