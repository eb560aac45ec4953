"""Structure of ingested documents: lines, anchors, offsets, hyphens, HTML blocks, citations."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.runtime import materialise, running_total

#: Text between two citations that makes the first one external or internal.
INSTRUMENTS = r"(?:Directive|Regulation|Norm|Bulletin|Charter|Convention|Treaty|Decision)"


def line_class(text: Column) -> Column:
    """Class of a printed line by its form alone."""
    t = F.trim(text)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^(?i)(page\s+)?[-\[(]?\s*(\d{1,4}|[ivxlc]{1,6})(\s+of\s+\d+)?\s*[-\])]?$"), "page_footer")
        .when(t.rlike(r"\.{4,}\s*\d+$"), "table_of_contents")
        .when(t.rlike(r"\S\s{2,}\d+(\s{2,}\d+)*$"), "table_row")
        .when(t.rlike(r"^[A-Z][^.;:,!?]*$") & (F.size(F.split(t, r"\s+")) <= 6), "heading")
        .otherwise("content")
    )


def carried_headings(lines: DataFrame) -> DataFrame:
    """(line_id, heading): the last heading at or above each line of its document, over its pages; null above the first one.

    Headings are numbered along each document by a range sort, so no document has to fit into one task. Line ids are distinct.
    """
    h = lines.select("doc_id", "line_id", F.when(line_class(F.col("text")) == "heading", F.trim("text")).alias("heading"))
    x = materialise(running_total(h, ["doc_id"], [F.col("line_id")], F.col("heading").isNotNull().cast("long"), "no"))
    y = x.filter("heading IS NOT NULL").select(F.col("doc_id").alias("d"), F.col("no").alias("k"), "heading")
    return x.drop("heading").join(y, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("no") == F.col("k")), "left").select("line_id", "heading")


def block_offsets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, start, end): offsets of a unit's chunks joined by a line break, in their order."""
    w = W.partitionBy("parent_id").orderBy(F.coalesce("seq", F.lit(0)), "chunk_id").rowsBetween(W.unboundedPreceding, 0)
    n = F.coalesce(F.length("text"), F.lit(0))
    end = F.sum(n + 1).over(w) - 1
    return chunks.select("chunk_id", (end - n).alias("start"), end.alias("end"))


def resolve_hyphen(hyphen_evidence: Column, joined_evidence: Column, joined_is_word: Column, halves_are_words: Column) -> Column:
    """keep or delete the hyphen: attested form first, then the word list, else keep."""
    h, j = F.coalesce(hyphen_evidence, F.lit(0)), F.coalesce(joined_evidence, F.lit(0))
    return F.when(j > h, "delete").when(h > j, "keep").when(joined_is_word & ~halves_are_words, "delete").otherwise("keep")


class _Blocks(HTMLParser):
    VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
    BLOCK = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "tr", "table", "ul", "ol", "nav", "header", "footer", "body", "html"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.out: list[tuple[str, str]] = []
        self.buf: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.buf).split())
        if text:
            self.out.append((next((t for t in reversed(self.open) if t in self.BLOCK), "text"), text))
        self.buf = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BLOCK or tag == "br":
            self.flush()
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.BLOCK:
            self.flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not {"script", "style"} & set(self.open):
            self.buf.append(data)


def parse_html(source: str) -> list[tuple[str, str]]:
    """(tag, text) of the text blocks in order; scripts and styles dropped, unclosed tags closed by their parent's end."""
    p = _Blocks()
    p.feed(source or "")
    p.close()
    p.flush()
    return p.out


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_no, tag, text) by Arrow batches; null pages have no blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, tag, t) for k, h in zip(b[key], b[html]) for i, (tag, t) in enumerate(parse_html(h))]
            yield pd.DataFrame(rows, columns=[key, "block_no", "tag", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, block_no int, tag string, text string")


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 399."""
    steps = [(100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, rest = F.lit(""), n
    for value, letters in steps:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def citation_class(sentence: Column, surface: Column) -> Column:
    """internal, external or amending: by the instrument named right behind the reference, or by the sentence's verb."""
    behind = F.element_at(F.split(sentence, F.concat(F.lit(r"\Q"), surface, F.lit(r"\E"))), -1)
    return F.when(behind.rlike(rf"^(\s*\([^)]*\))*\s+of\s+(the\s+)?{INSTRUMENTS}"), "external").when(sentence.rlike(r"(?i)\bis (amended|replaced) as follows"), "amending").otherwise("internal")


def enumerated(surface: Column) -> Column:
    """Numbers a citation names: ``Articles 102 to 104`` gives three, lists give each."""
    bare = F.regexp_replace(surface, r"\([^)]*\)", "")
    lo, hi = F.regexp_extract(bare, r"(\d+)\s+to\s+(\d+)", 1), F.regexp_extract(bare, r"(\d+)\s+to\s+(\d+)", 2)
    span = F.sequence(lo.cast("int"), hi.cast("int"))
    return F.when((lo != "") & (hi.cast("int") >= lo.cast("int")), span).otherwise(F.transform(F.regexp_extract_all(bare, F.lit(r"(\d+)"), 1), lambda x: x.cast("int")))
