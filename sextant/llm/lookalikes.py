"""One consistent form for texts that look alike: a longest-match transducer over grapheme clusters (problem 6)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.words import newest
from sextant.runtime import latest

#: Characters that print nothing.
INVISIBLE = "".join(map(chr, [
    0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010),
    *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0x3164, *range(0xFE00, 0xFE0F), 0xFEFF, 0xFFA0, 0xFFFE,
]))
#: Spaces other than U+0020.
SPACES = "".join(map(chr, [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Cyrillic, Greek, Armenian, Cherokee and Coptic letters that look like a Latin one.
LOOKALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјкорсухһԁԛԝүӏѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "αικνορυχϲϳ" "օսհոց" "ᎪᎫᎬᎷᎻᎳᏃᏙᏚᏞᏟᏢᏦᏴᎡᎢ" "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ",
        "ABESIJKMHOPCTYXYGQWaesijkopcyxhdqwylv" "ABEZHIKMNOPTYX" "aikvopuxcj" "ouhng" "AJEMHWZVSLCPKBRT" "ABEHIKMNOPCTYX",
    )
)
#: Scripts whose joiners are part of the spelling.
_JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Gujarati}\p{Gurmukhi}\p{Oriya}\p{Nko}\p{Emoji_Presentation}\p{Extended_Pictographic}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}￾]+")
_LATIN = regex.compile(r"\p{Latin}")
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}]")
#: What attaches to the character before it: marks, the half-width voicing signs, and what prints nothing. Jamo go together.
_ATTACHED = r"\p{M}ﾞﾟ" + regex.escape(INVISIBLE)
_JAMO = r"ᄀ-ᅞᅡ-ᇿꥠ-ꥼ가-힣ힰ-ퟻ"
_CLUSTER = regex.compile(rf"[{_JAMO}][{_JAMO}{_ATTACHED}]*|[^{_ATTACHED}][{_ATTACHED}]+|[{_ATTACHED}]+|[^\x00-\x7f]")
#: Compatibility forms of Unicode that are another width or another drawing of the same letters.
_FORMS = {"<wide>", "<narrow>", "<font>"}
_JOINED = [(0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3)]
#: Clusters kept compiled at most; beyond it compiling starts anew.
_COMPILED_MOST = 200_000


@functools.cache
def table() -> dict[str, str]:
    """Source character -> target, made from the Unicode database by rule.

    Raises if two rules give one source different targets, or if a target, alone or composed, is mapped again.
    """
    out: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if out.setdefault(source, target) != target:
            raise ValueError(f"conflicting targets for {source!r}")

    for ch in INVISIBLE:
        put(ch, "")
    for ch in SPACES:
        put(ch, " ")
    for lo, hi in _JOINED:
        for cp in range(lo, hi + 1):
            put(chr(cp), unicodedata.normalize("NFKC", chr(cp)))
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        ch = chr(cp)
        if ch in out:
            continue
        kind, _, parts = unicodedata.decomposition(ch).partition(" ")
        if kind in _FORMS:
            put(ch, unicodedata.normalize("NFKC", ch))
        elif kind and not kind.startswith("<") and not parts:
            put(ch, unicodedata.normalize("NFC", ch))  # a second code for the same character
    for source, target in out.items():
        if any(t in out for t in target) or any(t in out for t in unicodedata.normalize("NFC", target)):
            raise ValueError(f"target of {source!r} is itself mapped")
    return out


@functools.cache
def _single() -> dict[int, str]:
    return {ord(k): v for k, v in table().items()}


_compiled: dict[tuple[str, bool], str] = {}


def _compile(cluster: str, foreign: bool) -> str:
    """The form of one cluster: what prints nothing cleared, letters mapped, marks composed in canonical order."""
    kept = "".join("\0" + c if c in "‌‍" else c for c in cluster) if "\0" in cluster else cluster
    out = unicodedata.normalize("NFD", kept.translate(_single()))
    if foreign:
        out = "".join(LOOKALIKE.get(c, c) for c in out)
    return unicodedata.normalize("NFC", out)


def _form(cluster: str, foreign: bool) -> str:
    got = _compiled.get((cluster, foreign))
    if got is None:
        if len(_compiled) >= _COMPILED_MOST:
            _compiled.clear()
        got = _compiled[cluster, foreign] = _compile(cluster, foreign)
    return got


def _foreign_words(text: str) -> list[tuple[int, int]]:
    """Places of words whose letters of another alphabet stand for Latin ones.

    A word with Latin letters too, or one made of look-alikes only that touches no genuine word of another script;
    genuine words hold at least one letter no Latin letter looks like. Words are judged in their mapped form.
    """
    if not _OTHER.search(text.translate(_single())):
        return []
    out, alike, genuine = [], [], []
    for m in _WORD.finditer(text):
        w = unicodedata.normalize("NFD", m[0].translate(_single()))
        others = _OTHER.findall(w)
        if not others:
            continue
        if _LATIN.search(w):
            if any(c in LOOKALIKE for c in others):
                out.append(m.span())
        elif len(others) > 1 and all(c in LOOKALIKE for c in others):
            alike.append(m.span())
        else:
            genuine.append(m.span())
    ends, starts = {e for _, e in genuine}, {s for s, _ in genuine}
    near = lambda a, b: any(a - k in ends or b + k in starts for k in (0, 1))
    return sorted(out + [x for x in alike if not near(*x)])


def transduce(text: str) -> tuple[str, int]:
    """The consistent form of ``text`` and the number of clusters that changed; one pass, longest cluster first.

    A cluster is a character with all marks and invisible characters behind it, or a run of jamo. Its form is compiled
    once from the table: invisible characters go, widths, drawings, ligatures and odd spaces are mapped, letters of other
    alphabets too where their word stands for a Latin one, and what is left is composed in canonical order. So the form
    is the same for canonically equal texts, and mapping it again changes nothing. Joiners between letters of scripts that
    spell with them, and in emoji, stay.
    """
    if text.isascii():
        return text, 0
    words, at, n = _foreign_words(text), 0, 0

    def put(m: regex.Match) -> str:
        nonlocal at, n
        c, start = m[0], m.start()
        while at < len(words) and words[at][1] <= start:
            at += 1
        foreign = at < len(words) and words[at][0] <= start
        if "‌" in c or "‍" in c:
            new = _with_joiners(text, m.start(), m.end(), foreign)
        else:
            new = _form(c, foreign)
        n += new != c
        return new

    return _CLUSTER.sub(put, text), n


def _with_joiners(text: str, start: int, end: int, foreign: bool) -> str:
    """The form of a cluster with joiners: those beside a character that spells with them, in the cluster or behind it, stay."""
    visible = [i for i in range(start, end) if text[i] not in INVISIBLE]
    spells = [i for i in visible if _JOINING.match(text[i])]
    if end < len(text) and _JOINING.match(text[end]):
        spells.append(end)
    out, last = [], start
    for i in range(start, end):
        beside = any(j < i for j in spells) or any(j > i and (j < end or not any(k > i for k in visible)) for j in spells)
        if text[i] in "\u200c\u200d" and beside:
            out += [_form("".join(text[j] for j in visible if last <= j < i), foreign), text[i]]
            last = i + 1
    return "".join([*out, _form("".join(text[j] for j in visible if j >= last), foreign)])


def normalised(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``<text>_normal`` and ``<text>_changes``; rows of ASCII only never leave the JVM.

    Null stays null with 0 changes; an empty text stays empty.
    """
    plain = F.coalesce(F.octet_length(text) == F.length(text), F.lit(True))
    cols = [*df.columns, f"{text}_normal", f"{text}_changes"]
    easy = df.filter(plain).withColumn(cols[-2], F.col(text)).withColumn(cols[-1], F.lit(0))

    @F.pandas_udf("normal string, changes int")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([transduce(t) for t in s], columns=["normal", "changes"])

    hard = df.filter(~plain).withColumn("_x", apply(F.col(text))).select(*df.columns, F.col("_x.normal").alias(cols[-2]), F.col("_x.changes").alias(cols[-1]))
    return easy.unionByName(hard)


def affected(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(source_table, record_key) of the records whose text changes; chunks delivered twice count once (the newest)."""
    c = normalised(chunks.select("chunk_id", "text", "ingested_at", F.md5("text").alias("digest")), "text").select("chunk_id", F.col("text_changes").alias("n"), "ingested_at", "digest")
    c = latest(c, "chunk_id", ["ingested_at", "digest"]).filter("n > 0").select(F.lit("chunks").alias("source_table"), F.col("chunk_id").alias("record_key"))
    h = normalised(decisions.select("decision_id", "sentence"), "sentence").filter("sentence_changes > 0").dropna(subset=["decision_id"])
    return c.unionByName(h.select(F.lit("hyphen_decisions").alias("source_table"), F.col("decision_id").cast("string").alias("record_key")).distinct())


def normalised_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_normal, text_changes) of every chunk's newest text; null ids are dropped."""
    return normalised(newest(chunks, "text"), "text").select("chunk_id", "text_normal", "text_changes")
