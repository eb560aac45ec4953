"""Attribution of spans, self-containedness, existence denials, and deterministic sinks."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as T

FLOOR = 0.8
#: How a sentence says that what is asked for does not exist.
DENIALS = [r"\bthere is no\b", r"\bdoes not exist\b", r"\bdo not exist\b", r"\bis not (?:part of|contained in|found in)\b", r"\bno such\b", r"\bnot (?:contain|include)\b"]


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of the matching ratio from lengths alone; 1 for two empty texts."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / n)


def ratio(pairs: DataFrame, a: str, b: str, out: str = "ratio", floor: float = FLOOR) -> DataFrame:
    """``pairs`` whose matching ratio (matched characters, Ratcliff-Obershelp) reaches ``floor``, with the ratio.

    The bound from lengths drops pairs natively before the Arrow batches.
    """

    @F.pandas_udf("double")
    def match(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in it:
            out = []
            for u, v in zip(x, y):
                m = difflib.SequenceMatcher(None, u, v, autojunk=False)
                out.append(m.ratio() if m.quick_ratio() >= floor else 0.0)
            yield pd.Series(out, dtype="float64")

    kept = pairs.filter(ratio_bound(F.col(a), F.col(b)) >= floor)
    return kept.withColumn(out, match(F.col(a), F.col(b))).filter(F.col(out) >= floor)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, at least the matched characters of the ratio; by bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = left = (1 << len(a)) - 1
    for c in b:
        u = left & at.get(c, 0)
        left = (left + u | left - u) & full
    return len(a) - left.bit_count()


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``common_subsequence`` of one coded text with each row of ``b`` (codes, -1 behind the end), all rows at once, 63 letters a word."""
    words = -(-len(a) // 63) or 1
    at = np.zeros((words, int(max(a.max(initial=-1), b.max(initial=-1))) + 2), dtype=np.uint64)
    for i, c in enumerate(a):
        at[i // 63, c] |= np.uint64(1) << np.uint64(i % 63)
    full = np.uint64((1 << 63) - 1)
    left = [np.full(len(b), full) for _ in range(words)]
    for c in np.ascontiguousarray(b.T):
        carry = None
        for w in range(words):
            x = left[w]
            u = x & at[w][c]
            s = x + u if carry is None else x + u + carry
            carry = s >> np.uint64(63) if w + 1 < words else None
            left[w] = (s | (x ^ u)) & full
    return sum((63 - np.bitwise_count(x).astype(np.int64) for x in left), np.zeros(len(b), dtype=np.int64))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many codes each of ``a`` shares with each of ``b``, as multisets: products of the marks of every first, second, ... place of a code."""

    def marks(x: np.ndarray) -> np.ndarray:
        x = np.sort(x)
        new = np.ones(len(x), dtype=bool)
        new[1:] = x[1:] != x[:-1]
        at = np.arange(len(x))
        return x * (1 << 20) + at - np.maximum.accumulate(np.where(new, at, 0)) if len(x) else x

    ma, mb = [marks(x) for x in a], [marks(x) for x in b]
    keys = np.unique(np.concatenate([*ma, np.zeros(0, dtype=np.int64)]))

    def matrix(m: list[np.ndarray]) -> np.ndarray:
        flat, row = np.concatenate([*m, np.zeros(0, dtype=np.int64)]), np.repeat(np.arange(len(m)), [len(x) for x in m])
        col = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        known = keys[col] == flat if len(keys) else np.zeros(len(flat), dtype=bool)
        out = np.zeros((len(m), len(keys)), dtype=np.float32)
        out[row[known], col[known]] = 1
        return out

    return matrix(ma) @ matrix(mb).T


def alike(a: list[str], b: list[str], floor: float) -> list[tuple[str, str, float]]:
    """(text of a, text of b, ratio) of all pairs whose matching ratio reaches ``floor``; bounds drop only pairs that cannot.

    Lengths, shared letters, shared pairs of letters (of m matched characters at least 3 m - n - 1 neighbours stay together,
    n being both lengths), then common subsequences of one text with all that are left.
    """
    if not a or not b:
        return []
    letters: dict[str, int] = {}
    ca, cb = ([np.array([letters.setdefault(c, len(letters)) for c in t], dtype=np.int64) for t in x] for x in (a, b))
    na, nb = np.array([len(x) for x in ca]), np.array([len(x) for x in cb])
    both = na[:, None] + nb[None, :]
    need = floor * both / 2 - 1e-9
    near = (np.minimum(na[:, None], nb[None, :]) >= need) & (shared_counts(ca, cb) >= need)
    two = lambda x: x[:-1] * len(letters) + x[1:]
    near &= shared_counts([two(x) for x in ca], [two(x) for x in cb]) >= 3 * need - both - 1
    padded = np.full((len(b), int(nb.max())), -1, dtype=np.int64)
    for i, x in enumerate(cb):
        padded[i, : len(x)] = x
    out = []
    for i, x in enumerate(a):
        some = np.flatnonzero(near[i])
        if len(some):
            some = some[common_subsequences(ca[i], padded[some, : nb[some].max()]) >= need[i, some]]
        for y in (b[k] for k in some):
            r = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
            if r >= floor:
                out.append((x, y, r))
    return out


def lexical_attribution(spans: DataFrame, segments: DataFrame, gold: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(span_id, unit, seg_no, ratio): segments of other than gold units that read like a span, however their words are spelled.

    Groups of distinct spans meet groups of distinct segments; lengths, letters and common subsequences bound the ratio.
    Columns: spans (span_id, span), segments (unit, seg_no, segment), gold (span_id, unit).
    """
    seg = segments.select("unit", "seg_no", T.lexical_form(F.col("segment")).alias("s"))
    sp = spans.select("span_id", T.lexical_form(F.col("span")).alias("p"))
    p, s = sp.select("p").dropna().distinct(), seg.select("s").dropna().distinct()
    n_p, n_s = -(-p.count() // 1024) or 1, -(-s.count() // 8192) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = p.select("p", F.pmod(F.xxhash64("p"), F.lit(n_p)).cast("int").alias("i"), every(n_s).alias("j"))
    s = s.select("s", F.pmod(F.xxhash64("s"), F.lit(n_s)).cast("int").alias("j"), every(n_p).alias("i"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(alike(list(x["p"]), list(y["s"]), floor), columns=["p", "s", "ratio"])

    hit = p.groupBy("i", "j").cogroup(s.groupBy("i", "j")).applyInPandas(run, "p string, s string, ratio double")
    return sp.join(hit, "p").join(seg, "s").join(gold, ["span_id", "unit"], "left_anti").select("span_id", "unit", "seg_no", F.bround("ratio", 4).alias("ratio"))


def opcodes(a: str, b: str) -> list[tuple[str, str, str]]:
    """(kind, run of a, run of b) where two texts differ, word by word."""
    x, y = a.split(), b.split()
    m = difflib.SequenceMatcher(None, x, y, autojunk=False)
    return [(k, " ".join(x[i:j]), " ".join(y[p:q])) for k, i, j, p, q in m.get_opcodes() if k != "equal"]


def denies_existence(unit: Column) -> Column:
    """Whether a claim unit says that what it names does not exist."""
    return F.lower(T.norm_comparison(unit)).rlike("|".join(DENIALS))


def adversarial_verdict(units: DataFrame) -> DataFrame:
    """(custom_id, verdict): failure as soon as one unit is not a denial, not_failure otherwise."""
    return units.groupBy("custom_id").agg(F.when(F.bool_or(~denies_existence(F.col("unit"))), "failure").otherwise("not_failure").alias("verdict"))


def csv_number(x: Column) -> Column:
    """A double as a table prints it: six places, trailing zeros off, nothing for null."""
    return F.when(x.isNull(), "").otherwise(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""))


def contrast_ratio(a: Column, b: Column) -> Column:
    """Contrast of two ``#rrggbb`` colours."""

    def luminance(c: Column) -> Column:
        def part(i: int) -> Column:
            v = F.conv(F.substring(c, i, 2), 16, 10).cast("double") / 255
            return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

        return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)

    hi, lo = F.greatest(luminance(a), luminance(b)), F.least(luminance(a), luminance(b))
    return (hi + 0.05) / (lo + 0.05)


def write_jsonl(df: DataFrame, path: str, key: str) -> str:
    """One sorted JSON line per row, keys in alphabetical order; returns the digest over the part files in order.

    Rows are range-sorted by ``key``, so any size is written in parallel; an existing path is refused.
    """
    line = F.to_json(F.struct(*sorted(df.columns)))
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(line.alias("value")).write.mode("errorifexists").text(path)
    parts = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    return hashlib.sha256("".join(p["h"] for p in parts).encode()).hexdigest()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
