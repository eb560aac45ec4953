"""Words, their numbers, and the newest delivery, shared by the text operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import latest

#: White space as Python's str.split() sees it, in Java's and RE2's syntax.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^")


#: A word: a maximal run of a-z and 0-9 in lower-cased text.
WORD = re.compile(r"[a-z0-9]+")
_M, _N, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S)) * _M
    x = (x ^ (x >> _S)) * _N
    return x ^ (x >> _S)


class _Numbers(dict):
    """A stable 64-bit number per word (FNV-1a), kept for words met before."""

    def __missing__(self, word: str) -> int:
        h = 0xCBF29CE484222325
        for b in word.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        self[word] = h
        return h


_known = _Numbers()
#: Words whose numbers are kept at most; beyond it they are computed anew.
_KNOWN_MOST = 1_000_000


def word_hashes(words: list[str]) -> np.ndarray:
    """A stable, mixed 64-bit number per word."""
    if len(_known) > _KNOWN_MOST:
        _known.clear()
    return mix(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)))


def token_count(text: Column) -> Column:
    """Number of white-space separated tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0))


def newest(chunks: DataFrame, *cols: str) -> DataFrame:
    """(chunk_id, cols) of the newest delivery of each chunk; of one time the text with the greatest digest, null lowest."""
    rest = [c for c in cols if c != "chunk_id"]
    read = chunks.select("chunk_id", *rest, "ingested_at", F.md5("text").alias("_digest"))
    return latest(read, "chunk_id", ["ingested_at", "_digest"]).select("chunk_id", *rest)
