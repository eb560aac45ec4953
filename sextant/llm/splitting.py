"""Splitting oversized texts at natural boundaries with balanced targets (problem 3)."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.words import newest, token_count
from sextant.runtime import running_total

MAX_TOKENS = 400
OVERLAP = 40
_TOKEN = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?][\"'”’»)\]]*$")


def _strength(token: str, gap: str) -> int:
    """How natural a cut after ``token`` and before the white space ``gap`` is: paragraph 5 ... none 0."""
    if gap.count("\n") > 1:
        return 5
    if "\n" in gap:
        return 4
    if _SENTENCE.search(token):
        return 3
    return 2 if token[-1] in ";:" else 1 if token[-1] == "," else 0


def _least_weak(natural: list[int], n: int, room: int, limit: int) -> int:
    """Cuts off every natural boundary that any placement needs: those inside stretches longer than a piece's own tokens."""
    weak, at = 0, 0
    for b in [*natural, n]:
        weak += max(0, -(-(b - at) // (limit if at == 0 else room)) - 1)
        at = b
    return weak


def cut_points(strength: list[int], limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[int]:
    """Token numbers where the new material of each piece ends; the last is the number of tokens.

    ``strength[i]`` belongs to a cut after token ``i``. A piece holds the last ``overlap`` tokens of the one
    before it and its own new tokens, ``limit`` at most. The fewest pieces come first, with targets of equal
    length; each target moves to the strongest boundary near it (the nearest on ties, the earlier one then). Where
    that leaves more cuts off natural boundaries than any placement needs, pieces are added, 1, 2, 4, ... more, at most
    as many as there are, and the placement with the fewest such cuts is taken, of the fewest pieces.
    """
    n = len(strength)
    if n <= limit:
        return [n]
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    room = limit - overlap
    least = 1 + -(-(n - limit) // room)
    places: dict[int, list[int]] = {}  # strength -> cuts of it, rising
    for i in range(n - 1):
        if strength[i]:
            places.setdefault(strength[i], []).append(i + 1)
    levels = [places[k] for k in sorted(places, reverse=True)]
    needed = _least_weak([i + 1 for i in range(n - 1) if strength[i]], n, room, limit)

    def nearest(a: int, b: int, target: int) -> int | None:
        for level in levels:
            k = bisect.bisect_left(level, target)
            near = [c for c in level[max(0, k - 1) : k + 1] if a <= c <= b]
            if near:
                return min(near, key=lambda c: (abs(c - target), c))
        return None

    best: tuple[int, list[int]] | None = None
    for more in [0, *(1 << k for k in range(least.bit_length()))]:
        pieces = least + more
        cuts, weak, start = [], 0, 0
        own = (n + (pieces - 1) * overlap) / pieces  # equal whole lengths, overlap included
        for i in range(1, pieces):
            rest = pieces - i  # those after this one must be able to hold what remains
            low = max(start + 1, n - rest * room)
            high = min(start + (limit if start == 0 else room), n - 1)
            if low > high:
                break
            target = min(max(round(i * own - (i - 1) * overlap), low), high)
            reach = max(8, int(own) // 4)
            at = nearest(max(low, target - reach), min(high, target + reach), target)
            weak += at is None
            start = target if at is None else at
            cuts.append(start)
        else:
            if n - start <= room and (best is None or weak < best[0]):
                best = (weak, [*cuts, n])
        if best and best[0] <= needed:
            break
    return best[1]  # the fewest pieces always fit, so there is one


def split_text(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece as offsets into ``text``."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return [(0, len(text), 0)]
    ends = [*[s for s, _ in spans[1:]], len(text)]
    strength = [_strength(text[s:e], text[e:nxt]) for (s, e), nxt in zip(spans, ends)]
    out, start = [], 0
    for cut in cut_points(strength, limit, overlap):
        first = max(0, start - overlap)
        out.append((spans[first][0], spans[cut - 1][1], cut - first))
        start = cut
    return out


def split_oversized(chunks: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Every chunk as one or more pieces of at most ``limit`` tokens.

    Columns: chunk_id, parent_id, piece (from 1), n_pieces, text, token_count, char_start, char_end (within the
    chunk's text). Only oversized texts pass through Python. Chunks delivered twice count once (the latest);
    a null or empty text is one piece of 0 tokens; null ids are dropped; extra columns are ignored.
    """
    one = newest(chunks, "parent_id", "seq", "text")
    counted = one.withColumn("n", token_count(F.col("text")))
    small = counted.filter(F.col("n") <= limit).select(
        "chunk_id", "parent_id", "seq", F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), "text",
        F.col("n").cast("int").alias("token_count"), F.lit(0).alias("char_start"), F.coalesce(F.length("text"), F.lit(0)).alias("char_end"),
    )

    names = small.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                parts = split_text(r.text, limit, overlap)
                rows += [(r.chunk_id, r.parent_id, r.seq, i, len(parts), r.text[s:e], k, s, e) for i, (s, e, k) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=names).astype({"seq": "Int32"})

    big = counted.filter(F.col("n") > limit).select("chunk_id", "parent_id", "seq", "text")
    return small.unionByName(big.mapInPandas(run, small.schema))


def renumbered(pieces: DataFrame) -> DataFrame:
    """Pieces with ``seq`` and ``n_chunks_in_unit`` counted anew over each parent.

    Parents of any size work: the numbering sums piece counts over range partitions, with ids and counts only.
    """
    per_chunk = pieces.filter(F.col("piece") == 1).select("chunk_id", "parent_id", F.coalesce("seq", F.lit(0)).alias("old"), "n_pieces")
    done = running_total(per_chunk, ["parent_id"], [F.col("old"), F.col("chunk_id")], F.col("n_pieces"), "upto")
    total = per_chunk.groupBy("parent_id").agg(F.sum("n_pieces").alias("n_chunks_in_unit"))
    place = done.join(total, done["parent_id"].eqNullSafe(total["parent_id"])).select("chunk_id", (F.col("upto") - F.col("n_pieces")).alias("before"), "n_chunks_in_unit")
    return pieces.join(place, "chunk_id").select(
        "chunk_id", "parent_id", (F.col("before") + F.col("piece")).cast("int").alias("seq"), F.col("n_chunks_in_unit").cast("int").alias("n_chunks_in_unit"),
        "piece", "n_pieces", "text", "token_count", "char_start", "char_end",
    )
