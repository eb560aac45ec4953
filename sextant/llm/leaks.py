"""Evaluation texts inside training text: greedy string tiling over Karp-Rabin seeds (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.llm.words import WORD, mix, word_hashes
from sextant.runtime import materialise, size_in_bytes

RUN = 13
SEED = 5
#: Share of a part's words under tiles from which it counts as leaked in any order, for parts of at least RUN words.
COVERED = 0.5
#: Bits of the filter over the items' seeds: 16 a seed, between these bounds; it only spares work, the join decides.
FILTER_BITS = (1 << 16, 1 << 28)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, width: int = SEED) -> np.ndarray:
    """Karp-Rabin fingerprint of every window of ``width`` word numbers."""
    if len(ids) < width:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(ids) - width + 1, np.uint64)
    x = np.asarray(ids).astype(np.uint64)
    for k in range(width):
        acc = acc * _BASE + x[k : len(x) - width + 1 + k]
    return mix(acc)


class _Prints:
    """Karp-Rabin fingerprints of windows of any width over one sequence, from its prefix sums."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.power = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _BASE, np.uint64), out=self.power[1:])
        # sum of id * base^position; a window's sum, scaled to one place, does not depend on where it stands
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids) * self.power[:n])])
        self.taken = np.zeros(n, bool)

    def free(self, width: int) -> np.ndarray:
        """Starts of the windows without a taken place."""
        if len(self.taken) < width:
            return np.empty(0, np.int64)
        c = np.concatenate([[0], np.cumsum(self.taken)])
        return np.flatnonzero(c[width:] == c[:-width])

    def at(self, starts: np.ndarray, width: int, top: int, powers: np.ndarray) -> np.ndarray:
        return (self.prefix[starts + width] - self.prefix[starts]) * powers[top - starts]


def tiles(doc: list[int], item: list[int], shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, place in doc, place in item), longest first, none overlapping.

    Each round finds the greatest length at which unmarked stretches of both agree, by bisection over running Karp-Rabin
    fingerprints, and marks matches of that length until none is left. Ties go to the earliest place in the document, then
    in the item. A round costs the two lengths times a logarithm, however often words repeat.
    """
    d, t = (_Prints(np.asarray(x).astype(np.int64).view(np.uint64)) for x in (doc, item))
    top = max(len(doc), len(item))
    powers = np.ones(top + 1, np.uint64)
    np.cumprod(np.full(top, _BASE, np.uint64), out=powers[1:])

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = d.free(width), t.free(width)
        x, y = d.at(a, width, top, powers), t.at(b, width, top, powers)
        both = np.isin(x, y)
        return a[both], x[both], b, y

    out: list[tuple[int, int, int]] = []
    high = min(len(doc), len(item))
    while True:
        low, up = shortest - 1, high
        while low < up:  # the greatest width with a common window
            mid = (low + up + 1) // 2
            if len(common(mid)[0]):
                low = mid
            else:
                up = mid - 1
        if low < shortest:
            return out
        a, x, b, y = common(low)
        order = np.argsort(y, kind="stable")
        ys, bs = y[order], b[order]
        first, last = np.searchsorted(ys, x), np.searchsorted(ys, x, side="right")
        seen: dict[int, int] = {}  # how far the places of one fingerprint are used up
        for i, f, l in zip(a.tolist(), first.tolist(), last.tolist()):
            if d.taken[i] or d.taken[i + low - 1]:
                continue
            k = seen.get(f, f)
            while k < l and (t.taken[bs[k]] or t.taken[bs[k] + low - 1]):
                k += 1
            seen[f] = k
            if k < l:
                j = int(bs[k])
                d.taken[i : i + low] = True
                t.taken[j : j + low] = True
                out.append((low, i, j))
        high = low - 1


def _needed(n: int) -> int:
    """Seed places of a part of ``n`` words that a leak has at least: those of a run, or one for each SEED covered words."""
    return max(1, min(RUN - SEED + 1, -(-int(np.ceil(COVERED * n)) // SEED)))


def item_parts(items: DataFrame) -> DataFrame:
    """(part_id, item_id, part, n_words, ids, prints): the queries and passages of RUN words or more; equal rows count once."""
    each = items.select("item_id", F.expr("stack(2, 'query', query, 'passage', passage) AS (part, t)")).filter("item_id IS NOT NULL AND t IS NOT NULL").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, part, text in b.itertuples(index=False):
                ids = word_hashes(WORD.findall(text.lower()))
                if len(ids) >= RUN:  # a shorter part cannot leak
                    rows.append((item, part, len(ids), _needed(len(ids)), ids.view(np.int64), rolling(ids).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "part", "n_words", "needed", "ids", "prints"])

    kind = items.schema["item_id"].dataType.simpleString()
    done = each.mapInPandas(run, f"item_id {kind}, part string, n_words int, needed int, ids array<long>, prints array<long>")
    return materialise(done.select(F.xxhash64("item_id", "part", "ids").alias("part_id"), "*"))


def seed_filter(prints: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array over the items' seeds and its number of bits; built in parts, at most FILTER_BITS[1] / 8 bytes."""
    n = prints.count()
    bits = FILTER_BITS[0]
    while bits < min(16 * n, FILTER_BITS[1]):
        bits *= 2
    slot = F.pmod("print", F.lit(bits))
    word = prints.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(print, {bits}L) % 32 AS INT))")).alias("m")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[word["w"].to_numpy(np.int64)] = word["m"].to_numpy(np.int64).astype(np.uint32)
    return out, bits


def document_runs(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, start, ids, prints): stretches of a document in which every window's fingerprint passes the items' filter.

    Each document is read and fingerprinted once; what leaves it are the words under possible seeds.
    """
    array, bits = seed_filter(prints)
    shared = documents.sparkSession.sparkContext.broadcast(array)
    docs = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, mask = shared.value, np.uint64(bits - 1)
        for b in batches:
            words: list[str] = []
            starts = [0]
            for t in b["text"]:
                words += WORD.findall(t.lower())
                starts.append(len(words))
            ids = word_hashes(words)
            at = rolling(ids)
            slot = at & mask
            hit = (bitmap[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
            pos = np.flatnonzero(hit)
            place = np.searchsorted(starts, pos, side="right") - 1
            inside = pos + SEED <= np.array(starts)[place + 1] if len(pos) else np.empty(0, bool)  # no window crosses the end of a text
            pos, place = pos[inside], place[inside]
            cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(place) != 0)) + 1
            doc = b["doc_id"].to_numpy()
            rows = [(doc[place[a]], pos[a] - starts[place[a]], ids[pos[a] : pos[z - 1] + SEED].view(np.int64), at[pos[a] : pos[z - 1] + 1].view(np.int64)) for a, z in zip([0, *cut], [*cut, len(pos)]) if z > a]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "ids", "prints"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return materialise(docs.mapInPandas(run, f"doc_id {kind}, start long, ids array<long>, prints array<long>"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, part, n_words, longest, covered, n_tiles): documents and the parts of items that leaked into them.

    ``part`` is query or passage, ``longest`` the longest run of shared words, ``covered`` the share of the part's words
    under tiles of at least SEED words, whatever their order. A part leaked if a run has RUN words, or if tiles cover
    COVERED of it and it has RUN words at all. Documents are read once and joined to items by fingerprints. Of a part's
    seed places all but the most frequent ones are joined: a leak has more places than are left out, so none is lost,
    however common a phrase is. Null or empty texts match nothing; items delivered twice count once.
    """
    parts = item_parts(items)
    every = parts.select("part_id", "needed", F.posexplode("prints").alias("at", "print"))
    runs = document_runs(documents, every.select("print").distinct())
    seen = runs.select("doc_id", F.explode("prints").alias("print")).distinct()
    frequency = seen.groupBy("print").agg(F.count("*").alias("n"))
    # places are ranked inside one part; the needed - 1 most frequent ones can't be all a leak has
    w = W.partitionBy("part_id").orderBy(F.coalesce("n", F.lit(0)).desc(), "at")
    rare = every.join(frequency, "print", "left").withColumn("r", F.row_number().over(w)).filter(F.col("r") >= F.col("needed")).select("part_id", "print").distinct()
    pairs = seen.join(rare, "print").select("doc_id", "part_id").distinct()
    whole = runs.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "ids"))).alias("runs"))
    met = pairs.join(parts.drop("prints"), "part_id").join(whole, "doc_id")
    if size_in_bytes(runs) > 8 << 20:  # pairs of one document or item may lie together; tiling is spread anew
        met = met.repartition("doc_id", "part_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                item = np.asarray(r.ids)
                # numbers that stand for no word of either side keep the stretches apart
                near = np.concatenate([np.append(x["ids"], -1 - i) for i, x in enumerate(r.runs)])
                mine = np.isin(near, item)
                near[~mine] = -1 - np.flatnonzero(~mine)
                t = tiles(near, item)
                if not t:
                    continue
                longest, covered = t[0][0], sum(x for x, _, _ in t) / len(item)
                if longest >= RUN or (covered >= COVERED and len(item) >= RUN):
                    rows.append((r.doc_id, r.item_id, r.part, r.n_words, longest, covered, len(t)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "part", "n_words", "longest", "covered", "n_tiles"])

    kinds = [f"{c} {t}" for c, t in (("doc_id", documents.schema["doc_id"].dataType.simpleString()), ("item_id", items.schema["item_id"].dataType.simpleString()))]
    return met.select("doc_id", "item_id", "part", "n_words", "ids", "runs").mapInPandas(run, ", ".join([*kinds, "part string, n_words int, longest int, covered double, n_tiles int"]))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with RUN or more consecutive words of an item's query or passage."""
    return leaks(documents, items).filter(F.col("longest") >= RUN).select("doc_id", "item_id").distinct()
