"""Near-duplicate texts: fast similarity sketches, banding, exact verification (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.copies import identity
from sextant.llm.words import WORD, mix, newest, word_hashes
from sextant.operators.graph import components
from sextant.runtime import materialise

THRESHOLD = 0.7
WIDTH = 3
ROWS, BANDS = 5, 50  # a pair at the threshold shares no band with probability (1 - 0.7^5)^50 = 1e-4
#: Buckets above this many members are not joined with themselves: their members meet by rare shingles, without loss.
BLOCK = 256
#: Shingles sketched at once; bounds the memory of a batch, not the length of a text.
_AT_ONCE = 1 << 19


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words of the lower-cased text."""
    h = word_hashes(WORD.findall(text.lower()))
    if len(h) < width:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(acc)


def sketches(sets: list[np.ndarray], t: int = ROWS * BANDS) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: ``t`` values each, equal per place with the sets' similarity.

    In each of the first ``t`` rounds every item lands in one hashed bin, in the next ``t`` all land in the bin of
    that round; a bin keeps its least (round, value), and a set's rounds end once none of its bins is empty.
    """
    empty = np.iinfo(np.uint64).max
    out = np.full((len(sets), t), empty, np.uint64)
    low, flat = np.uint64((1 << 52) - 1), np.concatenate(sets) if sets else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    for i in range(2 * t):
        if not len(flat):
            break
        h = mix(flat + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        value = (mix(h) & low) | (np.uint64(i) << np.uint64(52))
        place = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out.reshape(-1), row * t + place, value)
        left = (out == empty).any(axis=1)[row]
        flat, row = flat[left], row[left]
    return out


def sketch(items: np.ndarray, t: int = ROWS * BANDS) -> np.ndarray:
    """The sketch of one non-empty set."""
    return sketches([items], t)[0]


def bands_of(values: np.ndarray) -> np.ndarray:
    """One hash per set and band of ROWS sketch values; the number of the band is part of it."""
    v = values.reshape(-1, BANDS, ROWS)
    acc = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(v), 1))
    for k in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + v[:, :, k])
    return acc


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def members(chunks: DataFrame) -> DataFrame:
    """(chunk_id, record, cls, items, bands): ``cls`` numbers equal shingle sets, ``record`` equal records.

    Chunks delivered twice count once (the latest); null ids, null texts and texts shorter than a shingle are left out.
    """
    src = newest(chunks, "unit_type", "text").filter(F.col("text").isNotNull()).select("chunk_id", F.xxhash64(identity(F.col("text"), F.col("unit_type"))).alias("record"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            at, size = np.flatnonzero([len(s) > 0 for s in sets]), np.cumsum([len(s) for s in sets])
            for group in np.split(at, np.flatnonzero(np.diff(size[at] // _AT_ONCE)) + 1) if len(at) else ():
                mine = [sets[i] for i in group]
                cls = mix(np.array([np.bitwise_xor.reduce(mix(s)) + np.uint64(len(s)) for s in mine], np.uint64)).view(np.int64)
                bands = bands_of(sketches(mine)).view(np.int64)
                yield pd.DataFrame({"chunk_id": b["chunk_id"].iloc[group], "record": b["record"].iloc[group], "cls": cls, "items": [s.view(np.int64) for s in mine], "bands": list(bands)})

    return src.mapInPandas(run, "chunk_id string, record long, cls long, items array<long>, bands array<long>")


def _verify(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Those of the (a, b) class pairs whose sets reach the threshold."""
    sets = reps.select("cls", "items")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [similarity(x, y) >= threshold for x, y in zip(p["x"], p["y"])]
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _by_rare_items(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) candidate classes among ``sets`` (cls, items), complete for the threshold, without comparing all.

    Items are ordered by how few sets hold them. Two similar sets share an item among the first of each, as many as may be
    missing and one; sizes and places bound what they can share at most. Ids travel, no sets.
    """
    each = sets.select("cls", F.size("items").alias("size"), F.explode("items").alias("it"))
    known = each.join(each.groupBy("it").agg(F.count("*").alias("n")), "it")
    first = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    sorted_items = known.groupBy("cls", "size").agg(F.array_sort(F.collect_list(F.struct("n", "it"))).alias("s"))
    prefix = sorted_items.select("cls", "size", F.posexplode(F.slice("s", F.lit(1), first)).alias("pos", "x")).filter("x.n > 1").select("cls", "size", "pos", F.col("x.it").alias("it"))
    x, y = (prefix.select("it", F.col("cls").alias(c), F.col("size").alias(f"s{c}"), F.col("pos").alias(f"p{c}")) for c in "ab")
    most = 1 + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) - 1
    need = F.lit(threshold / (1 + threshold)) * (F.col("sa") + F.col("sb")) - 1e-9
    return x.join(y, "it").filter((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= threshold * F.greatest("sa", "sb")) & (most >= need)).select("a", "b").distinct()


def similar_classes(m: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with a < b: classes of different shingle sets whose similarity reaches the threshold.

    Classes that share a band meet in its bucket. Buckets of more than BLOCK classes are resolved among their members by
    rare items, which finds every pair of them that the bucket could give, and more.
    """
    reps = m.groupBy("cls").agg(F.first("items").alias("items"), F.first("bands").alias("bands"))
    keys = reps.select("cls", F.size("items").alias("size"), F.explode("bands").alias("key"))
    sized = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    calm, hot = sized.filter(F.col("n") <= BLOCK), sized.filter(F.col("n") > BLOCK).select("cls").distinct()
    x, y = (calm.select("key", F.col("cls").alias(c), F.col("size").alias(f"s{c}")) for c in "ab")
    pairs = x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= threshold * F.greatest("sa", "sb"))).select("a", "b")
    more = _by_rare_items(reps.select("cls", "items").join(hot, "cls", "left_semi"), threshold)
    return _verify(pairs.unionByName(more).distinct(), reps, threshold)


def near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id_a, chunk_id_b): pairs whose shingle sets reach the threshold and that are not the same record."""
    m = materialise(members(chunks))
    links = similar_classes(m, threshold)
    own = m.groupBy("cls").agg(F.countDistinct("record").alias("n")).filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    ids = m.select("cls", "record", "chunk_id")
    p = (
        links.unionByName(own)
        .join(ids.select(F.col("cls").alias("a"), F.col("record").alias("ra"), F.col("chunk_id").alias("ca")), "a")
        .join(ids.select(F.col("cls").alias("b"), F.col("record").alias("rb"), F.col("chunk_id").alias("cb")), "b")
        .filter((F.col("ra") != F.col("rb")) & ((F.col("a") != F.col("b")) | (F.col("ca") < F.col("cb"))))
    )
    return p.select(F.least("ca", "cb").alias("chunk_id_a"), F.greatest("ca", "cb").alias("chunk_id_b"))


def duplicate_classes(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id, class_id, n_links): one row per chunk with a shingle.

    ``class_id`` is the smallest chunk_id of its shingle set, ``n_links`` the number of other sets at or above the threshold.
    """
    m = materialise(members(chunks))
    links = similar_classes(m, threshold)
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    first = m.groupBy("cls").agg(F.min("chunk_id").alias("class_id"))
    per = first.join(ends, "cls", "left").select("cls", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return m.select("cls", "chunk_id").join(per, "cls").select("chunk_id", "class_id", "n_links")


def duplicate_groups(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id, group_id, n_chunks): one row per chunk with a shingle; groups are what links at or above the threshold connect.

    ``group_id`` is the smallest chunk_id of the group, ``n_chunks`` the number of its chunks, copies included.
    """
    m = materialise(members(chunks))
    c = components(similar_classes(m, threshold)).select(F.col("node").alias("cls"), "component")
    ids = m.select("cls", "chunk_id").join(c, "cls", "left").select("chunk_id", F.coalesce("component", "cls").alias("component"))
    groups = ids.groupBy("component").agg(F.min("chunk_id").alias("group_id"), F.count("*").alias("n_chunks"))
    return ids.join(groups, "component").select("chunk_id", "group_id", "n_chunks")
