"""Deterministic sampling frames and greedy packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.runtime import materialise, running_total


def spaced_picks(sized: DataFrame, m: int, offset: int) -> DataFrame:
    """(stratum, pick): ``m`` evenly spaced places among ``n`` per stratum, starting at ``offset``; at most n."""
    k = F.least(F.col("n"), F.lit(m))
    i = F.explode(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)))).alias("i")
    return sized.filter("n > 0").select("stratum", "n", k.alias("k"), i).select("stratum", F.pmod(F.lit(offset) + F.floor(F.col("i") * F.col("n") / F.col("k")), F.col("n")).cast("long").alias("pick"))


def largest_remainder(sized: DataFrame, total: int) -> DataFrame:
    """(stratum, n, allocation): ``total`` in proportion to n; floors first, the rest to the largest fractions (ties by stratum).

    Strata are few; the one window spans one row each.
    """
    quota = F.col("n") * total / F.col("all")
    q = sized.crossJoin(F.broadcast(sized.agg(F.sum("n").alias("all")))).select("stratum", "n", F.floor(quota).alias("low"), F.bround(quota - F.floor(quota), 9).alias("part"))
    spare = q.agg((F.lit(total) - F.sum("low")).alias("spare"))
    r = q.withColumn("r", F.row_number().over(W.orderBy(F.col("part").desc(), "stratum")))
    return r.crossJoin(F.broadcast(spare)).select("stratum", "n", (F.col("low") + (F.col("r") <= F.col("spare")).cast("long")).alias("allocation"))


def select_walk(draws: DataFrame, key: Column, m: int, group: str, order: str) -> DataFrame:
    """First ``m`` draws per group in order, each key once; null keys never collide."""
    k = draws.withColumn("_k", key)
    first = k.filter("_k IS NOT NULL").groupBy(group, "_k").agg(F.min(order).alias(order)).select(group, order).unionByName(k.filter("_k IS NULL").select(group, order))
    w = W.partitionBy(group).orderBy(order)
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= m)


def split_gap(n: int, start: int, length: int, keep: int = 1) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Draws (distance, place) inside a gap between two drawn places of a circle of ``n``, and its parts (start, length) up to ``keep`` left whole.

    The farthest place of a gap is its middle, of two the lower; distances fall, or places rise, from a gap to its halves, so
    the draws of all gaps by falling distance, then place, are in drawing order.
    """
    draws, rest, todo = [], [], [(start, length)]
    while todo:
        a, w = todo.pop()
        if w < 2:
            continue
        if w <= keep:
            rest.append((a, w))
            continue
        half = w // 2
        cut = half if w % 2 == 0 or (a + half) % n < (a + half + 1) % n else half + 1
        draws.append((half, (a + cut) % n))
        todo += [(a, cut), ((a + cut) % n, w - cut)]
    return draws, rest


def first_draws(n: int, m: int, offset: int = 0) -> tuple[list[int], list[tuple[int, int]]]:
    """The ``m`` evenly spaced places drawn first (the lowest place if ``m`` is 0), and the gaps (start, length) they leave."""
    picks = list(dict.fromkeys((offset + i * n // max(m, 1)) % n for i in range(min(max(m, 1), n)))) if m else [0][:n]
    at = sorted(picks)
    return picks, [(a, (b - a) % n or n) for a, b in zip(at, at[1:] + at[:1])]


def draw_order(n: int, m: int, offset: int = 0) -> list[int]:
    """Order in which ``n`` places on a circle are drawn: ``m`` evenly spaced, then always the farthest (lower place on ties)."""
    picks, gaps = first_draws(n, m, offset)
    return picks + [p for _, p in sorted((d for g in gaps for d in split_gap(n, *g)[0]), key=lambda x: (-x[0], x[1]))]


def draw_orders(sized: DataFrame, m: int, keep: int = 1 << 16) -> DataFrame:
    """(stratum, draw_rank, place) of the whole draw of each stratum, of any size: gaps up to ``keep`` are drawn apart, then ranked by a range sort."""
    out = "stratum string, n long, length long, distance long, turn long, place long"

    def rows(s, n: int, draws: list, rest: list) -> list[tuple]:
        return [(s, n, 0, h, p, p) for h, p in draws] + [(s, n, w, 0, 0, a) for a, w in rest]

    def frame(x: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(x, columns=["stratum", "n", "length", "distance", "turn", "place"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, n in zip(b["stratum"], b["n"]):
                picks, gaps = first_draws(n, m)
                yield frame([(s, n, 0, n, i, p) for i, p in enumerate(picks)])
                for g in gaps:
                    yield frame(rows(s, n, *split_gap(n, *g, keep)))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, n, w, a in zip(b["stratum"], b["n"], b["length"], b["place"]):
                yield frame(rows(s, n, *split_gap(n, a, w)))

    top = materialise(sized.select("stratum", F.col("n").cast("long").alias("n")).mapInPandas(first, out))
    gaps = top.filter("length > 0").repartition("stratum", "place").mapInPandas(inside, out)
    every = top.filter("length = 0").unionByName(gaps).select("stratum", "distance", "turn", "place")
    return running_total(every, ["stratum"], [F.col("distance").desc(), F.col("turn")], F.lit(1).cast("long"), "draw_rank").select("stratum", "draw_rank", "place")


def pack_blocks(costs: Column, cap: int) -> Column:
    """Bin number of each block of an array, filled greedily in order up to ``cap``; an oversized block is alone."""
    start = F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("bins"))

    def put(s: Column, c: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + c > cap)
        b = s["bin"] + F.when(new, 1).otherwise(0)
        return F.struct(b.cast("long").alias("bin"), F.when(new, c).otherwise(s["used"] + c).cast("long").alias("used"), F.concat(s["bins"], F.array(b.cast("long"))).alias("bins"))

    return F.aggregate(costs, start, put, lambda s: s["bins"])
