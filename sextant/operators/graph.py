"""Equivalence classes, closures and relation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.runtime import discard, materialise


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the least node id each node is connected to, by large-star and small-star steps.

    Edges are (a, b); loops and nulls drop out. Every round works on distinct edges, written to the shared folder;
    a star of any size is a group-by, so no class is gathered. Raises if ``rounds`` do not suffice.
    """
    e = edges.select("a", "b").dropna().filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialise(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select("a", "b", "m")
        new = materialise(small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            discard(e)
            return new.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
        discard(e)
        e = new
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def closure(seeds: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, depth): all nodes reachable from the seeds over undirected edges, with the fewest steps."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = materialise(seeds.select("node").dropna().distinct().withColumn("depth", F.lit(0)))
    front = seen
    for k in range(1, rounds + 1):
        new = materialise(front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        if new.isEmpty():
            return seen
        both_seen = materialise(seen.unionByName(new))
        for old in {id(x): x for x in (seen, front)}.values():
            discard(old)
        seen, front = both_seen, new
    raise RuntimeError(f"closure did not settle within {rounds} rounds")


def contained(texts: DataFrame, n: int = 8) -> DataFrame:
    """(inner, outer): texts of words parted by one space that stand whole, between word ends, in a text; each also in itself.

    ``texts`` is (id, m), distinct and of ``n`` words or more, of any length. A containing text has every window of ``n``
    words of the contained one, so only texts whose windows all stand in a second text are looked up, each by its rarest window.
    """
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))
    g = materialise(texts.select("id", F.split("m", " ").alias("w")).select("id", windows.alias("k")))  # a text is split once, not for each window
    each = g.select("id", F.explode("k").alias("k"))
    shared = materialise(each.join(each.groupBy("k").agg(F.count("*").alias("f")).filter("f > 1"), "k"))
    sized = g.select("id", F.size("k").alias("n"))
    probe = shared.groupBy("id").agg(F.count("*").alias("c"), F.min_by("k", F.struct("f", "k")).alias("k")).join(sized, "id").filter("c = n").select(F.col("id").alias("inner"), "k")
    pairs = probe.join(shared.select(F.col("id").alias("outer"), "k"), "k").filter("inner <> outer").select("inner", "outer")
    both = pairs.join(texts.select(F.col("id").alias("inner"), F.col("m").alias("a")), "inner").join(texts.select(F.col("id").alias("outer"), F.col("m").alias("b")), "outer")
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    found = both.filter(F.length("a") < F.length("b")).filter(pad(F.col("b")).contains(pad(F.col("a")))).select("inner", "outer")
    return found.unionByName(g.select(F.col("id").alias("inner"), F.col("id").alias("outer")))
