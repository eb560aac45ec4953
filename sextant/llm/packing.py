"""Filling containers of fixed capacity: bulk-synchronous best fit (problem 8)."""

from __future__ import annotations

import base64
import bisect
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.runtime import broadcast_below, materialise, running_total

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts in which white space meets white space other than in a single blank line are encoded whole.
_TANGLED = re.compile(r"\s | \s|[^\S\n]\n|\n[^\S\n]|\n\n\n|\n\n\Z")
_CACHE_MOST = 500_000
_state: dict = {}


def token_counts(texts: list[str], ranks: bytes) -> list[int]:
    """Tokens of each text.

    The pattern cuts before every single space and around every single newline, so the count is a sum over
    words; counts of words met before are kept (a bounded number), and most text is never merged again.
    """
    import tiktoken

    if _state.get("of") != hash(ranks):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _state.update(of=hash(ranks), enc=tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), first={}, inner={})
    encode, first, inner = _state["enc"].encode_ordinary, _state["first"], _state["inner"]
    get_first, get_inner = first.__getitem__, inner.__getitem__
    out = []
    for t in texts:
        if _TANGLED.search(t):
            out.append(len(encode(t)))
            continue
        lines = [x.split(" ") for x in t.split("\n")]
        try:
            out.append(len(lines) - 1 + sum(get_first(x[0]) + sum(map(get_inner, x[1:])) for x in lines))
        except KeyError:
            if len(first) + len(inner) > _CACHE_MOST:
                first.clear()
                inner.clear()
            for x in lines:
                if x[0] not in first:
                    first[x[0]] = len(encode(x[0]))
                for w in x[1:]:
                    if w not in inner:
                        inner[w] = len(encode(" " + w))
            out.append(len(lines) - 1 + sum(get_first(x[0]) + sum(map(get_inner, x[1:])) for x in lines))
    return out


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document. Null and empty texts have 0 tokens; null ids are dropped."""
    shared = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": token_counts(b["text"].tolist(), shared.value)})

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id long, n_tokens long")


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, size, token_start, token_end): a text is cut, into full containers and a rest, only beyond the capacity.

    A text of no tokens takes one place, so that it too is put somewhere.
    """
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    cut = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("piece"))
    start = (F.col("piece") - 1).cast("long") * capacity
    end = F.least(F.col("n_tokens"), start + capacity)
    return cut.select("doc_id", "piece", F.greatest(end - start, F.lit(1)).cast("int").alias("size"), start.alias("token_start"), end.alias("token_end"))


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(size, first rank, number, first container): which items, by rank within their size, go to which containers.

    Items of one size are alike and so are containers with one gap, so the rounds work on those classes: at most
    ``capacity`` of each, however many items there are. A round takes the sizes in falling order; each looks for its
    successor among the gaps (the smallest that holds it), items and containers of a class meet by rank, and a
    container takes one item a round. Then the gaps are updated, and the next round begins. Where no item fits any
    gap, as many containers are opened as the rest fills at best, for the largest items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, deque[tuple[int, int]]] = {}  # gap -> runs of (first container, number)
    plan: list[tuple[int, int, int, int]] = []
    opened = 0
    while left:
        total = sum(s * n for s, n in left.items())
        big = sum(n for s, n in left.items() if 2 * s > capacity)
        new = max(big, -(-total // capacity))
        gaps.setdefault(capacity, deque()).append((opened, new))
        opened += new
        moved = True
        while moved and left and gaps:
            moved, later, free = False, defaultdict(deque), sorted(gaps)
            for s in sorted(left, reverse=True):
                i = bisect.bisect_left(free, s)
                while i < len(free) and s in left:
                    runs = gaps[free[i]]
                    first, n = runs.popleft()
                    k = min(n, left[s])
                    plan.append((s, taken[s], k, first))
                    taken[s] += k
                    left[s] -= k
                    if not left[s]:
                        del left[s]
                    if free[i] > s:
                        later[free[i] - s].append((first, k))
                    if k < n:
                        runs.appendleft((first + k, n - k))
                    moved = True
                    if not runs:
                        del gaps[free[i]]
                        del free[i]
            for g, runs in later.items():
                gaps.setdefault(g, deque()).extend(runs)
        least = min(left, default=0)
        gaps = {g: r for g, r in gaps.items() if g >= least}
    return plan


def assign(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, doc_id, piece, token_start, token_end, n_tokens): every document or piece in one container.

    Texts are read once, for their sizes; the counts per size, at most ``capacity`` rows, make the plan; items are
    numbered within their size by a range sort, whatever share of them has one size, and meet the plan by rank.
    Documents of one id are numbered in any order, their content being alike to the plan. An empty table gives no rows.
    """
    items = materialise(pieces(sized(documents, tokenizer), capacity))
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    spark = documents.sparkSession
    runs = spark.createDataFrame(pd.DataFrame(plan, columns=["size", "rank0", "k", "container0"]).astype("int64"), "size long, rank0 long, k long, container0 long")
    # one container opened for each run of ranks: full pieces need no numbering beyond it
    ranked = running_total(items, ["size"], [F.col("doc_id"), F.col("piece")], F.lit(1), "upto")
    rank = F.col("upto") - 1
    met = ranked.withColumnRenamed("size", "s").join(broadcast_below(runs, 16 << 20), (F.col("s") == F.col("size")) & (rank >= F.col("rank0")) & (rank < F.col("rank0") + F.col("k")))
    return met.select((F.col("container0") + rank - F.col("rank0")).alias("container_id"), "doc_id", "piece", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("n_tokens"))


def fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers the tokens could fill, and the share of space used."""
    c = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    t = c.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.max("used").alias("fullest"))
    return t.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), "fullest", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * capacity).alias("share_used"))


def checked(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents placed, containers over the capacity, documents split though they fit, and documents whose pieces
    leave out or repeat a token."""
    over = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).filter(F.col("used") > capacity).agg(F.count("*").alias("n_over"))
    d = assigned.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.min("token_start").alias("first"), F.max("token_end").alias("last"), F.countDistinct("token_start").alias("starts"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    whole = (F.col("first") == 0) & (F.col("last") == F.col("n")) & (F.col("starts") == F.col("k"))
    return d.agg(F.count("*").alias("n_documents"), one((F.col("k") > 1) & (F.col("n") <= capacity)).alias("n_split_needlessly"), one(~whole).alias("n_not_whole")).crossJoin(F.broadcast(over))  # one row each
