"""Lexical and dense ranking, fusion, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.functions import text as T
from sextant.runtime import broadcast_below, materialise, row_groups

K1, B, EPSILON, RRF_K, DEPTH, TOP = 1.5, 0.75, 0.25, 60, 100, 10


def lengths(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, dl): primary tokens per document; a null text has none."""
    return docs.select(F.col(doc).alias("doc"), F.coalesce(F.size(T.primary_tokens(F.col(text))), F.lit(0)).alias("dl"))


def postings(docs: DataFrame, doc: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf); of the terms in ``only`` where given, before anything is counted."""
    t = docs.select(F.col(doc).alias("doc"), F.explode(T.document_tokens(F.col(text))).alias("term"))
    if only is not None:
        t = t.join(broadcast_below(only.select("term").distinct(), 64 << 20), "term", "left_semi")
    return t.groupBy("term", "doc").agg(F.count("*").alias("tf"))


def term_statistics(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf_nonneg, idf_plain): idf never negative, and the plain one that may be."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n, d = F.col("n_docs"), F.col("df")
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", F.log1p((n - d + 0.5) / (d + 0.5)).alias("idf_nonneg"), F.log((n - d + 0.5) / (d + 0.5)).alias("idf_plain"))


def floored(stats: DataFrame) -> DataFrame:
    """(term, idf): plain idf with negative ones at a quarter of the mean over all terms (one row is broadcast)."""
    mean = stats.agg(F.avg("idf_plain").alias("mean"))
    return stats.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf_plain") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf_plain")).alias("idf"))


def bm25(query_terms: DataFrame, post: DataFrame, dl: DataFrame, idf: DataFrame) -> DataFrame:
    """(query, doc, score): BM25; a term repeated in a query counts each time. Scores are sums of whole billionths, the same in any order."""
    stat = dl.agg((F.sum("dl") / F.count("*")).alias("avgdl"))
    # written, so that its true size decides on the broadcast; without one, common terms would fill single tasks
    q = materialise(query_terms.groupBy("query", "term").agg(F.count("*").alias("times")).join(idf, "term"))
    p = post.join(broadcast_below(q, 64 << 20), "term").join(dl, "doc").crossJoin(F.broadcast(stat))
    one = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("times")
    return p.groupBy("query", "doc").agg(F.sum(F.rint(one * 1e9).cast("long")).alias("score")).withColumn("score", F.bround(F.col("score") / 1e9, 6))


class _Scores:
    """What each term adds to the score of each document of a batch, in whole billionths times 1,024 and 1 more for the match."""

    def __init__(self, docs: pa.Table, terms: pa.Array, avgdl: float) -> None:
        self.n, tokens = docs.num_rows, docs["tokens"].combine_chunks()
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = (code * self.n + np.repeat(np.arange(self.n), size))[code >= 0]
        key, tf = np.unique(key, return_counts=True)
        self.at, self.doc, self.tf = np.searchsorted(key, np.arange(len(terms) + 1) * self.n), key % max(self.n, 1), tf.astype(np.float64)
        self.norm = K1 * (1 - B + B * docs["dl"].to_numpy().astype(np.float64) / avgdl)
        self.made: dict[tuple[int, int], tuple[np.ndarray | None, np.ndarray]] = {}

    def add(self, total: np.ndarray, term: int, times: int, idf: float) -> None:
        if (term, times) not in self.made:
            part = slice(self.at[term], self.at[term + 1])
            doc, tf = self.doc[part], self.tf[part]
            one = np.rint(idf * tf * (K1 + 1) / (tf + self.norm[doc]) * times * 1e9).astype(np.int64) * 1024 + 1
            if 8 * len(doc) > self.n:
                every = np.zeros(self.n, dtype=np.int64)
                every[doc] = one
                doc, one = None, every
            self.made[term, times] = doc, one
        doc, one = self.made[term, times]
        if doc is None:
            total += one
        else:
            total[doc] += one


def bm25_best(query_terms: DataFrame, docs: DataFrame, depth: int, others: bool = False) -> DataFrame:
    """(query, doc, score, rank): the best ``depth`` of ``bm25`` with ``idf_nonneg``; with ``others`` a query's own id is no answer.

    Columns: query_terms (query, term), docs (doc, dl, tokens), a materialised table. No pair of query and document is
    written but the best of each task: a task scores its documents for every distinct set of terms.
    """
    stat = docs.agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl")).first()
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    times = query_terms.groupBy("query", "term").agg(F.count("*").alias("times"))
    sets = materialise(times.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("terms")))
    firsts = sets.groupBy("terms").agg(F.min("query").alias("first"))
    n, d = F.lit(stat["n_docs"]), F.col("df")
    idf = materialise(df.join(query_terms.select("term").distinct(), "term").select("term", F.log1p((n - d + 0.5) / (d + 0.5)).alias("idf")))
    asked = materialise(firsts.select("first", F.inline("terms")).join(idf, "term").groupBy("first").agg(F.collect_list(F.struct("term", "times", "idf")).alias("terms")))
    files, avgdl, most = sorted(asked.inputFiles()), stat["avgdl"], depth + others
    word_files = sorted(idf.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.concat_tables([*row_groups(word_files, 1 << 20)] or [pa.table({"term": pa.array([], pa.string())})], promote_options="default")["term"].combine_chunks()
        number = {t: i for i, t in enumerate(terms.to_pylist())}
        of, kind = {}, pa.int64()
        for g in row_groups(files, 1 << 14):
            kind = g["first"].type
            for first, listed in zip(g["first"].to_pylist(), g["terms"].to_pylist()):
                of[first] = [(number[x["term"]], x["times"], x["idf"]) for x in listed]
        best: dict = {k: ([], []) for k in of}
        low = dict.fromkeys(of, 0)
        ids = None
        for b in pieces(batches, 16384):
            s, ids = _Scores(b, terms, avgdl), b["doc"].combine_chunks()
            total = np.empty(s.n, dtype=np.int64)
            for k, listed in of.items():
                total[:] = 0
                for x in listed:
                    s.add(total, *x)
                hit = np.flatnonzero(total > low[k])
                if len(hit) > most:
                    a = total[hit] >> 10
                    hit = hit[a >= np.partition(a, len(a) - most)[len(a) - most] - 1000]
                if len(hit):
                    best[k] = cut([*best[k][0], *(total[hit] >> 10).tolist()], [*best[k][1], *ids.take(pa.array(hit)).to_pylist()], most)
                    if len(best[k][0]) == most:
                        low[k] = max(0, (best[k][0][-1] - 1000 << 10) - 1)
        if ids is not None:
            yield pa.record_batch({"first": pa.array([k for k, v in best.items() for _ in v[0]], kind), "doc": pa.array([x for v in best.values() for x in v[1]], ids.type), "points": pa.array([x for v in best.values() for x in v[0]], pa.int64())})

    kind = query_terms.schema["query"].dataType.simpleString()
    met = materialise(docs.coalesce(24).mapInArrow(run, f"first {kind}, doc {docs.schema['doc'].dataType.simpleString()}, points bigint"))
    scored = met.withColumn("score", F.bround(F.col("points") / 1e9, 6)).withColumnRenamed("first", "query").select("query", "doc", "score")
    top = ranked(scored, most).drop("rank").withColumnRenamed("query", "first")
    mine = sets.join(firsts, "terms").select("query", "first").join(top, "first").select("query", "doc", "score")
    return ranked(mine.filter("query <> doc") if others else mine, depth)


def only_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` with those of its ``tokens`` that are in ``terms``, each as often as it stands there; a null list gives an empty one.

    ``terms`` (term) are distinct; they are written once and read by the tasks. ``tokens`` is the last column.
    """
    files = sorted(materialise(terms.select("term")).inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.chunked_array([c for g in row_groups(files, 1 << 20) for c in g["term"].chunks], pa.string()).combine_chunks()
        for b in batches:
            tokens = b["tokens"]
            flat = tokens.flatten()
            keep = pc.is_in(flat, value_set=known)
            upto = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))])
            lists = pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), flat.filter(keep))
            yield pa.record_batch([*(b[n] for n in b.schema.names[:-1]), lists], b.schema.names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of ``most`` rows and a last one."""
    held, n = [], 0
    for b in batches:
        while len(b):
            part = b.slice(0, most - n)
            held, n, b = [*held, part], n + len(part), b.slice(len(part))
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def cut(points: list[int], docs: list, most: int) -> tuple[list[int], list]:
    """The ``most`` best by points rounded half-even to thousands, then id."""
    half = [p // 1000 + (p % 1000 > 500 or p % 1000 == 500 and p // 1000 % 2) for p in points]
    order = sorted(range(len(points)), key=lambda i: (-half[i], docs[i]))[:most]
    return [points[i] for i in order], [docs[i] for i in order]


def ranked(scores: DataFrame, depth: int) -> DataFrame:
    """The best ``depth`` per query with ``rank``; ties by document id."""
    w = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double, half-even to 4 places."""
    return F.bround(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), 4)


def dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, score) of every query vector against every vector; the queries are the stated, bounded side."""
    q = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return vectors.crossJoin(broadcast_below(q, 256 << 20)).filter(F.col("vec_id") != F.col("query")).select("query", F.col("vec_id").alias("doc"), cosine(F.col("q"), F.col("embedding")).alias("score"))


def fuse(*arms: DataFrame, k: int = RRF_K, depth: int = TOP) -> DataFrame:
    """Reciprocal rank fusion of rankings (query, doc, rank); a document missing from an arm adds nothing for it."""
    both = arms[0].select("query", "doc", "rank")
    for a in arms[1:]:
        both = both.unionByName(a.select("query", "doc", "rank"))
    s = both.groupBy("query", "doc").agg(F.sum((F.lit(1) / (k + F.col("rank"))).cast("decimal(28,12)")).cast("double").alias("score"))
    return ranked(s, depth)


def gold_slots(items: DataFrame) -> DataFrame:
    """(query, slot_index, unit): one slot per expected unit."""
    return items.select(F.col("item_id").alias("query"), F.posexplode("expected_units").alias("slot_index", "unit"))


def slot_hits(ranking: DataFrame, slots: DataFrame) -> DataFrame:
    """(query, slot_index, satisfied, first_rank, first_chunk): each slot against the units of the ranked chunks."""
    r = ranking.filter(F.col("rank") <= TOP).select("query", "rank", F.col("doc").alias("chunk"), T.unit_of(F.col("doc")).alias("unit"))
    j = slots.join(r, ["query", "unit"], "left")
    return j.groupBy("query", "slot_index").agg(F.min("rank").alias("first_rank"), F.min_by("chunk", "rank").alias("first_chunk")).withColumn("satisfied", F.col("first_rank").isNotNull())


def query_metrics(ranking: DataFrame, slots: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, precision_at_10, recall_at_10, mrr, ndcg_at_10) of every query; null where it has no gold."""
    hits = slot_hits(ranking, slots).groupBy("query").agg(
        F.avg(F.col("satisfied").cast("double")).alias("recall"), F.coalesce(F.lit(1.0) / F.min("first_rank"), F.lit(0.0)).alias("mrr"),
        F.count("*").alias("n"), F.coalesce(F.sum((F.lit(1.0) / F.log2(F.col("first_rank") + 1)).cast("decimal(28,12)")), F.lit(0)).cast("double").alias("dcg"),
    )
    units = slots.select("query", "unit").distinct()
    match = ranking.filter(F.col("rank") <= TOP).select("query", T.unit_of(F.col("doc")).alias("unit"), "doc").join(units, ["query", "unit"], "left_semi").groupBy("query").agg((F.count("*") / 10).alias("p"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1)))
    return queries.join(hits, "query", "left").join(match, "query", "left").select(
        "query", F.when(F.col("n") > 0, F.bround(F.coalesce("p", F.lit(0.0)), 6)).alias("precision_at_10"), F.bround("recall", 6).alias("recall_at_10"),
        F.bround("mrr", 6).alias("mrr"), F.bround(F.col("dcg") / ideal, 6).alias("ndcg_at_10"),
    )


def macro(metrics: DataFrame, stratum: str) -> DataFrame:
    """Means over queries with gold by stratum and overall (null stratum), never pooled."""
    names = ["precision_at_10", "recall_at_10", "mrr", "ndcg_at_10"]
    g = metrics.filter(F.col("recall_at_10").isNotNull()).groupingSets([[F.col(stratum)], []], F.col(stratum))
    return g.agg(F.count("*").alias("n"), *[F.bround(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 5).alias(c) for c in names])
