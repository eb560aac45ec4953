"""Retrieval queries: BM25, dense, fusion, metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import retrieval as R
from sextant.plans.common import C, DOC_TOKENS, ITEMS, TOKENS, chunks, items
from sextant.runtime import broadcast_below, latest, latest_lean, materialise
from sextant.sources.tables import table


def _docs(spark, d):
    return chunks(spark, d, "text")


def _n(docs):
    return docs.agg(F.count("*").alias("n_docs"))


def _query_terms(spark, d):
    return items(spark, d).select(F.col("item_id").alias("query"), F.explode(T.primary_tokens(F.col("query"))).alias("term"))


def bm25_term_stats(spark, d):
    docs = _docs(spark, d)
    s = R.term_statistics(R.postings(docs, "chunk_id", "text"), _n(docs))
    return s.select("term", "df", F.bround("idf_nonneg", 6).alias("idf_nonneg"), F.bround("idf_plain", 6).alias("idf_plain"))


def bm25_idf_floored(spark, d):
    docs = _docs(spark, d)
    s = R.term_statistics(R.postings(docs, "chunk_id", "text"), _n(docs)).withColumn("idf_plain", F.bround("idf_plain", 9))
    mean = s.withColumn("idf_plain", F.col("idf_plain").cast("decimal(20,9)")).agg(F.avg("idf_plain").cast("double").alias("mean"))
    x = s.crossJoin(F.broadcast(mean))
    return x.select("term", F.bround(F.when(F.col("idf_plain") < 0, R.EPSILON * F.col("mean")).otherwise(F.col("idf_plain")), 5).alias("idf"))


def _lexical(spark, d, idf="idf_nonneg"):
    docs = _docs(spark, d)
    q = _query_terms(spark, d)
    post = materialise(R.postings(docs, "chunk_id", "text", only=q))
    return R.bm25(q, post, R.lengths(docs, "chunk_id", "text"), R.term_statistics(post, _n(docs)).select("term", F.col(idf).alias("idf")))


def bm25_top10(spark, d):
    return R.ranked(_lexical(spark, d), R.TOP).select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("chunk_id"), "score")


def _vectors(spark, d):
    return latest(table(spark, d, "embeddings"), "vec_id", ["label", "embedding"])


def dense_top10(spark, d):
    v = _vectors(spark, d)
    return R.ranked(R.dense(v, v.filter("vec_id % 100 = 0")), R.TOP).select("query", "rank", "doc", "score")


def dense_best_of_label(spark, d):
    """Best vector per label for each query; ties by id (the first of equals)."""
    v = _vectors(spark, d)
    s = R.dense(v, v.filter("vec_id % 100 = 0")).join(v.select(F.col("vec_id").alias("doc"), "label"), "doc")
    return s.groupBy("query", "label").agg(F.min_by("doc", F.struct(-F.col("score"), "doc")).alias("doc"), F.max("score").alias("score"))


def dense_norms(spark, d):
    v = _vectors(spark, d)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.agg(F.count("*").alias("n"), F.sum((F.abs(norm - 1) > 1e-3).cast("long")).alias("off_unit"), F.max(F.size("embedding")).alias("dims"))


def _both(spark, d):
    """The queries' scores under both idf variants, over postings that are made once."""
    docs, q = _docs(spark, d), _query_terms(spark, d)
    post = materialise(R.postings(docs, "chunk_id", "text", only=q))
    dl, stats = R.lengths(docs, "chunk_id", "text"), materialise(R.term_statistics(post, _n(docs)))
    return [R.bm25(q, post, dl, stats.select("term", F.col(i).alias("idf"))) for i in ("idf_nonneg", "idf_plain")]


def rrf_top10(spark, d):
    """Two lexical arms of one set of postings, fused."""
    return R.fuse(*[R.ranked(s, R.DEPTH) for s in _both(spark, d)]).select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("chunk_id"), F.bround("score", 9).alias("score"))


def _indexed(docs, key, *more):
    """(doc, dl, tokens) and ``more``: a document's length and its tokens as indexed."""
    return docs.select(F.col(key).alias("doc"), F.coalesce(F.size(T.primary_tokens(F.col("text"))), F.lit(0)).alias("dl"), T.document_tokens(F.col("text")).alias("tokens"), *more)


def hybrid_top10(spark, d):
    """Texts and vectors together: documents whose id is divisible by 100 ask with their title and their vector for all others.

    The lexical arm ranks the documents by BM25, the dense arm the vectors of the same ids; ranks are fused, and what one
    arm lacks adds nothing for it.
    """
    v = _vectors(spark, d)
    whole = latest_lean(table(spark, d, "documents").select("doc_id", "title", "text", "collected_at"), "doc_id", ["collected_at", "text"])
    q = materialise(whole.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.explode(T.primary_tokens(F.col("title"))).alias("term")))
    # no text is shuffled, and of a document's tokens only those that are asked for are written
    docs = materialise(R.only_terms(_indexed(whole, "doc_id"), q.select("term").distinct()))
    lexical = R.bm25_best(q, docs, R.DEPTH, others=True)
    dense = R.dense(v, v.filter("vec_id % 100 = 0"))
    return R.fuse(lexical, R.ranked(dense, R.DEPTH)).select("query", "rank", "doc", F.bround("score", 9).alias("score"))


def _ranking(spark, d):
    return materialise(R.ranked(_lexical(spark, d), R.TOP))


def _items(spark, d):
    return items(spark, d)


def gold_slot_hits(spark, d):
    h = R.slot_hits(_ranking(spark, d), R.gold_slots(_items(spark, d)))
    return h.select(F.col("query").alias("item_id"), "slot_index", "satisfied", F.col("first_rank").cast("double").alias("first_rank"), "first_chunk")


def gold_metrics(spark, d):
    i = _items(spark, d)
    return R.query_metrics(_ranking(spark, d), R.gold_slots(i), i.select(F.col("item_id").alias("query"))).withColumnRenamed("query", "item_id")


def gold_by_stratum(spark, d):
    i = _items(spark, d)
    m = R.query_metrics(_ranking(spark, d), R.gold_slots(i), i.select(F.col("item_id").alias("query")))
    return R.macro(m.join(i.select(F.col("item_id").alias("query"), "type"), "query"), "type")


def gold_carriers(spark, d):
    """Distinct gold units per query, and the upper median, least and most over queries of a type."""
    s = R.gold_slots(_items(spark, d)).groupBy("query").agg(F.countDistinct("unit").alias("n"))
    j = _items(spark, d).select(F.col("item_id").alias("query"), "type").join(s, "query")
    # counted per type and value first: the running sums span distinct values, not queries
    k = j.groupBy("type", "n").agg(F.count("*").alias("k"))
    w = W.partitionBy("type")
    r = k.withColumn("upto", F.sum("k").over(w.orderBy("n"))).withColumn("all", F.sum("k").over(w))
    return r.groupBy("type").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("upper_median"))


def gold_slot_overlaps(spark, d):
    """Slots of one query that name the same unit: none if slots are disjoint."""
    a = R.gold_slots(_items(spark, d))
    b = a.select("query", F.col("slot_index").alias("j"), "unit")
    return a.join(b, ["query", "unit"]).filter("slot_index < j").groupBy(F.col("query").alias("item_id"), F.col("slot_index").alias("i"), "j").agg(F.array_join(F.array_sort(F.collect_set("unit")), " ").alias("shared"))


def known_item_rank1(spark, d):
    """Chunks whose id hashes to the stated query set ask for themselves; what stands first is themselves, a twin or another."""
    docs = materialise(_indexed(_docs(spark, d), "chunk_id", "text"))
    asked = docs.filter("text IS NOT NULL").filter(F.pmod(F.conv(F.substring(F.md5("doc"), 1, 6), 16, 10).cast("long"), F.lit(100)) == 0)
    q = asked.select(F.col("doc").alias("query"), F.explode(T.primary_tokens(F.col("text"))).alias("term"))
    top = materialise(R.bm25_best(q, docs.select("doc", "dl", "tokens"), 1).select("query", "doc"))
    own = docs.select(F.col("doc").alias("query"), T.norm_comparison(F.col("text")).alias("a"))
    other = docs.select("doc", T.norm_comparison(F.col("text")).alias("b"))
    kind = F.when(F.col("query") == F.col("doc"), "self").when(F.col("a") == F.col("b"), "twin").otherwise("other")
    mine = materialise(own.join(broadcast_below(top, 64 << 20), "query"))
    return other.join(broadcast_below(mine, 64 << 20), "doc").select(F.col("query").alias("chunk_id"), F.col("doc").alias("first"), kind.alias("kind"))


_BASE = f"""WITH {C}, n AS (SELECT count(*) n FROM c),
dl AS (SELECT chunk_id doc, coalesce(len({TOKENS.format('text')}), 0) dl FROM c), av AS (SELECT sum(dl) / count(*) av FROM dl),
p AS (SELECT doc, term, count(*) tf FROM (SELECT chunk_id doc, unnest({DOC_TOKENS.format('text')}) term FROM c WHERE text IS NOT NULL) GROUP BY ALL),
st AS (SELECT term, count(*) df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) idf_nonneg, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) idf_plain FROM p, n GROUP BY term),
{ITEMS}"""
_Q = f"SELECT item_id query, unnest({TOKENS.format('query')}) term FROM i"


def _scores(q: str, idf: str) -> str:
    return f"""SELECT query, doc, round_even(CAST(sum(CAST(round_even(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / av)) * times * 1e9, 0) AS BIGINT)) AS DOUBLE) / 1e9, 6) score
  FROM (SELECT query, term, count(*) times, any_value({idf}) idf FROM ({q}) JOIN st USING (term) GROUP BY query, term) JOIN p USING (term) JOIN dl USING (doc), av GROUP BY query, doc"""


def _top(scores: str, k: int) -> str:
    return f"SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) rank FROM ({scores}) QUALIFY rank <= {k}"


_R = f"{_BASE}, r AS ({_top(_scores(_Q, 'idf_nonneg'), 10)}), sl AS (SELECT query, CAST(k - 1 AS INT) slot_index, expected_units[k] unit FROM (SELECT item_id query, expected_units, unnest(range(1, len(expected_units) + 1)) k FROM i)), ru AS (SELECT query, rank, doc, split_part(doc, '#', 1) unit FROM r), h AS (SELECT query, slot_index, min(rank) first_rank, arg_min(doc, rank) first_chunk FROM sl LEFT JOIN ru USING (query, unit) GROUP BY ALL)"
_M = _R + """, g AS (SELECT query, avg(CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END) recall, coalesce(1.0 / min(first_rank), 0) mrr, count(*) n, CAST(coalesce(sum(CAST(1.0 / log2(first_rank + 1) AS DECIMAL(28,12))), 0) AS DOUBLE) dcg FROM h GROUP BY query),
mt AS (SELECT query, count(*) / 10 p FROM ru WHERE (query, unit) IN (SELECT query, unit FROM sl) GROUP BY query),
m AS (SELECT i.item_id, i.type, CASE WHEN n > 0 THEN round_even(coalesce(p, 0), 6) END precision_at_10, round_even(recall, 6) recall_at_10, round_even(mrr, 6) mrr,
  round_even(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1.0 / log2(k + 1))), 6) ndcg_at_10 FROM i LEFT JOIN g ON g.query = i.item_id LEFT JOIN mt ON mt.query = i.item_id)"""
_V = "WITH v AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label DESC NULLS LAST) = 1), s AS (SELECT q.vec_id query, v.vec_id doc, v.label, round_even(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), lambda a, b: a + b), 4) score FROM v, v q WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"

_D = _BASE.replace(f"WITH {C}", "WITH c AS (SELECT doc_id chunk_id, title, text FROM documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC NULLS LAST, text DESC NULLS LAST) = 1)")
_HYBRID = f"""{_D}, la AS ({_top('SELECT * FROM (' + _scores(f"SELECT chunk_id query, unnest({TOKENS.format('title')}) term FROM c WHERE chunk_id % 100 = 0", 'idf_nonneg') + ') WHERE query <> doc', 100)}),
v AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label DESC NULLS LAST) = 1), da AS ({_top('SELECT q.vec_id query, v.vec_id doc, round_even(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), lambda a, b: a + b), 4) score FROM v, v q WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id', 100)}),
u AS (SELECT query, doc, rank FROM la UNION ALL SELECT query, doc, rank FROM da), f AS (SELECT query, doc, CAST(sum(CAST(1 / (60 + rank) AS DECIMAL(28,12))) AS DOUBLE) score FROM u GROUP BY query, doc)"""
QUERIES = {f.__name__: f for f in (bm25_term_stats, bm25_idf_floored, bm25_top10, dense_top10, dense_best_of_label, dense_norms, rrf_top10, hybrid_top10, gold_slot_hits, gold_metrics, gold_by_stratum, gold_carriers, gold_slot_overlaps, known_item_rank1)}
SQL = {
    "bm25_term_stats": f"{_BASE} SELECT term, df, round_even(idf_nonneg, 6) AS idf_nonneg, round_even(idf_plain, 6) AS idf_plain FROM st",
    "bm25_idf_floored": f"{_BASE}, s AS (SELECT term, round_even(idf_plain, 9) x FROM st), m AS (SELECT CAST(sum(CAST(x AS DECIMAL(28,9))) AS DOUBLE) / count(*) m FROM s) SELECT term, round_even(CASE WHEN x < 0 THEN 0.25 * m ELSE x END, 5) AS idf FROM s, m",
    "bm25_top10": f"{_BASE} SELECT query AS item_id, CAST(rank AS INT) AS rank, doc AS chunk_id, score FROM ({_top(_scores(_Q, 'idf_nonneg'), 10)})",
    "dense_top10": f"{_V} SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank, doc, score FROM s QUALIFY rank <= 10",
    "dense_best_of_label": f"{_V} SELECT query, label, doc, score FROM s QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY score DESC, doc) = 1",
    "dense_norms": "WITH v AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label DESC NULLS LAST) = 1) SELECT count(*) AS n, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-3) AS off_unit, CAST(max(len(embedding)) AS INT) AS dims FROM v",
    "rrf_top10": f"{_BASE}, u AS (SELECT query, doc, rank FROM ({_top(_scores(_Q, 'idf_nonneg'), 100)}) UNION ALL SELECT query, doc, rank FROM ({_top(_scores(_Q, 'idf_plain'), 100)})), f AS (SELECT query, doc, CAST(sum(CAST(1 / (60 + rank) AS DECIMAL(28,12))) AS DOUBLE) score FROM u GROUP BY query, doc) SELECT query AS item_id, CAST(rank AS INT) AS rank, doc AS chunk_id, round_even(score, 9) AS score FROM ({_top('SELECT * FROM f', 10)})",
    "hybrid_top10": f"{_HYBRID} SELECT query, CAST(rank AS INT) AS rank, doc, round_even(score, 9) AS score FROM ({_top('SELECT * FROM f', 10)})",
    "gold_slot_hits": f"{_R} SELECT query AS item_id, slot_index, first_rank IS NOT NULL AS satisfied, CAST(first_rank AS DOUBLE) AS first_rank, first_chunk FROM h",
    "gold_metrics": f"{_M} SELECT item_id, precision_at_10, recall_at_10, mrr, ndcg_at_10 FROM m",
    "gold_by_stratum": f"{_M} SELECT type, count(*) AS n, " + ", ".join(f"round_even(CAST(sum(CAST({c} AS DECIMAL(18,6))) AS DOUBLE) / count(*), 5) AS {c}" for c in ("precision_at_10", "recall_at_10", "mrr", "ndcg_at_10")) + " FROM m WHERE recall_at_10 IS NOT NULL GROUP BY GROUPING SETS ((type), ())",
    "gold_carriers": "WITH s AS (SELECT item_id, any_value(type) type, count(DISTINCT u) n FROM (SELECT item_id, type, unnest(expected_units) u FROM eval_queries) GROUP BY item_id) SELECT type, min(n) AS least, max(n) AS most, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM s GROUP BY type",
    "gold_slot_overlaps": "WITH s AS (SELECT item_id, unnest(range(len(expected_units))) i, expected_units e FROM eval_queries) SELECT a.item_id, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, array_to_string(list_sort(list(DISTINCT a.e[a.i + 1])), ' ') AS shared FROM s a JOIN s b ON a.item_id = b.item_id AND a.i < b.i AND a.e[a.i + 1] = b.e[b.i + 1] GROUP BY ALL",
    "known_item_rank1": f"{_BASE}, q AS (SELECT chunk_id query, unnest({TOKENS.format('text')}) term FROM c WHERE text IS NOT NULL AND CAST('0x' || left(md5(chunk_id), 6) AS BIGINT) % 100 = 0) SELECT query AS chunk_id, doc AS first, CASE WHEN query = doc THEN 'self' WHEN (SELECT text FROM c WHERE chunk_id = query) = (SELECT text FROM c WHERE chunk_id = doc) THEN 'twin' ELSE 'other' END AS kind FROM ({_top(_scores('SELECT * FROM q', 'idf_nonneg'), 1)})",
}
