"""Sampling, ingest, assembly and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import ingest as I
from sextant.operators import sampling as S
from sextant.operators.grounding import newest_answers, newest_requests
from sextant.plans.common import C, NORM, TOKENS, chunks, items, units
from sextant.runtime import latest
from sextant.sources.tables import table


def _strata(spark, d):
    return units(spark, d).groupBy(F.col("unit_type").alias("stratum")).agg(F.count("*").alias("n"))


def spaced_picks(spark, d):
    return S.spaced_picks(_strata(spark, d), 7, 1)


def largest_remainder(spark, d):
    return S.largest_remainder(_strata(spark, d), 50)


def select_walk(spark, d):
    """First five units per type in id order, one per document."""
    return S.select_walk(units(spark, d), F.col("doc"), 5, "unit_type", "unit_id")


def draw_order(spark, d):
    return S.draw_orders(_strata(spark, d), 10)


def packed_blocks(spark, d):
    """Chunks of a unit packed greedily up to 400 tokens, in order."""
    c = chunks(spark, d, "parent_id", "seq", "text")
    n = F.coalesce(F.size(T.primary_tokens(F.col("text"))), F.lit(0))
    a = c.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(0)).alias("s"), "chunk_id", n.cast("long").alias("n")))).alias("b"))
    z = a.select("parent_id", F.arrays_zip(F.col("b.chunk_id").alias("chunk_id"), S.pack_blocks(F.col("b.n"), 400).alias("bin")).alias("z"))
    return z.select("parent_id", F.explode("z").alias("z")).select("parent_id", "z.chunk_id", "z.bin")


def block_offsets(spark, d):
    return I.block_offsets(chunks(spark, d, "parent_id", "seq", "text"))


def _lines(spark, d):
    return latest(table(spark, d, "lines").select("line_id", "doc_id", "page", "text", "char_start", "char_end", "extracted_at"), "line_id", ["extracted_at", "text"])


def line_classes(spark, d):
    return _lines(spark, d).groupBy(I.line_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


def carried_headings(spark, d):
    h = I.carried_headings(_lines(spark, d))
    return h.filter("heading IS NOT NULL").groupBy("heading").agg(F.count("*").alias("n_lines"))


def partition_proof(spark, d):
    """Characters of each document's lines by class, and whether offsets agree with text lengths."""
    x = _lines(spark, d)
    return x.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.sum((F.col("char_end") - F.col("char_start")).cast("long")).alias("span"), F.sum((F.col("char_end") - F.col("char_start") != F.length("text")).cast("long")).alias("off"))


def _hyphens(spark, d):
    return latest(table(spark, d, "hyphen_decisions"), "decision_id", ["tier", "outcome", "joined_evidence", "hyphen_evidence"])


def hyphen_resolution(spark, d):
    w = table(spark, d, "wordlist").select(F.lower("word").alias("w")).distinct()
    h = _hyphens(spark, d)
    for name, col in (("jw", F.lower("joined")), ("lw", F.lower("left_part")), ("rw", F.lower("right_part"))):
        h = h.join(w.select(F.col("w").alias(f"_{name}")), col == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return h.select("decision_id", I.resolve_hyphen(F.col("hyphen_evidence"), F.col("joined_evidence"), F.col("jw"), F.col("lw") & F.col("rw")).alias("outcome"))


def hyphen_summary(spark, d):
    """Decisions by tier and outcome with subtotals; rows whose outcome differs from the ladder's."""
    h = _hyphens(spark, d).select("decision_id", "tier", F.col("outcome").alias("old"))
    j = h.join(hyphen_resolution(spark, d), "decision_id")
    return j.rollup("tier", "outcome").agg(F.count("*").alias("n"), F.sum((~F.col("old").eqNullSafe(F.col("outcome"))).cast("long")).alias("changed"))


def _relations(spark, d):
    return latest(table(spark, d, "relations"), "relation_id", ["recorded_at", "unit_id"])


def citation_classes(spark, d):
    """Printed citations of relations by recorded class and by what their sentence says."""
    r = _relations(spark, d)
    x = r.select(F.explode("prose_xrefs_dropped").alias("x")).select("x.surface", "x.sentence", "x.classification").filter("surface IS NOT NULL AND sentence IS NOT NULL")
    return x.groupBy("classification", I.citation_class(F.col("sentence"), F.col("surface")).alias("read_as")).agg(F.count("*").alias("n"))


def citation_numbers(spark, d):
    r = _relations(spark, d)
    x = r.select(F.explode("prose_xrefs_dropped.surface").alias("s")).filter("s RLIKE '^(Article|Annex|Recital)'")
    return x.select(F.explode(I.enumerated(F.col("s"))).alias("number")).groupBy("number").agg(F.count("*").alias("n")).withColumn("roman", I.roman(F.col("number")))


def request_digests(spark, d):
    """Digest of each request's canonical body; null system text is left out of it."""
    r = newest_requests(table(spark, d, "requests"))
    body = F.to_json(F.struct("custom_id", F.col("user_text").alias("messages"), F.col("system_text").alias("system")))
    return r.select("custom_id", F.sha2(body, 256).alias("digest"), F.length(body).alias("n_chars"))


def request_audit(spark, d):
    """Requests and answers side by side: matched, without answer, without request, delivered twice."""
    r = table(spark, d, "requests").groupBy("custom_id").agg(F.count("*").alias("nr"))
    a = table(spark, d, "answers").groupBy("custom_id").agg(F.count("*").alias("na"))
    j = r.join(a, "custom_id", "full")
    one = lambda c: F.sum(c.cast("long"))
    return j.agg(one(F.col("nr").isNotNull() & F.col("na").isNotNull()).alias("matched"), one(F.col("na").isNull()).alias("no_answer"), one(F.col("nr").isNull()).alias("no_request"), one(F.coalesce(F.col("nr") > 1, F.lit(False)) | F.coalesce(F.col("na") > 1, F.lit(False))).alias("twice"))


def stop_reasons(spark, d):
    a = newest_answers(table(spark, d, "answers"))
    return a.groupBy(F.col("response.message.stop_reason").alias("stop_reason")).agg(F.count("*").alias("n"))


def query_overlap(spark, d):
    """Distinct tokens of each item's query and passage: shared, in the query only, containment, Jaccard."""
    i = items(spark, d)
    q, p = F.array_distinct(T.primary_tokens(F.col("query"))), F.array_distinct(T.primary_tokens(F.col("passage")))
    x = i.select("item_id", q.alias("q"), p.alias("p")).withColumn("s", F.size(F.array_intersect("q", "p")))
    return x.select("item_id", F.size("q").alias("n_query"), F.size("p").alias("n_passage"), F.col("s").alias("shared"), (F.size("q") - F.col("s")).alias("query_only"), F.bround(F.try_divide(F.col("s").cast("double"), F.size("q").cast("double")), 4).alias("containment"), F.bround(F.try_divide(F.col("s").cast("double"), F.size(F.array_union("q", "p")).cast("double")), 4).alias("jaccard"))


def quoted_terms(spark, d):
    """Terms in quotation marks: in how many chunks each stands, with and without the marks."""
    c = chunks(spark, d, "text").filter("text IS NOT NULL")
    t = c.select(F.explode(F.regexp_extract_all("text", F.lit(r"[“«]([^”»]{3,60})[”»]"), 1)).alias("term")).select(F.lower("term").alias("term")).distinct()
    return t.select("term", F.size(F.split("term", " ")).alias("n_words"))


def lineitem_rollup(spark, d):
    """Counts and exact sums by flag and status with subtotals."""
    x = table(spark, d, "lineitem")
    return x.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("string").alias("quantity"))


_L = "l AS (SELECT * FROM lines WHERE line_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY extracted_at DESC NULLS LAST, text DESC NULLS LAST) = 1)"
_CLASS = r"CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), '^(?i)(page\s+)?[-\[(]?\s*(\d{1,4}|[ivxlc]{1,6})(\s+of\s+\d+)?\s*[-\])]?$') THEN 'page_footer' WHEN regexp_matches(trim(text), '\.{4,}\s*\d+$') THEN 'table_of_contents' WHEN regexp_matches(trim(text), '\S\s{2,}\d+(\s{2,}\d+)*$') THEN 'table_row' WHEN regexp_matches(trim(text), '^[A-Z][^.;:,!?]*$') AND len(regexp_split_to_array(trim(text), '\s+')) <= 6 THEN 'heading' ELSE 'content' END"
_H = "h AS (SELECT decision_id, tier, outcome old, CASE WHEN coalesce(joined_evidence, 0) > coalesce(hyphen_evidence, 0) THEN 'delete' WHEN coalesce(hyphen_evidence, 0) > coalesce(joined_evidence, 0) THEN 'keep' WHEN coalesce(lower(joined) IN (SELECT lower(word) FROM wordlist), false) AND NOT (coalesce(lower(left_part) IN (SELECT lower(word) FROM wordlist), false) AND coalesce(lower(right_part) IN (SELECT lower(word) FROM wordlist), false)) THEN 'delete' ELSE 'keep' END outcome FROM hyphen_decisions WHERE decision_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY tier DESC NULLS LAST, outcome DESC NULLS LAST, joined_evidence DESC NULLS LAST, hyphen_evidence DESC NULLS LAST) = 1)"
_U = "u AS (SELECT * FROM units WHERE unit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY added_at DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1), s AS (SELECT unit_type stratum, count(*) n FROM u GROUP BY 1)"
_R = "r AS (SELECT * FROM relations WHERE relation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY recorded_at DESC NULLS LAST, unit_id DESC NULLS LAST) = 1)"

QUERIES = {f.__name__: f for f in (spaced_picks, largest_remainder, select_walk, draw_order, packed_blocks, block_offsets, line_classes, carried_headings, partition_proof, hyphen_resolution, hyphen_summary, citation_classes, citation_numbers, request_digests, request_audit, stop_reasons, query_overlap, quoted_terms, lineitem_rollup)}
SQL = {
    "spaced_picks": f"WITH {_U} SELECT stratum, CAST((1 + floor(i * n / least(n, 7))) % n AS BIGINT) AS pick FROM s, (SELECT unnest(range(7)) i) WHERE i < least(n, 7)",
    "largest_remainder": f"WITH {_U}, q AS (SELECT stratum, n, floor(n * 50 / t) low, round_even(n * 50 / t - floor(n * 50 / t), 9) part FROM s, (SELECT sum(n) t FROM s)) SELECT stratum, n, CAST(low + CASE WHEN row_number() OVER (ORDER BY part DESC, stratum) <= (SELECT 50 - sum(low) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS allocation FROM q",
    "select_walk": f"WITH {_U}, f AS (SELECT unit_type, min(unit_id) unit_id FROM u WHERE doc IS NOT NULL GROUP BY unit_type, doc UNION ALL SELECT unit_type, unit_id FROM u WHERE doc IS NULL) SELECT unit_type, unit_id, CAST(row_number() OVER (PARTITION BY unit_type ORDER BY unit_id) AS INT) AS place FROM f QUALIFY place <= 5",
    "draw_order": f"WITH RECURSIVE {_U}, w(stratum, n, picks) AS (SELECT stratum, n, list_transform(range(10), lambda i: i * n // 10 % n) FROM s WHERE n > 10 UNION ALL SELECT stratum, n, list_append(picks, list_reduce(list_transform(list_filter(range(n), lambda i: NOT list_contains(picks, i)), lambda i: {{'d': list_min(list_transform(picks, lambda p: least((i - p + n) % n, (p - i + n) % n))), 'i': i}}), lambda x, y: CASE WHEN y.d > x.d THEN y ELSE x END).i) FROM w WHERE len(picks) < n), z AS (SELECT stratum, picks FROM w WHERE len(picks) = n UNION ALL SELECT stratum, range(n) FROM s WHERE n <= 10) SELECT stratum, unnest(range(1, len(picks) + 1)) AS draw_rank, unnest(picks) AS place FROM z",
    "packed_blocks": f"WITH RECURSIVE {C}, o AS (SELECT parent_id, chunk_id, coalesce(len({TOKENS.format('text')}), 0) n, row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(seq, 0), chunk_id) k FROM c), w AS (SELECT parent_id, chunk_id, k, n used, CAST(0 AS BIGINT) bin FROM o WHERE k = 1 UNION ALL SELECT o.parent_id, o.chunk_id, o.k, CASE WHEN w.used > 0 AND w.used + o.n > 400 THEN o.n ELSE w.used + o.n END, w.bin + CASE WHEN w.used > 0 AND w.used + o.n > 400 THEN 1 ELSE 0 END FROM w JOIN o ON o.parent_id = w.parent_id AND o.k = w.k + 1) SELECT parent_id, chunk_id, bin FROM w",
    "block_offsets": f"WITH {C}, o AS (SELECT chunk_id, coalesce(length(text), 0) n, sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY parent_id ORDER BY coalesce(seq, 0), chunk_id ROWS UNBOUNDED PRECEDING) - 1 e FROM c) SELECT chunk_id, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM o",
    "line_classes": f"WITH {_L} SELECT {_CLASS} AS class, count(*) AS n FROM l GROUP BY 1",
    "carried_headings": f"WITH {_L}, h AS (SELECT last_value(CASE WHEN {_CLASS} = 'heading' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) heading FROM l) SELECT heading, count(*) AS n_lines FROM h WHERE heading IS NOT NULL GROUP BY heading",
    "partition_proof": f"WITH {_L} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(char_end - char_start) AS BIGINT) AS span, count(*) FILTER (char_end - char_start <> length(text)) AS off FROM l GROUP BY doc_id",
    "hyphen_resolution": f"WITH {_H} SELECT decision_id, outcome FROM h",
    "hyphen_summary": f"WITH {_H} SELECT tier, outcome, count(*) AS n, count(*) FILTER (old IS DISTINCT FROM outcome) AS changed FROM h GROUP BY ROLLUP (tier, outcome)",
    "citation_classes": rf"WITH {_R}, x AS (SELECT x.surface surface, x.sentence sentence, x.classification classification FROM (SELECT unnest(prose_xrefs_dropped) x FROM r)) SELECT classification, CASE WHEN regexp_matches(list_last(string_split(sentence, surface)), '^(\s*\([^)]*\))*\s+of\s+(the\s+)?{I.INSTRUMENTS}') THEN 'external' WHEN regexp_matches(sentence, '(?i)\bis (amended|replaced) as follows') THEN 'amending' ELSE 'internal' END AS read_as, count(*) AS n FROM x WHERE surface IS NOT NULL AND sentence IS NOT NULL GROUP BY ALL",
    "citation_numbers": rf"WITH {_R}, x AS (SELECT x.surface s FROM (SELECT unnest(prose_xrefs_dropped) x FROM r)), n AS (SELECT CAST(unnest(regexp_extract_all(regexp_replace(s, '\([^)]*\)', '', 'g'), '\d+')) AS INT) number FROM x WHERE regexp_matches(s, '^(Article|Annex|Recital)')), t AS (SELECT number, count(*) n FROM n GROUP BY 1) SELECT number, n, repeat('C', CAST(number // 100 AS INT)) || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[number % 100 // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[number % 10 + 1] AS roman FROM t",
    "request_audit": "WITH r AS (SELECT custom_id, count(*) nr FROM requests GROUP BY 1), a AS (SELECT custom_id, count(*) na FROM answers GROUP BY 1), j AS (SELECT nr, na FROM r FULL JOIN a USING (custom_id)) SELECT count(*) FILTER (nr IS NOT NULL AND na IS NOT NULL) AS matched, count(*) FILTER (na IS NULL) AS no_answer, count(*) FILTER (nr IS NULL) AS no_request, count(*) FILTER (coalesce(nr, 0) > 1 OR coalesce(na, 0) > 1) AS twice FROM j",
    "stop_reasons": "SELECT response.message.stop_reason AS stop_reason, count(*) AS n FROM (SELECT * FROM answers WHERE custom_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY collected_at DESC NULLS LAST, body_sha256 DESC NULLS LAST) = 1) GROUP BY 1",
    "query_overlap": f"WITH x AS (SELECT item_id, list_distinct({TOKENS.format('query')}) q, list_distinct({TOKENS.format('passage')}) p FROM eval_queries WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY id DESC NULLS LAST, query DESC NULLS LAST) = 1), y AS (SELECT *, len(list_intersect(q, p)) s FROM x) SELECT item_id, CAST(len(q) AS INT) AS n_query, CAST(len(p) AS INT) AS n_passage, CAST(s AS INT) AS shared, CAST(len(q) - s AS INT) AS query_only, round_even(s / nullif(len(q), 0), 4) AS containment, round_even(s / nullif(len(q) + len(p) - s, 0), 4) AS jaccard FROM y",
    "quoted_terms": f"WITH {C} SELECT DISTINCT lower(t) AS term, CAST(len(string_split(lower(t), ' ')) AS INT) AS n_words FROM (SELECT unnest(regexp_extract_all(text, '[“«]([^”»]{{3,60}})[”»]', 1)) t FROM c)",
    "lineitem_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS VARCHAR) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
