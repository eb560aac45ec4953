"""Completeness, grounding, reports and control queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.functions import text as T
from sextant.operators import grounding as G
from sextant.plans.common import NORM, TOKENS, items
from sextant.runtime import materialise
from sextant.sources.tables import table


def _requests(spark, d):
    return G.newest_requests(table(spark, d, "requests"))


def _answers(spark, d):
    return G.newest_answers(table(spark, d, "answers"))


def references(spark, d):
    """How often each printed reference stands in the extracts of requests."""
    b = G.context_blocks(_requests(spark, d))
    return b.select(F.explode(G.surfaces(F.col("block"))).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))


def context_blocks(spark, d):
    return G.context_blocks(_requests(spark, d)).select("custom_id", "pos", "unit_id", F.length("block").alias("n_chars"))


def resolved_units(spark, d):
    return G.assess(_requests(spark, d), table(spark, d, "units"))


def absent_units(spark, d):
    return resolved_units(spark, d).filter("resolved AND NOT in_context").select("custom_id", "unit", "first_pos")


def unresolved_references(spark, d):
    return resolved_units(spark, d).filter("NOT resolved").groupBy("unit").agg(F.count("*").alias("n_requests"))


def augmented_context(spark, d):
    return G.augmented(_requests(spark, d), table(spark, d, "units"))


def context_sizes(spark, d):
    """Histogram of context sizes, bins of width 4 from the least."""
    n = augmented_context(spark, d).groupBy("custom_id").agg(F.count("*").alias("n"))
    low = n.agg(F.min("n").alias("low"))
    return n.crossJoin(F.broadcast(low)).groupBy((F.floor((F.col("n") - F.col("low")) / 4) * 4 + F.col("low")).alias("bin")).agg(F.count("*").alias("n_requests"))


def layer_recall(spark, d):
    """Expected units of the evaluation item behind a request that its context holds, before and after fetching."""
    q = _requests(spark, d).select("custom_id", F.regexp_extract("query_id", r"(\d+)$", 1).cast("long").alias("item_id"))
    gold = items(spark, d).select("item_id", F.explode("expected_units").alias("unit"))
    need = q.join(gold, "item_id").select("custom_id", "unit").distinct()
    have = augmented_context(spark, d).groupBy("custom_id", "unit").agg(F.max((F.col("origin") == "first").cast("int")).alias("first"))
    j = need.join(have, ["custom_id", "unit"], "left")
    return j.agg(F.count("*").alias("n_slots"), F.coalesce(F.sum("first"), F.lit(0)).alias("hit_first"), F.count("first").alias("hit_after"))


def window_scores(spark, d):
    v = G.unit_verdicts(_answers(spark, d), _requests(spark, d))
    return v.select("custom_id", "pos", "n_tokens", "n_surfaces", F.bround("overlap_max", 6).alias("overlap_max"), F.bround("score", 6).alias("score"), "grounded")


def crosscheck_disagreements(spark, d):
    """The Arrow score against the native expression, on every unit and block pair of requests with few extracts."""
    a = _answers(spark, d).select("custom_id", T.answer_text(F.col("response")).alias("a")).filter("a IS NOT NULL")
    u = a.select("custom_id", F.explode(T.claim_units(F.col("a"))).alias("u")).select("custom_id", T.primary_tokens(F.col("u")).alias("unit_tokens"))
    b = G.context_blocks(_requests(spark, d)).select("custom_id", T.primary_tokens(F.col("block")).alias("block_tokens"))
    p = G.scored(u.join(b, "custom_id")).withColumn("native", G.score_expression(F.col("unit_tokens"), F.col("block_tokens")))
    return p.agg(F.count("*").alias("n_pairs"), F.sum((F.abs(F.col("score") - F.col("native")) > 1e-12).cast("long")).alias("n_different"))


def answer_grading(spark, d):
    return G.answer_grading(G.unit_verdicts(_answers(spark, d), _requests(spark, d)))


def flagged_units(spark, d):
    v = G.unit_verdicts(_answers(spark, d), _requests(spark, d)).filter("NOT grounded")
    return v.groupBy("custom_id").agg(F.count("*").alias("n_flagged"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]), " / ").alias("units"))


def _graded(spark, d):
    """One row per request with an answer: its condition, tier, stratum, counts and class."""
    r = _requests(spark, d).select("custom_id", "query_set", "condition", F.split("custom_id", "__")[2].alias("tier"), "query_id")
    a = _answers(spark, d).select("custom_id", T.response_class(T.answer_text(F.col("response"))).alias("cls"), F.coalesce(F.col("response.message.usage.input_tokens"), F.lit(0)).cast("long").alias("tin"), F.coalesce(F.col("response.message.usage.output_tokens"), F.lit(0)).cast("long").alias("tout"), "collected_at")
    g = G.answer_grading(G.unit_verdicts(_answers(spark, d), _requests(spark, d)))
    return r.join(a, "custom_id").join(g, "custom_id", "left").fillna(0, ["n_units", "n_grounded", "n_ungrounded"])


def _block(g):
    return g.agg(F.count("*").alias("n_rows"), F.sum("n_units").alias("n_units"), F.sum("n_ungrounded").alias("n_ungrounded"), F.bround(F.try_divide(F.sum("n_ungrounded").cast("double"), F.sum("n_units").cast("double")), 6).alias("rate"), F.sum((F.col("n_units") > 0).cast("long")).alias("answered"))


def rates_by_tier(spark, d):
    return _block(_graded(spark, d).groupBy("condition", "tier"))


def rates_pooled(spark, d):
    """Micro rates by condition and tier, by condition and overall: counts summed, then divided."""
    return _block(_graded(spark, d).rollup("condition", "tier"))


def rates_by_stratum(spark, d):
    """Rates per condition and query set with explicit rows for sets without answers."""
    g = _block(_graded(spark, d).groupBy("condition", "query_set"))
    r = _requests(spark, d)
    every = r.select("condition").distinct().crossJoin(F.broadcast(r.select("query_set").distinct()))  # two small dimensions
    return every.join(g, ["condition", "query_set"], "left").fillna(0, ["n_rows", "n_units", "n_ungrounded", "answered"])


def comparable_set(spark, d):
    """Queries answered under both the raw and the second-call condition, each side's counts on that membership."""
    g = _graded(spark, d).filter("n_units > 0 AND condition IN ('raw', 'second_call')")
    both = g.groupBy("query_id").agg(F.countDistinct("condition").alias("n")).filter("n = 2").select("query_id")
    return _block(g.join(both, "query_id", "left_semi").groupBy("condition"))


def token_latency(spark, d):
    """Tokens read and written, and the longest latency, per tier."""
    q = _requests(spark, d).select("custom_id", "created_at")
    g = _graded(spark, d).join(q, "custom_id")
    return g.groupBy("tier").agg(F.sum("tin").alias("input_tokens"), F.sum("tout").alias("output_tokens"), F.max(F.unix_timestamp("collected_at") - F.unix_timestamp("created_at")).alias("latency_s"))


def _overlaps(spark, d):
    return materialise(G.unit_verdicts(_answers(spark, d), _requests(spark, d)).select("custom_id", "pos", F.bround("overlap_max", 6).alias("v")))


def alignment_summary(spark, d):
    v = _overlaps(spark, d)
    q = lambda p: F.bround(F.percentile("v", F.lit(p)), 6)
    return v.agg(F.count("*").alias("n"), F.min("v").alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), q(0.95).alias("q95"), F.max("v").alias("most"), F.bround(F.avg(F.col("v").cast("decimal(18,6)")).cast("double"), 5).alias("mean"), F.sum((F.col("v") == 0).cast("long")).alias("zeros"))


def alignment_histogram(spark, d):
    """20 fixed bins of 0.05, empty ones kept, 1.0 in the last."""
    v = _overlaps(spark, d).groupBy(F.least(F.floor(F.bround(F.col("v") / 0.05, 6)), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(20).select(F.col("id").cast("int").alias("bin"))
    return bins.join(v, "bin", "left").fillna(0, ["n"])


def alignment_gaps(spark, d):
    """The five largest gaps between neighbouring distinct scores; the window spans distinct values, at most a million."""
    v = _overlaps(spark, d).select("v").distinct().withColumn("above", F.lead("v").over(W.orderBy("v")))
    return v.filter("above IS NOT NULL").select(F.col("v").alias("below"), "above", F.bround(F.col("above") - F.col("v"), 6).alias("gap")).orderBy(F.col("gap").desc(), "below").limit(5)


def foreign_alignment(spark, d):
    """Each unit's own best overlap against its best with the blocks of every request of another query; ties beat nothing."""
    r, a = G.lean_requests(table(spark, d, "requests")), G.lean_answers(table(spark, d, "answers"))
    tokens = lambda texts: F.transform(texts, T.primary_tokens)
    v = G.own_alignment(r.join(a, "custom_id").select("custom_id", "query_id", tokens(T.claim_units(F.col("a"))).alias("units"), tokens(G.extracts(F.col("user_text"))).alias("blocks")))
    blocks = r.select("query_id", F.explode(G.extracts(F.col("user_text"))).alias("block")).select("query_id", T.primary_tokens(F.col("block")).alias("block_tokens"))
    foreign = G.foreign_alignment(v, blocks)
    rows = F.broadcast(r.agg((F.countDistinct("query_id") - 1).alias("foreign_rows")))
    margin = F.bround(F.col("overlap_max") - F.col("foreign_max"), 6)
    return foreign.crossJoin(rows).select("custom_id", "pos", "foreign_rows", F.bround("overlap_max", 6).alias("own_max"), F.bround("foreign_max", 6).alias("foreign_max"), margin.alias("margin"), (F.col("overlap_max") > F.col("foreign_max")).alias("beats"))


QUERIES = {f.__name__: f for f in (references, context_blocks, resolved_units, absent_units, unresolved_references, augmented_context, context_sizes, layer_recall, window_scores, crosscheck_disagreements, answer_grading, flagged_units, rates_by_tier, rates_pooled, rates_by_stratum, comparable_set, token_latency, alignment_summary, alignment_histogram, alignment_gaps, foreign_alignment)}

_B = r"""WITH r AS (SELECT * FROM requests WHERE custom_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY created_at DESC NULLS LAST, user_text DESC NULLS LAST) = 1),
x AS (SELECT custom_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(user_text, '(?s)\n*Question:.*$', ''), '(?s)^\s*Extracts:\s*', ''), '\n\n\[', chr(1) || '[', 'g'), chr(1)), lambda b: regexp_matches(b, '^\[[^\]]+\]')) p FROM r),
b AS (SELECT custom_id, CAST(i - 1 AS INT) pos, split_part(regexp_extract(p[i], '^\[([^\]]+)\]', 1), '#', 1) unit_id, p[i] block FROM (SELECT custom_id, p, unnest(range(1, len(p) + 1)) i FROM x))"""
_S = "list_distinct(list_concat(" + ", ".join(f"list_transform(regexp_extract_all(regexp_replace(block, '\\b{k} {n}(\\([^)]*\\))*\\s*(\\([^)]*\\)\\s*)*of\\s+(the\\s+)?(Directive|Regulation|Norm|Bulletin|Charter|Convention|Treaty|Decision)', '', 'g'), '\\b{k} ({n})\\b', 1), lambda z: '{p}|' || z)" for k, p, n in G.KINDS) + ", list_transform(regexp_extract_all(block, '\\b([A-Z]{4,} \\d+\\.\\d+)\\b', 1), lambda z: 'sub|' || replace(z, ' ', '_'))))"
_A = _B + f""", s AS (SELECT custom_id, pos, unit_id, unnest({_S}) s FROM b),
cand AS (SELECT custom_id, split_part(unit_id, ':', 1) || ':' || split_part(s, '|', 1) || '_' || regexp_replace(split_part(s, '|', -1), '-+', '-', 'g') unit, min(pos) first_pos FROM s GROUP BY ALL),
ass AS (SELECT custom_id, unit, first_pos, unit IN (SELECT unit_id FROM units WHERE unit_id IS NOT NULL) resolved, (custom_id, unit) IN (SELECT custom_id, unit_id FROM b) in_context FROM cand),
aug AS (SELECT custom_id, CAST(pos AS BIGINT) pos, unit_id unit, 'first' origin FROM b UNION ALL SELECT custom_id, n + row_number() OVER (PARTITION BY custom_id ORDER BY first_pos, unit) - 1, unit, 'fetched' FROM ass JOIN (SELECT custom_id, count(*) n FROM b GROUP BY 1) USING (custom_id) WHERE resolved AND NOT in_context)"""
SQL = {
    "references": f"{_B} SELECT surface, count(*) AS n FROM (SELECT unnest({_S}) surface FROM b) GROUP BY surface",
    "context_blocks": f"{_B} SELECT custom_id, pos, unit_id, CAST(length(block) AS INT) AS n_chars FROM b",
    "resolved_units": f"{_A} SELECT custom_id, unit, first_pos, resolved, in_context FROM ass",
    "absent_units": f"{_A} SELECT custom_id, unit, first_pos FROM ass WHERE resolved AND NOT in_context",
    "unresolved_references": f"{_A} SELECT unit, count(*) AS n_requests FROM ass WHERE NOT resolved GROUP BY unit",
    "augmented_context": f"{_A} SELECT custom_id, pos, unit, origin FROM aug",
    "context_sizes": f"{_A}, n AS (SELECT custom_id, count(*) n FROM aug GROUP BY 1) SELECT (n - (SELECT min(n) FROM n)) // 4 * 4 + (SELECT min(n) FROM n) AS bin, count(*) AS n_requests FROM n GROUP BY 1",
    "layer_recall": f"{_A}, need AS (SELECT DISTINCT custom_id, u unit FROM r JOIN (SELECT item_id, unnest(expected_units) u FROM eval_queries) ON item_id = TRY_CAST(regexp_extract(query_id, '(\\d+)$', 1) AS BIGINT)), have AS (SELECT custom_id, unit, max(CASE WHEN origin = 'first' THEN 1 ELSE 0 END) f FROM aug GROUP BY ALL) SELECT count(*) AS n_slots, CAST(coalesce(sum(f), 0) AS BIGINT) AS hit_first, count(f) AS hit_after FROM need LEFT JOIN have USING (custom_id, unit)",
}

_ITEM = T.LIST_MARKER
_ABBR = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_US = _S.replace("(block", "(unit")
_U = _B + rf""", an AS (SELECT custom_id, array_to_string(list_transform(list_filter(response.message.content, lambda b: b.type = 'text'), lambda b: coalesce(b.text, '')), '') a, response, collected_at FROM answers WHERE custom_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY collected_at DESC NULLS LAST, body_sha256 DESC NULLS LAST) = 1),
ln AS (SELECT custom_id, list_filter(list_transform(string_split(array_to_string(list_transform(string_split(a, chr(10)), lambda l: CASE WHEN trim(l) = '' THEN chr(2) WHEN regexp_matches(l, '{_ITEM}') THEN chr(2) || chr(3) || trim(regexp_replace(l, '{_ITEM}', '')) || chr(2) ELSE trim(l) || ' ' END), ''), chr(2)), lambda r: trim(r)), lambda r: r <> '') runs FROM an WHERE a IS NOT NULL),
un AS (SELECT custom_id, list_filter(flatten(list_transform(runs, lambda r: CASE WHEN r[1] = chr(3) THEN [r[2:]] ELSE
   list_filter(list_transform(string_split(regexp_replace(regexp_replace(r, '(?i)(^|[^A-Za-z.])({_ABBR})\.(\s|$)', '\1\2' || chr(1) || '\3', 'g'), '([.?!])\s+', '\1' || chr(4), 'g'), chr(4)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '') END)),
   lambda u: trim(u) <> '' AND {_FLAT.format('u')} <> '{T.MARKER}' AND rtrim(lower({_FLAT.format('u')}), '.') <> '{T.MARKER[:-1].lower()}') us FROM ln),
u AS (SELECT custom_id, CAST(i - 1 AS INT) pos, us[i] unit FROM (SELECT custom_id, us, unnest(range(1, len(us) + 1)) i FROM un)),
ut AS (SELECT *, {TOKENS.format('unit')} t, {_US} sf FROM u), bt AS (SELECT custom_id, {TOKENS.format('block')} t, {_S} sf FROM b),
pr AS (SELECT ut.custom_id, ut.pos, len(list_filter(ut.sf, lambda z: NOT list_contains(bt.sf, z))) = 0 ok,
   CASE WHEN len(ut.t) = 0 OR len(bt.t) < len(ut.t) THEN 0.0 ELSE list_max(list_transform(range(1, len(bt.t) - len(ut.t) + 2), lambda i: list_sum(list_transform(list_distinct(ut.t), lambda w: least(len(list_filter(ut.t, lambda q: q = w)), len(list_filter(bt.t[i:i + len(ut.t) - 1], lambda q: q = w))))))) / len(ut.t) END sc FROM ut JOIN bt USING (custom_id)),
bs AS (SELECT custom_id, pos, max(sc) om, max(sc) FILTER (ok) sc FROM pr GROUP BY ALL),
vd AS (SELECT ut.custom_id, ut.pos, unit, CAST(len(t) AS INT) n_tokens, CAST(len(ut.sf) AS INT) n_surfaces, coalesce(om, 0) overlap_max, coalesce(sc, 0) score, len(t) > 0 AND coalesce(sc, 0) >= CASE WHEN len(t) < 4 THEN 1.0 ELSE 0.75 END grounded FROM ut LEFT JOIN bs USING (custom_id, pos)),
ag AS (SELECT custom_id, count(*) n_units, count(*) FILTER (grounded) n_grounded FROM vd GROUP BY 1),
gr AS (SELECT r.custom_id, r.query_set, r.condition, split_part(r.custom_id, '__', 3) tier, r.query_id, r.created_at, an.collected_at, coalesce(n_units, 0) n_units, coalesce(n_units - n_grounded, 0) bad, coalesce(response.message.usage.input_tokens, 0) tin, coalesce(response.message.usage.output_tokens, 0) tout FROM r JOIN an USING (custom_id) LEFT JOIN ag USING (custom_id))"""
_BL = "count(*) AS n_rows, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(bad) AS BIGINT) AS n_ungrounded, round_even(sum(bad) / nullif(sum(n_units), 0), 6) AS rate, count(*) FILTER (n_units > 0) AS answered"
_V6 = _U + ", v AS (SELECT round_even(overlap_max, 6) v FROM vd)"
SQL |= {
    "text_claim_units": f"{_U} SELECT custom_id, pos, unit FROM u",
    "window_scores": f"{_U} SELECT custom_id, pos, n_tokens, n_surfaces, round_even(overlap_max, 6) AS overlap_max, round_even(score, 6) AS score, grounded FROM vd",
    "crosscheck_disagreements": f"{_U} SELECT count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_different FROM pr",
    "answer_grading": f"{_U} SELECT custom_id, n_units, n_grounded, n_units - n_grounded AS n_ungrounded, round_even(1 - n_grounded / n_units, 6) AS unsupported_rate FROM ag",
    "flagged_units": f"{_U} SELECT custom_id, count(*) AS n_flagged, string_agg(unit, ' / ' ORDER BY pos) AS units FROM vd WHERE NOT grounded GROUP BY 1",
    "rates_by_tier": f"{_U} SELECT condition, tier, {_BL} FROM gr GROUP BY ALL",
    "rates_pooled": f"{_U} SELECT condition, tier, {_BL} FROM gr GROUP BY ROLLUP (condition, tier)",
    "rates_by_stratum": f"{_U}, g AS (SELECT condition, query_set, {_BL} FROM gr GROUP BY ALL) SELECT c.condition, s.query_set, coalesce(n_rows, 0) AS n_rows, coalesce(n_units, 0) AS n_units, coalesce(n_ungrounded, 0) AS n_ungrounded, rate, coalesce(answered, 0) AS answered FROM (SELECT DISTINCT condition FROM r) c CROSS JOIN (SELECT DISTINCT query_set FROM r) s LEFT JOIN g ON g.condition = c.condition AND g.query_set = s.query_set",
    "comparable_set": f"{_U}, a2 AS (SELECT * FROM gr WHERE n_units > 0 AND condition IN ('raw', 'second_call')) SELECT condition, {_BL} FROM a2 WHERE query_id IN (SELECT query_id FROM a2 GROUP BY 1 HAVING count(DISTINCT condition) = 2) GROUP BY condition",
    "token_latency": f"{_U} SELECT tier, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens, max(CAST(floor(epoch(collected_at)) AS BIGINT) - CAST(floor(epoch(created_at)) AS BIGINT)) AS latency_s FROM gr GROUP BY tier",
    "alignment_summary": f"{_V6} SELECT count(*) AS n, min(v) AS least, round_even(quantile_cont(v, 0.25), 6) AS q25, round_even(quantile_cont(v, 0.5), 6) AS median, round_even(quantile_cont(v, 0.75), 6) AS q75, round_even(quantile_cont(v, 0.95), 6) AS q95, max(v) AS most, round_even(CAST(sum(CAST(v AS DECIMAL(18,6))) AS DOUBLE) / count(*), 5) AS mean, count(*) FILTER (v = 0) AS zeros FROM v",
    "alignment_histogram": f"{_V6}, h AS (SELECT CAST(least(floor(round_even(v / 0.05, 6)), 19) AS INT) bin, count(*) n FROM v GROUP BY 1) SELECT CAST(x.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) bin) x LEFT JOIN h ON h.bin = x.bin",
    "alignment_gaps": f"{_V6}, g AS (SELECT v AS below, lead(v) OVER (ORDER BY v) above FROM (SELECT DISTINCT v FROM v)) SELECT below, above, round_even(above - below, 6) AS gap FROM g WHERE above IS NOT NULL ORDER BY gap DESC, below LIMIT 5",
}
