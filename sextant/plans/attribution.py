"""Attribution and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import attribution as A
from sextant.operators import grounding as G
from sextant.plans import grounding as P
from sextant.plans.common import chunks, items


def lexical_attribution(spark, d):
    """Each segment of an item's passage (span_id ``item#number``) against the segments of all chunks outside its expected units."""
    i = items(spark, d)
    spans = i.select("item_id", "expected_units", F.posexplode(T.segments(F.col("passage"))).alias("k", "span")).withColumn("span_id", F.concat_ws("#", "item_id", "k"))
    seg = chunks(spark, d, "text").filter("text IS NOT NULL").select(T.unit_of(F.col("chunk_id")).alias("unit"), F.posexplode(T.segments(F.col("text"))).alias("seg_no", "segment"))
    return A.lexical_attribution(spans.select("span_id", "span"), seg, spans.select("span_id", F.explode("expected_units").alias("unit")))


def adversarial_verdicts(spark, d):
    a = P._answers(spark, d).select("custom_id", T.answer_text(F.col("response")).alias("a")).filter("a IS NOT NULL")
    return A.adversarial_verdict(a.select("custom_id", F.explode(T.claim_units(F.col("a"))).alias("unit")))


def rates_table(spark, d):
    """The pooled rates as a printed table: numbers with six places, trailing zeros off, nothing where undefined."""
    return P.rates_pooled(spark, d).select("condition", "tier", A.csv_number(F.col("rate")).alias("rate"))


def decomposition(spark, d):
    """Second-call answers against the raw ones of the same query and tier, over the queries with both whose raw side answered.

    Abstained are those without a grounded unit after the second call (a marker has no units); the others are answered in both.
    """
    key, counts = ["query_set", "tier", "query_id"], ["n_units", "n_grounded", "n_ungrounded"]
    g = P._graded(spark, d).filter("query_id IS NOT NULL AND condition IN ('raw', 'second_call')")
    x = g.groupBy(*key).agg(F.countDistinct("condition").alias("sides"), *[F.sum(F.when(F.col("condition") == c, F.col(n)).otherwise(0)).alias(f"{c}_{n}") for c in ("raw", "second_call") for n in counts])
    x = x.filter("sides = 2 AND raw_n_units > 0").withColumn("both", F.col("second_call_n_grounded") > 0)
    total = lambda when, e, name: F.sum(F.when(when, F.expr(e)).otherwise(0)).cast("long").alias(name)
    both, out = F.col("both"), ~F.col("both")
    return x.groupBy("query_set", "tier").agg(
        F.count("*").alias("n"), total(F.lit(True), "CAST(raw_n_ungrounded > second_call_n_ungrounded AS INT)", "fewer"), total(F.lit(True), "second_call_n_ungrounded - raw_n_ungrounded", "delta"),
        total(out, "1", "abstained"), total(out, "raw_n_ungrounded", "abstained_ungrounded"), total(out, "raw_n_units", "abstained_units"),
        total(both, "raw_n_ungrounded - second_call_n_ungrounded", "ungrounded_removed"), total(both, "second_call_n_grounded - raw_n_grounded", "grounded_added"), total(both, "second_call_n_units - raw_n_units", "units_added"),
    )


def surface_tokens(spark, d):
    """Blocks by how many references they print, and how many of them print more than their own label."""
    b = G.context_blocks(P._requests(spark, d)).select(F.size(G.surfaces(F.col("block"))).alias("n_surfaces"))
    return b.groupBy("n_surfaces").agg(F.count("*").alias("n_blocks"))


_DEN = "|".join(A.DENIALS)
_V = P._U + f", ad AS (SELECT custom_id, CASE WHEN bool_or(NOT regexp_matches(lower({P.NORM.format('unit')}), '{_DEN}')) THEN 'failure' ELSE 'not_failure' END verdict FROM u GROUP BY 1)"
QUERIES = {f.__name__: f for f in (lexical_attribution, adversarial_verdicts, rates_table, decomposition, surface_tokens)}
SQL = {
    "adversarial_verdicts": f"{_V} SELECT custom_id, verdict FROM ad",
    "rates_table": f"{P._U}, t AS (SELECT condition, tier, {P._BL} FROM gr GROUP BY ROLLUP (condition, tier)) SELECT condition, tier, coalesce(regexp_replace(printf('%.6f', rate), '\\.?0+$', ''), '') AS rate FROM t",
    "decomposition": f"{P._U}, dx AS (SELECT query_set, tier, query_id, count(DISTINCT condition) sides, sum(n_units) FILTER (condition = 'raw') ru, sum(bad) FILTER (condition = 'raw') rb, sum(n_units) FILTER (condition = 'second_call') su, sum(bad) FILTER (condition = 'second_call') sb FROM gr WHERE query_id IS NOT NULL AND condition IN ('raw', 'second_call') GROUP BY ALL), dy AS (SELECT *, su - sb > 0 kept FROM dx WHERE sides = 2 AND ru > 0) SELECT query_set, tier, count(*) AS n, count(*) FILTER (rb > sb) AS fewer, CAST(sum(sb - rb) AS BIGINT) AS delta, count(*) FILTER (NOT kept) AS abstained, CAST(coalesce(sum(rb) FILTER (NOT kept), 0) AS BIGINT) AS abstained_ungrounded, CAST(coalesce(sum(ru) FILTER (NOT kept), 0) AS BIGINT) AS abstained_units, CAST(coalesce(sum(rb - sb) FILTER (kept), 0) AS BIGINT) AS ungrounded_removed, CAST(coalesce(sum(su - sb - ru + rb) FILTER (kept), 0) AS BIGINT) AS grounded_added, CAST(coalesce(sum(su - ru) FILTER (kept), 0) AS BIGINT) AS units_added FROM dy GROUP BY query_set, tier",
    "surface_tokens": f"{P._B} SELECT CAST(len({P._S}) AS INT) AS n_surfaces, count(*) AS n_blocks FROM b GROUP BY 1",
}
