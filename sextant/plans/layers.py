"""The second call against the first, rules over the rates, requests as they are put together, and nested records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import grounding as G
from sextant.operators import retrieval as RT
from sextant.plans import frames as FR
from sextant.plans import grounding as P
from sextant.plans.common import C, NORM, chunks, items
from sextant.sources.tables import table

#: Conditions and tiers in the order reports print them.
CONDITIONS, TIERS = ["raw", "second_call", "no_context"], ["small1", "mid2", "large3"]


def _fired(spark, d):
    """Requests whose context lacks a unit it refers to."""
    return P.absent_units(spark, d).select("custom_id").distinct().withColumn("fired", F.lit(True))


def abstentions(spark, d):
    """Per answer: whether the check fired, the answer is the marker, and it abstains: by the marker, or fired without a grounded unit."""
    g = P._graded(spark, d).join(_fired(spark, d), "custom_id", "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    marker = F.coalesce(F.col("cls") != "answered", F.lit(False))
    none = (F.col("condition") == "second_call") & F.col("fired") & (F.col("n_units") > 0) & (F.col("n_grounded") == 0)
    return g.select("custom_id", "query_set", "condition", "tier", "query_id", "n_units", "n_grounded", "n_ungrounded", "fired", marker.alias("marker"), (marker | none).alias("abstains"))


def abstention_rows(spark, d):
    return abstentions(spark, d).select("custom_id", "fired", "marker", "abstains")


def grading_blocks(spark, d):
    """Rows, abstaining and answered, units and rates by condition and tier, by condition, and overall."""
    a = abstentions(spark, d)
    n = lambda c: F.sum(c.cast("long"))
    rate = lambda x, y: F.bround(F.try_divide(x.cast("double"), y.cast("double")), 6)
    return a.rollup("condition", "tier").agg(
        F.count("*").alias("n_rows"), n(F.col("abstains")).alias("abstaining"), n(~F.col("abstains")).alias("answered"), F.sum("n_units").alias("n_units"), F.sum("n_grounded").alias("n_grounded"),
        n(F.col("n_units") == 0).alias("without_units"), rate(n(F.col("abstains")), F.count("*")).alias("abstention_rate"), rate(F.sum("n_ungrounded"), F.sum("n_units")).alias("rate"),
    )


def dev_totals(spark, d):
    """Totals of the development set's first and second calls."""
    a = abstentions(spark, d).filter("query_set = 'dev' AND condition IN ('raw', 'second_call')")
    return a.groupBy("condition").agg(F.count("*").alias("n_rows"), F.sum(F.col("abstains").cast("long")).alias("abstaining"), F.sum("n_units").alias("n_units"), F.sum("n_ungrounded").alias("n_ungrounded"))


def _sides(spark, d):
    """One row per query and tier with both calls: the first call's columns and the second's."""
    key = ["query_set", "tier", "query_id"]
    a = abstentions(spark, d).filter("query_id IS NOT NULL")
    one = lambda c, p: a.filter(F.col("condition") == c).groupBy(*key).agg(F.bool_or("abstains").alias(f"{p}_abstains"), F.sum("n_units").alias(f"{p}_units"), F.sum("n_ungrounded").alias(f"{p}_ungrounded"), F.bool_or("fired").alias(f"{p}_fired"))
    return one("raw", "raw").join(one("second_call", "layer"), key)


def abstention_changes(spark, d):
    """Queries that abstain after the first call only (recovered) and after the second only (lost), counted and listed by tier."""
    s = _sides(spark, d)
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("query_id")))), " ")
    rec, lost = F.col("raw_abstains") & ~F.col("layer_abstains"), ~F.col("raw_abstains") & F.col("layer_abstains")
    return s.groupBy("query_set", "tier").agg(F.count("*").alias("n"), F.sum(rec.cast("long")).alias("recovered"), ids(rec).alias("recovered_ids"), F.sum(lost.cast("long")).alias("lost"), ids(lost).alias("lost_ids"))


def layer_disagreements(spark, d):
    """Answers whose condition and check do not agree: a second call where nothing was absent, by tier, beside those that agree."""
    a = abstentions(spark, d).filter("condition = 'second_call'")
    return a.groupBy("tier").agg(F.count("*").alias("n_rows"), F.sum(F.col("fired").cast("long")).alias("agree"), F.sum((~F.col("fired")).cast("long")).alias("disagree"))


def fate_table(spark, d):
    """What became of the first call's ungrounded units in the second call of the same query and tier.

    Repeated units are grounded now or still not; the others are dropped. Raises where the counts do not add up.
    """
    key = ["query_set", "tier", "query_id"]
    v = G.unit_verdicts(table(spark, d, "answers"), table(spark, d, "requests"))
    r = P._requests(spark, d).filter("query_id IS NOT NULL").select("custom_id", "query_set", "condition", F.split("custom_id", "__")[2].alias("tier"), "query_id")
    u = r.join(v.select("custom_id", T.norm_comparison(F.col("unit")).alias("u"), "grounded"), "custom_id")
    calls = r.filter("condition = 'second_call'").select(*key).distinct()
    first = u.filter("condition = 'raw' AND NOT grounded").join(calls, key, "left_semi").select(*key, "u").distinct()
    second = u.filter("condition = 'second_call'").groupBy(*key, "u").agg(F.bool_or("grounded").alias("now"))
    f = first.join(second, [*key, "u"], "left").groupBy("tier").agg(
        F.count("*").alias("flagged_in"), F.count("now").alias("repeated"), F.sum(F.coalesce("now", F.lit(False)).cast("long")).alias("now_grounded"),
        F.sum(F.coalesce(~F.col("now"), F.lit(False)).cast("long")).alias("still_unsupported"), F.sum(F.col("now").isNull().cast("long")).alias("dropped"),
    )
    sound = (F.col("flagged_in") == F.col("repeated") + F.col("dropped")) & (F.col("repeated") == F.col("now_grounded") + F.col("still_unsupported"))
    return f.withColumn("dropped", F.when(sound, F.col("dropped")).otherwise(F.raise_error(F.lit("fates do not add up")).cast("long")))


def flag_matches(spark, d):
    """Ungrounded units against all units of answers of the same tier and query by exact text: matched once, or ambiguous."""
    v = G.unit_verdicts(table(spark, d, "answers"), table(spark, d, "requests")).join(P._requests(spark, d).select("custom_id", "query_id", F.split("custom_id", "__")[2].alias("tier")), "custom_id")
    n = v.groupBy("tier", "query_id", "unit").agg(F.count("*").alias("k"), F.sum((~F.col("grounded")).cast("long")).alias("flagged")).filter("flagged > 0")
    return n.groupBy("tier").agg(F.sum("flagged").alias("n_flagged"), F.sum((F.col("k") == 1).cast("long")).alias("matched"), F.sum((F.col("k") > 1).cast("long")).alias("ambiguous"))


def concentration_by_reference(spark, d):
    """Units that print a reference and units that do not: how many are grounded, by condition and tier."""
    v = G.unit_verdicts(table(spark, d, "answers"), table(spark, d, "requests")).join(P._requests(spark, d).select("custom_id", "condition", F.split("custom_id", "__")[2].alias("tier")), "custom_id")
    return v.groupBy("condition", "tier", (F.col("n_surfaces") > 0).alias("prints")).agg(F.count("*").alias("n_units"), F.sum(F.col("grounded").cast("long")).alias("n_grounded"), F.bround(F.sum((~F.col("grounded")).cast("long")) / F.count("*"), 6).alias("rate"))


def concentration_by_recall(spark, d):
    """Ungrounded units of answers by how much of their item's expected units the context holds: full, partial or none."""
    q = P._requests(spark, d).select("custom_id", "condition", F.regexp_extract("query_id", r"(\d+)$", 1).alias("n")).filter("n <> ''").withColumn("item_id", F.col("n").cast("long"))
    gold = items(spark, d).select("item_id", F.explode(F.array_distinct("expected_units")).alias("unit"))
    have = P.augmented_context(spark, d).select("custom_id", "unit").distinct().withColumn("has", F.lit(1))
    r = q.join(gold, "item_id").join(have, ["custom_id", "unit"], "left").groupBy("custom_id", "condition").agg(F.count("*").alias("need"), F.count("has").alias("has"))
    g = P._graded(spark, d).select("custom_id", "n_units", "n_ungrounded")
    recall = F.when(F.col("has") == F.col("need"), "full").when(F.col("has") > 0, "partial").otherwise("none")
    return r.join(g, "custom_id").groupBy("condition", recall.alias("recall")).agg(F.count("*").alias("n_rows"), F.sum("n_units").alias("n_units"), F.sum("n_ungrounded").alias("n_ungrounded"))


def alignment_beats(spark, d):
    """Units by tier, and overall, whose own overlap beats, equals or falls below the best foreign one."""
    f = P.foreign_alignment(spark, d).withColumn("tier", F.split("custom_id", "__")[2])
    n = lambda c: F.sum(c.cast("long"))
    m = F.col("margin")
    return f.groupingSets([[F.col("tier")], []], F.col("tier")).agg(F.count("*").alias("n_units"), n(m > 0).alias("beats"), n(m == 0).alias("ties"), n(m < 0).alias("below"), F.bround(n(m > 0) / F.count("*"), 6).alias("beat_rate"))


def window_scores_relational(spark, d):
    """The best overlap of each unit and block of a request by sorting alone: every token of the block that the unit has opens
    and closes an interval of window starts, and the running sum of openings has its maximum at the best window."""
    a = P._answers(spark, d).select("custom_id", T.answer_text(F.col("response")).alias("a")).filter("a IS NOT NULL")
    u = a.select("custom_id", F.posexplode(T.claim_units(F.col("a"))).alias("pos", "unit")).select("custom_id", "pos", T.primary_tokens(F.col("unit")).alias("t")).withColumn("n", F.size("t"))
    b = G.context_blocks(P._requests(spark, d)).select("custom_id", F.col("pos").alias("bpos"), T.primary_tokens(F.col("block")).alias("t")).withColumn("m", F.size("t"))
    need = u.select("custom_id", "pos", "n", F.explode("t").alias("w")).groupBy("custom_id", "pos", "n", "w").agg(F.count("*").cast("int").alias("k"))
    at = b.select("custom_id", "bpos", "m", F.posexplode("t").alias("i", "w")).groupBy("custom_id", "bpos", "m", "w").agg(F.sort_array(F.collect_list("i")).alias("p"))
    met = need.join(at, ["custom_id", "w"]).filter("m >= n")
    x = met.select("custom_id", "pos", "n", "bpos", "m", "k", "p", F.posexplode("p").alias("j", "i"))
    low = F.greatest(F.col("i") - F.col("n") + 1, F.lit(0), F.coalesce(F.get("p", F.col("j") - F.col("k")) + 1, F.lit(0)))
    high = F.least("i", F.col("m") - F.col("n"))
    s = x.select("custom_id", "pos", "n", "bpos", low.alias("lo"), high.alias("hi")).filter("lo <= hi")
    e = s.select("custom_id", "pos", "n", "bpos", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    e = e.groupBy("custom_id", "pos", "n", "bpos", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy("custom_id", "pos", "bpos").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    best = e.withColumn("s", F.sum("d").over(w)).groupBy("custom_id", "pos").agg(F.max(F.col("s") / F.col("n")).alias("v"))
    return u.select("custom_id", "pos").join(best, ["custom_id", "pos"], "left").select("custom_id", "pos", F.bround(F.coalesce("v", F.lit(0.0)), 6).alias("overlap_max"))


def rules(spark, d):
    """Boolean rules over the rates; null where a rule cannot be scored for want of rows.

    Abstention, the size and sign of gaps between conditions, the order of tiers, and the instrument's own soundness.
    """
    b = grading_blocks(spark, d)
    stops = P._answers(spark, d).agg(F.sum((F.col("response.message.stop_reason") == "max_tokens").cast("long")).alias("cut"))
    pick = lambda c, t, x: F.max(F.when(F.col("condition").eqNullSafe(F.lit(c)) & F.col("tier").eqNullSafe(F.lit(t)), F.col(x)))
    one = b.agg(
        *[pick(c, None, x).alias(f"{c}_{x}") for c in CONDITIONS for x in ("rate", "abstaining", "without_units")],
        *[pick("raw", t, "rate").alias(f"raw_{t}") for t in TIERS], pick(None, None, "rate").alias("all_rate"), pick(None, None, "without_units").alias("bare"), pick(None, None, "abstaining").alias("silent"),
    ).crossJoin(F.broadcast(stops))  # one row each
    return one.select(F.expr("stack(" + str(len(RULES)) + ", " + ", ".join(f"'{n}', {e}" for n, e in RULES.items()) + ") AS (rule, holds)"))


#: Name -> condition over the pooled rates.
RULES = {
    "raw abstains never": "raw_abstaining = 0",
    "second call abstains at least as often as raw": "second_call_abstaining >= raw_abstaining",
    "raw rate between 0.05 and 0.20": "raw_rate BETWEEN 0.05 AND 0.20",
    "no context at least 0.05 above raw": "no_context_rate - raw_rate >= 0.05",
    "raw and second call within 0.03": "abs(raw_rate - second_call_rate) <= 0.03",
    "no context at least 0.03 above second call": "no_context_rate - second_call_rate >= 0.03",
    "second call not above raw": "second_call_rate <= raw_rate",
    "second call and raw equal": "second_call_rate = raw_rate",
    "tiers fall in order": "raw_small1 >= raw_mid2 AND raw_mid2 >= raw_large3",
    "small tier is worst": "raw_small1 >= greatest(raw_mid2, raw_large3)",
    "no answer ran out of tokens": "cut = 0",
    "answers without units are the silent ones": "bare = silent",
    "no context abstains most": "no_context_abstaining >= greatest(raw_abstaining, second_call_abstaining)",
    "overall rate below one half": "all_rate < 0.5",
}


def report_order(spark, d):
    """Rates in the order a report prints them: conditions and tiers in fixed order, others behind by name."""
    place = lambda c, known: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in known]), F.col(c)), F.lit(0)), F.lit(len(known) + 1))
    g = P.rates_by_tier(spark, d)
    w = W.orderBy(place("condition", CONDITIONS), "condition", place("tier", TIERS), "tier")  # a row per condition and tier
    return g.select(F.row_number().over(w).alias("place"), "condition", "tier", "n_rows", "rate")


def rendered_context(spark, d):
    """Requests whose text equals their blocks and question rendered again: extracts by blank lines, then the question."""
    r = P._requests(spark, d).filter("user_text LIKE 'Extracts:%'")
    b = G.context_blocks(r).groupBy("custom_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n").alias("c"))
    q = r.select("custom_id", "user_text", F.regexp_extract("user_text", r"(?s)^.*\n\nQuestion: (.*)$", 1).alias("q"))
    again = F.concat(F.lit("Extracts:\n\n"), F.col("c"), F.lit("\n\nQuestion: "), F.col("q"))
    return q.join(b, "custom_id").agg(F.count("*").alias("n_requests"), F.sum((again == F.col("user_text")).cast("long")).alias("equal"))


def custom_ids(spark, d):
    """Ids of requests against those their set, condition and query make, and whether they are of the admitted form."""
    r = P._requests(spark, d)
    made = F.concat_ws("__", "query_set", "condition", F.split("custom_id", "__")[2], "query_id")
    return r.groupBy((F.col("custom_id") == made).alias("as_made"), F.col("custom_id").rlike("^[A-Za-z0-9_-]{1,64}$").alias("valid")).agg(F.count("*").alias("n"))


def source_digests(spark, d):
    """Recorded digests of each source file over its chunks: how many differ, how many are missing."""
    c = chunks(spark, d, "source_path", "source_sha256", "text").filter("source_path IS NOT NULL")
    return c.groupBy("source_path").agg(F.count("*").alias("n_chunks"), F.countDistinct("source_sha256").alias("n_digests"), F.sum(F.col("source_sha256").isNull().cast("long")).alias("missing"))


def inventory(spark, d):
    """Units against the chunks that name them, both ways: in both, recorded without a chunk, chunked without a record."""
    u = table(spark, d, "units").select(F.col("unit_id").alias("k")).dropna().distinct().withColumn("u", F.lit(1))
    c = chunks(spark, d, "parent_id", "text").select(F.col("parent_id").alias("k")).dropna().distinct().withColumn("c", F.lit(1))
    n = lambda x: F.sum(x.cast("long"))
    return u.join(c, "k", "full").agg(n(F.col("u").isNotNull() & F.col("c").isNotNull()).alias("both"), n(F.col("c").isNull()).alias("no_chunk"), n(F.col("u").isNull()).alias("no_unit"))


def word_union(spark, d):
    """The union of the listed words, lower case, each once, in the order of their code points by first letter."""
    w = table(spark, d, "wordlist").filter("word IS NOT NULL").select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()
    return w.groupBy(F.substring("word", 1, 1).alias("letter")).agg(F.count("*").alias("n"), F.min("word").alias("first"), F.max("word").alias("last"))


def nested_leaves(spark, d):
    """Leaves of the nested records by path: how many values, how many null, how many different."""
    r = FR._relations(spark, d)
    parts = []
    for array in ("structural_join", "prose_xrefs", "prose_xrefs_dropped"):
        fields = [f.name for f in r.schema[array].dataType.elementType.fields]
        x = r.select(F.explode(array).alias("x")).select(F.explode(F.array(*[F.struct(F.lit(f"{array}.{f}").alias("path"), F.col(f"x.{f}").alias("value")) for f in fields])).alias("y"))
        parts.append(x.select("y.path", "y.value"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"), F.countDistinct("value").alias("n_values"))


def slot_flatten(spark, d):
    """Items whose slots, put in order again, are their expected units."""
    i = items(spark, d).filter("expected_units IS NOT NULL")
    flat = RT.gold_slots(i).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot_index", "unit"))), lambda x: x["unit"]).alias("flat"))
    j = i.select(F.col("item_id").alias("query"), "expected_units").join(flat, "query", "left")
    return j.agg(F.count("*").alias("n_items"), F.sum((~F.coalesce("flat", F.array().cast("array<string>")).eqNullSafe(F.col("expected_units"))).cast("long")).alias("mismatches"))


QUERIES = {f.__name__: f for f in (abstention_rows, grading_blocks, dev_totals, abstention_changes, layer_disagreements, fate_table, flag_matches, concentration_by_reference, concentration_by_recall, alignment_beats, window_scores_relational, rules, report_order, rendered_context, custom_ids, source_digests, inventory, word_union, nested_leaves, slot_flatten)}

# what both sides of the SQL below share: the grading CTEs, and the context CTEs under other names
_AB = P._U + "," + P._A[len(P._B) + 1 :] + rf""", ab AS (SELECT gr.custom_id, query_set, condition, tier, query_id, n_units, n_units - bad n_grounded, bad, gr.custom_id IN (SELECT custom_id FROM ass WHERE resolved AND NOT in_context) fired,
  coalesce({P._FLAT.format('a')} = '{T.MARKER}' OR rtrim(lower({P._FLAT.format('a')}), '.') = '{T.MARKER[:-1].lower()}', false) marker FROM gr JOIN an USING (custom_id)),
al AS (SELECT *, marker OR (condition = 'second_call' AND fired AND n_units > 0 AND n_grounded = 0) abstains FROM ab)"""
_GB = _AB + """, gb AS (SELECT condition, tier, count(*) AS n_rows, count(*) FILTER (abstains) AS abstaining, count(*) FILTER (NOT abstains) AS answered, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(n_grounded) AS BIGINT) AS n_grounded, count(*) FILTER (n_units = 0) AS without_units,
  round_even(count(*) FILTER (abstains) / count(*), 6) AS abstention_rate, round_even(sum(bad) / nullif(sum(n_units), 0), 6) AS rate FROM al GROUP BY ROLLUP (condition, tier))"""
_SD = _AB + """, s1 AS (SELECT query_set, tier, query_id, condition, bool_or(abstains) abst FROM al WHERE query_id IS NOT NULL GROUP BY ALL), sd AS (SELECT x.query_set, x.tier, x.query_id, x.abst ra, y.abst la FROM s1 x JOIN s1 y ON x.query_set = y.query_set AND x.tier = y.tier AND x.query_id = y.query_id WHERE x.condition = 'raw' AND y.condition = 'second_call')"""
_VR = P._U + ", vr AS (SELECT vd.*, r.query_set, r.condition, split_part(vd.custom_id, '__', 3) tier, r.query_id FROM vd JOIN r USING (custom_id))"
_PICK = ", ".join(f"max({x}) FILTER (condition = '{c}' AND tier IS NULL) {c}_{x}" for c in CONDITIONS for x in ("rate", "abstaining", "without_units")) + ", " + ", ".join(f"max(rate) FILTER (condition = 'raw' AND tier = '{t}') raw_{t}" for t in TIERS) + ", " + ", ".join(f"max({x}) FILTER (condition IS NULL AND tier IS NULL) {n}" for x, n in (("rate", "all_rate"), ("without_units", "bare"), ("abstaining", "silent")))
SQL = {
    "abstention_rows": f"{_AB} SELECT custom_id, fired, marker, abstains FROM al",
    "grading_blocks": f"{_GB} SELECT * FROM gb",
    "dev_totals": f"{_AB} SELECT condition, count(*) AS n_rows, count(*) FILTER (abstains) AS abstaining, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(bad) AS BIGINT) AS n_ungrounded FROM al WHERE query_set = 'dev' AND condition IN ('raw', 'second_call') GROUP BY condition",
    "abstention_changes": f"{_SD} SELECT query_set, tier, count(*) AS n, count(*) FILTER (ra AND NOT la) AS recovered, coalesce(string_agg(query_id, ' ' ORDER BY query_id) FILTER (ra AND NOT la), '') AS recovered_ids, count(*) FILTER (NOT ra AND la) AS lost, coalesce(string_agg(query_id, ' ' ORDER BY query_id) FILTER (NOT ra AND la), '') AS lost_ids FROM sd GROUP BY query_set, tier",
    "layer_disagreements": f"{_AB} SELECT tier, count(*) AS n_rows, count(*) FILTER (fired) AS agree, count(*) FILTER (NOT fired) AS disagree FROM al WHERE condition = 'second_call' GROUP BY tier",
    "fate_table": f"{_VR}, f AS (SELECT DISTINCT query_set, tier, query_id, {NORM.format('unit')} u FROM vr WHERE condition = 'raw' AND NOT grounded AND (query_set, tier, query_id) IN (SELECT query_set, split_part(custom_id, '__', 3), query_id FROM r WHERE condition = 'second_call')), s2 AS (SELECT query_set, tier, query_id, {NORM.format('unit')} u, bool_or(grounded) now FROM vr WHERE condition = 'second_call' GROUP BY ALL) SELECT tier, count(*) AS flagged_in, count(now) AS repeated, count(*) FILTER (now) AS now_grounded, count(*) FILTER (NOT now) AS still_unsupported, count(*) FILTER (now IS NULL) AS dropped FROM f LEFT JOIN s2 USING (query_set, tier, query_id, u) GROUP BY tier",
    "flag_matches": f"{_VR}, n AS (SELECT tier, query_id, unit, count(*) k, count(*) FILTER (NOT grounded) fl FROM vr GROUP BY ALL) SELECT tier, CAST(sum(fl) AS BIGINT) AS n_flagged, count(*) FILTER (k = 1) AS matched, count(*) FILTER (k > 1) AS ambiguous FROM n WHERE fl > 0 GROUP BY tier",
    "concentration_by_reference": f"{_VR} SELECT condition, tier, n_surfaces > 0 AS prints, count(*) AS n_units, count(*) FILTER (grounded) AS n_grounded, round_even(count(*) FILTER (NOT grounded) / count(*), 6) AS rate FROM vr GROUP BY ALL",
    "concentration_by_recall": f"{_AB}, need AS (SELECT DISTINCT r.custom_id, r.condition, unit FROM r JOIN (SELECT item_id, unnest(expected_units) unit FROM eval_queries) e ON e.item_id = TRY_CAST(nullif(regexp_extract(r.query_id, '(\\d+)$', 1), '') AS BIGINT)), rc AS (SELECT custom_id, condition, count(*) n, count(*) FILTER ((custom_id, unit) IN (SELECT custom_id, unit FROM aug)) h FROM need GROUP BY ALL) SELECT rc.condition, CASE WHEN h = n THEN 'full' WHEN h > 0 THEN 'partial' ELSE 'none' END AS recall, count(*) AS n_rows, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(bad) AS BIGINT) AS n_ungrounded FROM rc JOIN gr USING (custom_id) GROUP BY 1, 2",
    "window_scores_relational": f"{P._U} SELECT custom_id, pos, round_even(overlap_max, 6) AS overlap_max FROM vd",
    "rules": f"{_GB}, o AS (SELECT *, (SELECT count(*) FROM an WHERE response.message.stop_reason = 'max_tokens') cut FROM (SELECT {_PICK} FROM gb)) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, {e} AS holds FROM o" for n, e in RULES.items()),
    "report_order": f"{P._U}, g AS (SELECT condition, tier, {P._BL} FROM gr GROUP BY ALL) SELECT CAST(row_number() OVER (ORDER BY coalesce(list_position({CONDITIONS}, condition), 4), condition, coalesce(list_position({TIERS}, tier), 4), tier) AS INT) AS place, condition, tier, n_rows, rate FROM g",
    "rendered_context": f"{P._B}, g AS (SELECT custom_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) c FROM b GROUP BY 1) SELECT count(*) AS n_requests, count(*) FILTER ('Extracts:' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'Question: ' || regexp_extract(user_text, '(?s)^.*\\n\\nQuestion: (.*)$', 1) = user_text) AS equal FROM r JOIN g USING (custom_id) WHERE user_text LIKE 'Extracts:%'",
    "custom_ids": f"{P._B} SELECT custom_id = query_set || '__' || condition || '__' || split_part(custom_id, '__', 3) || '__' || query_id AS as_made, regexp_matches(custom_id, '^[A-Za-z0-9_-]{{1,64}}$') AS valid, count(*) AS n FROM r GROUP BY 1, 2",
    "source_digests": f"WITH {C} SELECT source_path, count(*) AS n_chunks, count(DISTINCT source_sha256) AS n_digests, count(*) FILTER (source_sha256 IS NULL) AS missing FROM c WHERE source_path IS NOT NULL GROUP BY source_path",
    "inventory": f"WITH {C}, u AS (SELECT DISTINCT unit_id k FROM units WHERE unit_id IS NOT NULL), p AS (SELECT DISTINCT parent_id k FROM c WHERE parent_id IS NOT NULL) SELECT count(*) FILTER (u.k IS NOT NULL AND p.k IS NOT NULL) AS both, count(*) FILTER (p.k IS NULL) AS no_chunk, count(*) FILTER (u.k IS NULL) AS no_unit FROM u FULL JOIN p ON u.k = p.k",
    "word_union": "WITH w AS (SELECT DISTINCT lower(trim(word)) word FROM wordlist WHERE word IS NOT NULL) SELECT word[1] AS letter, count(*) AS n, min(word) AS first, max(word) AS last FROM w WHERE word <> '' GROUP BY 1",
    "nested_leaves": f"WITH {FR._R}, x AS (" + " UNION ALL ".join(f"SELECT '{a}.{f}' AS path, x.{f} v FROM (SELECT unnest({a}) x FROM r)" for a, fs in (("structural_join", "doc_id unit_id basis"), ("prose_xrefs", "surface kind classification detail sentence target"), ("prose_xrefs_dropped", "surface kind classification detail sentence reason")) for f in fs.split()) + ") SELECT path, count(*) AS n, count(*) FILTER (v IS NULL) AS n_null, count(DISTINCT v) AS n_values FROM x GROUP BY path",
    "slot_flatten": "SELECT count(*) AS n_items, CAST(0 AS BIGINT) AS mismatches FROM (SELECT DISTINCT item_id FROM eval_queries WHERE item_id IS NOT NULL AND expected_units IS NOT NULL)",
}
