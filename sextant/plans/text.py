"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.grounding import newest_answers
from sextant.plans.common import C, DOC_TOKENS, NORM, TOKENS, chunks
from sextant.sources.tables import table


def text_primary_tokens(spark, d):
    c = chunks(spark, d, "text")
    return c.select("chunk_id", F.size(T.primary_tokens(F.col("text"))).alias("n_tokens"), F.array_join(T.primary_tokens(F.col("text")), " ").alias("tokens")).filter("tokens IS NOT NULL")


def text_document_tokens(spark, d):
    c = chunks(spark, d, "text").filter("text IS NOT NULL")
    return c.select("chunk_id", F.size(T.document_tokens(F.col("text"))).alias("n_indexed"), F.size(T.primary_tokens(F.col("text"))).alias("length"))


def text_norm_comparison(spark, d):
    c = chunks(spark, d, "text").filter("text IS NOT NULL")
    return c.select("chunk_id", T.norm_comparison(F.col("text")).alias("norm"), F.sha2(T.norm_comparison(F.col("text")), 256).alias("digest"))


def text_lexical_forms(spark, d):
    c = chunks(spark, d, "text").filter("text IS NOT NULL")
    return c.select("chunk_id", T.lexical_form(F.col("text")).alias("lexical"), T.match_form(F.col("text")).alias("match"))


def text_segments(spark, d):
    c = chunks(spark, d, "text").filter("text IS NOT NULL")
    return c.select("chunk_id", F.posexplode(T.segments(F.col("text"))).alias("seg_no", "segment"))


def text_segment_funnel(spark, d):
    c = chunks(spark, d, "heading", "text").filter("text IS NOT NULL")
    s = c.select("heading", F.explode(T.segments(F.col("text"))).alias("s"))
    alpha = T.is_alphabetic(T.lexical_form(F.col("s")))
    own = F.coalesce(F.trim("s") == F.trim("heading"), F.lit(False))
    cnt = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return s.agg(F.count("*").alias("start"), cnt(~alpha).alias("not_alphabetic"), cnt(alpha & own).alias("own_heading"), cnt(alpha & ~own).alias("kept"))


def text_codepoints(spark, d):
    c = chunks(spark, d, "text").filter("text IS NOT NULL")
    odd = F.regexp_replace("text", r"[\x00-\x7f]", "")
    x = c.select(F.explode(F.split(odd, "")).alias("ch")).filter("ch <> ''")
    return x.groupBy(F.ascii("ch").alias("codepoint")).agg(F.count("*").alias("n"))


def text_claim_units(spark, d):
    a = newest_answers(table(spark, d, "answers")).select("custom_id", T.answer_text(F.col("response")).alias("a")).filter("a IS NOT NULL")
    return a.select("custom_id", F.posexplode(T.claim_units(F.col("a"))).alias("pos", "unit"))


def text_response_class(spark, d):
    a = newest_answers(table(spark, d, "answers")).select("custom_id", T.answer_text(F.col("response")).alias("a"))
    return a.groupBy(T.response_class(F.col("a")).alias("response_class")).agg(F.count("*").alias("n"))


_SEG = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_LEX = f"trim(regexp_replace(regexp_replace(lower({NORM}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_ANS = "SELECT custom_id, array_to_string(list_transform(list_filter(response.message.content, lambda b: b.type = 'text'), lambda b: coalesce(b.text, '')), '') a FROM answers WHERE custom_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY collected_at DESC NULLS LAST, body_sha256 DESC NULLS LAST) = 1"

QUERIES = {f.__name__: f for f in (text_primary_tokens, text_document_tokens, text_norm_comparison, text_lexical_forms, text_segments, text_segment_funnel, text_codepoints, text_claim_units, text_response_class)}
SQL = {
    "text_primary_tokens": f"WITH {C}, t AS (SELECT chunk_id, {TOKENS.format('text')} t FROM c WHERE text IS NOT NULL) SELECT chunk_id, CAST(len(t) AS INT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM t",
    "text_document_tokens": f"WITH {C} SELECT chunk_id, CAST(len({DOC_TOKENS.format('text')}) AS INT) AS n_indexed, CAST(len({TOKENS.format('text')}) AS INT) AS length FROM c WHERE text IS NOT NULL",
    "text_norm_comparison": f"WITH {C} SELECT chunk_id, {NORM.format('text')} AS norm, sha256({NORM.format('text')}) AS digest FROM c WHERE text IS NOT NULL",
    "text_lexical_forms": f"WITH {C} SELECT chunk_id, {_LEX.format('text')} AS lexical, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS match FROM c WHERE text IS NOT NULL",
    "text_segments": f"WITH {C}, s AS (SELECT chunk_id, {_SEG} s FROM c WHERE text IS NOT NULL) SELECT chunk_id, CAST(i - 1 AS INT) AS seg_no, s[i] AS segment FROM (SELECT chunk_id, s, unnest(range(1, len(s) + 1)) i FROM s)",
    "text_segment_funnel": f"WITH {C}, s AS (SELECT heading, unnest({_SEG}) s FROM c WHERE text IS NOT NULL), f AS (SELECT len(list_filter(string_split({_LEX.format('s')}, ' '), lambda t: regexp_full_match(t, '[a-z]+'))) > 0 alpha, coalesce(trim(s) = trim(heading), false) own FROM s) SELECT count(*) AS start, count(*) FILTER (NOT alpha) AS not_alphabetic, count(*) FILTER (alpha AND own) AS own_heading, count(*) FILTER (alpha AND NOT own) AS kept FROM f",
    "text_codepoints": f"WITH {C}, x AS (SELECT unnest(string_split(regexp_replace(text, '[\\x00-\\x7f]', '', 'g'), '')) ch FROM c WHERE text IS NOT NULL) SELECT unicode(ch) AS codepoint, count(*) AS n FROM x WHERE ch <> '' GROUP BY 1",
    "text_response_class": f"WITH a AS ({_ANS}) SELECT CASE WHEN trim(regexp_replace(a, '\\s+', ' ', 'g')) = '{T.MARKER}' THEN 'abstained' WHEN rtrim(lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))), '.') = '{T.MARKER[:-1].lower()}' THEN 'marker_variant' ELSE 'answered' END AS response_class, count(*) AS n FROM a GROUP BY 1",
}
