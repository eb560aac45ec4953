"""Queries of problem 7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import orphans as O
from sextant.sources.tables import table


def _inputs(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("relations", "found_references", "answers", "units", "requests")]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(*_inputs(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("source_table", "period", "reason").agg(F.count("*").alias("n_orphans"))


def p7_current_orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.current_orphans(O.reference_state(*_inputs(spark, d)))


_FOUND = r"""
WITH u AS (SELECT DISTINCT unit_id, added_at, deleted_at FROM units WHERE unit_id IS NOT NULL),
r AS (SELECT DISTINCT relation_id, unit_id, structural_join, prose_xrefs, prose_xrefs_dropped, recorded_at FROM relations),
s AS (
  SELECT DISTINCT * FROM (
    SELECT 'relations.structural_join' source_table, relation_id, x.unit_id ref, x.unit_id k, recorded_at t FROM (SELECT relation_id, recorded_at, unnest(structural_join) x FROM r)
    UNION ALL SELECT 'relations.prose_xrefs', relation_id, x.target, x.target, recorded_at FROM (SELECT relation_id, recorded_at, unnest(prose_xrefs) x FROM r)
    UNION ALL SELECT 'relations.prose_xrefs_dropped', relation_id, x.surface,
      CASE WHEN regexp_matches(x.surface, '^(?i)(art|ann|anx|rec|rct|sec|act)')
        THEN split_part(unit_id, ':', 1) || ':' || CASE lower(left(x.surface, 3)) WHEN 'ann' THEN 'anx' WHEN 'rec' THEN 'rct' ELSE lower(left(x.surface, 3)) END || '_' || upper(regexp_extract(regexp_replace(x.surface, '\([^)]*\)', '', 'g'), '^[A-Za-z]+\.?\s*(\S+)\s*$', 1))
        ELSE split_part(unit_id, ':', 1) || ':sub_' || upper(regexp_extract(x.surface, '^([A-Za-z]+)', 1)) || '_' || regexp_extract(regexp_replace(x.surface, '\([^)]*\)', '', 'g'), '^[A-Za-z]+\.?\s*(\S+)\s*$', 1) END,
      recorded_at FROM (SELECT relation_id, unit_id, recorded_at, unnest(prose_xrefs_dropped) x FROM r) WHERE x.classification = 'internal')
  WHERE ref IS NOT NULL),
s1 AS (SELECT source_table, CAST(relation_id AS VARCHAR) source_key, ref, t,
   COALESCE(bool_or(u.added_at <= t AND (u.deleted_at IS NULL OR u.deleted_at > t)), false) live, COALESCE(bool_or(u.added_at > t), false) late, COALESCE(bool_or(u.deleted_at <= t), false) gone
  FROM s LEFT JOIN u ON u.unit_id = s.k GROUP BY ALL),
f AS (SELECT DISTINCT reference_id, surface, seen_at t, candidates FROM found_references WHERE len(candidates) > 0),
f1 AS (SELECT reference_id, surface, t, unnest(candidates) k FROM f),
f2 AS (SELECT 'found_references' source_table, CAST(reference_id AS VARCHAR) source_key, surface ref, t,
   COALESCE(bool_or(u.added_at <= t AND (u.deleted_at IS NULL OR u.deleted_at > t)), false) live, COALESCE(bool_or(u.added_at > t), false) late, COALESCE(bool_or(u.deleted_at <= t), false) gone
  FROM f1 LEFT JOIN u ON u.unit_id = f1.k GROUP BY ALL),
a AS (SELECT 'answers' source_table, custom_id source_key, custom_id ref, min(collected_at) t FROM answers WHERE custom_id IS NOT NULL AND custom_id NOT IN (SELECT custom_id FROM requests WHERE custom_id IS NOT NULL) GROUP BY custom_id)
SELECT source_table, source_key, ref, CASE WHEN late THEN 'late' WHEN gone THEN 'deleted' ELSE 'missing' END reason, strftime(t, '%Y-%m') AS period FROM (SELECT * FROM s1 UNION ALL SELECT * FROM f2) WHERE NOT live
UNION ALL SELECT source_table, source_key, ref, 'missing', strftime(t, '%Y-%m') FROM a
"""

_STATE = r"""
WITH r AS (SELECT DISTINCT relation_id, unit_id, structural_join, prose_xrefs, prose_xrefs_dropped, recorded_at FROM relations),
s AS (SELECT DISTINCT * FROM (
    SELECT 1 src, relation_id, x.unit_id ref, x.unit_id k, recorded_at FROM (SELECT relation_id, recorded_at, unnest(structural_join) x FROM r)
    UNION ALL SELECT 2, relation_id, x.target, x.target, recorded_at FROM (SELECT relation_id, recorded_at, unnest(prose_xrefs) x FROM r)
    UNION ALL SELECT 3, relation_id, x.surface,
      split_part(unit_id, ':', 1) || ':' || CASE lower(left(x.surface, 3)) WHEN 'ann' THEN 'anx' WHEN 'rec' THEN 'rct' ELSE lower(left(x.surface, 3)) END || '_' || upper(regexp_extract(regexp_replace(x.surface, '\([^)]*\)', '', 'g'), '^[A-Za-z]+\.?\s*(\S+)\s*$', 1)),
      recorded_at FROM (SELECT relation_id, unit_id, recorded_at, unnest(prose_xrefs_dropped) x FROM r) WHERE x.classification = 'internal') WHERE ref IS NOT NULL),
refs AS (SELECT k FROM s UNION ALL SELECT k FROM (SELECT unnest(list_distinct(candidates)) k FROM (SELECT DISTINCT reference_id, surface, seen_at, candidates FROM found_references WHERE len(candidates) > 0)) UNION ALL SELECT DISTINCT custom_id FROM answers),
ex AS (SELECT unit_id k, 1 d FROM (SELECT DISTINCT unit_id, added_at FROM units WHERE added_at IS NOT NULL) UNION ALL SELECT unit_id, -1 FROM (SELECT DISTINCT unit_id, deleted_at FROM units WHERE deleted_at IS NOT NULL) UNION ALL SELECT custom_id, 1 FROM (SELECT DISTINCT custom_id FROM requests)),
n AS (SELECT k, sum(a) nr, sum(b) ne FROM (SELECT k, 1 a, 0 b FROM refs WHERE k IS NOT NULL UNION ALL SELECT k, 0, d FROM ex WHERE k IS NOT NULL) GROUP BY k)
SELECT k AS key, CAST(nr AS BIGINT) AS n_references, CAST(ne AS BIGINT) AS n_existing FROM n WHERE nr > 0 AND ne <= 0
"""

QUERIES = {"p7_found": p7_found, "p7_report": p7_report, "p7_current_orphans": p7_current_orphans}
SQL = {
    "p7_found": _FOUND,
    "p7_report": f"SELECT source_table, period, reason, count(*) AS n_orphans FROM ({_FOUND}) GROUP BY ALL",
    "p7_current_orphans": _STATE,
}
