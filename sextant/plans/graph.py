"""Units, equivalence classes, relations and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import graph as G
from sextant.plans.common import C, NORM, chunks
from sextant.runtime import materialise
from sextant.sources.tables import table


def _norm_groups(spark, d):
    c = chunks(spark, d, "text").filter("text IS NOT NULL").select("chunk_id", F.sha2(T.norm_comparison(F.col("text")), 256).alias("key"))
    g = c.groupBy("key").agg(F.min("chunk_id").alias("representative"), F.count("*").alias("n")).filter("n > 1")
    return c, g


def verbatim_groups(spark, d):
    _, g = _norm_groups(spark, d)
    return g.select("representative", "n")


def verbatim_members(spark, d):
    c, g = _norm_groups(spark, d)
    return c.join(g, "key").select("representative", F.col("chunk_id").alias("member"))


def verbatim_sizes(spark, d):
    _, g = _norm_groups(spark, d)
    return g.groupBy(F.col("n").alias("size")).agg(F.count("*").alias("n_groups"))


def unit_index(spark, d):
    """Chunks of each unit in order, with a check that they agree on document and type."""
    c = chunks(spark, d, "parent_id", "doc_id", "unit_type", "seq", "text")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(0)).alias("s"), "chunk_id"))), lambda x: x["chunk_id"]), " ")
    return c.groupBy("parent_id").agg(F.min("doc_id").alias("doc"), F.min("unit_type").alias("unit_type"), ordered.alias("chunks"), ((F.countDistinct("doc_id") <= 1) & (F.countDistinct("unit_type") <= 1)).alias("consistent"))


def unit_cardinality(spark, d):
    c = chunks(spark, d, "parent_id", "unit_type", "text")
    n = c.groupBy("parent_id").agg(F.count("*").alias("n_chunks"), F.min("unit_type").alias("unit_type"))
    return n.groupBy("unit_type", "n_chunks").agg(F.count("*").alias("n_units"))


def unit_tokens(spark, d):
    """Token distribution by document and overall, with what exceeds the cap."""
    c = chunks(spark, d, "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.size(T.primary_tokens(F.col("text"))).alias("n"))
    return c.groupingSets([[F.col("doc_id")], []], F.col("doc_id")).agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.bround(F.sum("n") / F.count("*"), 6).alias("mean"), F.sum((F.col("n") > 400).cast("long")).alias("over_cap"))


def _edges(spark, d):
    r = table(spark, d, "relations").select("unit_id", F.explode("structural_join").alias("x"))
    return r.select(F.col("unit_id").alias("a"), F.col("x.unit_id").alias("b"), F.col("x.basis").alias("basis")).dropna(subset=["a", "b"]).distinct()


def _equivalent(spark, d):
    """Edges between units: structural joins, and units of verbatim chunks."""
    c, g = _norm_groups(spark, d)
    v = c.join(g, "key").select(T.unit_of(F.col("representative")).alias("a"), T.unit_of(F.col("chunk_id")).alias("b"))
    return _edges(spark, d).filter("basis = 'same statement'").select("a", "b").unionByName(v).filter("a <> b")


def carrier_classes(spark, d):
    return G.components(_equivalent(spark, d))


def carrier_class_sizes(spark, d):
    s = G.components(_equivalent(spark, d)).groupBy("component").agg(F.count("*").alias("size"))
    return s.groupBy("size").agg(F.count("*").alias("n_classes"))


def frame_closure(spark, d):
    """Units reachable from the expected units of the evaluation items over equivalence edges."""
    seeds = table(spark, d, "eval_queries").select(F.explode("expected_units").alias("node"))
    return G.closure(seeds, _equivalent(spark, d))


def gold_in_closure(spark, d):
    gold = table(spark, d, "eval_queries").select("item_id", F.explode("expected_units").alias("unit")).distinct()
    dup = G.components(_equivalent(spark, d)).select(F.col("node").alias("unit"), "component")
    return gold.join(dup, "unit").groupBy("component").agg(F.countDistinct("item_id").alias("n_queries")).filter("n_queries > 1")


def relation_symmetry(spark, d):
    """Structural edges and how many have no edge back, by basis."""
    e = _edges(spark, d)
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().withColumn("back", F.lit(True))
    return e.join(back, ["a", "b"], "left").groupBy("basis").agg(F.count("*").alias("n_edges"), F.sum(F.col("back").isNull().cast("long")).alias("one_way"))


def relation_dangling(spark, d):
    e = _edges(spark, d)
    u = table(spark, d, "units").select(F.col("unit_id").alias("b")).distinct()
    return e.join(u, "b", "left_anti").groupBy("b").agg(F.count("*").alias("n"))


def relation_positions(spark, d):
    """For each evaluation pick: whether its verbatim group includes, excludes or is silent about a chunk of the expected unit."""
    ex = table(spark, d, "near_duplicate_exceptions").select(F.col("query").alias("pick"), F.col("returned").alias("other")).dropna().distinct()
    c, g = _norm_groups(spark, d)
    m = c.join(g.select("key"), "key")
    a = m.select(F.col("chunk_id").alias("pick"), F.col("key").alias("ka"))
    b = m.select(F.col("chunk_id").alias("other"), F.col("key").alias("kb"))
    j = ex.join(a, "pick", "left").join(b, "other", "left")
    pos = F.when(F.col("ka").isNull(), "SILENT").when(F.col("ka") == F.col("kb"), "INCLUDES").otherwise("EXCLUDES")
    return j.select("pick", "other", pos.alias("position"))


def nominated(spark, d):
    """Other members of a chunk's verbatim group, and whether they stand in another document."""
    c, g = _norm_groups(spark, d)
    m = c.join(g, "key").select("representative", "chunk_id")
    r = m.filter(F.col("chunk_id") != F.col("representative"))
    doc = lambda x: F.substring_index(x, ":", 1)
    return r.select("representative", F.col("chunk_id").alias("nominee"), (doc(F.col("chunk_id")) != doc(F.col("representative"))).alias("cross_document"))


def duplication_map(spark, d):
    """Statements (8 words or more) of one chunk standing whole in a chunk of another document."""
    t = chunks(spark, d, "doc_id", "text").filter("text IS NOT NULL").select("chunk_id", "doc_id", T.match_form(F.col("text")).alias("m"))
    rep = materialise(t.groupBy("doc_id", "m").agg(F.min("chunk_id").alias("chunk_id")).filter(F.size(F.split("m", " ")) >= 8))
    pairs = G.contained(rep.groupBy("m").agg(F.min("chunk_id").alias("id")))
    place = rep.join(rep.groupBy("m").agg(F.min("chunk_id").alias("id")), "m").select("id", "doc_id", "chunk_id")
    p, h = (place.select(F.col("id").alias(i), F.col("doc_id").alias(f"{i}d"), F.col("chunk_id").alias(n)) for i, n in (("inner", "source"), ("outer", "holder")))
    j = pairs.join(p, "inner").join(h, "outer").filter(F.col("innerd") != F.col("outerd"))
    return j.select("source", "holder", (F.col("inner") == F.col("outer")).alias("whole"))


_NG = f"WITH RECURSIVE {C}, k AS (SELECT chunk_id, sha256({NORM.format('text')}) key FROM c WHERE text IS NOT NULL), g AS (SELECT key, min(chunk_id) representative, count(*) n FROM k GROUP BY key HAVING count(*) > 1)"
_E = _NG + """, rel AS (SELECT DISTINCT unit_id a, x.unit_id b, x.basis basis FROM (SELECT unit_id, unnest(structural_join) x FROM relations) WHERE unit_id IS NOT NULL AND x.unit_id IS NOT NULL),
eq AS (SELECT a, b FROM rel WHERE basis = 'same statement' AND a <> b UNION SELECT split_part(representative, '#', 1), split_part(chunk_id, '#', 1) FROM k JOIN g USING (key) WHERE split_part(representative, '#', 1) <> split_part(chunk_id, '#', 1)),
e2 AS (SELECT a, b FROM eq UNION SELECT b, a FROM eq)"""
_CC = _E + ", reach(node, other) AS (SELECT a, a FROM e2 UNION SELECT reach.node, e2.b FROM reach JOIN e2 ON e2.a = reach.other), cc AS (SELECT node, min(other) component FROM reach GROUP BY node)"

QUERIES = {f.__name__: f for f in (verbatim_groups, verbatim_members, verbatim_sizes, unit_index, unit_cardinality, unit_tokens, carrier_classes, carrier_class_sizes, frame_closure, gold_in_closure, relation_symmetry, relation_dangling, relation_positions, nominated, duplication_map)}
from sextant.plans.common import TOKENS  # noqa: E402

SQL = {
    "verbatim_groups": f"{_NG} SELECT representative, n FROM g",
    "verbatim_members": f"{_NG} SELECT representative, chunk_id AS member FROM k JOIN g USING (key)",
    "verbatim_sizes": f"{_NG} SELECT n AS size, count(*) AS n_groups FROM g GROUP BY n",
    "unit_index": f"WITH {C} SELECT parent_id, min(doc_id) AS doc, min(unit_type) AS unit_type, string_agg(chunk_id, ' ' ORDER BY coalesce(seq, 0), chunk_id) AS chunks, count(DISTINCT doc_id) <= 1 AND count(DISTINCT unit_type) <= 1 AS consistent FROM c GROUP BY parent_id",
    "unit_cardinality": f"WITH {C}, n AS (SELECT parent_id, count(*) n_chunks, min(unit_type) unit_type FROM c GROUP BY parent_id) SELECT unit_type, n_chunks, count(*) AS n_units FROM n GROUP BY ALL",
    "unit_tokens": f"WITH {C}, t AS (SELECT doc_id, CAST(len({TOKENS.format('text')}) AS INT) n FROM c WHERE text IS NOT NULL) SELECT doc_id, count(*) AS chunks, min(n) AS least, max(n) AS most, round_even(sum(n) / count(*), 6) AS mean, count(*) FILTER (n > 400) AS over_cap FROM t GROUP BY GROUPING SETS ((doc_id), ())",
    "carrier_classes": f"{_CC} SELECT node, component FROM cc",
    "carrier_class_sizes": f"{_CC}, s AS (SELECT component, count(*) size FROM cc GROUP BY component) SELECT size, count(*) AS n_classes FROM s GROUP BY size",
    "frame_closure": f"{_E}, seeds AS (SELECT DISTINCT unnest(expected_units) node FROM eval_queries), walk(node, depth) AS (SELECT node, 0 FROM seeds WHERE node IS NOT NULL UNION SELECT e2.b, walk.depth + 1 FROM walk JOIN e2 ON e2.a = walk.node WHERE walk.depth < 30) SELECT node, min(depth) AS depth FROM walk GROUP BY node",
    "gold_in_closure": f"{_CC} SELECT component, count(DISTINCT item_id) AS n_queries FROM (SELECT DISTINCT item_id, unnest(expected_units) u FROM eval_queries) JOIN cc ON cc.node = u GROUP BY component HAVING count(DISTINCT item_id) > 1",
    "relation_symmetry": f"{_E} SELECT basis, count(*) AS n_edges, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rel q WHERE q.a = rel.b AND q.b = rel.a)) AS one_way FROM rel GROUP BY basis",
    "relation_dangling": f"{_E} SELECT b, count(*) AS n FROM rel WHERE b NOT IN (SELECT unit_id FROM units WHERE unit_id IS NOT NULL) GROUP BY b",
    "relation_positions": f"{_NG}, m AS (SELECT chunk_id, key FROM k WHERE key IN (SELECT key FROM g)) SELECT e.query AS pick, e.returned AS other, CASE WHEN a.key IS NULL THEN 'SILENT' WHEN a.key = b.key THEN 'INCLUDES' ELSE 'EXCLUDES' END AS position FROM (SELECT DISTINCT query, returned FROM near_duplicate_exceptions WHERE query IS NOT NULL AND returned IS NOT NULL) e LEFT JOIN m a ON a.chunk_id = e.query LEFT JOIN m b ON b.chunk_id = e.returned",
    "nominated": f"{_NG} SELECT representative, chunk_id AS nominee, split_part(chunk_id, ':', 1) <> split_part(representative, ':', 1) AS cross_document FROM k JOIN g USING (key) WHERE chunk_id <> representative",
    "duplication_map": f"WITH {C}, t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) m, min(chunk_id) chunk_id FROM c WHERE text IS NOT NULL GROUP BY ALL) SELECT p.chunk_id AS source, h.chunk_id AS holder, p.m = h.m AS whole FROM t p JOIN t h ON p.doc_id <> h.doc_id AND contains(' ' || h.m || ' ', ' ' || p.m || ' ') WHERE len(string_split(p.m, ' ')) >= 8",
}
