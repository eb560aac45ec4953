"""Queries on printed references, citations, terms and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import grounding as G
from sextant.operators import references as R
from sextant.operators import retrieval as RT
from sextant.operators.ingest import line_class
from sextant.plans import frames as FR
from sextant.plans import grounding as P
from sextant.plans import retrieval as PR
from sextant.plans.common import C, NORM, chunks, units
from sextant.runtime import materialise, running_total


def _sources(spark, d):
    """What a request's references are read from: its question (source -1) and its blocks."""
    r = P._requests(spark, d)
    q = r.select("custom_id", F.lit(-1).alias("source"), F.lit(None).cast("string").alias("doc"), F.regexp_extract("user_text", r"(?s)(?:^|.*\n)Question:\s*(.*)$", 1).alias("t"))
    b = G.context_blocks(r).select("custom_id", F.col("pos").alias("source"), F.substring_index("unit_id", ":", 1).alias("doc"), F.col("block").alias("t"))
    return q.unionByName(b)


def printed_references(spark, d):
    """Every printed reference of a request's question and blocks with its place, external ones marked."""
    return R.printed(_sources(spark, d), ["custom_id", "source"], "t")


def resolved_references(spark, d):
    """Units each request refers to, first place first: a block's references stand in its document, a question's in any."""
    x = R.printed(_sources(spark, d), ["custom_id", "source", "doc"], "t").filter("NOT external")
    named = x.select("custom_id", "source", "doc", "start", R.unit_name(F.col("kind"), F.col("surface")).alias("name"))
    u = units(spark, d).select(F.col("unit_id").alias("unit"), F.substring_index("unit_id", ":", 1).alias("d"), F.element_at(F.split("unit_id", ":"), 2).alias("name"))
    hit = named.join(u, "name").filter(F.col("doc").isNull() | (F.col("doc") == F.col("d")))
    return hit.groupBy("custom_id", "unit").agg(F.min(F.struct("source", "start")).alias("f")).select("custom_id", "unit", F.col("f.source").alias("source"), F.col("f.start").alias("start"))


def citation_precedence(spark, d):
    """Dropped citations read by precedence: self, external by the next words, amending sentence, sentence of an instrument, internal."""
    x = FR._relations(spark, d).select("unit_id", F.explode("prose_xrefs_dropped").alias("x")).select("unit_id", "x.surface", "x.sentence").filter("surface IS NOT NULL AND sentence IS NOT NULL")
    behind = F.expr("left(substring_index(concat(sentence, ' '), surface, -1), 90)")
    own = F.regexp_extract("unit_id", r"_(\S+)$", 1)
    kind = (
        F.when(F.regexp_extract("surface", r"(\S+)$", 1) == own, "self").when(behind.rlike(R.QUALIFIER), "external")
        .when(F.col("sentence").rlike(r"(?i)\bis (amended|replaced) as follows"), "amending").when(F.col("sentence").rlike(r"\b(Directive|Treaty|Convention) "), "instrument").otherwise("internal")
    )
    return x.groupBy(kind.alias("read_as")).agg(F.count("*").alias("n"))


def reference_buckets(spark, d):
    """Chunks by how many references they print, and the least, median and most."""
    n = chunks(spark, d, "text").filter("text IS NOT NULL").select(F.size(G.surfaces(F.col("text"))).alias("n"))
    b = F.when(F.col("n") == 0, "0").when(F.col("n") <= 2, "1-2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").otherwise("11+")
    return n.groupBy(b.alias("bucket")).agg(F.count("*").alias("n_chunks"), F.min("n").alias("least"), F.bround(F.percentile("n", F.lit(0.5)), 6).alias("median"), F.max("n").alias("most"))


def masked_references(spark, d):
    """References of a chunk's text, with and without those inside its own printed label."""
    c = chunks(spark, d, "unit_label", "text").filter("text IS NOT NULL AND unit_label IS NOT NULL AND unit_label <> ''")
    bare = F.replace(F.col("text"), F.col("unit_label"), F.lit("\x01"))
    return c.select("chunk_id", F.size(G.surfaces(F.col("text"))).alias("n_all"), F.size(G.surfaces(bare)).alias("n_masked"))


def self_contained(spark, d):
    """Units by type: all chunks without references beyond their own label, so that they can be read alone."""
    m = masked_references(spark, d).join(chunks(spark, d, "parent_id", "unit_type", "text").select("chunk_id", "parent_id", "unit_type"), "chunk_id")
    u = m.groupBy("parent_id").agg(F.max("n_masked").alias("n"), F.min("unit_type").alias("unit_type"))
    return u.groupBy("unit_type").agg(F.count("*").alias("n_units"), F.sum((F.col("n") == 0).cast("long")).alias("self_contained"))


def term_occurrence(spark, d):
    """Quoted terms and the chunks they stand in, whatever their case: met by their first word, then looked up whole."""
    c = chunks(spark, d, "text").filter("text IS NOT NULL").select("chunk_id", F.lower("text").alias("t"))
    terms = FR.quoted_terms(spark, d).select("term", F.regexp_extract("term", r"([a-z0-9]+)", 1).alias("w")).filter("w <> ''")
    words = c.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("([a-z0-9]+)"), 1))).alias("w"))
    met = terms.join(words, "w").select("term", "chunk_id").distinct()
    return met.join(c, "chunk_id").filter(F.col("t").contains(F.col("term"))).groupBy("term").agg(F.count("*").alias("n_chunks"))


def action_parents(spark, d):
    """Actions and the subcategory their number names, with whether that unit exists: its first letters and number agree."""
    u = units(spark, d).select("unit_id", "unit_type", F.substring_index("unit_id", ":", 1).alias("doc"))
    a = u.filter("unit_type = 'action'").select("unit_id", "doc", F.regexp_extract("unit_id", r":act_([A-Z]{2})-", 1).alias("p"), F.regexp_extract("unit_id", r":act_[A-Z]{2}-(\d+\.\d+)-", 1).alias("n"))
    s = u.filter("unit_type = 'subcategory'").select(F.col("unit_id").alias("parent"), "doc", F.regexp_extract("unit_id", r":sub_([A-Z]{2})", 1).alias("p"), F.regexp_extract("unit_id", r"_(\d+\.\d+)$", 1).alias("n"))
    return a.join(s, ["doc", "p", "n"], "left").groupBy("unit_id").agg(F.min("parent").alias("parent"), F.count("parent").alias("n_parents"))


def units_without_copies(spark, d):
    """Articles, sections and subcategories no chunk of which stands word for word elsewhere, by type."""
    c = chunks(spark, d, "unit_type", "text").filter("text IS NOT NULL").select("chunk_id", "unit_type", F.sha2(T.norm_comparison(F.col("text")), 256).alias("key"))
    twice = c.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    bad = c.join(twice, "key", "left_semi").select(T.unit_of(F.col("chunk_id")).alias("unit")).distinct()
    u = c.filter(F.col("unit_type").isin("article", "section", "subcategory")).select(T.unit_of(F.col("chunk_id")).alias("unit"), "unit_type").distinct()
    return u.join(bad, "unit", "left_anti").groupBy("unit_type").agg(F.count("*").alias("n_units"))


def unit_slices(spark, d):
    """Stretches of a document from one heading line to the next: the heading, its first line, lines and characters.

    Headings are numbered along the document by a range sort; lines before the first one are slice 0.
    """
    x = FR._lines(spark, d).filter("doc_id IS NOT NULL").select("doc_id", "line_id", "text", (line_class(F.col("text")) == "heading").alias("anchor"))
    n = materialise(running_total(x, ["doc_id"], [F.col("line_id")], F.coalesce(F.col("anchor").cast("long"), F.lit(0)), "slice"))
    return n.groupBy("doc_id", "slice").agg(F.max(F.when(F.col("anchor"), F.trim("text"))).alias("heading"), F.min("line_id").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def soft_hyphens(spark, d):
    """Soft breaks of each document's lines: how many, at line ends or inside, and the characters left once they are joined."""
    x = FR._lines(spark, d)
    n = F.length("text") - F.length(F.translate("text", "\xad￾", ""))
    end = F.col("text").rlike("[\xad￾]$").cast("long")
    return x.groupBy("doc_id").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_breaks"), F.coalesce(F.sum(end), F.lit(0)).alias("at_end"), F.coalesce(F.sum(F.length("text") - n), F.lit(0)).alias("chars_joined")).filter("n_breaks > 0")


def cited_sentences(spark, d):
    """Sentences of the chunks' texts, cut behind a full stop or semicolon before a capital, with their place in the text."""
    c = chunks(spark, d, "text").filter("text IS NOT NULL")
    cut = r"(?<=[.;])\s+(?=[A-Z‘“(])|\n+"
    parts = F.split("text", cut, -1)
    gaps = F.regexp_extract_all("text", F.lit(f"({cut})"), 1)
    total = lambda a, k: F.aggregate(F.slice(a, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
    x = c.select("chunk_id", F.posexplode(F.transform(parts, lambda s, i: F.struct((total(parts, i) + total(gaps, i)).alias("start"), s.alias("s")))).alias("no", "x"))
    return x.filter(F.trim("x.s") != "").select("chunk_id", "no", "x.start", F.length("x.s").alias("n_chars"), F.md5("x.s").alias("digest"))


def rank_stability(spark, d):
    """Two scorings of the same queries: how many documents stand in one top 10 only, and in how many queries only the order differs."""
    a, b = (RT.ranked(x, RT.TOP).select("query", "doc", F.col("rank").alias(n)) for x, n in zip(PR._both(spark, d), ("ra", "rb")))
    j = a.join(b, ["query", "doc"], "full").groupBy("query").agg(F.sum((F.col("ra").isNull() | F.col("rb").isNull()).cast("long")).alias("members"), F.sum((F.col("ra") != F.col("rb")).cast("long")).alias("moved"))
    return j.agg(F.count("*").alias("n_queries"), F.sum("members").alias("in_one_only"), F.sum((F.col("members") > 0).cast("long")).alias("membership_differs"), F.sum(((F.col("members") == 0) & (F.col("moved") > 0)).cast("long")).alias("order_differs"))


QUERIES = {f.__name__: f for f in (printed_references, resolved_references, citation_precedence, reference_buckets, masked_references, self_contained, term_occurrence, action_parents, units_without_copies, unit_slices, soft_hyphens, cited_sentences, rank_stability)}


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_SRC = P._B + r", src AS (SELECT custom_id, -1 source, NULL doc, regexp_extract(user_text, '(?s)(?:^|.*\n)Question:\s*(.*)$', 1) t FROM r UNION ALL SELECT custom_id, pos, split_part(unit_id, ':', 1), block FROM b)"
_SRC += ", pr AS (" + " UNION ALL ".join(
    rf"""SELECT custom_id, source, doc, t, '{k}' kind, m[i] surface, CAST(list_sum([0] || list_transform(p[1:i], lambda x: length(x))) + list_sum([0] || list_transform(m[1:i - 1], lambda x: length(x))) AS INT) AS start
FROM (SELECT *, unnest(range(1, len(m) + 1)) i FROM (SELECT custom_id, source, doc, t, regexp_extract_all(t, '{p}') m, string_split_regex(t, '{p}') p FROM src WHERE t IS NOT NULL))""" for k, p in R.GRAMMAR
) + rf"), px AS (SELECT *, kind IN ('art', 'anx', 'rct', 'sec') AND regexp_matches(substr(t, start + length(surface) + 1, {R.LOOKAHEAD}), '{R.QUALIFIER}') AS external FROM pr)"
_NAME = r"""kind || '_' || CASE kind WHEN 'act' THEN left(surface, 2) || '-' || regexp_extract(surface, '\d+\.\d+') || '-' || right(surface, 3) WHEN 'sub' THEN regexp_extract(surface, '^[A-Z]+') || '_' || regexp_extract(surface, '\S+$')
ELSE CASE WHEN regexp_matches(surface, '\s[IVXLC]+$') THEN CAST((SELECT r.v FROM rom r WHERE r.s = regexp_extract(surface, '[IVXLC]+$')) AS VARCHAR) ELSE regexp_extract(surface, '\S+$') END END"""
_ROM = ", rom AS (SELECT v, repeat('C', CAST(v // 100 AS INT)) || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[v % 100 // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[v % 10 + 1] s FROM (SELECT unnest(range(1, 200)) v))"
_SURF = P._S.replace("(block", "(text")
_MASK = P._S.replace("(block", "(replace(text, unit_label, chr(1))")
_Q = "[“«]([^”»]{3,60})[”»]"
SQL = {
    "printed_references": f"{_SRC} SELECT custom_id, source, kind, surface, start, external FROM px",
    "resolved_references": f"{_SRC}{_ROM}, {FR._U}, nm AS (SELECT custom_id, source, doc, start, {_NAME} nm FROM px WHERE NOT external) SELECT custom_id, unit_id AS unit, arg_min(source, source * 1000000 + start) AS source, arg_min(start, source * 1000000 + start) AS start FROM nm JOIN u ON split_part(u.unit_id, ':', 2) = nm AND (nm.doc IS NULL OR nm.doc = split_part(u.unit_id, ':', 1)) GROUP BY custom_id, unit_id",
    "citation_precedence": rf"WITH {FR._R}, x AS (SELECT unit_id, x.surface surface, x.sentence sentence FROM (SELECT unit_id, unnest(prose_xrefs_dropped) x FROM r)) SELECT CASE WHEN regexp_extract(surface, '\S+$') = regexp_extract(unit_id, '_(\S+)$', 1) THEN 'self' WHEN regexp_matches(left(list_last(string_split(sentence || ' ', surface)), 90), '{R.QUALIFIER}') THEN 'external' WHEN regexp_matches(sentence, '(?i)\bis (amended|replaced) as follows') THEN 'amending' WHEN regexp_matches(sentence, '\b(Directive|Treaty|Convention) ') THEN 'instrument' ELSE 'internal' END AS read_as, count(*) AS n FROM x WHERE surface IS NOT NULL AND sentence IS NOT NULL GROUP BY 1",
    "reference_buckets": f"WITH {C}, n AS (SELECT CAST(len({_SURF}) AS INT) n FROM c WHERE text IS NOT NULL) SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n_chunks, min(n) AS least, round_even(quantile_cont(n, 0.5), 6) AS median, max(n) AS most FROM n GROUP BY 1",
    "masked_references": f"WITH {C} SELECT chunk_id, CAST(len({_SURF}) AS INT) AS n_all, CAST(len({_MASK}) AS INT) AS n_masked FROM c WHERE text IS NOT NULL AND unit_label <> ''",
    "self_contained": f"WITH {C}, u AS (SELECT parent_id, max(len({_MASK})) n, min(unit_type) unit_type FROM c WHERE text IS NOT NULL AND unit_label <> '' GROUP BY parent_id) SELECT unit_type, count(*) AS n_units, count(*) FILTER (n = 0) AS self_contained FROM u GROUP BY unit_type",
    "term_occurrence": f"WITH {C}, t AS (SELECT DISTINCT lower(t) term FROM (SELECT unnest(regexp_extract_all(text, '{_Q}', 1)) t FROM c)), w AS (SELECT chunk_id, lower(text) l, regexp_extract_all(lower(text), '[a-z0-9]+') ws FROM c WHERE text IS NOT NULL) SELECT term, count(*) AS n_chunks FROM t JOIN w ON contains(l, term) AND list_contains(ws, regexp_extract(term, '[a-z0-9]+')) GROUP BY term",
    "action_parents": rf"WITH {FR._U}, a AS (SELECT unit_id, split_part(unit_id, ':', 1) doc, regexp_extract(unit_id, ':act_([A-Z]{{2}})-', 1) p, regexp_extract(unit_id, ':act_[A-Z]{{2}}-(\d+\.\d+)-', 1) n FROM u WHERE unit_type = 'action'), q AS (SELECT unit_id parent, split_part(unit_id, ':', 1) doc, regexp_extract(unit_id, ':sub_([A-Z]{{2}})', 1) p, regexp_extract(unit_id, '_(\d+\.\d+)$', 1) n FROM u WHERE unit_type = 'subcategory') SELECT a.unit_id, min(parent) AS parent, count(parent) AS n_parents FROM a LEFT JOIN q USING (doc, p, n) GROUP BY a.unit_id",
    "units_without_copies": f"WITH {C}, k AS (SELECT split_part(chunk_id, '#', 1) unit, unit_type, {NORM.format('text')} key FROM c WHERE text IS NOT NULL), bad AS (SELECT DISTINCT unit FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)) SELECT unit_type, count(DISTINCT unit) AS n_units FROM k WHERE unit_type IN ('article', 'section', 'subcategory') AND unit NOT IN (SELECT unit FROM bad) GROUP BY unit_type",
    "unit_slices": f"WITH {FR._L}, a AS (SELECT *, coalesce({FR._CLASS} = 'heading', false) anchor FROM l WHERE doc_id IS NOT NULL), n AS (SELECT *, sum(CASE WHEN anchor THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS slice FROM a) SELECT doc_id, CAST(slice AS BIGINT) AS slice, max(CASE WHEN anchor THEN trim(text) END) AS heading, min(line_id) AS first_line, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM n GROUP BY doc_id, slice",
    "rank_stability": f"{PR._BASE}, a AS ({PR._top(PR._scores(PR._Q, 'idf_nonneg'), 10)}), b AS ({PR._top(PR._scores(PR._Q, 'idf_plain'), 10)}), j AS (SELECT query, count(*) FILTER (a.rank IS NULL OR b.rank IS NULL) members, count(*) FILTER (a.rank <> b.rank) moved FROM a FULL JOIN b USING (query, doc) GROUP BY query) SELECT count(*) AS n_queries, CAST(sum(members) AS BIGINT) AS in_one_only, count(*) FILTER (members > 0) AS membership_differs, count(*) FILTER (members = 0 AND moved > 0) AS order_differs FROM j",
    "soft_hyphens": f"WITH {FR._L}, n AS (SELECT doc_id, length(text) l, length(text) - length(translate(text, chr(173) || chr(65534), '')) k, right(text, 1) IN (chr(173), chr(65534)) e FROM l) SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_breaks, count(*) FILTER (e) AS at_end, CAST(sum(l - k) AS BIGINT) AS chars_joined FROM n GROUP BY doc_id HAVING sum(k) > 0",
}
