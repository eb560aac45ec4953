"""DuckDB SQL of the training-data queries, where SQL can express them on whole tables."""

from __future__ import annotations

from sextant.llm.words import NOT_SPACE

_LATEST = """SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, md5(text) DESC NULLS LAST) = 1"""

_P3 = rf"SELECT chunk_id FROM ({_LATEST}) WHERE len(regexp_extract_all(text, '{NOT_SPACE}+')) > 400"

_LABELS = "suggested action|risks|actors|evidence"
_RECORDS = rf"""
WITH c AS ({_LATEST}),
m AS (SELECT chunk_id, unit_type, text, regexp_replace(lower(text), '(^|[\n|])[ \t*\x{{2022}}\x{{b7}}>-]*(({_LABELS})\b)', chr(1) || '\2', 'g') a FROM c WHERE text IS NOT NULL),
g2 AS (SELECT chunk_id, unit_type, text, list_sort(list_filter(list_transform(string_split(a, chr(1)), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '')) f1,
   list_sort(list_filter(list_transform(string_split(regexp_replace(a, '(\s)(({_LABELS})\s*:)', chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '')) f2 FROM m),
f AS (SELECT chunk_id, unit_type, text, CASE WHEN len(f1) > 1 THEN f1 ELSE f2 END fields FROM g2),
k AS (SELECT chunk_id, text, CASE WHEN unit_type = 'action' THEN 'fields:' || array_to_string(fields, '|') ELSE 'text:' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') END record FROM f),
g AS (SELECT record, min(chunk_id) first_chunk_id, count(*) n_copies FROM k GROUP BY record)
"""
_P4 = _RECORDS + "SELECT first_chunk_id, chunk_id AS copy_chunk_id FROM k JOIN g USING (record) WHERE n_copies > 1 AND chunk_id <> first_chunk_id"
_P4_RECORDS = _RECORDS + "SELECT first_chunk_id AS chunk_id, n_copies FROM g"
_P4_COUNTS = _RECORDS + """, w AS (SELECT text, count(*) n FROM k GROUP BY text HAVING count(*) > 1)
SELECT 'raw_identity' AS basis, count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chunks FROM w
UNION ALL SELECT 'normalised_identity', count(*), CAST(coalesce(sum(n_copies), 0) AS BIGINT) FROM g WHERE n_copies > 1"""


#: Pairs that share a shingle, counted; exact, for all chunks.
_PAIRS = rf"""{_RECORDS.replace('WITH c AS', 'WITH RECURSIVE c AS')},
w AS (SELECT chunk_id, record, regexp_extract_all(lower(text), '[a-z0-9]+') t FROM k),
s AS (SELECT chunk_id, record, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) x FROM w WHERE len(t) >= 3),
e AS (SELECT chunk_id, unnest(x) g FROM s),
n AS (SELECT a.chunk_id a, b.chunk_id b, count(*) c FROM e a JOIN e b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
p2 AS (SELECT a, b, p.record ra, q.record rb, c = len(p.x) AND c = len(q.x) AS same FROM n JOIN s p ON p.chunk_id = a JOIN s q ON q.chunk_id = b WHERE c >= 0.7 * (len(p.x) + len(q.x) - c))"""
_P2 = f"{_PAIRS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM p2 WHERE ra <> rb"
_P2_CLASSES = f"""{_PAIRS}, z AS (SELECT s.chunk_id, least(s.chunk_id, min(a)) class_id FROM s LEFT JOIN p2 ON p2.b = s.chunk_id AND same GROUP BY s.chunk_id),
l AS (SELECT x.class_id u, y.class_id v FROM (SELECT a, b FROM p2 UNION ALL SELECT b, a FROM p2) JOIN z x ON x.chunk_id = a JOIN z y ON y.chunk_id = b WHERE x.class_id <> y.class_id)
SELECT chunk_id, class_id, coalesce(n, 0) AS n_links FROM z LEFT JOIN (SELECT u, count(DISTINCT v) n FROM l GROUP BY u) ON u = class_id"""
_P2_GROUPS = f"""{_PAIRS}, e2 AS (SELECT a, b FROM p2 UNION SELECT b, a FROM p2), reach(node, other) AS (SELECT chunk_id, chunk_id FROM s UNION SELECT reach.node, e2.b FROM reach JOIN e2 ON e2.a = reach.other),
r AS (SELECT node, min(other) g FROM reach GROUP BY node)
SELECT node AS chunk_id, g AS group_id, count(*) OVER (PARTITION BY g) AS n_chunks FROM r"""


#: Format characters, odd spaces, variation selectors, ligatures, digraphs, width forms, drawn letters: ranges of Unicode's charts.
_FORMS = (
    r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0e}\x{feff}\x{fffe}"
    r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{fb00}-\x{fb06}\x{fb13}-\x{fb17}\x{132}\x{133}\x{1c4}-\x{1cc}\x{1f1}-\x{1f3}\x{ff01}-\x{ffbe}\x{ffc2}-\x{ffee}"
    r"\x{2102}\x{210a}-\x{2113}\x{2115}\x{2119}-\x{211d}\x{2124}\x{2128}\x{212c}\x{212d}\x{212f}-\x{2131}\x{2133}\x{2134}\x{1d400}-\x{1d7ff}]"
)
#: Letters of other alphabets drawn like Latin ones, also under an accent.
_LIKE = "[АВЕЅІЈКМНОРСТУХҮЁЇаеѕіјкорсухһԁѵёїўΑΒΕΖΗΙΚΜΝΟΡΤΥΧΆΈΉΊΌΎαικνορυχάίόύϊϋϲϳօսհոցᎪᎫᎬᎷᎻᎳᏃᏙᏚᏞᏟᏢᏦᏴᎡᎢⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ]"


def _odd(text: str) -> str:
    return (
        rf"(regexp_matches({text}, '{_FORMS}') OR nfc_normalize({text}) <> {text} OR regexp_matches({text}, '\p{{Latin}}{_LIKE}|{_LIKE}\p{{Latin}}')"
        rf" OR len(list_filter(regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: regexp_full_match(w, '{_LIKE}{_LIKE}+'))) > 0)"
    )


_P6 = f"""SELECT 'chunks' AS source_table, chunk_id AS record_key FROM ({_LATEST}) WHERE {_odd('text')}
UNION ALL SELECT DISTINCT 'hyphen_decisions', CAST(decision_id AS VARCHAR) FROM hyphen_decisions WHERE decision_id IS NOT NULL AND {_odd('sentence')}"""

#: Runs of 13 words, exact, for all documents.
_P9 = r"""WITH q AS (SELECT DISTINCT item_id, unnest([query, passage]) t FROM eval_queries),
qw AS (SELECT item_id, regexp_extract_all(lower(t), '[a-z0-9]+') w FROM q WHERE t IS NOT NULL),
qr AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) i FROM qw)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents WHERE text IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM dw))
SELECT DISTINCT doc_id, item_id FROM dr JOIN qr USING (run)"""

_P10 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
f AS (SELECT doc_id, t,
  list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{M}\p{N}'']+'), lambda x: x <> '') w,
  list_filter(regexp_split_to_array(t, '\s*\n\s*'), lambda x: trim(x) <> '') l,
  length(regexp_replace(t, '\s+', '', 'g')) ink, length(regexp_replace(t, '[\p{L}\p{M}\p{N}\s]+', '', 'g')) sym FROM d),
c AS (SELECT list(DISTINCT lower(word)) c FROM wordlist WHERE common)
SELECT doc_id, CAST(len(w) AS INT) AS n_words, round_even(coalesce((ink - sym) / nullif(len(w), 0), 0), 6) AS mean_word_length,
  round_even(coalesce(sym / nullif(ink, 0), 0), 6) AS symbol_ratio,
  round_even(coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;\x{2026}]["''\x{201d}\x{2019}\x{bb})\]]*$'))) / nullif(len(l), 0), 0), 6) AS punct_line_share,
  round_even(coalesce(len(list_filter(w, lambda x: list_contains(c, x))) / nullif(len(w), 0), 0), 6) AS common_word_share
FROM f, c"""

#: What every sound assignment gives.
_P8_CHECK = "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_split_needlessly, CAST(0 AS BIGINT) AS n_not_whole, CAST(0 AS BIGINT) AS n_over FROM documents WHERE doc_id IS NOT NULL"

SQL = {"p8_check": _P8_CHECK, "p9_found": _P9, "p10_statistics": _P10, "p2_found": _P2, "p2_classes": _P2_CLASSES, "p2_groups": _P2_GROUPS, "p3_found": _P3, "p4_found": _P4, "p4_records": _P4_RECORDS, "p4_group_counts": _P4_COUNTS, "p6_found": _P6}
