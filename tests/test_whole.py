"""Queries on fixtures that a cut of the job would change."""

import difflib
import random
import re
from datetime import datetime as D

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from sextant.functions import text as T
from sextant.operators import attribution as A
from sextant.operators import grounding as GR
from sextant.operators import references as RF
from sextant.operators import retrieval as R
from sextant.operators import sampling as S
from sextant.plans import printed
from sextant.runtime import latest, latest_lean, materialise
from tests.schemas import ANSWERS, CHUNKS, ITEMS, LINES, REQUESTS, UNITS


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_duplication_map_finds_long_statements(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    opening = said(8)
    long, short = f"{opening} {said(120)}", said(9)
    texts = [("a", long), ("b", long), ("b", f"{said(5)} {long} {said(70)}"), ("c", f"{opening} {said(90)}"), ("c", short), ("a", f"{said(80)} {short}. {said(3)}"), ("a", said(7)), ("b", f"{long}x"), ("c", f"{opening} {opening} {opening}"), ("b", opening)]
    save(spark, tmp_path, "chunks", [(f"{d}:{i}", f"{d}:{i}", d, "section", None, t, 0, None) for i, (d, t) in enumerate(texts)], CHUNKS)
    form = [(f"{d}:{i}", d, t.replace(".", "")) for i, (d, t) in enumerate(texts)]
    want = sorted((i, j, a == b) for i, x, a in form for j, y, b in form if x != y and len(a.split()) >= 8 and f" {a} " in f" {b} ")
    got = sorted(tuple(x) for x in E.queries()["duplication_map"](spark, str(tmp_path)).select("source", "holder", "whole").collect())
    assert got == want and any(len(dict((i, t) for i, _, t in form)[s].split()) > 60 for s, _, _ in got)


def exchange(custom_id, query_id, condition, blocks, answer):
    text = "Extracts:\n\n" + "\n\n".join(f"[d:u{i}] {b}" for i, b in enumerate(blocks)) + "\n\nQuestion: what?"
    request = (custom_id, "test", condition, query_id, None, text, None)
    return request, (custom_id, "succeeded", ("x", ("m", "t", "assistant", "end_turn", [("text", answer, None)], (1, 1, "batch"))), None, None)


def test_foreign_alignment_meets_every_other_query(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{c}" for c in "abcdefghijkl"]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [exchange(f"test__raw__t__{i}", f"q{i // 2}", "raw", [said(r.randrange(3, 20)) for _ in range(i % 3)], f"{said(6).capitalize()}.\n- {said(4)}") for i in range(24)]
    rows.append(exchange("test__raw__t__99", "q99", "raw", [], "Zz yy."))
    save(spark, tmp_path, "requests", [x for x, _ in rows], REQUESTS)
    save(spark, tmp_path, "answers", [y for _, y in rows], ANSWERS)
    got = {(x["custom_id"], x["pos"]): x for x in E.queries()["foreign_alignment"](spark, str(tmp_path)).collect()}
    query = {x[0]: x[3] for x, _ in rows}
    blocks = [(query[b["custom_id"]], b["t"]) for b in GR.context_blocks(spark.createDataFrame([x for x, _ in rows], REQUESTS)).select("custom_id", F.split(F.lower(F.regexp_replace("block", r"[\[\]:]", " ")), " +").alias("t")).collect()]
    blocks = [(q, [t for t in b if t]) for q, b in blocks]
    texts = {(x[0], p): u.lower().strip(".- ").split() for x, y in rows for p, u in enumerate(y[2][1][4][0][1].split("\n"))}
    assert set(got) == set(texts) and all(x["foreign_rows"] == 12 for x in got.values())
    for k, unit in texts.items():
        want = max([GR.window_score(unit, b) for q, b in blocks if q != query[k[0]]], default=0.0)
        assert abs(got[k]["foreign_max"] - want) < 1e-6


def test_foreign_best_is_the_maximum_over_all_blocks():
    r = random.Random(6)
    said = lambda n: [r.choice("abcdefgh") for _ in range(n)]
    blocks = pd.DataFrame([(r.choice(["p", "q", None]), said(r.randrange(0, 30))) for _ in range(60)], columns=["only", "block_tokens"])
    units = pd.DataFrame([(r.choice("pq"), said(r.randrange(0, 14)) + r.choice([[], ["z"]])) for _ in range(120)], columns=["query_id", "unit_tokens"])
    want = [max(GR.window_score(u, b) for o, b in blocks.itertuples(index=False) if o != q) for q, u in units.itertuples(index=False)]
    for wide in (12, 256):
        assert all(abs(x - y) < 1e-9 for x, y in zip(GR.foreign_best(units, blocks, wide), want))


def test_foreign_alignment_copies_no_block_for_a_group(spark):
    r = random.Random(7)
    said = lambda n: [r.choice("abcdefgh") for _ in range(n)]
    blocks = [(r.choice("pq"), said(r.randrange(0, 30))) for _ in range(150)]
    units = [(f"c{i}", i, r.choice("pqr"), said(r.randrange(0, 9))) for i in range(60)]
    want = {c: max((GR.window_score(u, b) for o, b in blocks if o != q or any(b == y and x != q for x, y in blocks)), default=0.0) for c, _, q, u in units}
    got = GR.foreign_alignment(spark.createDataFrame(units, "custom_id string, pos int, query_id string, unit_tokens array<string>"), spark.createDataFrame(blocks, "query_id string, block_tokens array<string>"), 7, 40)
    assert not re.search("CoGroup|Generate", got._jdf.queryExecution().executedPlan().toString())
    assert {x["custom_id"]: round(x["foreign_max"], 9) for x in got.collect()} == {c: round(v, 9) for c, v in want.items()}


def test_decomposition_joins_the_same_query(spark, tmp_path):
    held, lost, marker = "the model owner verifies logs", "nobody ever saw this printed", "I do not have enough information to answer this question."
    cases = [  # query, raw answer, second-call answer
        ("t_1", f"- {held}\n- {lost}", f"- {held}\n- {held} daily"),
        ("t_51", f"- {lost}\n- {lost} again", marker),
        ("t_101", marker, f"- {held}"),
        ("t_151", f"- {lost}", None),
        ("t_201", f"- {held}\n- {lost}\n- {lost} again", f"- {held}"),
    ]
    rows = [exchange(f"test__{c}__mid__{q}", q, c, [f"{held} daily"], a) for q, *both in cases for c, a in zip(("raw", "second_call"), both) if a]
    save(spark, tmp_path, "requests", [x for x, _ in rows], REQUESTS)
    save(spark, tmp_path, "answers", [y for _, y in rows], ANSWERS)
    got = [x.asDict() for x in E.queries()["decomposition"](spark, str(tmp_path)).collect()]
    assert got == [dict(query_set="test", tier="mid", n=3, fewer=3, delta=-5, abstained=1, abstained_ungrounded=2, abstained_units=2, ungrounded_removed=3, grounded_added=1, units_added=-2)]


def test_second_call_against_the_first(spark, tmp_path):
    held, lost, marker = "the model owner verifies logs", "nobody ever saw this printed", "I do not have enough information to answer this question."
    cases = [("t_1", f"- {held}\n- {lost}", f"- {held}\n- {lost}"), ("t_2", f"- {lost}", f"- {held}"), ("t_3", marker, f"- {held}"), ("t_4", f"- {held}", marker), ("t_5", f"- {lost}", None)]
    rows = [exchange(f"test__{c}__mid2__{q}", q, c, [f"{held} daily"], a) for q, *both in cases for c, a in zip(("raw", "second_call"), both) if a]
    # an earlier delivery of an answer does not count
    early = exchange("test__raw__mid2__t_1", "t_1", "raw", [f"{held} daily"], f"- {lost} long ago")
    rows = [((*x[:-1], D(2024, 5, 1)), (*y[:-1], D(2024, 5, 1))) for x, y in rows] + [((*early[0][:-1], D(2024, 4, 1)), (*early[1][:-1], D(2024, 4, 1)))]
    save(spark, tmp_path, "requests", [x for x, _ in rows], REQUESTS)
    save(spark, tmp_path, "answers", [y for _, y in rows], ANSWERS)
    save(spark, tmp_path, "units", [("d:art_1", "d", "article", None, None)], UNITS)
    run = lambda name: [x.asDict() for x in E.queries()[name](spark, str(tmp_path)).collect()]
    assert run("fate_table") == [dict(tier="mid2", flagged_in=2, repeated=1, now_grounded=0, still_unsupported=1, dropped=1)]
    assert run("abstention_changes") == [dict(query_set="test", tier="mid2", n=4, recovered=1, recovered_ids="t_3", lost=1, lost_ids="t_4")]
    assert {x["rule"]: x["holds"] for x in run("rules")}["second call abstains at least as often as raw"] is True
    assert {(x["condition"], x["tier"]): x["abstaining"] for x in run("grading_blocks")}[None, None] == 2


def quadratic(n, m, offset=0):
    picks = list(dict.fromkeys((offset + i * n // max(m, 1)) % n for i in range(min(m, n)))) if n else []
    far = lambda a, b: min((a - b) % n, (b - a) % n)
    left = set(range(n)) - set(picks)
    while left:
        picks.append(max(left, key=lambda i: (min((far(i, p) for p in picks), default=n), -i)))
        left.remove(picks[-1])
    return picks


def test_draw_order_equals_the_quadratic_form():
    for n in [*range(40), 75]:
        for m in (0, 1, 2, 5, 10):
            for offset in (0, 1, 7):
                assert S.draw_order(n, m, offset) == quadratic(n, m, offset), (n, m, offset)


def test_draw_order_takes_whole_strata(spark, tmp_path):
    sizes = {"action": 613, "annex": 7, "recital": 1}
    save(spark, tmp_path, "units", [(f"d:{t}_{i}", "d", t, None, None) for t, n in sizes.items() for i in range(n)], UNITS)
    for got in (E.queries()["draw_order"](spark, str(tmp_path)), S.draw_orders(spark.createDataFrame(list(sizes.items()), "stratum string, n long"), 10, 8)):
        got = got.orderBy("stratum", "draw_rank").collect()
        assert [tuple(x) for x in got] == [(t, k, p) for t, n in sizes.items() for k, p in enumerate(S.draw_order(n, 10), 1)]
    assert S.draw_order(613, 10) == quadratic(613, 10)


def test_carried_headings_pass_over_pages(spark, tmp_path):
    said = [("a", 1, "before any heading, this."), ("a", 1, "Record keeping"), ("a", 1, "some words, here."), ("a", 2, "more words, here."), ("a", 3, "still more, here."), ("a", 3, "Scope"), ("a", 4, "last words, here."), ("b", 4, "another document, here."), ("b", 5, "Scope"), (None, 1, "Loose heading"), (None, 2, "loose words, here.")]
    save(spark, tmp_path, "lines", [(i, d, p, i, t, None, 0, len(t), None, None, None) for i, (d, p, t) in enumerate(said)], LINES)
    got = {x["heading"]: x["n_lines"] for x in E.queries()["carried_headings"](spark, str(tmp_path)).collect()}
    assert got == {"Record keeping": 4, "Scope": 3, "Loose heading": 2}


def test_lexical_attribution_takes_every_segment_however_spelled(spark, tmp_path):
    texts = ["The provider tests models.", "The provlder te5ts m0dels.", "Thee providers tessts modells.", "Something else stands here.", "Someth1ng elsse standz heere.", "Logs", "Logz", "1ogs."]
    save(spark, tmp_path, "chunks", [(f"d:u{i}#p1", f"d:u{i}", "d", "section", None, t, 0, None) for i, t in enumerate(texts)], CHUNKS)
    save(spark, tmp_path, "eval_queries", [(1, "a", "x", "q", f"{texts[0]} {texts[3]}", ["d:u0"]), (2, "b", "x", "q", "Logs", [])], ITEMS)
    form = lambda t: " ".join(t.lower().replace(".", " ").split())
    want = set()
    for span, t, gold in (("1#0", texts[0], "d:u0"), ("1#1", texts[3], "d:u0"), ("2#0", "Logs", None)):
        for i, x in enumerate(texts):
            ratio = difflib.SequenceMatcher(None, form(t), form(x), autojunk=False).ratio()
            if ratio >= A.FLOOR and f"d:u{i}" != gold:
                want.add((span, f"d:u{i}", 0, round(ratio, 4)))
    got = {tuple(x) for x in E.queries()["lexical_attribution"](spark, str(tmp_path)).collect()}
    assert got == want and {"d:u1", "d:u4"} <= {u for _, u, _, _ in want}


def test_references_stand_where_their_places_say(spark):
    text = "Article 5 and Articles 12 of the Treaty; see Annex IV, Ann. 2, GV-1.2--003 or GAUGE 1.3.\nArticle 5"
    got = RF.printed(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), ["k"], "t").collect()
    assert all(text[x["start"] : x["start"] + len(x["surface"])] == x["surface"] for x in got)
    assert sorted((x["start"], x["kind"], x["external"]) for x in got) == [(0, "art", False), (14, "art", True), (45, "anx", False), (55, "anx", False), (63, "act", False), (78, "sub", False), (89, "art", False)]
    names = spark.createDataFrame([("anx", "Annex IV"), ("anx", "Annex XC"), ("act", "GV1.2--003"), ("sub", "GAUGE  1.3"), ("art", "Art. 7")], "k string, s string")
    assert [x["n"] for x in names.select(RF.unit_name(F.col("k"), F.col("s")).alias("n")).collect()] == ["anx_4", "anx_90", "act_GV-1.2-003", "sub_GAUGE_1.3", "art_7"]


def test_cited_sentences_keep_their_places(spark, tmp_path):
    texts = ["One is. Two are; Three went.\n\nFour (as is). five", "", None, "No end", "  Lead. (In brackets). ‘Quoted’ it"]
    save(spark, tmp_path, "chunks", [(f"d:{i}", f"d:{i}", "d", "section", None, t, 0, None) for i, t in enumerate(texts)], CHUNKS)
    got = sorted((x["chunk_id"], x["start"], x["n_chars"]) for x in printed.cited_sentences(spark, str(tmp_path)).collect())
    want, cut = [], r"(?<=[.;])\s+(?=[A-Z‘“(])|\n+"
    for i, t in enumerate(texts):
        at = 0
        for m in [*re.finditer(cut, t or ""), None]:
            piece = (t or "")[at : m.start() if m else None]
            if piece.strip():
                want.append((f"d:{i}", at, len(piece)))
            at = m.end() if m else at
    assert got == sorted(want)


def test_best_documents_are_those_of_all_pairs(spark):
    r = random.Random(8)
    words = ["a", "b", "c-d", "e", "f"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 7))) if i % 9 else None) for i in range(120)]
    asked = [(i, t) for i, t in docs if i % 4 == 0 and t] + [(500, "a a zz")]
    d = spark.createDataFrame(docs, "doc long, text string").repartition(5)
    q = spark.createDataFrame(asked, "query long, text string").select("query", F.explode(T.primary_tokens(F.col("text"))).alias("term"))
    post, n = R.postings(d, "doc", "text"), d.agg(F.count("*").alias("n_docs"))
    pairs = R.bm25(q, post, R.lengths(d, "doc", "text"), R.term_statistics(post, n).select("term", F.col("idf_nonneg").alias("idf")))
    indexed = materialise(d.select("doc", F.coalesce(F.size(T.primary_tokens(F.col("text"))), F.lit(0)).alias("dl"), T.document_tokens(F.col("text")).alias("tokens")))
    for depth, others in ((1, False), (5, True), (200, True)):
        want = sorted(map(tuple, R.ranked(pairs.filter("query <> doc") if others else pairs, depth).select("query", "doc", "score", "rank").collect()))
        assert sorted(map(tuple, R.bm25_best(q, indexed, depth, others).select("query", "doc", "score", "rank").collect())) == want


def test_hybrid_writes_no_pairs_and_equals_sql(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(R, "bm25", None)
    monkeypatch.setattr(R, "postings", None)
    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for t in ("chunks", "eval_queries"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert sorted(map(tuple, E.queries()["hybrid_top10"](spark, d).collect())) == sorted(c.execute(E.oracle_sql()["hybrid_top10"]).fetchall())


def test_alignment_beats_counts_by_tier_without_copies_of_blocks(spark, tmp_path):
    rows = [
        exchange("test__raw__t__1", "q1", "raw", ["alpha beta gamma delta"], "Alpha beta gamma delta."),
        exchange("test__raw__t__2", "q2", "raw", ["one two three four"], "Alpha beta gamma delta."),
        exchange("test__raw__s__3", "q3", "raw", ["alpha beta gamma delta five"], "Alpha beta gamma delta."),
    ]
    save(spark, tmp_path, "requests", [x for x, _ in rows], REQUESTS)
    save(spark, tmp_path, "answers", [y for _, y in rows], ANSWERS)
    got = E.queries()["alignment_beats"](spark, str(tmp_path))
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x["tier"]: (x["n_units"], x["beats"], x["ties"], x["below"]) for x in got.collect()} == {"t": (2, 0, 1, 1), "s": (1, 0, 1, 0), None: (3, 0, 2, 1)}


def test_foreign_alignment_shuffles_no_unit_and_passes_columns_on(spark):
    r = random.Random(8)
    said = lambda n: [r.choice("abcdefgh") for _ in range(n)]
    blocks = [(r.choice(["p", "q", None]), said(r.randrange(0, 20))) for _ in range(90)]
    units = [(f"c{i}", i, r.choice("pqr"), said(r.randrange(0, 7)), i / 8) for i in range(53)]
    b = spark.createDataFrame(blocks, "query_id string, block_tokens array<string>")
    for n in (53, 1):
        u = spark.createDataFrame(units[:n], "custom_id string, pos int, query_id string, unit_tokens array<string>, own double").repartition(4)
        got = GR.foreign_alignment(u, b, 7, 40)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        owners = lambda b: {x for x, y in blocks if y == b and x}
        want = {c: (o, max((GR.window_score(t, y) for _, y in blocks if owners(y) != {q}), default=0.0)) for c, _, q, t, o in units[:n]}
        assert {x["custom_id"]: (x["own"], round(x["foreign_max"], 9)) for x in got.collect()} == {c: (o, round(v, 9)) for c, (o, v) in want.items()}
    assert GR.foreign_alignment(u.limit(0), b, 7, 40).count() == 0


def test_latest_lean_equals_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", None, "u"), ("c", None, "v"), ("c", 1, None), (None, 5, "w"), ("d", None, None)]
    for some in (rows, rows[2:3], []):
        df = spark.createDataFrame(some, "key string, t int, text string")
        want = sorted(map(str, latest(df, "key", ["t", "text"]).collect()))
        got = latest_lean(df, "key", ["t", "text"])
        assert sorted(map(str, got.collect())) == want and got.columns == df.columns


def test_hybrid_writes_asked_terms_only(spark, monkeypatch):
    from sextant.plans import retrieval as P

    written = []
    monkeypatch.setattr(P, "materialise", lambda df: written.append((df, materialise(df))) or written[-1][1])
    E.queries()["hybrid_top10"](spark, "/root/testdata/sf0.001")
    asked = {x["term"] for x in written[0][1].select("term").distinct().collect()}
    docs = written[1][1]
    kept = {x["t"] for x in docs.select(F.explode("tokens").alias("t")).distinct().collect()}
    assert kept and kept <= asked and "text" not in docs.columns
    rows = spark.createDataFrame([(1, ["a", "b", "a-b", "a", "b"]), (2, None), (3, []), (4, ["b", "b"])], "doc long, tokens array<string>")
    terms = spark.createDataFrame([("a",), ("a-b",), ("zz",)], "term string")
    assert [(x["doc"], x["tokens"]) for x in R.only_terms(rows, terms).orderBy("doc").collect()] == [(1, ["a", "a-b", "a"]), (2, []), (3, []), (4, [])]
    assert R.only_terms(rows, terms.limit(0)).filter("size(tokens) > 0").count() == 0
