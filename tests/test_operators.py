import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.operators import graph as G
from sextant.operators import grounding as GR
from sextant.operators import ingest as I
from sextant.operators import retrieval as R
from sextant.operators import sampling as S
from sextant.runtime import latest, running_total


def test_rank_ties_by_id(spark):
    s = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "query int, doc string, score double")
    assert [r["doc"] for r in R.ranked(s, 3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_fusion(spark):
    arm = lambda xs: spark.createDataFrame([(1, d, i) for i, d in enumerate(xs, 1)], "query int, doc string, rank int")
    assert [r["doc"] for r in R.fuse(arm("xy"), arm("yz")).orderBy("rank").collect()] == ["y", "x", "z"]


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "d:a#p1", 1, 9.0)], "query int, doc string, rank int, score double")
    slots = spark.createDataFrame([(1, 0, "d:a"), (1, 1, "d:b")], "query int, slot_index int, unit string")
    got = {r["query"]: r for r in R.query_metrics(ranking, slots, spark.createDataFrame([(1,), (2,)], "query int")).collect()}
    assert (got[1]["precision_at_10"], got[1]["recall_at_10"], got[1]["mrr"]) == (0.1, 0.5, 1.0)
    assert got[1]["ndcg_at_10"] == round(1 / (1 + 1 / math.log2(3)), 6)
    assert got[2]["recall_at_10"] is None


def test_bm25_against_brute_force(spark):
    docs = {"a": "risk model risk", "b": "model card", "c": "safety"}
    d = spark.createDataFrame(list(docs.items()), "id string, text string")
    q = spark.createDataFrame([(1, "risk"), (1, "risk"), (1, "model")], "query int, term string")
    post = R.postings(d, "id", "text")
    stats = R.term_statistics(post, d.agg(F.count("*").alias("n_docs")))
    got = {r["doc"]: r["score"] for r in R.bm25(q, post, R.lengths(d, "id", "text"), stats.select("term", F.col("idf_nonneg").alias("idf"))).collect()}
    avg = 6 / 3
    for k, t in docs.items():
        w = t.split()
        want = 0.0
        for term in ("risk", "risk", "model"):
            n = sum(term in x.split() for x in docs.values())
            tf = w.count(term)
            want += math.log(1 + (3 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
        assert abs(got.get(k, 0.0) - want) < 1e-5


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)] + [("hub", f"h{i:03d}") for i in range(150)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)] + [(None, "x"), ("y", "y")]
    got = {x["node"]: x["component"] for x in G.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    at: dict = {}

    def find(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            at[y] = x
    assert got == {k: find(k) for k in at}


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_running_total_matches_window(spark):
    rows = [(("hot" if i % 3 else f"g{i % 7}"), i, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {r["k"]: r["s"] for r in running_total(df, ["g"], [F.col("k")], F.col("v"), "s").collect()}
    want, acc = {}, {}
    for g, k, v in rows:
        acc[g] = acc.get(g, 0) + v
        want[k] = acc[g]
    assert got == want
    assert running_total(df.limit(0), ["g"], [F.col("k")], F.col("v"), "s").count() == 0


def test_latest_keeps_newest_and_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z"), ("b", None, "q")], "k string, t int, v string")
    assert {r["k"]: r["v"] for r in latest(df, "k", ["t", "v"]).collect()} == {"a": None, "b": "q"}


def brute(unit, block):
    n = len(unit)
    if not n or len(block) < n:
        return 0.0
    return max(sum(min(unit.count(t), block[i : i + n].count(t)) for t in set(unit)) for i in range(len(block) - n + 1)) / n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcde"), max_size=14))
def test_window_score(unit, block):
    assert GR.window_score(unit, block) == brute(unit, block)


def test_window_score_fixture():
    assert GR.window_score(list("abc"), list("axcb")) == 2 / 3


def test_surfaces_leave_out_external(spark):
    t = "Article 9 of Directive 2013/36/EU and Article 10, GAUGE 1.3 and Action SC-1.1-003"
    got = spark.createDataFrame([(t,)], "t string").select(GR.surfaces(F.col("t")).alias("s")).first()["s"]
    assert got == ["art|10", "act|SC-1.1-003", "sub|GAUGE_1.3"]


def test_spaced_and_remainder(spark):
    s = spark.createDataFrame([("x", 10)], "stratum string, n long")
    assert sorted(r["pick"] for r in S.spaced_picks(s, 3, 1).collect()) == [1, 4, 7]
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "stratum string, n long")
    assert {r["stratum"]: r["allocation"] for r in S.largest_remainder(s, 5).collect()} == {"a": 1, "b": 1, "c": 3}


def test_select_walk(spark):
    d = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 3, "b"), ("g", 4, None), ("g", 5, None)], "grp string, o int, k string")
    assert [r["o"] for r in S.select_walk(d, F.col("k"), 4, "grp", "o").orderBy("o").collect()] == [1, 3, 4, 5]


def test_draw_order_is_a_permutation():
    for n in (0, 1, 2, 9, 40):
        assert sorted(S.draw_order(n, 5)) == list(range(n))


def test_pack_blocks(spark):
    got = spark.createDataFrame([([100, 250, 60, 500, 10],)], "c array<bigint>").select(S.pack_blocks(F.col("c"), 400).alias("b")).first()["b"]
    assert got == [0, 0, 1, 2, 3]


def test_html_blocks():
    assert I.parse_html("<article><p>a <b>b</b><br>c</p><script>'</p>'</script><p>d") == [("p", "a b"), ("p", "c"), ("p", "d")]
    assert I.parse_html(None) == []


def test_enumerated_and_roman(spark):
    df = spark.createDataFrame([("Articles 102 to 104",), ("Article 7(2)",)], "s string")
    assert [r["n"] for r in df.select(I.enumerated(F.col("s")).alias("n")).collect()] == [[102, 103, 104], [7]]
    assert [r["r"] for r in spark.createDataFrame([(4,), (19,), (148,)], "n int").select(I.roman(F.col("n")).alias("r")).collect()] == ["IV", "XIX", "CXLVIII"]


@pytest.mark.parametrize("h, j, word, halves, want", [(0, 20, False, False, "delete"), (3, 0, True, False, "keep"), (None, None, False, False, "keep"), (0, 0, True, False, "delete"), (0, 0, True, True, "keep")])
def test_hyphen_ladder(spark, h, j, word, halves, want):
    df = spark.createDataFrame([(h, j, word, halves)], "h int, j int, w boolean, x boolean")
    assert df.select(I.resolve_hyphen(F.col("h"), F.col("j"), F.col("w"), F.col("x")).alias("o")).first()["o"] == want
