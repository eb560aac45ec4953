from datetime import datetime as D

from sextant.operators import orphans as O
from tests import schemas as S


def build(spark, relations=(), found=(), answers=(), units=(), requests=()):
    make = lambda rows, s: spark.createDataFrame(list(rows), s)
    return make(relations, S.RELATIONS), make(found, S.FOUND), make(answers, S.ANSWERS), make(units, S.UNITS), make(requests, S.REQUESTS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


U = [("d:art_1", "d", "article", D(2024, 1, 1), None), ("d:art_2", "d", "article", D(2024, 1, 1), D(2024, 2, 1)), ("d:sub_GAUGE_1.3", "d", "subcategory", D(2024, 6, 1), None), ("d:anx_4", "d", "annex", None, None)]


def test_reasons_and_forms(spark):
    dropped = [(s, "k", c, "", "", "") for s, c in [("Art. 1(2)(a)", "internal"), ("ARTICLE 2", "internal"), ("gauge 1.3", "internal"), ("Rec. 9", "internal"), ("Article 99", "external"), (None, "internal")]]
    rel = (1, "d:art_1", [("d", "d:art_2", "b"), ("d", None, "b")], None, dropped, D(2024, 3, 5))
    out = O.orphan_references(*build(spark, [rel, rel], units=U))
    assert rows(out) == [
        ("relations.prose_xrefs_dropped", "1", "ARTICLE 2", "deleted", "2024-03"), ("relations.prose_xrefs_dropped", "1", "Rec. 9", "missing", "2024-03"),
        ("relations.prose_xrefs_dropped", "1", "gauge 1.3", "late", "2024-03"), ("relations.structural_join", "1", "d:art_2", "deleted", "2024-03"),
    ]


def test_candidates_take_first_reason(spark):
    f = lambda i, c: (i, "s", "k", f"S{i}", 0, 1, c, D(2024, 2, 1))
    out = O.orphan_references(*build(spark, found=[f(1, ["d:art_2", "d:sub_GAUGE_1.3"]), f(2, ["d:art_2", "no"]), f(3, ["no", "d:art_1"]), f(4, []), f(5, None), f(6, ["no"])], units=U))
    assert [(r[1], r[3]) for r in rows(out)] == [("1", "late"), ("2", "deleted"), ("6", "missing")]


def test_answers_without_request(spark):
    a = lambda i, t: (i, "succeeded", None, None, t)
    out = O.orphan_references(*build(spark, answers=[a("x", D(2024, 5, 1)), a("x", D(2024, 7, 1)), a("y", D(2024, 1, 1)), a(None, None)], requests=[("y", None, None, None, None, None, None)]))
    assert rows(out) == [("answers", "x", "x", "missing", "2024-05")]


def test_empty_tables(spark):
    assert O.orphan_references(*build(spark)).count() == 0
    assert O.current_orphans(O.reference_state(*build(spark))).count() == 0


def test_state_from_deltas_equals_state_at_once(spark):
    s = "key string, n_references int, n_existing int"
    a = spark.createDataFrame([("k", 1, 0), ("m", 1, 1)], s)
    b = spark.createDataFrame([("m", 0, -1), ("k", -1, 0), ("z", 2, 0)], s)
    state = O.apply_deltas(O.apply_deltas(a.limit(0), a), b)
    assert rows(state) == rows(O.apply_deltas(a, b)) == [("m", 1, 0), ("z", 2, 0)]
    assert rows(O.current_orphans(state)) == [("m", 1, 0), ("z", 2, 0)]
