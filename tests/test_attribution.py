import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from sextant.operators import attribution as A


def test_lexical_attribution_against_all_pairs(spark):
    texts = ["the provider shall test the model often", "the provider shall test the models often", "an entirely different sentence stands here", "the provider must test the model often", ""]
    seg = spark.createDataFrame([(f"u{i}", 0, t) for i, t in enumerate(texts)], "unit string, seg_no int, segment string")
    spans = spark.createDataFrame([(1, texts[0]), (2, "nothing like it at all")], "span_id int, span string")
    gold = spark.createDataFrame([(1, "u0")], "span_id int, unit string")
    got = sorted((r["span_id"], r["unit"], r["ratio"]) for r in A.lexical_attribution(spans, seg, gold).collect())
    want = []
    for s, p in [(1, texts[0]), (2, "nothing like it at all")]:
        for i, t in enumerate(texts):
            x = difflib.SequenceMatcher(None, p, t, autojunk=False).ratio()
            if x >= A.FLOOR and (s, f"u{i}") != (1, "u0"):
                want.append((s, f"u{i}", round(x, 4)))
    assert got == want and want


def test_opcodes():
    assert A.opcodes("a b c", "a x c d") == [("replace", "b", "x"), ("insert", "", "d")]
    assert A.opcodes("", "") == []


def test_verdicts(spark):
    u = spark.createDataFrame([("a", "There is no Article 999."), ("b", "Article 999 requires logs."), ("b", "There is no more.")], "custom_id string, unit string")
    assert {r["custom_id"]: r["verdict"] for r in A.adversarial_verdict(u).collect()} == {"a": "not_failure", "b": "failure"}


def test_numbers_and_colours(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (None,), (0.446097,)], "x double")
    assert [r["s"] for r in df.select(A.csv_number(F.col("x")).alias("s")).collect()] == ["0.5", "1", "", "0.446097"]
    c = spark.createDataFrame([("#000000", "#ffffff")], "a string, b string").select(A.contrast_ratio(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert abs(c - 21) < 1e-9


def test_jsonl_sink_is_deterministic(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    one, two = A.write_jsonl(df, str(tmp_path / "x"), "k"), A.write_jsonl(df.orderBy("v"), str(tmp_path / "y"), "k")
    assert one == two and A.same_rows(spark.read.json(str(tmp_path / "x")), spark.read.json(str(tmp_path / "y")))


def test_common_subsequences_of_many_texts_at_once():
    r = random.Random(9)
    said = lambda n: "".join(r.choice("abcd") for _ in range(n))
    for n in (0, 1, 62, 63, 64, 130, 200):
        a, b = said(n), [said(r.randrange(0, 150)) for _ in range(20)]
        rows = np.full((20, 150), -1, dtype=np.int64)
        for i, t in enumerate(b):
            rows[i, : len(t)] = [ord(c) for c in t]
        assert A.common_subsequences(np.array([ord(c) for c in a], dtype=np.int64), rows).tolist() == [A.common_subsequence(a, t) for t in b]


def test_alike_drops_no_pair_by_its_bounds():
    r = random.Random(10)
    texts = ["", "a", "ab", *("".join(r.choice("ab c") for _ in range(r.choice([5, 20, 90]))) for _ in range(30))]
    texts = [*{*texts, *("".join(r.choice("abx") if r.random() < 0.15 else c for c in t) for t in texts)}]
    want = {(x, y) for x in texts for y in texts if difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= A.FLOOR}
    assert {(x, y) for x, y, _ in A.alike(texts, texts, A.FLOOR)} == want
