"""Training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
from collections import defaultdict
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from sextant.llm import copies, leaks, lookalikes, packing, pairs, scans, shapes, sketching, splitting
from tests import schemas as S

T0 = D(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chunks(spark, texts, unit_type="section"):
    data = [(k, k.split("#")[0], "d", unit_type, None, t, 1, T0) for k, t in texts]
    df = spark.createDataFrame(data, S.CHUNKS)
    for clash in ("n", "key", "record", "inv", "cls", "piece", "k", "size"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


WORDS = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "ho", "ki") for b in ("lan", "mer", "nop", "rit", "sut", "vex")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# ---- problem 2


def brute_pairs(texts, threshold):
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in texts if t for w in [sketching.WORD.findall(t.lower())]}
    bare = {k: "".join(c for c in t.lower() if c.isalnum()) for k, t in texts if t}
    ks = sorted(k for k, s in sets.items() if s)
    return [(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if bare[a] != bare[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def edited(r, base, n):
    w = base.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sketching, "BLOCK", block)
    r = random.Random(9)
    texts = []
    for g in range(12):
        base = prose(r, 60)
        texts += [(f"d:s_{g}_{i:02d}", edited(r, base, r.randrange(5))) for i in range(r.choice([1, 2, 14]))]
    texts += [("d:n", None), ("d:e", ""), ("d:two", "a b"), ("d:long", prose(r, 4000))]
    texts += [(k + "#c", t.upper() + "!") for k, t in texts[:3]]
    assert rows(sketching.near_duplicates(chunks(spark, texts))) == brute_pairs(texts, 0.7)


def test_near_duplicate_classes(spark):
    r = random.Random(4)
    a = prose(r, 60)
    got = {x["chunk_id"]: (x["class_id"], x["n_links"]) for x in sketching.duplicate_classes(chunks(spark, [("b", a), ("a", a), ("c", edited(r, a, 1)), ("z", prose(r, 60))])).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 1), "z": ("z", 0)}


@pytest.mark.parametrize("block", [256, 6])
def test_near_duplicate_groups(spark, monkeypatch, block):
    monkeypatch.setattr(sketching, "BLOCK", block)
    r = random.Random(5)
    texts, want = [], {}
    for g in range(4):
        w = prose(r, 80).split()
        for i in range(12):  # a chain: each text is like the one before, the ends are not alike
            texts.append((f"{g}{i:02d}", " ".join(w)))
            for k in range(2):
                w[(i * 5 + k * 37) % 80] = r.choice(WORDS)
    pairs = brute_pairs(texts, 0.7)
    for k, _ in texts:
        want[k] = k
    for _ in range(12):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {x["chunk_id"]: (x["group_id"], x["n_chunks"]) for x in sketching.duplicate_groups(chunks(spark, texts)).collect()}
    assert got == {k: (v, sum(x == v for x in want.values())) for k, v in want.items()}


def test_near_duplicates_of_nothing(spark):
    assert sketching.near_duplicates(chunks(spark, [])).count() == 0


# ---- problem 3


def test_split_and_renumber(spark):
    r = random.Random(1)
    long = prose(r, 1000)
    c = chunks(spark, [("d:u#p1", "short text."), ("d:u#p2", long), ("d:v", None), ("d:w", ""), ("d:x", "one  two"), ("d:edge", prose(r, 400))])
    c = c.unionByName(c).withColumn("seq", F.when(F.col("chunk_id") == "d:u#p2", 2).otherwise(F.lit(None).cast("int")))
    p = splitting.renumbered(splitting.split_oversized(c))
    got = defaultdict(list)
    for x in p.orderBy("parent_id", "seq").collect():
        got[x["chunk_id"]].append(x)
    assert {k: len(v) for k, v in got.items()} == {"d:u#p1": 1, "d:u#p2": 3, "d:v": 1, "d:w": 1, "d:x": 1, "d:edge": 1}
    assert [x["seq"] for x in got["d:u#p1"] + got["d:u#p2"]] == [1, 2, 3, 4]
    assert {x["n_chunks_in_unit"] for x in got["d:u#p1"] + got["d:u#p2"]} == {4}
    assert all(x["token_count"] <= 400 for v in got.values() for x in v)
    words, back = long.split(), []
    for x in got["d:u#p2"]:
        back += x["text"].split()[min(splitting.OVERLAP, len(back)) :]
    assert back == words


# ---- problem 4


def test_copies_by_format_and_field_order(spark):
    a = "Suggested action: Do it, now.\nRisks: one, two\nActors: us\nEvidence: The risks: none."
    b = "RISKS: one, two | EVIDENCE: the risks none | suggested action: do it now | actors: US"
    texts = [("d:c", a), ("d:a", b), ("d:b", a.replace("\n", "\n\n")), ("d:z", "Suggested action: Do it, later.\nRisks: one, two\nActors: us\nEvidence: The risks: none.")]
    assert rows(copies.copies_found(chunks(spark, texts, "action"))) == [("d:a", "d:b"), ("d:a", "d:c")]
    # the order of fields counts in other units
    assert rows(copies.copies_found(chunks(spark, texts, "section"))) == [("d:b", "d:c")]


def test_copies_nulls_empty_repeats(spark):
    texts = [("n1", None), ("n2", None), ("e1", ""), ("e2", "  --- "), ("x1", "Same, text"), ("x2", "same TEXT!"), ("x2", "same TEXT!"), ("y", "same texts"), (None, "same text") if False else ("q", "other")]
    c = chunks(spark, texts)
    assert rows(copies.copies_found(c)) == [("e1", "e2"), ("x1", "x2")]
    assert rows(copies.one_record_each(c)) == [("e1", 2), ("q", 1), ("x1", 2), ("y", 1)]
    assert {r["basis"]: (r["n_groups"], r["n_chunks"]) for r in copies.group_counts(c).collect()} == {"raw_identity": (0, 0), "normalised_identity": (2, 4)}
    assert copies.copies_found(chunks(spark, [])).count() == 0


def test_latest_delivery_counts(spark):
    data = [("a", "a", "d", "section", None, "old text", 1, T0), ("a", "a", "d", "section", None, "new text", 1, D(2024, 2, 1)), ("b", "b", "d", "section", None, "old text", 1, T0)]
    assert rows(copies.copies_found(spark.createDataFrame(data, S.CHUNKS))) == []


def test_an_older_delivery_does_not_come_back(spark):
    new = D(2024, 2, 1)
    given = [("x", "old text", T0), ("x", "different", new), ("y", "Old text", T0), ("z", "old, TEXT", T0), ("w", "old text", T0), ("w", None, new), ("v", "b", new), ("v", "a", new), ("u", "A", T0), ("q", "q", None), ("r", "Q", None)]
    c = spark.createDataFrame([(k, k, "d", "section", None, t, 1, at) for k, t, at in given], S.CHUNKS)
    assert rows(copies.copies_found(c)) == [("q", "r"), ("y", "z")]
    # of two deliveries of one time the greater digest counts: md5 of b is 92eb..., of a 0cc1...
    assert rows(copies.one_record_each(c)) == [("q", 2), ("u", 1), ("v", 1), ("x", 1), ("y", 2)]
    assert {r["basis"]: (r["n_groups"], r["n_chunks"]) for r in copies.group_counts(c).collect()} == {"raw_identity": (0, 0), "normalised_identity": (2, 4)}


def test_refinement_equals_one_costly_key(spark):
    r = random.Random(6)
    texts = [(f"t{i:03d}", " ".join(r.choice(["ab", "ba", "a-b", "Ab", "ü"]) for _ in range(r.randrange(4)))) for i in range(150)]
    want = defaultdict(list)
    for k, t in texts:
        want["".join(c for c in t.lower() if c.isalnum())].append(k)
    assert rows(copies.copies_found(chunks(spark, texts))) == sorted((v[0], x) for v in want.values() for x in v[1:])


# ---- problem 5

LISTED = [(w, lang, True) for lang, ws in {"en": "the of and what must do when is tested are shall by for in it that can", "de": "der die das und soll was muss wenn wird ist nicht kann auf mit", "fr": "le la les des est dans que pour par une doit", "es": "el los las del que debe para una por se"}.items() for w in ws.split()]


def answer(cid, text, stop="end_turn"):
    content = None if text is None else [("text", t, None) for t in (text if isinstance(text, list) else [text])]
    return (cid, "succeeded", ("succeeded", ("m", "x", "assistant", stop, content, None)), None, T0)


def test_defects(spark):
    q = "Question: What must the provider do when the model is tested?"
    good = "The provider shall test the model. It is the duty of the provider that the model can be tested."
    a = [answer(f"g{i}", good) for i in range(30)] + [
        answer("empty", [" ", "​"]), answer("none", None), answer("mark", "[]"), ("null", "errored", None, None, T0),
        answer("cut", "The provider shall test the model. It is the duty of the pro"), answer("cut2", "The provider shall test the model:\n1. It is tested.\n2."),
        answer("no", "I'm sorry, but I can't help with that request."), answer("echo", "WHAT MUST THE PROVIDER DO WHEN THE MODEL IS TESTED"),
        answer("de", "Der Anbieter soll das Modell und die Daten prüfen, wenn es nicht mit der Regel ist."), answer("list", "The duties are these.\n- Test the model\n- Test the model", "max_tokens"),
        answer("asked", "Der Anbieter soll das Modell und die Daten prüfen, wenn es nicht mit der Regel ist."), answer("lost", ""),
    ]
    req = [(x[0], "t", "raw", "1", None, q + (" Please reply in German." if x[0] == "asked" else ""), T0) for x in a if x[0] != "lost"]
    args = spark.createDataFrame(a + a[:3], S.ANSWERS), spark.createDataFrame(req, S.REQUESTS), spark.createDataFrame(LISTED, S.WORDLIST)
    got = {r["custom_id"]: r["defect"] for r in pairs.main_defect(pairs.defects(*args)).collect()}
    assert got == {"empty": "empty", "none": "empty", "mark": "empty", "null": "empty", "cut": "truncated", "cut2": "truncated", "no": "refusal", "echo": "copies_question", "de": "other_language"}


def test_defects_of_nothing(spark):
    args = spark.createDataFrame([], S.ANSWERS), spark.createDataFrame([], S.REQUESTS), spark.createDataFrame([], S.WORDLIST)
    assert pairs.defects(*args).count() == 0


# ---- problem 6


def test_affected_records(spark):
    c = chunks(spark, [("a", "plain"), ("b", "prοmpt"), ("b", "prοmpt"), ("c", None), ("d", ""), ("e", "über «надзор»"), ("f", "x" * 5000 + "\u00a0y")])
    h = spark.createDataFrame([(1, "ﬁt"), (1, "ﬁt"), (2, None), (None, "ﬁt"), (3, "fit")], S.DECISIONS)
    assert rows(lookalikes.affected(c, h)) == [("chunks", "b"), ("chunks", "f"), ("hyphen_decisions", "1")]
    assert {r["chunk_id"]: r["text_normal"] for r in lookalikes.normalised(c.select("chunk_id", "text").distinct(), "text").collect()}["b"] == "prompt"
    assert lookalikes.affected(chunks(spark, []), h.limit(0)).count() == 0


# ---- problem 8


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, None) for i, t in texts], S.DOCUMENTS).withColumn("size", F.lit("clash")).withColumn("upto", F.lit(0))


def test_packing(spark):
    r = random.Random(3)
    texts = [(i, prose(r, r.choice([3, 40, 200, 900]))) for i in range(60)] + [(100, None), (101, ""), (102, prose(r, 3000)), (103, "same"), (104, "same")]
    got = packing.assign(docs(spark, texts), 500).collect()
    load, seen = defaultdict(int), defaultdict(list)
    for x in got:
        load[x["container_id"]] += x["n_tokens"]
        seen[x["doc_id"]].append((x["token_start"], x["token_end"]))
    assert max(load.values()) <= 500 and set(seen) == {i for i, _ in texts}
    sizes = {x["doc_id"]: x["n_tokens"] for x in packing.sized(docs(spark, texts)).collect()}
    for i, spans in seen.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sizes[i] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-sizes[i] // 500))
    assert packing.assign(docs(spark, [])).count() == 0


# ---- problem 9


def test_leaks(spark):
    r = random.Random(8)
    q, p = prose(r, 20), prose(r, 60)
    items = spark.createDataFrame([(1, "a", "t", q, p, None), (2, "b", "t", None, "", None), (3, "c", "t", "short words", prose(r, 30), None)], S.ITEMS)
    w = p.split()
    texts = [
        (1, prose(r, 50) + " " + " ".join(w[20:33]).upper() + "! " + prose(r, 9)), (2, "zq " + " ".join(w[20:32]) + " zq"), (3, None), (4, ""), (5, q),
        (6, " zq ".join(" ".join(w[i : i + 10]) for i in (50, 30, 10, 0, 20, 40))), (7, " ".join(w[:7])), (8, " ".join(w[7:20])), (9, prose(r, 30) * 300),
    ]
    assert rows(leaks.leaked(docs(spark, texts), items.unionByName(items))) == [(1, 1), (5, 1), (8, 1)]
    # reordered tiles cover the passage
    tiled = leaks.leaks(docs(spark, texts), items)
    assert [(x["doc_id"], x["covered"]) for x in tiled.filter("part = 'passage' AND item_id = 1 AND covered > 0.9").collect()] == [(6, 1.0)]
    assert leaks.leaked(docs(spark, []), items).count() == 0 and leaks.leaked(docs(spark, texts), items.limit(0)).count() == 0


def test_leaks_equal_tiling_of_every_pair(spark):
    r = random.Random(12)
    phrase = " ".join("abcdefghij"[i] for i in range(8))  # a phrase in every text and item
    parts = {i: f"{prose(r, r.choice([6, 14, 30]))} {phrase} {prose(r, 12)}" for i in range(12)}
    texts = []
    for i in range(60):
        w = parts[i % 12].split()
        a, b = sorted(r.sample(range(len(w) + 1), 2))
        texts.append((i, " ".join([prose(r, 5), *w[a:b], phrase, *w[: r.randrange(9)], phrase, prose(r, 4)])))
    items = spark.createDataFrame([(i, "a", "t", None, p, None) for i, p in parts.items()], S.ITEMS)
    want = set()
    for d, t in texts:
        for i, p in parts.items():
            ids: dict = {}
            x, y = ([ids.setdefault(w, len(ids)) for w in z.split()] for z in (t, p))
            got = leaks.tiles(x, y)
            covered = sum(n for n, _, _ in got) / len(y)
            if got and (got[0][0] >= leaks.RUN or covered >= leaks.COVERED):
                want.add((d, i, got[0][0], round(covered, 9)))
    found = leaks.leaks(docs(spark, texts), items).collect()
    assert {(x["doc_id"], x["item_id"], x["longest"], round(x["covered"], 9)) for x in found} == want and len(found) == len(want) > 20


# ---- problem 10


def test_shapes(spark):
    common = "the of and to in is for that with as on by this be are or an at from which must may shall".split()
    words = [w + s for w in WORDS for s in ("", "ing", "ed", "ation")]
    wl = spark.createDataFrame([(w, "en", True) for w in common] + [(w, "en", False) for w in words], S.WORDLIST)
    made = shapes.labelled_documents(common, words, 40, seed=99)  # other documents than those learned from
    df = docs(spark, [(i, t) for i, t, _ in made] + [(10_000, None), (10_001, "")])
    got = {r["doc_id"]: r["shape"] for r in shapes.shaped(df, wl).collect()}
    assert got[10_000] == got[10_001] == "junk"
    assert sum(got[i] == s for i, _, s in made) / len(made) > 0.95
    assert shapes.shaped(docs(spark, []), wl).count() == 0


# ---- problem 1


def page(doc, number, first, texts):
    return [(first + i, doc, number, i + 1, t, "content", None, None, None, None, T0) for i, t in enumerate(texts)]


def scanned():
    cases = ["alpha", "beta", "gamma", "delta", "zeta", "theta", "kappa", "sigma"]
    body = ["In {} the provider shall test the model before each release of the sys-", "tem and record the results of the model test in the register. In {} the", "third-party provider must record the system and the third-party model as", "part of the register so that {} can test the system."]
    out, at = [], 1
    for n in range(1, 9):
        texts = [b.format(cases[n - 1]) for b in body]
        if n == 1:
            texts.insert(0, "RULES FOR MODELS, VOLUME 1 EDITION 2")
        else:
            texts.insert(0, "Rules for Models" if n % 2 else "Rules f0r Models")
            texts.append(f"Page {n} of 8")
        if n == 5:
            texts[2] = "tem and record the resulfs of the rnodel test in the register. In zeta the"
        out += page("d", n, at, texts)
        at += 20
    return out


def test_noise(spark):
    data = scanned()
    lines = spark.createDataFrame(data + data[:4], S.LINES).withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash"))
    words = spark.createDataFrame([("system", "en", False)], S.WORDLIST)
    got = defaultdict(set)
    for x in scans.noise(lines, words).collect():
        got[x["noise"]].add(x["line_id"])
    assert got["running_header"] == {x[0] for x in data if x[4].lower().startswith(("rules for models", "rules f0r")) and x[2] > 1}
    assert got["page_number"] == {x[0] for x in data if x[4].startswith("Page")}
    assert got["broken_word"] == {x[0] for x in data if x[4].endswith("sys-")}
    assert got["misread"] == {x[0] for x in data if "rnodel" in x[4]}


def test_paragraphs(spark):
    lines = spark.createDataFrame(scanned(), S.LINES)
    text = " ".join(r["text"] for r in scans.paragraphs(lines, spark.createDataFrame([], S.WORDLIST)).orderBy("paragraph").collect())
    assert "Page 3" not in text and "Rules for Models" not in text and "rnodel" not in text and "sys-" not in text
    assert "each release of the system and record the results of the model test" in text and "third-party" in text


def test_misread_words_at_line_ends_and_short_ones(spark):
    data = scanned()
    at = {(x[2], x[3]): x[0] for x in data}
    change = {at[2, 2]: ("In", "1n"), at[3, 5]: ("system.", "5ystem."), at[4, 3]: ("tem and", "tem 4nd"), at[6, 4]: ("model as", "rnodel as"), at[7, 4]: ("third-party", "th1rd-party"), at[2, 5]: ("system.", "systern.")}
    data = [(*x[:4], x[4].replace(*change[x[0]], 1) if x[0] in change else x[4], *x[5:]) for x in data]
    got = {x["line_id"] for x in scans.noise(spark.createDataFrame(data, S.LINES), spark.createDataFrame([], S.WORDLIST)).collect() if x["noise"] == "misread"}
    assert {at[3, 5], at[4, 3], at[7, 4], at[2, 5], at[6, 4]} <= got and got <= set(change) | {x[0] for x in data if "rnodel" in x[4] or "resulfs" in x[4]}


def test_broken_word_over_a_page_of_furniture_only(spark):
    data = [x for x in scanned() if x[2] != 3] + page("d", 3, 41, ["Rules for Models", "Page 3 of 8"])
    data = [(*x[:4], "can test the sys-", *x[5:]) if (x[2], x[3]) == (2, 5) else (*x[:4], "tem " + x[4], *x[5:]) if (x[2], x[3]) == (4, 2) else x for x in data]
    got = {x["line_id"] for x in scans.noise(spark.createDataFrame(data, S.LINES), spark.createDataFrame([], S.WORDLIST)).collect() if x["noise"] == "broken_word"}
    assert next(x[0] for x in data if x[4] == "can test the sys-") in got


def test_noise_of_odd_lines(spark):
    odd = [(1, "d", 1, 1, None, None, None, None, None, None, None), (2, "d", None, None, "text", None, None, None, None, None, None), (None, "d", 1, 1, "text", None, None, None, None, None, None), (3, None, 1, 1, "text", None, None, None, None, None, None), (4, "e", 1, 1, "w " * 5000, None, None, None, None, None, None)]
    assert scans.noise(spark.createDataFrame(odd, S.LINES), spark.createDataFrame([], S.WORDLIST)).count() == 0
    assert scans.noise(spark.createDataFrame([], S.LINES), spark.createDataFrame([], S.WORDLIST)).count() == 0
