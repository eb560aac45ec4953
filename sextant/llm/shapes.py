"""Per-document text statistics and the shape of a document by an induced rule list (problem 10)."""

from __future__ import annotations

import base64
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents made per shape to learn from; the only bounded part, all else covers every document.
TRAIN_PER_SHAPE = 900
#: How many documents of prose a collection has for each of another shape, for the learner's choices.
PROSE_WEIGHT = 8.0
#: Rule lists learned, of which the best is used.
TRIES = 5
#: Most entries a list of common words may have to be used as literals.
COMMON_LIMIT = 5_000

_ITEM = r"^\s*([-*+>](?=\s)|[\x{2022}\x{25aa}\x{25e6}\x{2013}\x{b7}\x{25cf}\x{2023}\x{2192}\x{2713}]|\[[ xX]?\]|\(?\w{1,4}[.)\]:](?=\s)|\d+(\.\d+)+\.?(?=\s))\s*\S"
_ROW = r"(\|.*\|)|(\t[^\t]*\t)|(\S {2,}\S.*\S {2,}\S)|(^[^,]{0,32}(,[^,]{0,32}){2,}$)|(^[^;]{0,48}(;[^;]{0,48}){2,}$)|(^\+[-=+]+\+$)|(^[-=| :+]{5,}$)"


def statistics(documents: DataFrame, common: list[str], names: list[str] | None = None) -> DataFrame:
    """doc_id and one row of statistics per document, computed natively; of ``names`` only, where given.

    Each pass over a text is made once, and only if a statistic asked for needs it: what the passes find goes
    through a generator, behind which no later filter or projection makes them run again. A null text counts as
    empty; ratios of an empty text are 0. Extra columns are ignored.
    """
    wanted = STATISTICS if names is None else [n for n in STATISTICS if n in names]
    text, lines = F.col("text"), F.filter(F.split("text", r"\s*\n\s*"), lambda x: x != "")
    found = {
        "w": F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}']+"), lambda w: w != ""),
        "l": lines,
        "k": F.transform(lines, lambda x: F.when(x.rlike(_ITEM) & ~x.startswith("|"), 2).when(x.rlike(_ROW), 1).when(F.length(x) >= 40, 3).otherwise(0)),
        "n": F.length(text),
        "ink": F.length(F.regexp_replace("text", r"\s+", "")),
        "sym": F.length(F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\s]+", "")),
        "stray": F.length(F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\s.,;:|+=%/-]+", "")),
        "ends": F.regexp_count("text", F.lit(r"\p{L}[.!?\x{2026}][\"'\x{201d}\x{2019}\x{bb})]*(\s|$)")),
        "s": F.split("text", r"[.!?]\s+|\n"),
    }

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def chars(code: int) -> Column:
        return F.aggregate(F.zip_with("l", "k", lambda x, k: F.when(k == code, F.length(x)).otherwise(0)), F.lit(0), lambda a, x: a + x)

    def lines_of(code: int) -> Column:
        return F.size(F.filter("k", lambda k: k == code))

    n_w, n_l = F.size("w"), F.size("l")
    every = {
        "n_words": (n_w, "w"),
        "mean_word_length": (share(F.col("ink") - F.col("sym"), n_w), "w ink sym"),
        "symbol_ratio": (share(F.col("sym"), F.col("ink")), "sym ink"),
        "punct_line_share": (share(F.size(F.filter("l", lambda x: x.rlike(r"[.!?:;\x{2026}][\"'\x{201d}\x{2019}\x{bb})\]]*$"))), n_l), "l"),
        "common_word_share": (share(F.size(F.filter("w", lambda w: w.isin(*common))), n_w), "w"),
        "stray_ratio": (share(F.col("stray"), F.col("ink")), "stray ink"),
        "n_lines": (n_l, "l"),
        "item_char_share": (share(chars(2), F.col("n")), "l k n"),
        "row_line_share": (share(lines_of(1), n_l), "l k"),
        "prose_char_share": (share(chars(3), F.col("n")), "l k n"),
        "distinct_sentence_share": (share(F.size(F.array_distinct("s")), F.size("s")), "s"),
        "words_per_line": (F.least(share(n_w, n_l), F.lit(60.0)), "w l"),
        "sentence_end_ratio": (share(F.col("ends"), n_w), "ends w"),
    }
    needs = {x for n in wanted for x in every[n][1].split()}
    raw = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    passed = raw.select("doc_id", F.explode(F.array(F.struct(*[v.alias(k) for k, v in found.items() if k in needs]))).alias("f")).select("doc_id", "f.*")
    done = passed.select("doc_id", F.explode(F.array(F.struct(*[every[n][0].alias(n) for n in wanted]))).alias("f"))
    return done.select("doc_id", "f.*")


STATISTICS = [
    "n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share", "stray_ratio", "n_lines", "item_char_share", "row_line_share",
    "prose_char_share", "distinct_sentence_share", "words_per_line", "sentence_end_ratio",
]
FEATURES = [
    "common_word_share", "punct_line_share", "stray_ratio", "item_char_share", "row_line_share", "prose_char_share",
    "distinct_sentence_share", "words_per_line", "sentence_end_ratio",
]


def common_words(wordlist: DataFrame) -> list[str]:
    """The common words of a fixed list, lower-cased; raises where the list is no longer small."""
    rows = wordlist.filter("common AND word IS NOT NULL").select(F.lower("word").alias("w")).distinct().limit(COMMON_LIMIT + 1).collect()
    if len(rows) > COMMON_LIMIT:
        raise ValueError(f"more than {COMMON_LIMIT} common words")
    return sorted(r["w"] for r in rows) or [""]


# ---- labelled documents -------------------------------------------------------------------------------------------


def _sentence(r: random.Random, common: list[str], words: list[str], share: float = 0.42) -> str:
    n = r.randint(6, 24)
    out = [r.choice(common) if r.random() < share else r.choice(words) for _ in range(n)]
    if r.random() < 0.4:
        out[n // 2] += ","
    if r.random() < 0.15:
        out[r.randrange(n)] = str(r.randint(2, 99))
    return " ".join(out).capitalize() + r.choice("......?;")[:1].replace(";", ".")


def _marked(r: random.Random, text: str) -> str:
    """Prose with some of its words in quotation marks, in brackets or with an apostrophe, as many a text has them."""
    rate = r.choice([0.02, 0.06, 0.15])
    form = ["“{}”", '"{}"', "({})", "{}’s", "{}'s", "*{}*", "§ {}", "«{}»", "({}) &"]
    return "".join(w if w.isspace() or not w or r.random() > rate else r.choice(form).format(w) for w in re.split(r"(\s+)", text))


def _wrap(text: str, width: int) -> str:
    lines, cur = [], ""
    for w in text.split(" "):
        if cur and len(cur) + len(w) >= width:
            lines.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}".strip()
    return "\n".join([*lines, cur])


def _phrase(r: random.Random, common: list[str], words: list[str], most: int = 8) -> str:
    return " ".join(r.choice(common) if r.random() < 0.3 else r.choice(words) for _ in range(r.randint(2, most)))


def _list(r: random.Random, common: list[str], words: list[str], n: int) -> str:
    if r.random() < 0.1:
        return "\n".join(f"{i // 9 + 1}.{i % 9 + 1}  {_phrase(r, common, words, 4).capitalize()} {'.' * r.randint(3, 14)} {i * 3 + 4}" for i in range(n))
    style = r.choice(["", "", "", "- ", "* ", "• ", "{}. ", "{}) ", "({}) ", "[ ] ", "[x] ", "– ", "", "+ "])
    end = r.choice(["", "", ";", "."])
    most = r.choice([5, 8, 11])
    return "\n".join(style.format(i + 1) + _phrase(r, common, words, most) + end for i in range(n))


def _table(r: random.Random, words: list[str]) -> str:
    cols, rows, style = r.randint(3, 7), r.randint(4, 30), r.choice(["pipe", "bar", "csv", "semi", "tab", "grid", "wide", "grid", "keys", "keys"])

    def cell() -> str:
        return r.choice([str(r.randint(0, 5000)), f"{r.random() * 100:.1f}%", "n/a", "yes", "no", "", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/2024", " ".join(r.choices(words, k=2)), r.choice(words)])

    data = [[" ".join(r.choices(words, k=2)) for _ in range(cols)], *[[cell() for _ in range(cols)] for _ in range(rows)]]
    if style in ("csv", "semi", "tab"):
        return "\n".join({"csv": ",", "semi": ";", "tab": "\t"}[style].join(x) for x in data)
    if style == "bar":
        return "\n".join(" | ".join(x) for x in data)
    if style == "pipe":
        data.insert(1, ["---"] * cols)
        return "\n".join("| " + " | ".join(x) + " |" for x in data)
    if style == "keys":
        data = [[*x, *x[: r.randint(0, 3)]] for x in data]
        return "\n".join("; ".join(f"{h}={c}" for h, c in zip(data[0], x)) for x in data[1:])
    width = 18
    flat = [[c[:width].ljust(width) for c in x] for x in data]
    if style == "wide":
        return "\n".join("  ".join(x).rstrip() for x in flat)
    rule = "+" + "+".join(["-" * (width + 2)] * cols) + "+"
    every = r.random() < 0.3
    body = ["| " + " | ".join(x) + " |" for x in flat]
    return "\n".join([rule, *[y for x in body for y in (x, rule)]] if every else [rule, body[0], rule, *body[1:], rule])


def _junk(r: random.Random, common: list[str], words: list[str]) -> str:
    kind = r.choice([0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 9, 10, 11, 11])
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == 0:
        return " ".join("".join(r.choices(letters, k=r.randint(2, 12))) for _ in range(r.randint(20, 150)))
    if kind == 1:
        return "\n".join(f"{i * 16:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)) for i in range(r.randint(4, 40)))
    if kind == 2:
        return _wrap(base64.b64encode(r.randbytes(r.randint(100, 900))).decode(), 76) if r.random() < 0.5 else base64.b64encode(r.randbytes(r.randint(100, 900))).decode()
    if kind == 3:
        nav = ["Home", "Menu", "Search...", "Next >>", "<< Previous", "Contact", "Archive", "Subscribe", "Topics", "Language: EN", "Login", "Print", "Share", "Home > Topics > Models", "Cookie settings", "Back to top", "Log in", "Accept all", "Print | Save | Send", "Go to the top", "All about us"]
        return r.choice(["\n", " | ", "\n"]).join(r.choices(nav, k=r.randint(12, 70)))
    if kind == 4:
        s = _sentence(r, common, words)
        return r.choice([" ", "\n"]).join([s] * r.randint(6, 40))
    if kind == 5:
        t = " ".join(_sentence(r, common, words) for _ in range(r.randint(4, 14)))
        odd = ["ï¿½", "Ã©", "â€™", "?", "Â", "Ã", "�"]
        rate = r.uniform(0.12, 0.4)
        return "".join(r.choice(odd) if r.random() < rate else c for c in t)
    if kind == 6:
        return "".join(chr(r.randint(33, 126)) if r.random() < 0.88 else " " for _ in range(r.randint(150, 1500)))
    if kind == 7:
        w = r.choices(words, k=r.randint(1, 4))
        return " ".join(w * r.randint(20, 120))
    if kind == 11:  # letters out of order
        text = " ".join(_sentence(r, common, words) for _ in range(r.randint(4, 20)))
        return " ".join("".join(r.sample(w, len(w))) if r.random() < 0.9 else w for w in text.split(" "))
    if kind == 8:
        return " ".join(r.choice("&~<>/^@=\\{}%|#*+-_") * r.randint(1, 10) for _ in range(r.randint(15, 120)))
    if kind == 9:
        return "\n".join([f"{r.choice(words)} 0x{r.randrange(65536):04x}"] * r.randint(10, 90))
    return "".join(r.choices("0123456789abcdef", k=r.randint(150, 1200))) if r.random() < 0.5 else "".join("%%%02X" % r.randrange(256) if r.random() < 0.7 else r.choice(letters) for _ in range(r.randint(60, 500)))


def labelled_documents(common: list[str], words: list[str], per_shape: int = TRAIN_PER_SHAPE, seed: int = 7) -> list[tuple[int, str, str]]:
    """(doc_id, text, shape): made documents of each shape, among them prose that holds a short list or wrapped lines."""
    r = random.Random(seed)
    out: list[tuple[int, str, str]] = []
    for i in range(per_shape):
        own, share = r.sample(words, min(len(words), r.choice([25, 60, 150, 600]))), r.uniform(0.22, 0.55)
        s = [_sentence(r, common, own, share) for _ in range(r.choice([3, 8, 15, 40, 150]))]
        s += r.sample(s, len(s) // r.choice([4, 8, 1000]))  # formulaic prose says a sentence again
        text = " ".join(s)
        if i % 5 < 2:
            text = _marked(r, text)
        if i % 4 == 1:
            text = _wrap(text, r.choice([50, 60, 72, 90]))
        if i % 4 == 2:
            k = r.randint(2, 6)
            text = text + "\n" + _list(r, common, words, k) if len(text) > 160 * k else text
        if i % 4 == 3:
            text = "\n\n".join(" ".join(s[a : a + 4]) for a in range(0, len(s), 4))
        if i % 9 == 0:
            text = "".join(c + " " * (c == " " and r.random() < 0.05) for c in text)
        if i % 5 == 0:
            text = _phrase(r, common, words, 4).capitalize() + "\n" + text
        out.append((len(out), text, "prose"))
        own = r.sample(words, min(len(words), r.choice([25, 60, 150, 600])))
        head = _sentence(r, common, words) + "\n" if r.random() < 0.5 else ""
        body = _list(r, common, own, r.randint(6, 60))
        tail = "\n" + _sentence(r, common, words) if r.random() < 0.2 else ""
        out.append((len(out), head + body + tail, "list"))
        head = _sentence(r, common, words) + "\n" if r.random() < 0.3 else ""
        out.append((len(out), head + _table(r, words), "table"))
        out.append((len(out), _junk(r, common, words), "junk"))
    return out


# ---- rule induction -------------------------------------------------------------------------------------------------

Rule = list[tuple[str, str, float]]


def _covers(x: np.ndarray, rule: Rule, names: list[str]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, op, v in rule:
        c = x[:, names.index(f)]
        ok &= c >= v if op == ">=" else c <= v
    return ok


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, names: list[str]) -> Rule:
    """Conditions by largest FOIL gain until no negative is covered; documents count by their weights."""
    rule: Rule = []
    at = np.ones(len(x), bool)
    while (at & ~y).any() and len(rule) < 5:
        p0, n0 = w[at & y].sum(), w[at & ~y].sum()
        best = (1e-9, None)
        for j, f in enumerate(names):
            v, wp, wn = x[at, j], w[at] * y[at], w[at] * ~y[at]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 41)))
            for c in (cuts[1:] + cuts[:-1]) / 2:
                for op, ok in ((">=", v >= c), ("<=", v <= c)):
                    p, n = wp[ok].sum(), wn[ok].sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, op, float(c)))
        if best[1] is None:
            break
        rule.append(best[1])
        at = _covers(x, rule, names)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, w: np.ndarray, names: list[str]) -> Rule:
    """The prefix of the rule with the largest (p - n) / (p + n) on documents it was not grown on."""

    def worth(k: int) -> float:
        ok = _covers(x, rule[:k], names)
        p, n = w[ok & y].sum(), w[ok & ~y].sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def induce(x: np.ndarray, shape: np.ndarray, names: list[str], order: tuple[str, ...] = ("table", "list", "junk"), seed: int = 11, prose: float = PROSE_WEIGHT) -> list[tuple[Rule, str]]:
    """Ordered rule list by incremental reduced-error pruning: per shape, grow on two thirds, prune on the rest, drop what is covered.

    A document of prose counts ``prose`` times, as prose is that much more frequent than each other shape. A rule is kept
    if more than half of the weight it covers on the rest is of its shape.
    """
    rng = np.random.default_rng(seed)
    weight = np.where(shape == "prose", prose, 1.0)
    left = np.ones(len(x), bool)
    out: list[tuple[Rule, str]] = []
    for target in order:
        for _ in range(12):
            idx = rng.permutation(np.flatnonzero(left))
            if not (shape[idx] == target).any():
                break
            a, b = idx[: len(idx) * 2 // 3], idx[len(idx) * 2 // 3 :]
            rule = _prune(_grow(x[a], shape[a] == target, weight[a], names), x[b], shape[b] == target, weight[b], names)
            ok = _covers(x, rule, names) & left
            held = _covers(x[b], rule, names)
            right = held & (shape[b] == target)
            if not rule or not held.any() or weight[b][right].sum() * 2 <= weight[b][held].sum() or right.sum() < 2:
                break
            out.append((rule, target))
            left &= ~ok
    return out


def predicted(x: np.ndarray, rules: list[tuple[Rule, str]], names: list[str]) -> np.ndarray:
    """The shape the rule list gives each document."""
    out, left = np.full(len(x), "prose", object), np.ones(len(x), bool)
    for rule, shape in rules:
        ok = _covers(x, rule, names) & left
        out[ok] = shape
        left &= ~ok
    return out


def induce_best(x: np.ndarray, shape: np.ndarray, names: list[str], tries: int = TRIES) -> list[tuple[Rule, str]]:
    """The best of ``tries`` rule lists, each grown and pruned on another three quarters of the documents, by the weight of errors on all of them."""
    weight, best = np.where(shape == "prose", PROSE_WEIGHT, 1.0), (np.inf, [])
    for k in range(tries):
        part = np.random.default_rng(100 + k).permutation(len(x))[: len(x) * 3 // 4]
        rules = induce(x[part], shape[part], names, seed=k)
        wrong = weight[predicted(x, rules, names) != shape].sum()
        if wrong < best[0]:
            best = (wrong, rules)
    return best[1]


def to_case(rules: list[tuple[Rule, str]], otherwise: str = "prose") -> str:
    """The rule list as one SQL CASE expression."""
    whens = " ".join("WHEN " + " AND ".join(f"{f} {op} {v!r}D" for f, op, v in rule) + f" THEN '{shape}'" for rule, shape in rules)
    return f"CASE {whens} ELSE '{otherwise}' END" if whens else f"'{otherwise}'"


def learned_case(wordlist: DataFrame, per_shape: int = TRAIN_PER_SHAPE) -> tuple[str, list[str]]:
    """The CASE expression learned from the made documents, and the common words used."""
    spark = wordlist.sparkSession
    common = common_words(wordlist)
    words = sorted(r["word"] for r in wordlist.filter("NOT common AND length(word) > 3").select("word").distinct().orderBy("word").limit(COMMON_LIMIT).collect()) or ["word"]
    made = pd.DataFrame(labelled_documents(common, words, per_shape), columns=["doc_id", "text", "shape"])
    stats = statistics(spark.createDataFrame(made[["doc_id", "text"]]), common, FEATURES).toPandas().set_index("doc_id").sort_index()
    rules = induce_best(stats[FEATURES].to_numpy(float), made["shape"].to_numpy(str), FEATURES)
    return to_case(rules), common


def shaped(documents: DataFrame, wordlist: DataFrame) -> DataFrame:
    """doc_id, the statistics the learned rules use, and ``shape``: prose, list, table or junk (a text without words is junk)."""
    case, common = learned_case(wordlist)
    s = statistics(documents, common, ["n_words", *[f for f in FEATURES if f in case]])
    return s.withColumn("shape", F.when(F.col("n_words") == 0, "junk").otherwise(F.expr(case)))
