"""Repair of text from scanned pages: page furniture, broken words, misread words, reflow (problem 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.runtime import broadcast_below, latest, materialise, running_total

#: What recognition prints for what stood there.
CONFUSIONS = [
    ("c", "e"), ("l", "i"), ("0", "o"), ("f", "t"), ("5", "s"), ("@", "a"), ("ri", "n"), ("(", "c"), ("1", "l"), ("cl", "d"), ("ii", "u"), ("y", "v"),
    ("rn", "m"), ("b", "h"), ("q", "g"), ("6", "b"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("n", "ri"), ("w", "vv"), ("u", "ii"), ("i", "l"), ("e", "c"),
    ("t", "f"), ("8", "b"), ("9", "g"), ("1", "i"), ("|", "l"), ("$", "s"), ("h", "b"), ("v", "y"), ("o", "0"),
]
HYPHENS = "-‐‑­¬￾"
EDITS = 2
#: A word is a misreading only of a word at least this many times as frequent.
RATIO = 6
LEAST = 3

_DIGITS = r"[\dOolISB]{1,4}"
_ROMAN = r"[ivxlcIVXLC]{1,7}"
_PAGE = r"[Pp]\S{1,3}[ec]\.?"
_WHOLE = re.compile(rf"^(?:(?P<word>{_PAGE})\s+)?(?P<open>[-–—\[(|]?)\s*(?P<n>{_DIGITS}|{_ROMAN})(?P<of>\s*(?:[o0]f|/)\s*{_DIGITS})?\s*[-–—\])|]?$")
_START = re.compile(rf"^(?:{_PAGE}\s+(?P<a>{_DIGITS})(?:\s+[o0]f\s+{_DIGITS})?|[-–\[]\s*(?P<b>{_DIGITS})\s*[-–\]]|(?P<c>{_DIGITS})\s*\||(?P<d>{_DIGITS})(?=\s\s))\s*")
_FINISH = re.compile(rf"\s*(?:\b{_PAGE}\s+(?P<a>{_DIGITS})(?:\s+[o0]f\s+{_DIGITS})?|[-–\[]\s*(?P<b>{_DIGITS})\s*[-–\]]|\|\s*(?P<c>{_DIGITS})|(?<=\s\s)(?P<d>{_DIGITS}))$")
_AS_DIGITS = str.maketrans("OolISB", "001158")


def _number(label: str) -> int:
    digits = label.translate(_AS_DIGITS)
    return int(digits) if digits.isdigit() else -1


def _prefix_end(head: str, text: str) -> int | None:
    """Where the start of ``text`` that reads ``head`` ends, up to an eighth of its letters wrong; None if it doesn't."""
    if text.startswith(head):
        return len(head)
    words = head.split()
    have = set(text[: len(head) + 8].split())
    if sum(w in have for w in words) * 2 < len(words):
        return None
    most = max(1, len(head) // 8)
    row = list(range(len(text[: len(head) + most]) + 1))
    seen = text[: len(head) + most]
    for i, c in enumerate(head, 1):
        new = [i]
        for j, d in enumerate(seen, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    best = min(range(len(row)), key=lambda j: (row[j], abs(j - len(head))))
    if row[best] > most:
        return None
    while best < len(text) and best and text[best].isalnum() and text[best - 1].isalnum():
        best += 1  # never inside a word
    return best


def parse_edge(text: str, page: int, heads: list[str], kinds: list[str]) -> tuple[bool, bool, str]:
    """(heading, number, body) of a line at the top or bottom of a page: what furniture it holds and what is left of it."""
    s = text.strip()
    m = _WHOLE.match(s)
    if m and (m["word"] or m["open"] or m["of"] or _number(m["n"]) == page or re.fullmatch(_ROMAN, m["n"])):
        return False, True, ""
    number = False
    rest = s
    if (m := _START.match(rest)) and _number(next(x for x in m.groups() if x)) == page and not rest[m.end() :].startswith("of "):
        number, rest = True, rest[m.end() :].strip()
    if (m := _FINISH.search(rest)) and m.end() > m.start() and _number(next(x for x in m.groups() if x)) == page:
        number, rest = True, rest[: m.start()].strip()
    low = rest.lower()
    for h in heads:
        end = _prefix_end(h, low)
        if end is not None:
            body = rest[end:].strip()
            if m := re.match(rf"(?:\|\s*)?({_DIGITS})(?:\s+|$)", body):
                if _number(m[1]) == page:
                    number, body = True, body[m.end() :]
            return True, number, body
        start = _prefix_end(h[::-1], low[::-1])
        if start is not None:
            body = rest[: len(rest) - start].strip()
            if m := re.search(rf"(?:^|\s)({_DIGITS})\s*\|?$", body):
                if _number(m[1]) == page:
                    number, body = True, body[: m.start()].strip()
            return True, number, body if len(body) > 20 else ""  # so little before it belongs to the heading
    if m := re.match(r"(.{3,60}?) [—–-] (.+)$", low):
        for k in kinds:
            end = _prefix_end(k, m[2])
            if end is not None and (len(m[2]) - end < 2 or rest[m.start(2) + end :].startswith(" ")):
                return True, number, rest[m.start(2) + end :].strip()
    return False, number, rest if number else text


def inventory(lines: DataFrame) -> DataFrame:
    """One row per line with its place on the page; second deliveries count once (the latest), null ids and documents drop out."""
    one = latest(lines.select("line_id", "doc_id", "page", "line_no", F.coalesce("text", F.lit("")).alias("text"), "extracted_at"), "line_id", ["extracted_at", "text"])
    on_page = W.partitionBy("doc_id", "page")
    return one.filter(F.col("doc_id").isNotNull()).select(
        "line_id", "doc_id", "page", "line_no", "text",
        F.row_number().over(on_page.orderBy("line_id")).alias("pos"), F.count("*").over(on_page).alias("n_on_page"),
    )


def headings(placed: DataFrame) -> DataFrame:
    """(doc_id, heads, title): what repeats at the edges of a document's pages, and its title; lower case, longest first.

    Counted per document and text before anything is gathered, so a document of any length gives a few rows.
    """
    edge = (F.col("pos") <= 2) | (F.col("pos") == F.col("n_on_page"))
    core = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", rf"^\s*{_DIGITS}(\s*\||\s\s)\s*", ""), rf"\s*(\||\s\s)\s*{_DIGITS}\s*$", "")))
    seen = placed.select("doc_id", "page", core.alias("core"), edge.alias("edge")).groupBy("doc_id", "core").agg(
        F.sum(F.col("edge").cast("int")).alias("n"), F.sum((~F.col("edge")).cast("int")).alias("inside")
    )
    pages = placed.filter("pos = 1").groupBy("doc_id").agg(F.count("*").alias("pages"))
    often = seen.join(pages, "doc_id").filter(
        (F.col("n") >= 3) & (F.col("n") >= 0.12 * F.col("pages")) & (F.col("inside") * 5 <= F.col("n"))
        & (F.length("core") >= 6) & F.col("core").rlike(r"\S\s+\S") & ~F.col("core").rlike(r"[.,;:]$|^(page|\W|\d)")
    ).groupBy("doc_id").agg(F.collect_set("core").alias("often"))
    title = placed.groupBy("doc_id").agg(F.min_by("text", "line_id").alias("t"))
    base = F.lower(F.trim(F.regexp_extract("t", r"(?i)^(.*?)(?:,?\s+volume\b.*|\s+edition\b.*)?$", 1)))
    all_heads = F.array_union(F.coalesce("often", F.array().cast("array<string>")), F.when(F.length(base) >= 6, F.array(base)).otherwise(F.array().cast("array<string>")))
    return title.join(often, "doc_id", "left").select("doc_id", F.array_sort(all_heads, lambda a, b: F.length(b) - F.length(a)).alias("heads"), base.alias("title"))


def without_furniture(lines: DataFrame) -> DataFrame:
    """(line_id, doc_id, page, line_no, text, heading, number, body): only lines at page edges pass through Python."""
    placed = materialise(inventory(lines))
    edge = (F.col("pos") <= 2) | (F.col("pos") == F.col("n_on_page"))
    first = placed.groupBy("doc_id").agg(F.min("line_id").alias("first_line"))
    at_edge = placed.filter(edge).join(headings(placed), "doc_id").join(first, "doc_id").select("line_id", "doc_id", "page", "line_no", "text", "heads", "title", (F.col("line_id") == F.col("first_line")).alias("is_title"))
    schema = "line_id long, doc_id string, page int, line_no int, text string, heading boolean, number boolean, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                title = r.title.split()
                kinds = [" ".join(title[:k]) for k in (4, 3, 2, 1) if len(title) >= k]
                got = (False, False, r.text) if r.is_title else parse_edge(r.text, -1 if pd.isna(r.page) else int(r.page), list(r.heads), kinds)
                rows.append((r.line_id, r.doc_id, r.page, r.line_no, r.text, *got))
            yield pd.DataFrame(rows, columns=["line_id", "doc_id", "page", "line_no", "text", "heading", "number", "body"])

    inner = placed.filter(~edge).select("line_id", "doc_id", "page", "line_no", "text", F.lit(False).alias("heading"), F.lit(False).alias("number"), F.col("text").alias("body"))
    return inner.unionByName(at_edge.mapInPandas(run, schema))


def _clean(token: Column) -> Column:
    """Lower case without the punctuation around a word; an opening bracket stays where it may stand for a letter."""
    t = F.regexp_replace(F.lower(token), r"^[\"'\x{201c}\x{2018}\[]+|^\((?=.*\))|[.,;:!?\"'\x{201d}\x{2019}\])]+$", "")
    return t


def next_bodies(clean: DataFrame) -> DataFrame:
    """Lines with running text and, for each, the following one's body on its page or, at its end, on the next page that has any.

    Windows span one page; pages are numbered along their document by a range sort and meet by a join, so no document is
    gathered. Lines without a page are followed by none.
    """
    body = clean.filter(F.trim("body") != "")
    w = W.partitionBy("doc_id", "page").orderBy("line_id")
    inside = body.select("*", F.lead("body").over(w).alias("_next"), F.lead("line_id").over(w).alias("_next_id"))
    starts = body.filter("page IS NOT NULL").groupBy("doc_id", "page").agg(F.min("line_id").alias("_fid"), F.min_by("body", "line_id").alias("_fbody"))
    numbered = materialise(running_total(starts, ["doc_id"], [F.col("_fid")], F.lit(1), "_no"))
    after = numbered.select("doc_id", (F.col("_no") - 1).alias("_no"), "_fid", "_fbody")
    following = numbered.select("doc_id", "page", "_no").join(after, ["doc_id", "_no"]).drop("_no")
    return inside.join(following, ["doc_id", "page"], "left").select(
        *body.columns, F.when(F.col("_next_id").isNull(), F.col("_fid")).otherwise(F.col("_next_id")).alias("next_id"), F.when(F.col("_next_id").isNull(), F.col("_fbody")).otherwise(F.col("_next")).alias("next_body")
    )


def tokens(bodies: DataFrame) -> DataFrame:
    """(line_id, at, n, word, before): the cleaned tokens of running text with their place, the line's number of them, and the one before."""
    # a line is split and cleaned once: what comes out goes through a generator
    once = bodies.select("line_id", F.explode(F.array(F.transform(F.split(F.trim("body"), r"\s+"), _clean))).alias("t"))
    each = once.select("line_id", F.size("t").alias("n"), F.posexplode(F.arrays_zip(F.col("t").alias("word"), F.concat(F.array(F.lit(None).cast("string")), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))).alias("before"))).alias("at", "x"))
    return each.select("line_id", "at", "n", F.col("x.word").alias("word"), F.col("x.before").alias("before"))


def word_counts(said: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(word, n, listed): how often each word stands inside a line, and whether the list has it; hyphenated words and their parts count.

    The first and last word of a line are no evidence, since they may be halves.
    """
    w = said.filter((F.col("at") > 0) & (F.col("at") < F.col("n") - 1)).groupBy("word").agg(F.count("*").alias("n"))
    parts = w.filter(F.col("word").contains("-")).select(F.explode(F.split("word", "-")).alias("word"), "n")
    n = w.unionByName(parts).filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    listed = wordlist.filter("word IS NOT NULL").select(F.lower("word").alias("word")).distinct().withColumn("listed", F.lit(True))
    return n.join(listed, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("listed", F.lit(False)).alias("listed"))


def broken_words(bodies: DataFrame, counts: DataFrame) -> DataFrame:
    """(line_id, next_id, left, right, joined): last words that go on in the next line.

    Evidence: the joined word against the word with its hyphen; only the two halves' four forms are looked up.
    """
    last = F.regexp_extract(F.trim("body"), r"(\S+)$", 1)
    first = F.regexp_extract(F.trim("next_body"), r"^(\S+)", 1)
    mark = last.rlike(rf"[{HYPHENS}]$")
    left = F.regexp_replace(F.lower(F.regexp_replace(last, rf"[{HYPHENS}]+$", "")), r"^[\"'(\x{201c}\x{2018}\[]+", "")
    right = _clean(first)
    cut = bodies.select("line_id", "next_id", left.alias("left"), right.alias("right"), mark.alias("mark"), last.rlike(r"[-\x{2010}\x{2011}]$").alias("plain"), first.alias("raw")).filter(
        F.col("left").rlike(r"[\p{L}]$") & F.col("raw").rlike(r"^\p{Ll}") & F.col("next_id").isNotNull()
    )
    forms = {"joined": F.concat("left", "right"), "kept": F.concat("left", F.lit("-"), "right"), "l": F.col("left"), "r": F.col("right")}
    asked = cut.select("line_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("word")) for k, v in forms.items()])).alias("x")).select("line_id", "x.k", "x.word")
    got = asked.join(counts, "word").groupBy("line_id").agg(*[F.max(F.when(F.col("k") == k, F.col("n") + F.col("listed").cast("int"))).alias(f"n_{k}") for k in forms])
    full = cut.join(got, "line_id", "left").fillna(0, [f"n_{k}" for k in forms])
    attested = F.col("n_joined") + F.col("n_kept") > 0
    with_mark = F.when(attested, F.col("n_joined") > F.col("n_kept")).otherwise(~F.col("plain") | (F.col("n_l") < LEAST) | (F.col("n_r") < LEAST))
    bare = (F.col("n_joined") > F.col("n_kept")) & ((F.col("n_l") * 10 <= F.col("n_joined")) | (F.col("n_r") * 10 <= F.col("n_joined")))
    return full.filter(F.when(F.col("mark"), with_mark).otherwise(bare)).select("line_id", "next_id", "left", "right", F.concat("left", "right").alias("joined"))


def explains(seen: str, meant: str, most: int = 2) -> bool:
    """Whether ``seen`` is ``meant`` with one to ``most`` of the known confusions and nothing else."""
    if seen == meant:
        return False
    todo, done = [(0, 0, 0)], set()
    while todo:
        i, j, k = todo.pop()
        if i == len(seen) and j == len(meant):
            return True
        if (i, j, k) in done:
            continue
        done.add((i, j, k))
        if i < len(seen) and j < len(meant) and seen[i] == meant[j]:
            todo.append((i + 1, j + 1, k))
        if k < most:
            todo += [(i + len(a), j + len(b), k + 1) for a, b in CONFUSIONS if seen.startswith(a, i) and meant.startswith(b, j)]
    return False


def trie_of(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def within(trie: dict, word: str, most: int = EDITS) -> list[tuple[str, int]]:
    """All words of the trie at Levenshtein distance up to ``most``: the automaton of ``word`` run along the trie.

    A state of the automaton is the row of distances to each prefix of ``word``; paths without a place under the bound end.
    """
    out = []
    todo = [(trie, tuple(range(len(word) + 1)))]
    while todo:
        node, row = todo.pop()
        for c, child in node.items():
            if c == "":
                if row[-1] <= most:
                    out.append((child, row[-1]))
                continue
            new = [row[0] + 1]
            for j, d in enumerate(word):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
            if min(new) <= most:
                todo.append((child, tuple(new)))
    return out


def _spans(n: int) -> list[tuple[int, int]]:
    """EDITS + 1 pieces of a word of ``n`` letters: with EDITS edits at least one stays whole."""
    k = EDITS + 1
    cuts = [n * i // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:]))


def vocabulary_keys(word: str) -> list[str]:
    return [f"{len(word)}/{i}/{word[a:b]}" for i, (a, b) in enumerate(_spans(len(word)))]


def query_keys(word: str) -> list[str]:
    """Keys of the pieces one of which every vocabulary word within EDITS edits of ``word`` shares with it.

    The edits before and behind a shared piece bound how far it may have moved: of the pieces in order one has at most as
    many edits before it as pieces, and the rest behind it, so few places are asked for, and none is missed.
    """
    out = set()
    for n in range(max(1, len(word) - EDITS), len(word) + EDITS + 1):
        longer = len(word) - n
        for i, (a, b) in enumerate(_spans(n)):
            behind = EDITS - i
            low, high = max(-i, longer - behind), min(i, longer + behind)
            for shift in range(low, high + 1):
                if 0 <= a + shift and b + shift <= len(word):
                    out.add(f"{n}/{i}/{word[a + shift:b + shift]}")
    return sorted(out)


#: Words asked for under one key in one place; keys with more are spread over several.
ASKED_MOST = 20_000


def corrections(counts: DataFrame, seen: DataFrame) -> DataFrame:
    """(seen, meant, distance, n_meant, explained): all candidates within EDITS edits for the words ``seen`` (word, n).

    Words and vocabulary meet by the pieces an edit cannot touch, in hash buckets; each key of a bucket has its own
    trie, so no vocabulary is broadcast and none needs to fit into one task. A key many words ask for is spread over as
    many places, each with the key's vocabulary. ``explained`` tells whether known confusions alone turn one word into
    the other. Words of letters only that they do not explain are words of their own; so are those of the list.
    """
    n_buckets = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocab = counts.filter((F.col("n") >= LEAST) & F.col("word").rlike(r"^\p{L}{2,}$")).select("word", "n")
    listed = counts.filter("listed").select("word")
    letters = F.col("word").rlike(r"^\p{L}*$")
    asked = seen.filter(F.col("word").rlike(r"\p{L}") & (F.length("word") >= F.when(letters, 3).otherwise(2))).join(listed, "word", "left_anti").select("word", "n")

    def keyed(df: DataFrame, keys) -> DataFrame:
        @F.pandas_udf("array<string>")
        def udf(s: pd.Series) -> pd.Series:
            return s.map(keys)

        return df.withColumn("key", F.explode(udf("word")))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("key", "salt"), F.lit(n_buckets)))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = set()
        by_key = {k: g for k, g in right.groupby("key")} if len(left) else {}
        for key, g in left.groupby("key") if len(right) else ():
            if key not in by_key:
                continue
            r = by_key[key]
            size, trie = dict(zip(r["word"], r["n"])), trie_of(list(r["word"]))
            for w, n in zip(g["word"], g["n"]):
                for v, d in within(trie, w):
                    if d and size[v] >= RATIO * n and (len(v) > 2 or not w.isalpha()):
                        known = explains(w, v)
                        if known or not w.isalpha():
                            rows.add((w, v, d, int(size[v]), known))
        return pd.DataFrame(sorted(rows), columns=["seen", "meant", "distance", "n_meant", "explained"])

    ask = materialise(keyed(asked, query_keys))
    hot = ask.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > ASKED_MOST).select("key", F.ceil(F.col("k") / ASKED_MOST).cast("int").alias("places"))
    hot = broadcast_below(materialise(hot), 16 << 20)
    left = ask.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("word"), F.coalesce("places", F.lit(1)))).drop("places")
    right = keyed(vocab, vocabulary_keys).join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("places", F.lit(1)).cast("long") - 1))).drop("places")
    out = placed(left).groupBy("bucket").cogroup(placed(right).groupBy("bucket")).applyInPandas(match, "seen string, meant string, distance int, n_meant long, explained boolean")
    return out.distinct()


def read_words(said: DataFrame, broken: DataFrame) -> DataFrame:
    """(line_id, at, part, word, before): the words of running text without the halves of broken ones; hyphenated words by part, without soft hyphens."""
    halves = broadcast_below(broken.select("line_id", F.lit(True).alias("cut_last")).distinct(), 32 << 20)
    after = broadcast_below(broken.select(F.col("next_id").alias("line_id"), F.lit(True).alias("cut_first")).distinct(), 32 << 20)
    each = said.join(halves, "line_id", "left").join(after, "line_id", "left")
    kept = each.filter(~((F.col("at") == 0) & F.coalesce("cut_first", F.lit(False))) & ~((F.col("at") == F.col("n") - 1) & F.coalesce("cut_last", F.lit(False))))
    parts = F.split(F.translate("word", "\xad\ufffe", ""), rf"[{HYPHENS}]")
    return kept.select("line_id", "at", "before", F.posexplode(parts).alias("part", "word")).filter(F.col("word") != "")


def misread_words(said: DataFrame, broken: DataFrame, counts: DataFrame) -> DataFrame:
    """(line_id, at, part, word, meant): misread words with the reading that fits best.

    Every word of running text is asked for, wherever in its line it stands. Candidates are ranked by whether known
    confusions explain them, by edits, by how often they follow the word before, by frequency, then by letters. Very short
    words, and words with a digit or sign no confusion explains, have to follow the word before somewhere else.
    """
    words = materialise(read_words(said, broken))
    fixes = materialise(corrections(counts, words.groupBy("word").agg(F.count("*").alias("n"))))
    hit = materialise(words.join(fixes, words["word"] == fixes["seen"]))
    asked = broadcast_below(materialise(hit.select(F.col("before").alias("b"), F.col("meant").alias("m")).distinct()), 64 << 20)
    pairs = words.select("before", "word").join(asked, (F.col("before") == F.col("b")) & (F.col("word") == F.col("m"))).groupBy("b", "m").agg(F.count("*").alias("together"))
    ranked = hit.join(pairs, (F.col("before") == F.col("b")) & (F.col("meant") == F.col("m")), "left").withColumn("together", F.coalesce("together", F.lit(0)))
    sure = (F.col("explained") & (F.length("meant") > 2)) | (F.col("together") > 0)
    order = F.struct(~F.col("explained"), F.col("distance"), -F.col("together"), -F.col("n_meant"), F.col("meant"))
    return ranked.filter(sure).groupBy("line_id", "at", "part", "word").agg(F.min_by("meant", order).alias("meant"))


def repaired(lines: DataFrame, wordlist: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines without furniture, bodies, broken words, misread words)."""
    clean = materialise(without_furniture(lines))
    bodies = materialise(next_bodies(clean))
    said = materialise(tokens(bodies))
    counts = materialise(word_counts(said, wordlist))
    broken = materialise(broken_words(bodies, counts))
    return clean, bodies, broken, misread_words(said, broken, counts)


def noise(lines: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(line_id, noise): running_header, page_number, broken_word, misread; one row per line and kind."""
    clean, _, broken, misread = repaired(lines, wordlist)
    kinds = F.array(F.when(F.col("heading"), "running_header"), F.when(F.col("number"), "page_number"))
    furniture = clean.filter("heading OR number").select("line_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("noise"))
    return furniture.unionByName(broken.select("line_id", F.lit("broken_word").alias("noise"))).unionByName(misread.select("line_id", F.lit("misread").alias("noise"))).distinct()


def paragraphs(lines: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(doc_id, paragraph, first_line_id, text): continuous text without furniture, broken words joined, misread ones corrected.

    A paragraph ends where line numbers leave a gap, or at a page end behind a full stop. Paragraphs are numbered by a range
    sort and built one by one; an empty document has none.
    """
    clean, bodies, broken, misread = repaired(lines, wordlist)
    fixed = misread.groupBy("line_id").agg(F.collect_list(F.struct("word", "meant")).alias("fix"))
    b = bodies.select("line_id", "doc_id", "page", "line_no", "body").join(fixed, "line_id", "left")

    @F.pandas_udf("string")
    def apply(body: pd.Series, fix: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(body, fix):
            for x in f if f is not None else ():
                def put(m: re.Match, meant: str = x["meant"]) -> str:
                    return meant.capitalize() if m[0][:1].isupper() else meant
                t = re.sub(r"(?<![^\W\d_])" + re.escape(x["word"]) + r"(?![^\W\d_])", put, t, flags=re.I)
            out.append(t)
        return pd.Series(out)

    w = W.partitionBy("doc_id", "page").orderBy("line_id")
    done = b.withColumn("text", F.when(F.col("fix").isNull(), F.trim("body")).otherwise(apply(F.trim("body"), F.col("fix"))))
    gap = done.withColumn("prev_no", F.lag("line_no").over(w)).join(broken.select(F.col("next_id").alias("line_id"), F.lit(True).alias("goes_on")).distinct(), "line_id", "left").join(
        broken.select("line_id", F.lit(True).alias("cut")).distinct(), "line_id", "left")
    fresh = F.when(F.col("goes_on"), 0).when(F.col("prev_no").isNull(), F.col("text").rlike(r"^[^\p{Ll}]").cast("int")).otherwise((F.col("line_no") - F.col("prev_no") > 1).cast("int"))
    numbered = running_total(gap.select("line_id", "doc_id", "text", "cut", fresh.alias("fresh")), ["doc_id"], [F.col("line_id")], F.col("fresh"), "paragraph")
    piece = F.when(F.col("cut"), F.regexp_replace("text", rf"[{HYPHENS}]+$", "")).otherwise(F.when(F.col("text").rlike(rf"[{HYPHENS}]$"), F.regexp_replace("text", rf"[{HYPHENS}]$", "-")).otherwise(F.concat("text", F.lit(" "))))
    grouped = numbered.select("doc_id", "paragraph", F.struct("line_id", piece.alias("x")).alias("s")).groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("doc_id", "paragraph", F.element_at("s", 1)["line_id"].alias("first_line_id"), F.trim(F.array_join(F.transform("s", lambda x: x["x"]), "")).alias("text"))
