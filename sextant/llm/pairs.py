"""Broken prompt and response pairs: noisy labelling functions under an expectation-maximization label model (problem 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.lookalikes import INVISIBLE
from sextant.runtime import broadcast_below, latest, materialise

DEFECTS = ["empty", "refusal", "copies_question", "other_language", "truncated"]
#: Posterior a defect must exceed; the best cutoffs on 1,500 made pairs (``validation``), checked on 1,500 others.
CUTOFF = {"empty": 0.2, "refusal": 0.25, "copies_question": 0.1, "other_language": 0.5, "truncated": 0.25}
VOTES = {"empty": 3, "refusal": 4, "copies_question": 3, "other_language": 3, "truncated": 4}
WORDLIST_LIMIT = 50_000
#: Mean letters a word below which a short answer talks rather than states.
SHORT_WORDS = 4.6
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TOKEN = re.compile(r"\w+")
_NONE = re.compile("[" + re.escape(INVISIBLE) + r"\W_]+")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]*\"")
#: A word of an answer and whether a phrase ends behind it; the last word of an answer.
_WORD_END = re.compile(r"([^\W_]+(?:['’-][^\W_]*)*)([.,;:!?)”»*]|[ \t]*\n)?")
_LAST_WORD = re.compile(r"([^\W_]+(?:['’-][^\W_]*)*)[\s*]*$")
_END = re.compile(r"[.!?…。](?:[\"'”’»)\]*_]|\s)*$|[)\]”»]\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+•–▪◦·]|\(?\w{1,3}[.)]|\[[ xX]?\])(?:\s+|$)")
#: Answers that stand for none.
_PLACEHOLDER = {"", "na", "none", "null", "nil", "nan", "tbd", "todo", "placeholder", "leer", "vide", "vacío"}
#: How a request names the language it wants, by language.
_LANGUAGE = {
    "en": r"english|englisch\w*|anglais|ingl[ée]s",
    "de": r"german|deutsch\w*|allemand|alem[áa]n",
    "fr": r"french|franz[öo]sisch\w*|fran[çc]ais|franc[ée]s",
    "es": r"spanish|spanisch\w*|espagnol|espa[ñn]ol|castellano",
}
_ASKED = re.compile("|".join(rf"(?P<{k}>\b(?:{v})\b)" for k, v in _LANGUAGE.items()), re.I)
_ASKS = re.compile(r"\b(answer|reply|respond|write|use|reader|understands?|speaks?|language|antwort\w*|schreib\w*|sprache|répond\w*|réponse|langue|respond\w*|respuesta|conteste?\w*|idioma|escrib\w*)\b", re.I)
#: Wordings that decline, in four languages.
_DECLINE = re.compile(
    r"\b(can(?:no|')t help|can't|can’t|cannot|can not|unable to|not able to|must decline|decline to|won't|won’t|will not be|would rather not|rather not|do not allow|does not allow|no answer can|too little material|lies? outside|not (?:in a position|permitted|allowed) to|have no (?:answer|opinion)|insufficient|i (?:must )?refuse|nothing in (?:the|these|this)\b|leave (?:it|this) (?:open|unanswered)"
    r"|keine (?:auskunft|antwort|angaben?)|nicht (?:beantworten|antworten|helfen|möglich)|reichen\b.*\bnicht|leider|lässt sich\b.*\bnicht|muss ich ablehnen|darf (?:ich )?nicht"
    r"|pas en mesure|ne (?:peux|puis|peut|permettent|permet)\b|aucune réponse|je (?:dois )?refuse|désolé\w*|regrette"
    r"|no puedo|no es posible|no (?:me )?(?:permite|permiten)|lo siento|no (?:estoy|soy)\b|rechaz\w*|lamento)",
    re.I,
)
_SPEAKER = re.compile(r"\b(i|i'm|i’m|my|me|as an? (?:assistant|ai|model)|ich|mir|je|j'|me|mi|yo|unterlagen|extraits|textos|passages|extracts|material|answer|response|réponse|respuesta|auskunft|antwort|tema)\b", re.I)
_FIRST = re.compile(r"\b(?:i|i'm|i’m|my|ich|mir|je|yo|lo siento|puedo)\b", re.I)
_POLITE = re.compile(r"\b(thank you|thanks|sensitive (?:topic|matter|subject)|danke|vielen dank|heikles|merci|sujet sensible|délicat|gracias|tema (?:delicado|sensible)|consult|sorry|apolog\w*|entschuldig\w*|understand your|having (?:looked|read)|(?:may|might) wish|please (?:contact|rephrase)|rephrase|(?:some|any)thing else|wenden sie sich|sonst noch|formulieren sie|veuillez|reformul\w*|autre chose|póngase|dir[íi]jase|otra cosa|algo más)\b", re.I)


def question_of(user: str) -> str:
    """The question of a request: what follows the last label, else its last paragraph."""
    at = user.rfind("Question:")
    return user[at + 9 :].strip() if at >= 0 else user.strip().rsplit("\n\n", 1)[-1].strip()


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?;])\s+|\n+", text.strip()) if _TOKEN.search(s)]


def language_of(text: str, words: dict[str, dict[str, float]]) -> tuple[str | None, float]:
    """The language most words of a text belong to, and its lead over the next as a share of all recognised weight."""
    score: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        for lang, weight in words.get(w, {}).items():
            score[lang] = score.get(lang, 0) + weight
    if not score:
        return None, 0.0
    best = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    return best[0][0], (best[0][1] - (best[1][1] if len(best) > 1 else 0)) / sum(score.values())


def _votes(answer: str | None, user: str, stop: str | None, last_seen: float | None, last_end: float | None, words: dict) -> list[int]:
    """Votes of every labelling function: 1 defect, 0 none, -1 abstains; in the order of DEFECTS and VOTES."""
    a = answer or ""
    bare = _NONE.sub("", a).lower()
    none = bare in _PLACEHOLDER
    empty = [int(answer is None), int(not bare), int(none) if len(bare) < 12 else 0]
    if none:
        return [*empty, *[0] * (sum(VOTES.values()) - 3)]
    toks = _TOKEN.findall(a.lower())
    q = question_of(user)
    sents = _sentences(a)
    # refusal: sentences that decline or are polite, against those with substance; the short words of talk; the first person
    declines = [bool(_DECLINE.search(s) and (_SPEAKER.search(s) or len(sents) <= 2)) for s in sents]
    substance = [s for s, d in zip(sents, declines) if not d and not _POLITE.search(s) and len(_TOKEN.findall(s)) > 5]
    refusal = [int(any(declines) and not substance), int(len(toks) < 45 and sum(map(len, toks)) <= SHORT_WORDS * len(toks)), 1 if stop == "refusal" else -1, int(bool(_FIRST.search(a))) if len(toks) < 45 else 0]
    # copy of the question or of the whole request
    qt, ut = _TOKEN.findall(q.lower()), _TOKEN.findall(user.lower())
    once = _TOKEN.findall(" ".join(dict.fromkeys(x.strip() for x in a.lower().split("\n"))))  # a line said twice counts once
    core = once[1:] if once[:1] == ["question"] and qt[:1] != ["question"] else once

    def likeness(x: list[str], y: list[str]) -> float:
        left, both = {}, 0
        for t in y:
            left[t] = left.get(t, 0) + 1
        for t in x:
            if left.get(t, 0) > 0:
                left[t] -= 1
                both += 1
        return 2 * both / (len(x) + len(y)) if x or y else 0.0

    inside = " ".join(qt) in " ".join(core) and len(core) <= 1.3 * len(qt) + 1
    by_line = [x for x in (_TOKEN.findall(y.lower()) for y in a.split("\n")) if x]
    to_q, to_u = max(likeness(core, qt), min(likeness(x, qt) for x in by_line)), likeness(core, ut)
    pairs = set(zip(core, core[1:]))
    shared = len(pairs & set(zip(ut, ut[1:]))) / len(pairs) if pairs else 0.0
    copies = [int(max(to_q, to_u) >= 0.8), int(shared >= 0.8 and (to_q >= 0.6 or to_u >= 0.6)), int(inside or core == ut)]
    # language
    asked = None
    for s in _sentences(q):
        if _ASKS.search(s) and (m := _ASKED.search(s)):
            asked = m.lastgroup
    want = asked or language_of(q, words)[0]
    body = _QUOTED.sub(" ", a)
    body = body if len(_WORD.findall(body)) >= 4 else a
    got, lead = language_of(body, words)
    odd = int(bool(want and got and want != got))
    half = _sentences(body)
    by_sentence = [language_of(s, words)[0] for s in half]
    most = sum(x is not None and x != want for x in by_sentence) * 2 > len(by_sentence) if want else False
    language = [odd if lead > 0.15 else -1, int(most), odd if len(toks) > 6 else -1]
    # truncation
    end = a.rstrip().rstrip(INVISIBLE).rstrip()
    lines = [x for x in end.split("\n") if x.strip()]
    last = lines[-1] if lines else ""
    items = [x for x in lines if _ITEM.match(x)]
    in_item = bool(_ITEM.match(last))
    done = bool(_END.search(end)) and not re.fullmatch(r"\s*\(?\w{1,3}[.)]", last)
    opened = end.count("“") > end.count("”") or end.count("(") > len(re.findall(r"(?<!^\w)\)", end)) and "(" in last and ")" not in last or last.count("**") % 2 == 1
    hanging = bool(re.search(r"[,;:(\[–—“«-]\s*$", end)) or opened or bool(re.fullmatch(r"\s*(?:[-*+•]|\(?\w{1,3}[.)]|\d+[.)]\s*\*\*[^*]*\**:?)\s*", last))
    stops = sum(bool(_END.search(x)) for x in items[:-1])
    if done and not hanging:
        mark = 0
    elif not in_item:
        mark = 1
    else:
        mark = 1 if len(items) > 1 and stops == len(items) - 1 else -1
    known = -1 if done or last_seen is None else int(last_seen <= 1)
    whole = -1 if done or last_end is None else int(last_end < 0.02)
    truncated = [mark, int(hanging) if hanging or done else -1, 1 if known == 1 else whole, 1 if stop == "max_tokens" and mark else 0 if done else -1]
    if in_item and mark == -1 and truncated[2] == 0:
        truncated[0] = 0
    return [*empty, *refusal, *copies, *language, *truncated]


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, prior: float = 0.05) -> np.ndarray:
    """Posterior of the defect for each distinct vote pattern, by expectation-maximization.

    Every labelling function has its own rates of voting for the defect, given a defect or none; they start from the
    assumption that it is right more often than not, and are smoothed towards it. An abstention is no evidence. Only
    distinct patterns and their counts are needed, so the size of the collection does not matter.
    """
    start = np.array([0.05, 0.8])  # votes for the defect, given none and given one
    rate = np.repeat(start[:, None], patterns.shape[1], axis=1)
    yes, no = (patterns == 1).astype(float), (patterns == 0).astype(float)
    share, weight, post = prior, 0.02 * counts.sum() + 20, np.zeros(len(patterns))
    for _ in range(rounds):
        logs = [yes @ np.log(rate[y]) + no @ np.log(1 - rate[y]) for y in (0, 1)]
        new = 1 / (1 + np.exp(-np.clip(np.log(share) + logs[1] - np.log(1 - share) - logs[0], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        share = float(np.clip((post @ counts + prior * 20) / (counts.sum() + 20), 1e-4, 0.5))
        for y, w in ((0, (1 - post) * counts), (1, post * counts)):
            rate[y] = np.clip((w @ yes + weight * start[y]) / (w @ (yes + no) + weight), 1e-4, 1 - 1e-4)
    return post


def joined_pairs(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(custom_id, answer, user_text, stop_reason) of answers with a request; second deliveries count once (the latest).

    The answer is the concatenation of its content texts; null where there is no response, message or content.
    """
    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = answers.select(
        "custom_id", F.col("response.message.stop_reason").alias("stop_reason"), "collected_at",
        F.array_join(F.transform(F.col("response.message.content"), lambda c: F.coalesce(c["text"], F.lit(""))), "").alias("answer"),
    )
    r = requests.select("custom_id", F.coalesce("user_text", F.lit("")).alias("user_text"), "created_at")
    # one exchange a side, by number, so that what reads the pairs has as many tasks; newest and join use it
    a, r = a.repartition(n, "custom_id"), r.repartition(n, "custom_id")
    return latest(a, "custom_id", ["collected_at", "answer"]).join(latest(r, "custom_id", ["created_at", "user_text"]), "custom_id")


def _word_ends(pairs: DataFrame) -> DataFrame:
    """(word, seen, share_end): how often each word of all answers occurs, and how often a phrase ends with it."""
    word = r"[\p{L}\p{N}'\x{2019}-]+"
    found = F.regexp_extract_all(F.lower("answer"), F.lit(rf"({word}(?:[.,;:!?)\x{{201d}}\x{{bb}}*]|[ \t]*\n)?)"), 1)
    each = pairs.select(F.explode(found).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    bare = F.regexp_extract("x", f"^{word}", 0)
    return each.groupBy(bare.alias("word")).agg(F.sum("n").alias("seen"), (F.sum(F.when(F.col("x") != bare, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_end"))


def voted(answers: DataFrame, requests: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(custom_id, votes): the votes of all labelling functions on each pair, materialised."""
    spark = answers.sparkSession
    listed = wordlist.filter("word IS NOT NULL AND lang IS NOT NULL").select(F.lower("word").alias("word"), "lang", F.coalesce("common", F.lit(False)).alias("common")).limit(WORDLIST_LIMIT + 1).collect()
    if len(listed) > WORDLIST_LIMIT:
        raise ValueError(f"more than {WORDLIST_LIMIT} words")
    words: dict[str, dict[str, float]] = {}
    for r in listed:
        words.setdefault(r["word"], {})[r["lang"]] = 1.0
    for langs in words.values():
        for lang in langs:
            langs[lang] = 1.0 / len(langs)
    shared = spark.sparkContext.broadcast(words)
    pairs = materialise(joined_pairs(answers, requests))
    tail = F.regexp_extract(F.lower("answer"), r"([\p{L}\p{N}'\x{2019}-]+)[\s*]*$", 1)
    wanted = pairs.select("*", tail.alias("word"))
    # the few words answers end with, and what all answers tell of them
    ends = materialise(_word_ends(pairs).join(wanted.filter("word <> ''").select("word").distinct(), "word", "left_semi"))
    small = broadcast_below(ends, 32 << 20)
    full = wanted.join(small, "word", "left")
    if small is ends:  # joined by the last word: spread anew, so that a hot word is not one task of Python
        full = full.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "custom_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                seen = None if pd.isna(r.seen) else float(r.seen)
                end = None if pd.isna(r.share_end) else float(r.share_end)
                answer = r.answer if isinstance(r.answer, str) else None
                rows.append((r.custom_id, _votes(answer, r.user_text, r.stop_reason if isinstance(r.stop_reason, str) else None, seen, end, words)))
            yield pd.DataFrame(rows, columns=["custom_id", "votes"])

    return materialise(full.select("custom_id", "answer", "user_text", "stop_reason", "seen", "share_end").mapInPandas(run, "custom_id string, votes array<int>"))


def posteriors(answers: DataFrame, requests: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(custom_id, votes, one posterior per defect). Votes are counted by pattern; the label model sees the counts only.

    Patterns number at most 3 to the number of labelling functions of a defect, whatever the input.
    """
    v = voted(answers, requests, wordlist)
    spark = v.sparkSession
    out, at = v, 0
    for name in DEFECTS:
        k = VOTES[name]
        part = F.slice("votes", at + 1, k)
        at += k
        seen = v.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        if not seen:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        post = label_model(np.array([r["p"] for r in seen]), np.array([r["n"] for r in seen], float))
        table = spark.createDataFrame([([int(x) for x in r["p"]], float(p)) for r, p in zip(seen, post)], f"p{name} array<int>, {name} double")
        out = out.join(F.broadcast(table), part == F.col(f"p{name}")).drop(f"p{name}")
    return out


def defects(answers: DataFrame, requests: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(custom_id, defect, posterior): every defect whose posterior exceeds its cutoff; a pair may have several."""
    p = posteriors(answers, requests, wordlist)
    each = F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior"), F.lit(CUTOFF[d]).alias("cutoff")) for d in DEFECTS])
    return p.select("custom_id", F.explode(each).alias("x")).filter("x.posterior > x.cutoff").select("custom_id", "x.defect", F.bround("x.posterior", 6).alias("posterior"))


def main_defect(found: DataFrame) -> DataFrame:
    """(custom_id, defect): the first of empty, refusal, copies_question, other_language, truncated that a pair has."""
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return found.groupBy("custom_id").agg(F.min_by("defect", rank).alias("defect"))
