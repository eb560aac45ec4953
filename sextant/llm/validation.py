"""Labelled pairs made to validate the cutoffs of the label models on (problem 5); part of the tests, not of a query."""

from __future__ import annotations

import random

import numpy as np

from sextant.llm import pairs as P

#: A few of the commonest words of each language, and nouns and verbs to speak of.
FUNCTION = {
    "en": "the of and to in is that for with as on by this be are or it shall must when which from".split(),
    "de": "der die das und zu in ist dass für mit als auf von dieser sind oder es soll muss wenn welche aus".split(),
    "fr": "le la les et de dans est que pour avec comme sur par cette sont ou il doit quand qui depuis une".split(),
    "es": "el la los y de en es que para con como sobre por esta son o se debe cuando cual desde una".split(),
}
CONTENT = {
    "en": "provider system model register record test review release report threshold operator measure assessment quality policy training".split(),
    "de": "anbieter systeme modelle verzeichnis aufzeichnung prüfung freigabe bericht schwelle betreiber maßnahme bewertung qualität schulung".split(),
    "fr": "fournisseur système modèle registre dossier essai publication rapport seuil exploitant mesure évaluation qualité formation".split(),
    "es": "proveedor sistema modelo registro expediente prueba publicación informe umbral operador medida evaluación calidad formación".split(),
}
#: Refusals worded otherwise than the labelling functions' own list was written from.
REFUSED = {
    "en": ["I'm afraid I can't help with this one.", "As an assistant I am not able to say more on it.", "I have to decline to answer this.", "Sorry, I cannot go into that."],
    "de": ["Dazu kann ich leider nichts sagen.", "Darauf darf ich nicht antworten.", "Das muss ich ablehnen."],
    "fr": ["Je ne peux pas vous aider sur ce point.", "Désolé, je ne suis pas en mesure d'en dire plus.", "Je dois refuser."],
    "es": ["Lo siento, no puedo ayudar con eso.", "No me es posible responder a esto.", "Lamento no poder decir más."],
}


def words_of() -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for words in (FUNCTION, CONTENT):
        for lang, ws in words.items():
            for w in ws:
                out.setdefault(w, {})[lang] = 1.0
    return {w: {k: 1 / len(v) for k in v} for w, v in out.items()}


def made_pairs(n: int, seed: int) -> list[tuple[str, str | None, str | None, str | None]]:
    """(user_text, answer, stop_reason, defect): half of them sound, each defect as often as the others."""
    r = random.Random(seed)

    def sentence(lang: str) -> str:
        w = [r.choice(FUNCTION[lang]) if r.random() < 0.5 else r.choice(CONTENT[lang]) for _ in range(r.randint(7, 22))]
        return (" ".join(w)).capitalize() + "."

    def answer(lang: str) -> str:
        s = [sentence(lang) for _ in range(r.randint(1, 6))]
        return " ".join(s) if r.random() < 0.6 else s[0][:-1] + ":\n" + "\n".join(f"- {x}" for x in s[1:] + [sentence(lang)])

    out = []
    for i in range(n):
        lang, defect = r.choice(list(FUNCTION)), None if i % 2 else P.DEFECTS[i // 2 % 5]
        question = sentence(lang)[:-1] + "?"
        user = " ".join(sentence(lang) for _ in range(4)) + "\n\nQuestion: " + question
        text, stop = answer(lang), "end_turn"
        if defect == "empty":
            text = r.choice([None, "", " \n ", "[]", "N/A", "...", "​"])
        elif defect == "refusal":
            text, stop = r.choice(REFUSED[lang]), r.choice(["end_turn", "refusal", None])
        elif defect == "copies_question":
            text = r.choice([question, question.upper(), "Question: " + question, user])
        elif defect == "other_language":
            text = answer(r.choice([x for x in FUNCTION if x != lang]))
        elif defect == "truncated":
            w = text.split(" ")
            cut = " ".join(w[: r.randint(max(3, len(w) // 3), max(4, len(w) - 1))]).rstrip(" .")
            text, stop = cut[: len(cut) - r.choice([0, 0, 2])], r.choice(["max_tokens", "end_turn"])
        out.append((user, text, stop, defect))
    return out


def posteriors(made: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(posterior per pair and defect, whether it has the defect) under label models fitted to the votes alone."""
    words, seen, ends = words_of(), {}, {}
    for _, text, _, _ in made:
        for m in P._WORD_END.finditer((text or "").lower()):
            seen[m[1]] = seen.get(m[1], 0) + 1
            ends[m[1]] = ends.get(m[1], 0) + bool(m[2])
    votes = []
    for user, text, stop, _ in made:
        last = P._LAST_WORD.search((text or "").lower())
        w = last[1] if last else None
        votes.append(P._votes(text, user, stop, seen.get(w), ends[w] / seen[w] if w in seen else None, words))
    v, out, at = np.array(votes), [], 0
    for d in P.DEFECTS:
        k = P.VOTES[d]
        patterns, back, counts = np.unique(v[:, at : at + k], axis=0, return_inverse=True, return_counts=True)
        out.append(P.label_model(patterns, counts.astype(float))[back.reshape(-1)])
        at += k
    return np.array(out).T, np.array([[x[3] == d for d in P.DEFECTS] for x in made])


def f1(post: np.ndarray, true: np.ndarray, cutoff: float) -> float:
    found = post > cutoff
    both = (found & true).sum()
    return 2 * both / max(1, found.sum() + true.sum())


def fitted_cutoffs(made: list[tuple]) -> dict[str, float]:
    """The cutoff of each defect with the best F1; of equally good ones the middle one."""
    post, true = posteriors(made)
    grid, out = np.round(np.arange(0.05, 0.96, 0.05), 2), {}
    for j, d in enumerate(P.DEFECTS):
        score = np.array([f1(post[:, j], true[:, j], c) for c in grid])
        best = np.flatnonzero(score >= score.max() - 1e-12)
        out[d] = float(grid[best[len(best) // 2]])
    return out
