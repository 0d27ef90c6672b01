"""Defective question and answer pairs (problem 3), by tagging the clauses of the answer.

A conditional random field tags each clause as answer, refusal, echo, foreign or
unfinished; the share of the clauses decides the pair's defect. The field is trained on a
bounded sample of the given pairs: as they are, and damaged on purpose (cut short, replaced
by the question, by another pair's answer in another language, or by a refusal), so that
the labels come with the damage. How likely a sentence ends where an answer stops is
counted over all answers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.crf import CRF
from mnemograph.session import cut

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: pairs that the field is trained on, before they are damaged
TRAINING_PAIRS = 2500
HASHED = 384
#: lengths of the contexts by which the end of a sentence is judged
CONTEXTS = (7, 5, 3, 2, 1)
#: longest answers that are trained on, in clauses; all answers are tagged whole
TRAINING_CLAUSES = 10

# fixed values: function words of the languages
FUNCTION_WORDS = {
    "en": "the a an of and in to is was were are for by with on from at about that this who what which how why when where did does do before after not it its be has had have than or as their her his he she they",
    "de": "der die das und in im ist war wurde wurden von zu den dem des ein eine einer einem nicht mit auf für als an bei nach über wer wie wo warum worum was welche welcher welches geht es um hat sich sie er ihre weil dass obwohl bis später",
    "es": "el la los las de del y en un una que por con para se su fue es son quién qué cómo dónde cuándo cuántos cuántas trata al no lo según entre hasta tras poco sobre como más pero porque está varios",
}
# fixed values: words by which a question names the language it wants
LANGUAGE_NAMES = {"en": "english englisch inglés 英语 英文", "de": "german deutsch alemán 德语 德文", "es": "spanish spanisch español 西班牙语 西班牙文", "zh": "chinese chinesisch chino 中文 汉语"}
# fixed values: answers without content
PLACEHOLDERS = "null none nil n/a na nan tbd tba todo unknown - -- ... … ? ?? . answer antwort respuesta 答案 答 无 k.a. s/d xxx placeholder undefined empty".split() + [
    "no answer", "no response", "not available", "not applicable", "to be determined", "to be done", "keine antwort", "keine angabe", "sin respuesta", "no disponible", "无答案", "暂无", "待定",
]
# fixed values: what a refusal says; {} takes the subject
REFUSALS = {
    "en": ["I cannot answer this question.", "I'm sorry, but I can't help with that.", "I am unable to provide an answer.", "I'm not able to discuss {}.", "I don't have enough information to tell.", "I must decline this request.", "I would rather not comment on {}.", "I won't be able to say anything about {}.", "My instructions do not allow me to go into {}.", "Nothing in the sources lets me answer.", "That is not something I can discuss.", "I cannot provide details about {}.", "As an assistant, I have to say that I can't answer.", "Sorry - I do not know.", "Apologies, I have no information about {}.", "Thank you for asking about {}. However, I am unable to answer this question."],
    "de": ["Das kann ich leider nicht beantworten.", "Es tut mir leid, aber ich kann diese Frage nicht beantworten.", "Zu {} liegen mir keine Angaben vor.", "Über {} möchte ich mich nicht äußern.", "Diese Anfrage muss ich ablehnen.", "Ich habe dazu nicht genügend Informationen.", "Dabei kann ich Ihnen nicht helfen.", "Danke für die Frage, doch dazu darf ich nichts sagen."],
    "es": ["No puedo responder a esta pregunta.", "Lo siento, pero no tengo información suficiente.", "Prefiero no opinar sobre {}.", "Debo rechazar esta solicitud.", "No me es posible ayudarle con eso.", "No dispongo de datos sobre {}.", "Gracias por preguntar, pero no puedo decir nada sobre {}."],
    "zh": ["对不起，我无法回答这个问题。", "抱歉，我不能提供相关信息。", "我没有足够的信息来回答。", "我必须拒绝这个请求。", "关于{}，我不便评论。", "很遗憾，我无法帮助您。"],
}
COURTESIES = {
    "en": ["Is there anything else you need?", "Please consult another source.", "Let me know if you can share more context.", "A specialist could assist you better.", "Records about {} may be kept elsewhere."],
    "de": ["Bitte nutzen Sie eine andere Quelle.", "Kann ich sonst noch helfen?"],
    "es": ["Consulte otra fuente, por favor.", "¿Puedo ayudarle en algo más?"],
    "zh": ["请查阅其他来源。", "还有什么可以帮您的吗？"],
}
ASKED = {"en": "You asked: ", "de": "Ihre Frage war: ", "es": "Usted preguntó: ", "zh": "您的问题是："}
#: words of a refusal: first person and what is denied; counted outside quotations
FIRST_PERSON = set("i i'm i'd i'll i've me my mine we our us ich mir mich mein meine wir puedo tengo debo prefiero siento dispongo quisiera podemos me nos".split())
DENIAL = set("cannot can't couldn't unable sorry apologies apologize decline declined won't don't not rather no nothing never regret afraid leider leid keine kein nicht nichts ablehnen no sin rechazar imposible lamento siento".split())
POLITE = set("you your please let help assist answer question request information details discuss comment provide asking instructions assistant context source bitte ihnen ihre frage danke helfen beantworten angaben quelle pregunta responder información usted favor consulte gracias ayudarle fuente opinar solicitud".split())
_CJK_FIRST, _CJK_DENIAL, _CJK_POLITE = "我", ("无法", "不能", "抱歉", "对不起", "拒绝", "没有足够", "不便", "遗憾"), ("请", "您", "回答", "提供", "查阅", "帮")

#: hashed letter runs that profiles of languages are made of
GRAMS = 1 << 13
#: marks by which an answer is written in another script than its question
_SCRIPTS = {
    "kana": re.compile("[\u3040-\u30ff]"), "hangul": re.compile("[\uac00-\ud7af]"), "cyrillic": re.compile("[\u0400-\u04ff]"), "greek": re.compile("[\u0370-\u03ff]"), "hebrew": re.compile("[\u0590-\u05ff]"),
    "arabic": re.compile("[\u0600-\u06ff]"), "devanagari": re.compile("[\u0900-\u097f]"), "thai": re.compile("[\u0e00-\u0e7f]"), "han": re.compile("[\u4e00-\u9fff]"), "latin": re.compile("[A-Za-z\u00c0-\u024f]"),
}
_SENTENCE = re.compile(r"[^.!?。！？;；\n]*(?:[.!?。！？;；\n]+[\"'”’»)\]]*|$)")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile("[一-鿿]")
_QUOTED = re.compile(r"(?<!\w)(['\"“‘«]).{3,}?['\"”’»](?!\w)")
_END = re.compile(r"[.!?。！？][\"'”’»)\]]*\s*$")
_TITLE = re.compile(r"(?<=\s)[A-Z]\w*(?:\s+(?:(?:of|at|from|the|a|and|in)\s+){0,3}[A-Z]\w*)+|(?<=\s)[A-Z]\w*")
_LANG = {w: [l for l, ws in FUNCTION_WORDS.items() if w in ws.split()] for ws in FUNCTION_WORDS.values() for w in ws.split()}


def words_of(text: str) -> list[str]:
    """Words, and each CJK character as a word of its own."""
    return [w for x in _WORDS.findall(text) for w in (list(x) if _CJK.search(x) else [x])]


def language(text: str) -> tuple[str, float]:
    """The language with the most function words and its lead; '' without evidence."""
    n_cjk = len(_CJK.findall(text))
    text = _TITLE.sub(" ", text)  # names and titles keep their language in any prose
    plain = [w for w in _WORDS.findall(text) if w[:1].islower() or w.lower() in _LANG]
    votes: Counter = Counter()
    for w in plain:
        langs = _LANG.get(w.lower(), ())
        for l in langs:
            votes[l] += 1 / len(langs)
    votes["es"] += 1.5 * len(re.findall("[¿¡ñ]", text))
    votes["de"] += 1.0 * len(re.findall("[ßäöü]", text))
    if n_cjk >= 4 and n_cjk > 2 * sum(votes.values()):
        return "zh", float(n_cjk)
    ranked = votes.most_common(2)
    if not ranked or ranked[0][1] < 1:
        return "", 0.0
    return ranked[0][0], ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0.0)


def script(text: str) -> str:
    """The script that most letters are of; Japanese by its kana, '' without letters. A CJK character counts as three letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    counts = {name: len(form.findall(text)) * (3 if name in ("han", "kana", "hangul") else 1) for name, form in _SCRIPTS.items()}
    if counts["kana"] > 0.15 * (counts["kana"] + counts["han"]):
        counts["kana"] += counts.pop("han")
    best = max(counts, key=counts.get)
    return best if counts[best] else ""


@lru_cache(maxsize=1 << 15)
def _runs_of(word: str) -> tuple[int, ...]:
    padded = f" {word} "
    return tuple(zlib.crc32(padded[i : i + 3].encode()) % GRAMS for i in range(len(padded) - 2))


def letter_runs(text: str) -> list[int]:
    """Hashed runs of three letters of the words in small letters, which names are not."""
    out = []
    for word in _WORDS.findall(_TITLE.sub(" ", text)):
        if word[:1].islower() and not _CJK.search(word):
            out.extend(_runs_of(word))
    return out


class Profiles:
    """Letter profiles of the corpus's own languages: how unlike a text is to one of them.

    ``counts`` has a row for each of ``names``. A text's mean log probability is compared
    with what texts of the language have, so a language that the corpus lacks is unlike all.
    """

    def __init__(self, names: list[str], counts: np.ndarray):
        self.place = {name: i for i, name in enumerate(names)}
        share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
        self.log = np.log(share)
        self.mean = (share * self.log).sum(axis=1)
        self.deviation = np.sqrt((share * (self.log - self.mean[:, None]) ** 2).sum(axis=1))

    def unlike(self, name: str, text: str) -> tuple[float, float]:
        """(by how many deviations of its mean a text is less likely than texts of the language, lead of another profile)."""
        runs = letter_runs(text)
        i = self.place.get(name)
        if i is None or len(runs) < 8:
            return 0.0, 0.0
        each = self.log[:, runs].mean(axis=1)
        far = (self.mean[i] - each[i]) / max(1e-6, self.deviation[i]) * math.sqrt(len(runs))
        return min(12.0, max(0.0, far)), max(0.0, float(each.max() - each[i]))


def _count_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = list(FUNCTION_WORDS)
    for batch in batches:
        counts = np.zeros((len(names), GRAMS), np.int64)
        for text in [*batch.question.dropna(), *batch.answer.dropna()]:
            name, lead = language(text)
            if name in names and lead >= 2:
                np.add.at(counts[names.index(name)], letter_runs(text), 1)
        row, run = np.nonzero(counts)
        yield pd.DataFrame({"lang": row, "run": run, "n": counts[row, run]})


def profiles(pairs: DataFrame) -> Profiles:
    """Profiles from all questions and answers; of fixed size."""
    names = list(FUNCTION_WORDS)
    counts = np.zeros((len(names), GRAMS))
    summed = pairs.select("question", "answer").mapInPandas(_count_runs, "lang int, run int, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n")).toPandas()
    counts[summed.lang, summed.run] = summed.n
    return Profiles(names, counts)


def wanted_language(question: str) -> str:
    """The language a question asks its answer to be in, '' if it names none."""
    low = question.lower()
    named = [l for l, names in LANGUAGE_NAMES.items() if any(n in low for n in names.split())]
    return named[0] if named else ""


def is_empty(answer: str | None) -> bool:
    """Null, blank, or a placeholder without content."""
    if answer is None:
        return True
    plain = " ".join(re.sub("[\u200b-\u200d\u2060\ufeff]", "", answer).split()).strip("\"'“”‘’[](){}<>*_ ").lower()
    letters = re.sub(r"[\W_]", "", plain)
    # a remark in brackets and nothing else, without a number or a name
    remark = re.fullmatch(r"\s*(?:\[[^\]\d]*\]|\([^)\d]*\)|<[^>\d]*>|\{[^}\d]*\})\s*", answer) and not re.search(r"\W[A-Z]\w*\s[A-Z]", answer)
    return not plain or plain in PLACEHOLDERS or plain.rstrip(":.!") in PLACEHOLDERS or letters in PLACEHOLDERS or not letters or bool(remark)


def clauses(answer: str, question: str | None = None) -> list[str]:
    """Sentences; the question, where the answer repeats it, is a clause of its own."""
    echo = re.escape((question or "").strip().rstrip("?？"))
    parts = re.split(f"((?:{echo})[?？]*)", answer, flags=re.IGNORECASE) if echo else [answer]
    found = [m.group() for p in parts for m in _SENTENCE.finditer(p)]
    out: list[str] = []
    for part in found:
        if not part.strip():
            continue
        if out and not re.search(r"\w", part):
            out[-1] += part
        elif out and re.fullmatch(r"\s*\(?\d{1,3}[.)]\s*", out[-1]):
            out[-1] += part  # the number of a list
        else:
            out.append(part)
    return out or [answer]


def _shape(token: str) -> str:
    if token.isdigit():
        return "0"
    if token[0].isupper():
        return "N"
    return token


def _units(text: str) -> list[str]:
    """Tokens of which contexts are made: words by shape, CJK characters, commas."""
    shapes = [_shape(w) for x in re.findall(r"[^\W_]+|[,，、(]", text) for w in (list(x) if _CJK.search(x) else [x])]
    return [u for i, u in enumerate(shapes) if u != "N" or shapes[i - 1 : i] != ["N"]]  # a name is one N


def end_contexts(answer: str) -> list[str]:
    """The last tokens of the answer's last sentence, the longest context first."""
    last = clauses(answer)[-1]
    units = ["^"] + _units(last)
    return [" ".join(units[-k:]) for k in CONTEXTS]


def _count_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ends: Counter = Counter()
        every: Counter = Counter()
        for answer in batch.answer:
            for sentence in clauses(answer):
                finished = bool(_END.search(sentence))
                units = ["^"] + _units(sentence)
                for i in range(2, len(units) + 1):
                    last = i == len(units)
                    if last and not finished:
                        continue
                    for k in CONTEXTS:
                        context = " ".join(units[max(0, i - k) : i])
                        every[context] += 1
                        ends[context] += last
        yield pd.DataFrame({"context": list(every), "n": list(every.values()), "n_end": [ends[c] for c in every]})


def with_ends(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``ends``: (n, n_end) of the contexts at the end of each answer, longest first."""

    @F.pandas_udf("array<string>")
    def contexts(answers: pd.Series) -> pd.Series:
        return answers.map(end_contexts)

    asked = pairs.select("*", F.posexplode(contexts("answer")).alias("k", "context"))
    # without the texts: only keys and counts are shuffled
    found = asked.select("table_name", "row", "k", "context").join(counts, "context").groupBy("table_name", "row").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", "n_end")))).alias("by_k"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_end"))
    ends = F.array(*(F.coalesce(F.try_element_at("by_k", F.lit(k)), zero) for k in range(len(CONTEXTS))))
    return pairs.join(found, ["table_name", "row"], "left").withColumn("ends", ends).drop("by_k")


def _end_probability(ends: list) -> tuple[float, float]:
    """log odds that a sentence ends after these tokens, backed off; and how common the last token is."""
    p = 0.05
    for e in reversed(list(ends)):
        p = (e["n_end"] + 2.0 * p) / (e["n"] + 2.0)
    return math.log((p + 1e-4) / (1 - p + 1e-4)), math.log1p(ends[-1]["n"])


def features(question: str | None, answer: str, ends: list, known: Profiles, blind: bool = False) -> np.ndarray:
    """A row for each clause of the answer; ``blind`` to function words, so that letter profiles are learned as well."""
    question = question or ""
    q_words = [w.lower() for w in words_of(question)]
    q_set = Counter(q_words)
    q_lang, q_sure = language(question)
    wants = wanted_language(question)
    q_script = script(question)
    parts = clauses(answer, question)
    odds, common = _end_probability(ends)
    finished = bool(_END.search(answer)) and not re.search(r"(\.\.\.|…)[\"'”’)\]]*\s*$", answer)
    ellipsis = bool(re.search(r"(\.\.\.|…)\s*$", answer))
    tail = answer.rstrip()[-1:]
    rows = []
    for i, part in enumerate(parts):
        words = [w.lower() for w in words_of(part)]
        n = max(1, len(words))
        shared = sum((Counter(words) & q_set).values())
        inside, covered = shared / n, shared / max(1, len(q_words)) if q_words else 0.0
        unquoted = _QUOTED.sub(" ", part)
        plain = [w.lower() for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", unquoted)]
        first = sum(w in FIRST_PERSON for w in plain) + (_CJK_FIRST in part)
        denies = sum(w in DENIAL for w in plain) + sum(x in part for x in _CJK_DENIAL)
        polite = sum(w in POLITE for w in plain) + (sum(x in part for x in _CJK_POLITE) if first or len(parts) > 1 else 0)
        lang, sure = ("", 0.0) if blind else language(part)
        far, lead = known.unlike(q_lang, part) if not wants else (0.0, 0.0)
        own_script = script(unquoted)
        strange = bool(q_script and own_script and own_script != q_script and not wants)
        other = bool(lang and q_lang and lang != q_lang and lang != wants and sure >= 1 and q_sure > 0)
        last = i == len(parts) - 1
        open_bracket = part.count("(") > part.count(")")
        stops = last and not finished
        fresh = (Counter(words) - q_set).keys()
        adds = any(w.isdigit() or _CJK.search(w) for w in fresh) or any(w[:1].isupper() and w.lower() in fresh for w in words_of(part)[1:])
        short = n <= (9 if _CJK.search(part) else 4)
        dense = [
            1.0, inside, covered, inside * covered, float(inside > 0.8 and covered > 0.8), float(inside > 0.8), float(part.strip()[-1:] in "?？"),
            float(bool(q_words) and words[:2] == q_words[:2]), min(n - shared, 8) / 8, float(not q_words),
            min(first, 2), min(denies, 3), min(polite, 3), float(first > 0 and denies > 0), float(denies > 0 and polite > 0), float(first > 0 and polite > 0),
            far / 3, float(far > 4), min(lead, 3.0), float(lead > 0.3), float(strange), float(strange) * min(n, 8) / 4,
            float(other), float(other) * min(sure, 6) / 3, float(bool(lang) and lang == q_lang), float(not lang),
            float(stops), float(stops) * odds, float(stops and odds < -2), float(stops and odds < -4), float(stops) * min(common, 4), float(stops and tail in ",，、:："), float(last and ellipsis), float(last and open_bracket),
            float(last), float(i == 0), float(len(parts) == 1), float(short), min(len(q_words), 20) / 20, float(stops and short and len(parts) == 1), float(not fresh), float(not fresh and covered > 0.6), float(adds), float(adds and inside > 0.6),
        ]
        hashed = np.zeros(HASHED)
        for w in set(plain):
            if w.islower():
                hashed[zlib.crc32(w.encode()) % HASHED] = 0.5
        rows.append(np.concatenate([dense, hashed]))
    return np.array(rows)


def defect_of(tags: np.ndarray, parts: list[str]) -> str | None:
    """The pair's defect from its tagged clauses, weighed by their length."""
    size = np.array([len(p.strip()) for p in parts], float)
    share = np.array([size[tags == t].sum() for t in range(len(TAGS))]) / max(1.0, size.sum())
    if share[REFUSAL] and share[ANSWER] + share[FOREIGN] < 0.5:
        return "refusal"
    if share[FOREIGN] >= 0.5:
        return "wrong_language"
    if share[ECHO] and not share[ANSWER] and not share[UNFINISHED]:
        return "copied_question"
    if tags[-1] == UNFINISHED:
        return "truncated"
    if share[ECHO] and not share[ANSWER]:
        return "copied_question"
    return None


def _damaged(rows: list, rng: np.random.Generator) -> list[tuple[str, str, list[int]]]:
    """(question, answer, tags) of the sample as it is and with each kind of damage."""
    good = []
    for r in rows:
        if not r.question or not r.question.strip() or is_empty(r.answer):
            continue
        plain = [w.lower() for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", r.answer)]
        asks = [w.lower() for w in words_of(r.question)]
        own = [w.lower() for w in words_of(r.answer)]
        suspect = sum(w in FIRST_PERSON for w in plain) or any(x in r.answer for x in _CJK_DENIAL)
        copied = 0.6 * len(asks) <= len(own) <= 2.5 * len(asks) and sum((Counter(own) & Counter(asks)).values()) > 0.9 * len(own)
        odd = language(r.answer)[0] not in ("", language(r.question)[0], wanted_language(r.question))
        if not (suspect or copied or odd):
            good.append((r.question, r.answer, language(r.question)[0] or "en"))
    out = []
    finished = [g for g in good if _END.search(g[1])]
    for k, (question, answer, lang) in enumerate(good):
        brief = len(words_of(answer)) <= (9 if _CJK.search(answer) else 4)
        if _END.search(answer) or brief:
            out.append((question, answer, [ANSWER] * len(clauses(answer, question))))
            if k % 4 == 0:  # only the full stop is missing
                bare = re.sub(r"[.。]\s*$", "", answer)
                out.append((question, bare, [ANSWER] * len(clauses(bare, question))))
        kind = k % 5
        if kind == 0 and len(answer) > 30 and _END.search(answer):
            last = clauses(answer)[-1]
            units = list(re.finditer(r"[^\W_]+|[一-鿿]", last))
            keep = int(rng.integers(max(1, len(units) // 4), max(2, len(units) - 1)))
            end = units[min(keep, len(units) - 1)].end() - (0 if rng.random() < 0.5 else int(rng.integers(0, 4)))
            head = last[: max(6, end)].rstrip()
            if rng.random() < 0.08:
                head = re.sub(r"(\w+)$", r"(\1", head)
            cut_text = answer[: len(answer) - len(last)] + head + ("" if rng.random() < 0.85 else ["…", ",", "..."][int(rng.integers(3))])
            out.append((question, cut_text, [ANSWER] * (len(clauses(cut_text, question)) - 1) + [UNFINISHED]))
        elif kind == 1:
            forms = [question, question.lower(), question.rstrip("?？"), f"{question} {question}", f'"{question}"', f"Answer: {question}", question.upper()]
            text = forms[int(rng.integers(len(forms)))]
            out.append((question, text, [ECHO] * len(clauses(text, question))))
            both = f"{question} {answer}"
            if _END.search(answer):
                n_echo = len(clauses(question, question))
                out.append((question, both, [ECHO] * n_echo + [ANSWER] * (len(clauses(both, question)) - n_echo)))
        elif kind == 2 and finished:
            other = finished[int(rng.integers(len(finished)))]
            if other[2] != lang and language(other[1])[0] == other[2] and wanted_language(question) == "":
                out.append((question, other[1], [FOREIGN] * len(clauses(other[1], question))))
        elif kind == 3:
            names = re.findall(r"[A-Z]\w+(?: [A-Z]\w+)*", question[1:]) or [question[:6]]
            pick = lambda xs: xs[int(rng.integers(len(xs)))].format(names[-1])
            text = pick(REFUSALS.get(lang, REFUSALS["en"]))
            if rng.random() < 0.5:
                text += " " + pick(COURTESIES.get(lang, COURTESIES["en"]))
            if rng.random() < 0.3:
                text = text.rstrip(".。")
            tags = [REFUSAL] * len(clauses(text, question))
            if rng.random() < 0.25:
                text += " " + ASKED.get(lang, ASKED["en"]) + question
                n_echo = len(clauses(question, question))
                tags = [REFUSAL] * (len(clauses(text, question)) - n_echo) + [ECHO] * n_echo
            out.append((question, text, tags))
        elif kind == 4:  # a bare name or number is an answer
            bare = re.findall(r"[A-Z]\w+(?: [A-Z]\w+)*|\d+|[一-鿿]{2,6}", answer)
            if bare:
                out.append((question, bare[int(rng.integers(len(bare)))], [ANSWER]))
    return [(q, a, t) for q, a, t in out if len(t) == len(clauses(a, q)) <= TRAINING_CLAUSES]


def _gathered(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.select(F.lit(name).alias("table_name"), F.col("id").cast("bigint").alias("sample_id"), "question", "answer") for name, t in tables.items()]
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    return pairs.where("sample_id is not null").distinct().withColumn("row", F.xxhash64("sample_id", "question", "answer"))


def train(pairs: DataFrame, counts: DataFrame, known_profiles: Profiles, seed: int = 3) -> CRF | None:
    """The field, from at most ``TRAINING_PAIRS`` pairs in hash order; None if none is usable."""
    sample = pairs.where("answer is not null").orderBy("row", "table_name").limit(TRAINING_PAIRS).select("question", "answer").collect()
    made = _damaged(sample, np.random.default_rng(seed))
    if len({t for _, _, tags in made for t in tags}) < 2:
        return None
    rows = [("t", i, q, a) for i, (q, a, _) in enumerate(made)]
    known = with_ends(pairs.sparkSession.createDataFrame(rows, "table_name string, row bigint, question string, answer string"), counts)
    ends = {r.row: r.ends for r in known.select("row", "ends").collect()}
    # a third of the rows is learned without function words: languages that have no list are told by letters alone
    rows = [(features(q, a, ends[i], known_profiles), np.array(t)) for i, (q, a, t) in enumerate(made)]
    rows += [(features(q, a, ends[i], known_profiles, blind=True), np.array(t)) for i, (q, a, t) in enumerate(made) if FOREIGN in t or i % 3 == 0]
    return CRF.fit([x for x, _ in rows], [t for _, t in rows], len(TAGS))


def tagged_defects(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, sample_id, defect, tags) of every pair of the tables; defect is null for sound pairs.

    ``tables`` have id, question, answer; other columns are ignored. Null, blank and
    placeholder answers are empty and have no tags; a null or blank question echoes nothing
    and has no language. Rows with a null id are left out, repeated rows count once. Where
    a table is too small to train on, only empty answers are flagged.
    """
    pairs = cut(_gathered(tables))
    spark = pairs.sparkSession

    @F.pandas_udf("boolean")
    def empty(answers: pd.Series) -> pd.Series:
        return answers.map(is_empty).astype(bool)

    marked = cut(pairs.withColumn("is_empty", empty.asNondeterministic()("answer")))
    filled = marked.where("not is_empty").drop("is_empty")
    counted = filled.select("answer").mapInPandas(_count_contexts, "context string, n bigint, n_end bigint")
    counts = cut(counted.groupBy("context").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")))
    letters = profiles(filled)
    model = train(filled, counts, letters)
    none = marked.where("is_empty").select("table_name", "sample_id", F.lit("empty").alias("defect"), F.lit(None).cast("array<string>").alias("tags"))
    if model is None:
        rest = filled.select("table_name", "sample_id", F.lit(None).cast("string").alias("defect"), F.lit(None).cast("array<string>").alias("tags"))
        return none.unionByName(rest)
    shared = spark.sparkContext.broadcast((model, letters))  # a few thousand weights, and profiles of fixed size

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            defects, tags = [], []
            for question, answer, ends in zip(batch.question, batch.answer, batch.ends):
                best = shared.value[0].best(features(question, answer, list(ends), shared.value[1]))
                defects.append(defect_of(best, clauses(answer, question)))
                tags.append([TAGS[t] for t in best])
            yield pd.DataFrame({"table_name": batch.table_name, "sample_id": batch.sample_id, "defect": defects, "tags": tags})

    scored = with_ends(filled, counts).select("table_name", "sample_id", "question", "answer", "ends")
    return none.unionByName(scored.mapInPandas(tag, "table_name string, sample_id bigint, defect string, tags array<string>"))


def defective_pairs(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, sample_id, defect): the pairs of ``tagged_defects`` that have one."""
    return tagged_defects(tables).where("defect is not null").select("table_name", "sample_id", "defect").distinct()
