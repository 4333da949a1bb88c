"""Broken prompt and response pairs.

Copies are found by aligning tokens: nearly all of a response's shingles lie in the prompt, and the longest common
subsequence of the prompt and some stretch of the response covers nearly all of the prompt; what frames a quotation does
not count. Refusals are found by aligning every sentence with templates, whose words must come in order and close
together; a response that declines somewhere is a refusal unless more of its words say something else. Truncation is seen in what is still open at the end, and in an end that no sentence, list, code block or
JSON value has; the language in the function words of the prose, code and names left out.

Each row has one defect at most, the first of: empty, copied, refusal, truncated, language. A null response is empty; a
null prompt can't be copied and asks for no language; short or wordless responses have none. Repeated rows of one id
count once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import rows_out

SHINGLE = 3
CONTAINED, COVERED = 0.8, 0.8
_TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*|\d+")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
# Responses that say nothing.
NOTHING = {"", "none", "null", "nil", "nan", "n/a", "na", "undefined", "no answer", "no response", "empty", "no output", "not available", "blank", "tbd", "todo"}
_FRAME = re.compile(r"^(?:you (?:asked|said|wrote)|(?:the |your )?(?:question|prompt|query|request|input)(?: (?:was|is))?|q|user|sie fragten|frage|ihre frage|vous avez demandé|votre question|usted preguntó|pregunta|su pregunta)\s*[:\-]\s*", re.I)

# Openings by which an answer is declined; words in order, with a few others between them.
REFUSALS = [
    t.split()
    for t in """i can not help|i can not assist|i can not answer|i can not provide|i can not comply|i can not discuss|i can not share|i can not do that|i can not tell|i am unable to|i am not able to|i am not allowed|i am not permitted|i am forbidden|i am not comfortable|i am not in a position
i will not be doing|i will not answer|i will not help|i will not provide|i will not do|i will not discuss|i must decline|i have to decline|i need to decline|i decline to|i must refuse|i refuse to|i would rather not|i prefer not to|i do not have access|i have no access|nothing i can tell|guidelines do not permit
guidelines do not allow|not permit me to|not allow me to|policy does not allow|not something i can|not something i am|outside what i may|outside what i can|beyond what i am|beyond what i may|as a language model|as an ai|against my guidelines|against my policy|unable to assist|unable to help|can not fulfill
darf ich keine auskunft|darf ich nicht|ich darf nicht|ich darf keine|mir nicht erlaubt|mir nicht gestattet|kann ich nicht helfen|kann ich dabei nicht|kann ich ihnen nicht|ich kann nicht helfen|ich kann dabei nicht|ich kann ihnen nicht|möchte ich nicht beantworten|möchte ich frage nicht|ich möchte nicht|ich muss ablehnen|muss ich ablehnen|ich muss das ablehnen|ich lehne ab|bin nicht befugt|bin ich nicht befugt|nicht in der lage|als sprachmodell|als ki
je ne peux pas|je ne puis|je ne suis pas en mesure|je dois refuser|je dois décliner|je refuse de|je ne suis pas autorisé|je préfère ne pas|je préférerais ne pas|en tant que modèle|ne m est pas permis|m est pas possible|m est interdit|je ne saurais|je n ai pas accès|ne me permettent pas
no puedo ayudar|no puedo responder|no puedo hacer|no puedo compartir|no me es posible|no se me permite|debo rechazar|debo negarme|tengo que rechazar|no estoy autorizado|no estoy en condiciones|prefiero no|preferiría no|como modelo de lenguaje|me niego a|no tengo acceso|no me permiten""".replace("\n", "|").split("|")
]
_BY_FIRST: dict[str, list[list[str]]] = {}
for _t in REFUSALS:
    _BY_FIRST.setdefault(_t[0], []).append(_t)
REFUSAL_GAP = 3
# Words of sentences around a refusal: courtesy, its reasons, the speaker and the person asking.
_AROUND = set(
    """i me my we our you your sorry apologies afraid thanks thank please understand unfortunately request requests question policy policies guidelines rules permission permitted allowed safety security private privacy confidential sensitive legal such instead
ich mich mir mein meine wir sie ihnen ihre ihr leid danke bitte leider anfrage frage richtlinien regeln erlaubnis vertraulich solche
je me mon ma mes nous vous votre vos désolé désolée merci hélas demande question règles consignes politique confidentiel confidentielles telle telles
yo mi mis nosotros usted le su lamento siento gracias favor solicitud pregunta normas política reglas confidencial tal tales desgracia""".split()
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*(?:[-*+•>]|\d+[.)])\s)")

# Frequent function words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the and is are were of to no that it for with as on this be by from or which when what how does do where why not has have its if at an then there these can will would should after before because while your our each every show list write generate compare explain",
    "de": "der die das und in ist sind war nicht ein eine einen einem einer den dem des mit von zu auf für im wird werden wurde wenn weil sich es als auch nach bei oder wie was wo wer zum zur dass bis aus sobald damit kurz man kann durch obwohl zeige fasse macht erkläre",
    "fr": "le la les et est sont une un des du de que qui dans pour pas avec sur ce cette il elle en au aux par plus se ne où quand parce dont lorsque bien avant après dès fait montre résume explique ont sa son ses leur",
    "es": "el la los las y es son una un de del que en para no con por se su al lo como más pero cuando donde dónde aunque antes después está hace qué cómo muestra resume explica desde sus porque muy ya esta este",
}
_WORD_OF: dict[str, list[str]] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in _ws.split():
        _WORD_OF.setdefault(_w, []).append(_l)
# Names of these languages in each of them.
_NAMES = {"en": "english|englisch|anglais|inglés|ingles", "de": "german|deutsch|allemand|alemán|aleman", "fr": "french|französisch|franzoesisch|français|francais|francés|frances", "es": "spanish|spanisch|espagnol|español|espanol|castellano"}
_ASKED = re.compile(r"\b(?:in|into|auf|ins|en|al|to)\s+(?:(?P<en>%(en)s)|(?P<de>%(de)s)|(?P<fr>%(fr)s)|(?P<es>%(es)s))\b" % _NAMES, re.I)
_CONTRACTED = [(re.compile(p), r) for p, r in ((r"\bcan'?t\b|\bcannot\b", "can not"), (r"\bwon'?t\b", "will not"), (r"n't\b", " not"), (r"\bi'm\b", "i am"), (r"\bi'd\b", "i would"), (r"\bi'll\b", "i will"), (r"\bi've\b", "i have"))]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if same := row & at.get(x, 0):
            row = ((row + same) | (row - same)) & full
    return len(b) - row.bit_count()


def bare(response: str | None) -> str:
    """The response without invisible characters, outer blanks and wrappers."""
    t = _INVISIBLE.sub("", response or "").strip()
    return re.sub(r"^<(\w+)>\s*(.*?)\s*</\1>$", r"\2", t, flags=re.S)


def empty(text: str) -> bool:
    core = re.sub(r"^[\s`*_\"'()\[\]{}<>.\-–—?!:;,…#|/\\=~]+|[\s`*_\"'()\[\]{}<>.\-–—?!:;,…#|/\\=~]+$", "", text)
    return core.lower() in NOTHING


def copied(prompt: str | None, text: str) -> bool:
    """Whether the response only gives the prompt back."""
    p = tokens(prompt or "")
    text = _FRAME.sub("", re.sub(r"^[\s>*_\"'`#]+", "", text))
    r = tokens(text)
    if len(p) < 2 or len(r) < 2:
        return False
    n = min(SHINGLE, len(p), len(r))
    have = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
    have |= {tuple((p + p)[i : i + n]) for i in range(len(p) - n + 1, len(p))}
    mine = [tuple(r[i : i + n]) for i in range(len(r) - n + 1)]
    if sum(s in have for s in mine) < CONTAINED * len(mine):
        return False
    wide, step = len(p) + (len(p) + 1) // 2, max(1, len(p) // 2)  # each stretch as long as the prompt lies in one of these
    return any(lcs(r[i : i + wide], p) >= COVERED * len(p) for i in range(0, max(1, len(r) - wide + step), step))


def _declines(ws: list[str]) -> bool:
    have = set(ws)
    for first in have & _BY_FIRST.keys():
        for template in _BY_FIRST[first]:
            if have.issuperset(template) and any(w == first and lcs(template, ws[i : i + len(template) + REFUSAL_GAP]) == len(template) for i, w in enumerate(ws)):
                return True
    return False


def refusal(text: str, prompt: str | None = None) -> bool:
    """Whether the response declines in some sentence, and no more of its words say something else.

    Code that the prompt holds, that a declining sentence leads to, or that one follows is quoted; other code is content.
    """
    t = text.lower().replace("’", "'")
    for p, r in _CONTRACTED:
        t = p.sub(r, t)
    declined, content, said = 0, 0, 0
    pending = 0  # words of code that a declining sentence may follow
    asked = set(tokens(prompt or ""))
    last = False
    for k, part in enumerate(re.split(r"```(.*?)(?:```|\Z)", t, flags=re.S)):
        if k % 2:
            ws = tokens(part)
            if not last and sum(w in asked for w in ws) < CONTAINED * len(ws):
                pending += len(ws)
            continue
        for sentence in _SENTENCE.split(part):
            ws = [w for x in tokens(re.sub(r"`[^`]*`|\S*/\S+", " ", sentence)) for w in x.split("_")]
            if not ws:
                continue
            if last := _declines(ws):
                declined += len(ws)
                pending = 0
            elif "`" not in sentence and not _AROUND.isdisjoint(ws):
                said += len(ws)
            else:
                content += len(ws)
    return declined > 0 and content + pending <= declined + said


def prose(text: str) -> str:
    """Text without code, paths, names and links."""
    t = re.sub(r"```.*?(?:```|\Z)|`[^`\n]*`|\]\([^)]*\)|\S*[/_]\S*|\b[A-Za-z]*[a-z][A-Z]\w*|\w+\.\w+", " ", text, flags=re.S)
    return t


def language(text: str, least: int = 2) -> str | None:
    """The language of a prose by its function words; None where they are few or undecided."""
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in re.findall(r"[^\W\d_]+", prose(text).lower()):
        for l in (of := _WORD_OF.get(w, ())):
            score[l] += 1 / len(of)
    first, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    return first[0] if first[1] >= least and first[1] > 1.3 * second[1] else None


def asked_language(system_prompt: str | None, prompt: str | None) -> str | None:
    for t in (prompt, system_prompt):
        if t and (m := _ASKED.search(t)):
            return m.lastgroup
    return language(prompt, 1) if prompt else None


def truncated(text: str) -> bool:
    """Whether the response ends before it is complete."""
    if text.count("```") % 2:
        return True
    if text[:1] in "{[" and re.match(r"[\[{]\s*(?:[\"{\[]|\d|$)", text):
        try:
            json.loads(text)
            return False
        except ValueError:
            return True
    if text.endswith("```"):
        return False
    body = re.sub(r"```.*?```", " ", text, flags=re.S)
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return False
    last = lines[-1].strip()
    if re.fullmatch(r"\d+[.)]|[-*+•>]|#+.*", last):
        return True
    if body.count("`") % 2 or last.count("(") > last.count(")") or last.count("[") > last.count("]"):
        return True
    end = re.sub(r"[\"'»”’)\]*_`]+$", "", last)
    if not end or end[-1] in ".!?…。|" or re.search(r"[)\]`|\"»”]$|\*\*$", last):
        return False
    if end[-1] in ",:;-–(":
        return True
    if re.match(r"(?:\d+[.)]|[-*+•])\s", last) and sum(bool(re.match(r"(?:\d+[.)]|[-*+•])\s", x.strip())) for x in lines) > 1:
        return False
    words = tokens(body)
    return len(words) > 8 or len(words) > 4 and bool(re.search(r"[.!?]\s", body))


def defect(prompt: str | None, response: str | None, system_prompt: str | None = None) -> str | None:
    """The kind of defect of a response, or None."""
    text = bare(response)
    if empty(text):
        return "empty"
    if copied(prompt, text):
        return "copied"
    if refusal(text, prompt):
        return "refusal"
    if truncated(text):
        return "truncated"
    if text[:1] not in "{[":
        want = asked_language(system_prompt, prompt)
        is_ = language(text)
        if want and is_ and want != is_:
            return "language"
    return None


def _rows(batch: dict[str, list]) -> Iterable[tuple]:
    for i, p, r, s in zip(*(batch[c] for c in ("id", "prompt", "response", "system_prompt"))):
        if d := defect(p, r, s):
            yield i, d


def defects(pairs: DataFrame) -> DataFrame:
    """(id, defect) of each defective pair, once."""
    return rows_out(pairs.where(F.col("id").isNotNull()).select("id", "prompt", "response", "system_prompt"), _rows, "id string, defect string", scan=True).dropDuplicates(["id"])
