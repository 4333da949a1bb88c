import pytest

from codeloom.llm import answers

ASK = "Where is load_ticket called from?"
EN = "The main entry is load_ticket, which is called by the scheduler when a file has changed."
DE = "Der Einstieg ist load_ticket, und die Datei wird gelesen, wenn sich etwas geändert hat."
CASES = [
    ("empty", ASK, None, None), ("empty", ASK, " \n", None), ("empty", ASK, "...", None), ("empty", ASK, "​", None), ("empty", ASK, "```\n```", None), ("empty", ASK, "(no answer)", None), ("empty", ASK, "<answer></answer>", None), ("empty", None, "N/A", None),
    ("copied", ASK, ASK.upper(), None), ("copied", ASK, "> " + ASK, None), ("copied", ASK, "You asked: " + ASK, None), ("copied", ASK, f"{ASK}\n{ASK}", None), ("copied", "  " + ASK, '"Where is load_ticket called from"\n', "Always answer in German."),
    ("refusal", ASK, "I'm sorry, but I can't help with that. Is there anything else you need?", None), ("refusal", ASK, "Hmm, my guidelines do not permit me to discuss A.", None), ("refusal", ASK, "Tut mir leid, aber darf ich zu src/a.py keine Auskunft geben.", None), ("refusal", ASK, "Désolé, je ne suis pas en mesure de répondre.", None), ("refusal", ASK, "Por desgracia, no se me permite describir A.", None),
    ("truncated", ASK, EN[:-12], None), ("truncated", ASK, EN + "\n\n```python\ndef f():\n", None), ("truncated", ASK, EN + "\n\n1. `a`\n2. `b`\n3.", None), ("truncated", ASK, '{"a": [1, ', None), ("truncated", ASK, EN + " It also (see", None), ("truncated", ASK, EN + " Then it,", None),
    ("language", ASK, DE, None), ("language", ASK, EN, "Antworte immer auf Deutsch."), ("language", "Was macht load_ticket?", EN, "Answer in the language of the question."), ("language", "Translate this note into French: the build is done.", DE, None),
    (None, ASK, EN, None), (None, ASK, DE, "Always answer in German."), (None, ASK, "`f`", None), (None, "Give a number.", "35", None), (None, "Is it async?", "No", None), (None, ASK, "src/a.py", None), (None, ASK, '{"a": [1]}', "Return JSON only."), (None, ASK, "```go\nfunc f() {}\n```", None),
    (None, ASK, f"**{ASK}**\n\n{EN}", None), (None, ASK, "Sorry for the earlier mix-up: the right file is src/a.py. " + EN, None), (None, ASK, "You cannot call load_ticket twice on the same slot, since it is closed.", None), (None, ASK, "`load_ticket` refuses requests that carry no lease. " + EN, None), (None, ASK, EN[:-1] + " (`src/a.py`)", None), (None, ASK, EN + "\n\n- `a`\n- `b`", None), (None, None, EN, None),
]


@pytest.mark.parametrize("want,prompt,response,system", CASES)
def test_defect(want, prompt, response, system):
    assert answers.defect(prompt, response, system) == want


def test_lcs():
    assert answers.lcs(list("abcbdab"), list("bdcaba")) == 4 and answers.lcs([], ["a"]) == 0


def test_operator(spark):
    rows = [(str(k), p, r, s) for k, (_, p, r, s) in enumerate(CASES)] + [("0", ASK, None, None), (None, ASK, None, None), ("long", ASK, EN * 2000, None)]
    got = dict(map(tuple, answers.defects(spark.createDataFrame(rows, "id string, prompt string, response string, system_prompt string").selectExpr("*", "1 AS defect")).collect()))
    assert got == {str(k): c[0] for k, c in enumerate(CASES) if c[0]}
    assert answers.defects(spark.createDataFrame([], "id string, prompt string, response string, system_prompt string")).count() == 0


CODE = "```python\ndef load_ticket(path, lease):\n    return open(path).read() if lease else None\n```"
WHOLE = [
    ("refusal", ASK, "Thanks for the question. I have read it twice. I am afraid I can't help with that.", None),
    ("refusal", ASK, "I'm sorry, but I can't help with that. " + "Your request touches private data, and our rules do not let me describe such files to anyone. " * 12, None),
    ("refusal", ASK, f"You sent this code:\n\n{CODE}\n\nI am not able to change it.", None),
    ("refusal", f"Change this: {CODE}", f"I can't help with that.\n\nThe code is:\n\n{CODE}", None),
    ("copied", ASK, "\n".join([ASK] * 4), None), ("copied", ASK, " ".join([ASK] * 40), None),
    (None, ASK, "I do not have access to the logs. " + EN + " " + EN, None),
    (None, ASK, f"I can't help with the logs. This does it:\n\n{CODE}", None),
    (None, ASK, f"{EN} {ASK} " + EN * 3, None),
]


@pytest.mark.parametrize("want,prompt,response,system", WHOLE)
def test_whole_response(want, prompt, response, system):
    assert answers.defect(prompt, response, system) == want
