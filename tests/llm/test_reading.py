import random

import numpy as np
import pytest

from codeloom.llm import reading

EASY = "the cat sat on a mat and the dog ran to it we can see the red box now go and look".split()
HARD = "notwithstanding asymptotic canonicalization presupposes referential transparency irrespective heterogeneous reconciliation combinatorial serialization semantics".split()


def text(rng: random.Random, share: float) -> str:
    return " ".join(" ".join(rng.sample(HARD if rng.random() < share else EASY, 6)).capitalize() + "." for _ in range(40))


def test_prose_only():
    t = "# Title words\n\nOne two `three_four` five. Six seven!\n\n```py\ncode here\n```\n\n| a | table |\n- list item\n1. another item\n[link](files/a.md)\nLast line"
    assert reading.sentences(t) == [["one", "two", "five"], ["six", "seven"], ["last", "line"]]
    assert reading.edges(None) == ([], []) and reading.edges(" ") == ([], [])


def test_cuts():
    x = np.array([1.0, 2, 3, 4])
    assert reading.cut(x, np.array([2, 1, 0, 0]), np.array([0, 0, 1, 1])) == 2.5
    assert reading.cut(x, np.array([2, 0, 1, 0]), np.array([0, 3, 0, 1])) == 1.5
    assert reading.cut(x, np.zeros(4), np.ones(4)) == -np.inf and reading.cut(x, np.ones(4), np.zeros(4)) == np.inf
    xs, ys = reading.scale(x, np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]))
    assert list(np.floor(np.interp(x, xs, ys) + 0.5)) == [1, 2, 3, 4]
    xs, ys = reading.scale(np.array([2.0]), np.array([[0, 0, 5, 0]]))
    assert list(np.interp([0.0, 2.0, 9.0], xs, ys)) == [3, 3, 3]


def test_operator(spark):
    rng = random.Random(3)
    share = {k: [0.0, 0.2, 0.6, 1.0][k % 4] for k in range(240)}
    docs = [(k, text(rng, s)) for k, s in share.items()] + [(0, text(rng, 0.0)), (900, None), (901, ""), (902, "```\ncode\n```"), (903, " ".join(HARD) + ". " + "x" * 50_000), (None, text(rng, 1.0))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS level", "2 AS grade", "'a' AS words")
    labels = [(k, "r1", k % 4 + 1) for k in range(120)] + [(1, "r2", 2), (2, "r2", None), (3, "r2", 9), (None, "r1", 4), (5000, "r1", 1)]
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    got = {r.doc_id: r for r in reading.levels(d, lab).collect()}
    assert set(got) == set(share) | {900, 901, 902, 903}
    assert all(got[k].level is None for k in (900, 901, 902)) and got[903].level == 4
    held = [k for k in range(120, 240)]
    assert sum(got[k].level == k % 4 + 1 for k in held) >= 0.8 * len(held)
    assert sum((got[k].level == 4) != (k % 4 == 3) for k in held) <= 2
    none = reading.levels(d, lab.limit(0)).collect()
    assert len(none) == len(got) and all(r.level is None for r in none)
    assert reading.levels(d.limit(0), lab).count() == 0
    assert reading.profile(reading.levels(d, lab), d.selectExpr("doc_id", "'S ' AS source")).count() == 5


def test_iterated_to_the_end(spark):
    """Grades at the ends of a chain of documents reach all of it, and the values agree with a long plain iteration."""
    name = lambda k: "w" + "".join(chr(97 + int(c)) for c in str(k))
    n = 30
    texts = [f"{name(k)} {name(k + 1)}." for k in range(n)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lab = spark.createDataFrame([(0, "r", 1), (n - 1, "r", 4)], "doc_id bigint, rater string, level int")
    got = {r.doc_id: r for r in reading.levels(d, lab).collect()}
    assert all(got[k].level is not None for k in range(n))
    words = [[k, k + 1] for k in range(n)]
    frequency = np.bincount(np.concatenate(words))
    rarity = np.log(n / np.maximum(1.0, frequency)) + 0.1
    grade = np.array([1.0] + [np.nan] * (n - 2) + [4.0])
    w = np.array([[0.5 * rarity[x] for x in ws] for ws in words])
    value, trust = np.full(n + 1, 2.5), np.zeros(n + 1)
    for _ in range(2000):
        t = (w * trust[words]).sum(1)
        f = np.where(np.isnan(grade), (w * trust[words] * value[words]).sum(1) / np.maximum(t, 1e-300), grade)
        c = np.where(np.isnan(grade), reading.TRUST * t / w.sum(1), 1.0)
        num, den = np.zeros(n + 1), np.zeros(n + 1)
        np.add.at(num, np.array(words), w * (c * f)[:, None])
        np.add.at(den, np.array(words), w * c[:, None])
        value, trust = (num + 1e-3 * 2.5) / (den + 1e-3), den / (den + 0.5)
    own = np.where(np.isnan(grade), 0.0, 1.0)[:, None] * w  # graded documents are estimated without their grade
    left = np.maximum(0.0, den[words] - own)
    left[left < 1e-9] = 0
    value = (np.where(left > 0, num[words] - own * np.nan_to_num(grade)[:, None], 0.0) + 1e-3 * 2.5) / (left + 1e-3)
    trust = left / (left + 0.5)
    free = (w * trust * value).sum(1) / (w * trust).sum(1)
    want = np.interp(free, *reading.scale(free[[0, -1]], np.array([[1, 0, 0, 0], [0, 0, 0, 1]])))
    want = np.where(np.isnan(grade), want, 0.6 * want + 0.4 * np.nan_to_num(grade))
    assert np.abs(np.array([got[k].difficulty for k in range(n)]) - want).max() < 2e-3


@pytest.mark.parametrize("hot", (5, 1_000_000))
def test_large_vocabularies_stay_distributed(spark, monkeypatch, hot):
    rng = random.Random(4)
    docs = [(k, text(rng, [0.0, 0.3, 0.6, 1.0][k % 4])) for k in range(60)] + [(90, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(k, "r", k % 4 + 1) for k in range(30)], "doc_id bigint, rater string, level int")
    want = {r.doc_id: r for r in reading.levels(d, lab).collect()}
    monkeypatch.setattr(reading, "WORDS_SENT", 3)
    monkeypatch.setattr(reading, "HOT", hot)
    got = {r.doc_id: r for r in reading.levels(d, lab).collect()}
    assert set(got) == set(want) and got[90].level is None
    assert all(got[k].difficulty == pytest.approx(want[k].difficulty, abs=2e-3) for k in range(60))


def test_guard_raises(spark):
    d = spark.createDataFrame([(k, f"{a} {b}.") for k, (a, b) in enumerate([("aa", "bb"), ("bb", "cc"), ("cc", "dd")])], "doc_id bigint, text string")
    lab = spark.createDataFrame([(0, "r", 1), (2, "r", 4)], "doc_id bigint, rater string, level int")
    with pytest.raises(RuntimeError):
        reading.levels(d, lab, rounds=2)
