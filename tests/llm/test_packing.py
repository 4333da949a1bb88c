import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import packing, tokens


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 60), max_size=25))
def test_plan_uses_up_the_histogram(histogram):
    plan = packing.plan(histogram, 50)
    used = Counter()
    for made, times in plan:
        assert sum(made) <= 50 and times > 0
        for s in made:
            used[s] += times
    assert used == Counter(histogram)


def test_plan_is_near_the_fewest():
    rng = random.Random(1)
    h = Counter(min(200, int(rng.lognormvariate(3.5, 0.8)) + 1) for _ in range(20_000))
    n = sum(t for _, t in packing.plan(h, 200))
    assert n <= 1.02 * sum(s * k for s, k in h.items()) / 200


def test_operator(spark):
    rng = random.Random(2)
    texts = [(k, " ".join("ab" for _ in range(rng.choice([5, 5, 5, 9, 30])))) for k in range(300)]
    texts += [(300, None), (301, ""), (302, "word and " * 100), (303, "ab"), (303, "ab"), (None, "ab")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "'x' AS container", "'y' AS tokens")
    rows = packing.pack(docs, 40).collect()
    count = tokens.counter().count
    text = dict(t for t in texts if t[0] is not None)
    assert {r.doc_id for r in rows} == set(text) - {300}
    room = Counter()
    for r in rows:
        assert r.tokens == count(text[r.doc_id][r.start_char : r.end_char])
        assert (r.pieces > 1) == (r.doc_id == 302)
        room[r.container] += r.tokens
    assert max(room.values()) <= 40 and len(rows) == len({(r.doc_id, r.piece) for r in rows})
    assert "".join(text[302][r.start_char : r.end_char] for r in sorted((r for r in rows if r.doc_id == 302), key=lambda r: r.piece)) == text[302]
    f = packing.filling(packing.pack(docs, 40), 40).first()
    assert f.items == len(rows) and f.divided == 1 and f.containers <= f.fewest + 2
    assert packing.pack(docs.limit(0), 40).count() == 0


def test_large_capacities_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SIZES", 16)
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    docs = spark.createDataFrame([(k, "ab " * (k % 90)) for k in range(400)] + [(400, "ab " * 500)], "doc_id bigint, text string")
    rows = packing.pack(docs, 99).collect()
    room = Counter()
    for r in rows:
        room[r.container] += r.tokens
    assert max(room.values()) <= 99 and {r.doc_id for r in rows} == set(range(401)) and len(rows) == len({(r.doc_id, r.piece) for r in rows})
    assert [r.doc_id for r in rows if r.pieces > 1 and r.piece == 0] == [400]
    assert len(room) <= 1.35 * sum(room.values()) / 99


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "ab " * 100), (1, "cd " * 250), (2, "x")], "doc_id bigint, text string")
    rows = [r for r in packing.pack(docs, 40).collect() if r.doc_id == 1]
    assert len({r.pieces for r in rows}) == 1 and sorted(r.piece for r in rows) == list(range(rows[0].pieces))
    assert sum(r.end_char - r.start_char for r in rows) in (300, 750)
