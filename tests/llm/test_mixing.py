import pytest
from hypothesis import given
from hypothesis import strategies as st

from codeloom.llm import mixing, tokens


@given(st.lists(st.tuples(st.floats(0, 10, allow_subnormal=False), st.floats(0, 10)), max_size=8))
def test_water_fill(rows):
    want, cap = [w for w, _ in rows], [c for _, c in rows]
    got = mixing.water_fill(want, cap)
    assert all(g <= c + 1e-9 for g, c in zip(got, cap))
    assert sum(got) == pytest.approx(min(sum(want), sum(c for w, c in rows if w > 0)), abs=1e-6)
    free = [g / w for g, w, c in zip(got, want, cap) if w > 1e-9 and g < c * (1 - 1e-9)]
    assert not free or max(free) == pytest.approx(min(free), rel=1e-6)


def test_operator(spark):
    docs = [(k, f"text number {k} of the source", "a") for k in range(200)] + [(500 + k, f"other {k}", " A " if k % 2 else "B") for k in range(40)]
    docs += [(900, "same", "c"), (901, "same", "c"), (902, None, "c"), (903, "x", None), (904, "y", " "), (None, "z", "a")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "0 AS tokens", "'k' AS key")
    targets = spark.createDataFrame(
        [("m", "a", 0.5, 1, 0.5), ("m", "b", 0.3, 2, 0.5), ("m", "c", 0.2, 3, 0.5), ("n", "a", 1.0, 2, 1.5), ("n", "none", 0.0, None, 1.5), ("o", "gone", 1.0, 2, 0.1)],
        "mix_name string, source string, target_share double, max_repeats int, budget_ratio double",
    )
    count = tokens.counter().count
    total = sum(count(t) for i, t, _ in docs if t is not None and i is not None)
    plan = {(r.mix_name, r.source): r for r in mixing.plan_table(d, targets).collect()}
    assert {k for k, r in plan.items() if r.short} == {("m", "b"), ("m", "c"), ("o", "gone")}
    assert plan["m", "c"].cap == 3 * 2 * count("same") and plan["m", "c"].tokens == 3 * count("same")
    drawn = mixing.draw(d, targets).collect()
    by = {}
    for r in drawn:
        most = {"a": 1, "b": 2, "c": 3}[r.source] if r.mix_name == "m" else 2
        assert 1 <= r.repeats <= most
        by[r.mix_name, r.source] = by.get((r.mix_name, r.source), 0) + r.repeats * r.tokens
    for k, t in by.items():
        assert t <= plan[k].tokens + 1e-6 and t >= plan[k].tokens - 12, k
    assert len(drawn) == len({(r.mix_name, r.source, r.doc_id) for r in drawn})
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mixing.draw(d, targets).collect()))
    assert sorted(map(tuple, drawn)) != sorted(map(tuple, mixing.draw(d, targets, seed=5).collect()))
    s = {(r.mix_name, r.source): r for r in mixing.shares(d, targets).collect()}
    assert len(s) == 6 and s["o", "gone"].tokens == 0 and s["n", "a"].share == 1.0
    assert total > 0 and mixing.draw(d.limit(0), targets).count() == 0 and mixing.draw(d, targets.limit(0)).count() == 0
