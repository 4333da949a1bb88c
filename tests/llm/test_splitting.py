import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import splitting

TEXT = st.text(alphabet="ab \n\t.é漢😀", max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(["chars", "bytes", "lines"]), st.integers(4, 40), st.integers(0, 3))
def test_pieces_fit_and_give_the_text_back(text, unit, limit, overlap):
    spans = splitting.split(text, unit, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    back = text[: spans[0][1]]
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d
        if unit == "chars" and b - a > overlap:
            assert b - c == overlap
        assert splitting.size(text[c:b], unit) <= overlap + (3 if unit == "bytes" else 1)
        back += text[b:d]
    assert back == text
    assert all(splitting.size(text[a:b], unit) <= limit for a, b in spans)
    if splitting.size(text, unit) <= limit:
        assert len(spans) == 1


@settings(max_examples=30, deadline=None)
@given(TEXT)
def test_tokens(text):
    spans = splitting.split(text, "tokens", 7, 2)
    assert all(splitting.size(text[a:b], "tokens") <= 7 for a, b in spans)
    assert text == text[: spans[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(spans, spans[1:]))


def test_natural_boundaries_and_exact_overlap():
    text = "one two\nthree four\n\nfive six seven\n"
    assert [text[a:b] for a, b in splitting.split(text, "chars", 22)] == ["one two\nthree four\n\n", "five six seven\n"]
    assert [text[a:b] for a, b in splitting.split(text, "chars", 18)] == ["one two\n", "three four\n\n", "five six seven\n"]
    assert splitting.split("x" * 10, "chars", 4, 1) == [(0, 4), (3, 7), (6, 10)]
    lines = "".join(f"l{k}\n" for k in range(10))
    got = splitting.split(lines, "lines", 5, 2)
    assert [lines[a:b].count("\n") for a, b in got] == [4, 4, 4, 4] and lines[got[1][0] :].startswith("l2")
    with pytest.raises(ValueError):
        splitting.split("abc", "chars", 2, 2)
    with pytest.raises(ValueError):
        splitting.split("abc", "words", 2, 1)


def test_operator(spark):
    limits = spark.createDataFrame([("a", "split", "python", "chars", 10, 2), ("b", "split", None, "bytes", 8, 0), ("c", "split", "go", "lines", 2, 0), ("d", "pack", None, "tokens", 5, 0)], "limit_id string, purpose string, language string, unit string, max_size bigint, overlap bigint")
    rows = [("p", "python", "aaaa\nbbbb\ncccc\n", 5), ("p", "python", "aaaa\nbbbb\ncccc\n", 5), ("fits", "python", "x" * 10, 1), ("g", "go", "a\nb\nc", 3), ("g2", "go", "x" * 99, 3), ("n", None, "éééééé", None), ("null", "python", None, 1), (None, "python", "x" * 99, 1), ("e", "ruby", "", 1)]
    chunks = spark.createDataFrame(rows, "id string, language string, content string, start_line int").withColumn("piece", __import__("pyspark").sql.functions.lit("clash"))
    got = splitting.split_chunks(chunks, limits).orderBy("id", "piece").collect()
    assert [(r.id, r.piece, r.content, r.start_line, r.end_line) for r in got] == [
        ("g", 0, "a\n", 3, 3), ("g", 1, "b\nc", 4, 5), ("n", 0, "éééé", 1, 1), ("n", 1, "éé", 1, 1),
        ("p", 0, "aaaa\nbbbb\n", 5, 6), ("p", 1, "b\ncccc\n", 6, 7),
    ]
    assert splitting.split_chunks(chunks.limit(0), limits).count() == 0
    assert splitting.split_chunks(chunks, limits.limit(0)).count() == 0
