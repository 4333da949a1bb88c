import numpy as np
import pytest

from codeloom.llm import neighbours

D = 16
SCHEMA = "id string, vector array<float>"


def data(n: int, seed: int = 0) -> tuple[list[str], np.ndarray]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, D))
    near = base[: n // 3] + rng.normal(size=(n // 3, D)) * 0.12
    x = np.concatenate([base, near]).astype(np.float32)
    x *= rng.choice([0.5, 1, 3.7], (len(x), 1)).astype(np.float32)
    return [f"k{i:05d}" for i in rng.permutation(len(x))], x


def brute(ids: list[str], x: np.ndarray, k: int, least: float) -> dict[str, list[str]]:
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 12), ids[j]))
        out[ids[i]] = [ids[j] for j in order[:k]]
    return out


def test_codes_and_lookup():
    _, x = data(600)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    books = neighbours.fit(x, 64, 1, 4, 7)
    codes, norms, cells = neighbours.encode(x, books, probes=3)
    assert codes.shape == (len(x), 7)
    sums = books.sums(codes[:, :4])
    assert ((x - books.sums(codes)) ** 2).sum() < ((x - sums) ** 2).sum()
    assert np.allclose(norms, np.linalg.norm(sums, axis=1), atol=1e-3)
    greedy = ((x - books.words[0][np.argmin(((x[:, None] - books.words[0]) ** 2).sum(2), 1)]) ** 2).sum(1)
    assert ((x - sums) ** 2).sum(1).mean() < 0.6 * greedy.mean() and cells.shape == (len(x), 3)
    got = neighbours.lookup(books.table(), 64, codes[:50], codes[50:100])
    assert np.allclose(got, (sums[:50] * sums[50:100]).sum(1), atol=1e-3)


@pytest.mark.parametrize("block", [2048, 8])
def test_neighbours_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    ids, x = data(400)
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    rows += rows[:5] + [("null", None), ("short", [1.0]), ("zero", [0.0] * D), ("nan", [float("nan")] * D), ("inf", [float("inf")] + [0.0] * (D - 1)), (None, x[0].tolist()), ("hole", [None] + [1.0] * (D - 1))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "'x' AS other")
    want = brute(ids, x, 3, 0.9)
    got: dict[str, list] = {}
    for r in neighbours.neighbours(df, 3, 0.9, dimension=D).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    found = {(a, b) for a, bs in got.items() for b in bs}
    assert len(pairs & found) >= 0.98 * len(pairs) and len(found - pairs) <= 0.02 * len(pairs)


def test_equal_vectors_and_ties(spark):
    v = [1.0] + [0.0] * (D - 1)
    w = [1.0, 0.1] + [0.0] * (D - 2)
    df = spark.createDataFrame([(f"c{k}", v) for k in range(9)] + [("a", w), ("z", w)], SCHEMA)
    got: dict[str, list] = {}
    for r in neighbours.neighbours(df, 3, 0.9, dimension=D).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got["c0"] == ["c1", "c2", "c3"] and got["c8"] == ["c0", "c1", "c2"] and got["a"] == ["z", "c0", "c1"]
    assert ("a", "c0") in {tuple(r) for r in neighbours.pairs(df, 3, 0.9, dimension=D).collect()}
    assert neighbours.neighbours(df.limit(0), dimension=D).count() == 0
    one = spark.createDataFrame([("a", v)], SCHEMA)
    assert neighbours.neighbours(one, dimension=D).count() == 0


def test_search_recall(spark):
    ids, x = data(900, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    asked = df.where("id < 'k00060'").select("id")
    want = brute(ids, x, 5, -2)
    got: dict[str, list] = {}
    for r in neighbours.search(df, asked, 5, dimension=D, rerank=60).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert len(got) == 60
    assert sum(len(set(v) & set(want[i])) for i, v in got.items()) >= 0.9 * 5 * len(got)
    assert neighbours.search(df, asked.limit(0), dimension=D).count() == 0


@pytest.mark.parametrize("block,slab", [(32_768, 1024), (100, 30)])
def test_nearest_is_exact_at_any_cosine(spark, block, slab, monkeypatch):
    monkeypatch.setattr(neighbours, "WIDE_BLOCK", block)
    monkeypatch.setattr(neighbours, "SLAB", slab)
    ids, x = data(400, 2)
    x = np.concatenate([x, x[:40] * 2, x[:10]])  # parallel and equal ones
    ids = ids + [f"j{i:05d}" for i in range(50)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(ids[0], x[0].tolist()), ("null", None), ("zero", [0.0] * D), (None, x[0].tolist())]
    got: dict[str, list] = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 5, dimension=D).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == brute(ids, x, 5, -2)


def test_nearest_of_few(spark):
    df = spark.createDataFrame([("a", [1.0] + [0.0] * (D - 1)), ("b", [-1.0] + [0.0] * (D - 1)), ("c", [0.0] * (D - 1) + [1.0])], SCHEMA)
    assert [tuple(r)[:3] for r in neighbours.nearest(df, 5, dimension=D).orderBy("id", "rank").collect()] == [("a", 1, "c"), ("a", 2, "b"), ("b", 1, "c"), ("b", 2, "a"), ("c", 1, "a"), ("c", 2, "b")]
    assert neighbours.nearest(df.limit(0), dimension=D).count() == 0


def test_query_lists_every_usable_entry(spark, tmp_path):
    from codeloom.llm.queries import QUERIES

    x = np.random.default_rng(0).normal(size=(30, 64)).astype(np.float32)
    rows = [(f"k{i:02d}", v.tolist(), f"p{i}") for i, v in enumerate(x)]
    spark.createDataFrame(rows, "id string, vector array<float>, prompt string").write.parquet(f"{tmp_path}/llm_cache.parquet")
    assert QUERIES["p4_neighbours"](spark, str(tmp_path)).count() == 5 * 30
