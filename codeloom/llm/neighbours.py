"""Most similar vectors, by additive quantisation.

A vector of length one is written as a sum of one word from each of ``LEVELS`` codebooks of full dimension, found by a
beam search over the residuals up to level ``COARSE`` and a greedy one behind it; codes and the norms of the sums are stored.
Inner products of coarse sums are sums of entries of one table of the inner products of all words, so vectors are scored
by looking up codes; what scores near enough is scored by the full sums, and what still does is reranked by the vectors
themselves.

``neighbours`` joins all vectors with all: the first words of the best few beams name the cells a vector lies in, with
cells in proportion to the vectors, and codes are compared within cells only. Cells over ``BLOCK`` entries are compared
block by block in tasks of their own, so none is dropped and none is large. Pairs of a cosine below ``least`` are not
looked for; the recall of the others is measured against brute force in the tests and in the README. Equal vectors are
one class: only classes are compared, and members take their places from the first few ids of each class.

``search`` takes stated queries against all rows: codes are scanned in full, in blocks of queries, and the best
``RERANK`` by lookup are reranked.

``nearest`` takes every vector as a query and has no least cosine: blocks of ``WIDE_BLOCK`` queries go to all executors
in turn, and each task scans its rows by products of matrices and keeps the best of each query. What may be among them by
single precision is scored in double, so the result is exact; the work is that of all pairs.

A vector is usable if it has the right length, finite numbers and not only zeros; all others, null ids and repeated rows
do not count. Equal cosines: the smaller id first. The codebooks are fitted on ``SAMPLE`` vectors at most, drawn by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import ship, written

SAMPLE, COARSE, LEVELS, BEAM, PROBES = 8192, 6, 14, 4, 6
BLOCK, RERANK, QUERY_BLOCK, SCANNED = 2048, 300, 512, 16
MARGIN, FINE_MARGIN = 0.35, 0.18
HOT_ROWS = 100_000
WIDE_BLOCK, SLAB, STRIPES, ROUNDING = 12_288, 1024, 64, 1e-5


@dataclass
class Codebooks:
    words: np.ndarray  # levels, size, dimension
    depth: int  # levels whose words name a cell
    coarse: int  # levels of the beam search and the lookup

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[2])

    def table(self) -> np.ndarray:
        """Inner products of all words of the coarse levels."""
        c = self.words[: self.coarse].reshape(-1, self.words.shape[2])
        return (c @ c.T).astype(np.float32)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[2]), dtype=np.float32)
        for m in range(codes.shape[1]):
            out += self.words[m][codes[:, m]]
        return out


def shape_for(n: int) -> tuple[int, int]:
    """(words per codebook, levels that name a cell): about four vectors a cell, 64 to 256 words, but no more than one for every 16 vectors."""
    bits = max(6.0, np.log2(max(n, 4) / 4))
    depth = int(np.ceil(bits / 8))
    return min(1 << int(min(8, max(6, np.ceil(bits / depth)))), max(1, n // 16)), depth


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        at = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n)[:-1]])[at], axis=0)
        c[at] = sums / n[at, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def fit(sample: np.ndarray, size: int, depth: int, coarse: int = COARSE, levels: int = LEVELS, seed: int = 0) -> Codebooks:
    """Residual codebooks; the coarse ones behind the cells are refitted together by least squares to the codes of a beam search."""
    rng = np.random.default_rng(seed)
    coarse = max(coarse, depth + 2)
    r, words = sample.astype(np.float32), []
    for _ in range(coarse):
        c = kmeans(r, size, rng)
        r = r - c[np.argmax(r @ c.T - 0.5 * (c * c).sum(1), 1)]
        words.append(c)
    books = Codebooks(np.stack(words), depth, coarse)
    if len(sample) >= 4 * size:
        codes, _, _ = encode(sample, books)
        rest = coarse - depth
        a = np.zeros((len(sample), rest * size), dtype=np.float32)
        for m in range(rest):
            a[np.arange(len(sample)), m * size + codes[:, depth + m]] = 1
        left = sample - books.sums(codes[:, :depth])
        solved = np.linalg.solve(a.T @ a + np.eye(rest * size, dtype=np.float32) * 0.5, a.T @ left + 0.5 * books.words[depth:].reshape(-1, sample.shape[1]))
        books.words[depth:] = solved.reshape(rest, size, -1)
    codes, _, _ = encode(sample, books)
    r = (sample - books.sums(codes)).astype(np.float32)
    for _ in range(levels - coarse):
        c = kmeans(r, size, rng, 5)
        r = r - c[np.argmax(r @ c.T - 0.5 * (c * c).sum(1), 1)]
        words.append(c)
    return Codebooks(np.concatenate([books.words, np.stack(words[coarse:])]) if levels > coarse else books.words, depth, coarse)


def encode(x: np.ndarray, books: Codebooks, beam: int = BEAM, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level), norms of the coarse sums, and cells (row, probe) of unit vectors; cells repeat where a beam is short."""
    levels, size, _ = books.words.shape
    coarse = books.coarse
    flat = books.words[:coarse].reshape(-1, books.words.shape[2])
    gram = flat @ flat.T
    own = np.diag(gram)
    codes_out, norms, cells = [], [], []
    for lo in range(0, len(x), 1024):
        b = x[lo : lo + 1024].astype(np.float32)
        n = len(b)
        at = -2 * (b @ flat.T) + own
        score = np.zeros((n, 1), dtype=np.float32)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        for m in range(coarse):
            grown = score[:, :, None] + at[:, None, m * size : (m + 1) * size]
            for l in range(m):
                grown += 2 * gram[:, m * size : (m + 1) * size][codes[:, :, l] + l * size]
            grown = grown.reshape(n, -1)
            keep = min(grown.shape[1], max(beam, probes) if m < books.depth else beam)
            best = np.argpartition(grown, keep - 1, 1)[:, :keep] if keep < grown.shape[1] else np.tile(np.arange(keep), (n, 1))
            score = np.take_along_axis(grown, best, 1)
            order = np.argsort(score, 1, kind="stable")
            best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // size)[:, :, None], 1), (best % size)[:, :, None]], 2)
            if m == books.depth - 1:
                cell = np.zeros(codes.shape[:2], dtype=np.int64)
                for l in range(books.depth):
                    cell = cell * size + codes[:, :, l]
                cells.append(np.pad(cell[:, :probes], ((0, 0), (0, max(0, probes - cell.shape[1]))), mode="edge"))
                score, codes = score[:, :beam], codes[:, :beam]
        best = [codes[:, 0, m] for m in range(coarse)]
        total = books.sums(codes[:, 0])
        norms.append(np.maximum(1e-6, np.linalg.norm(total, axis=1)))
        left = b - total
        for m in range(coarse, levels):
            w = books.words[m]
            c = np.argmax(left @ w.T - 0.5 * (w * w).sum(1), 1)
            left = left - w[c]
            best.append(c)
        codes_out.append(np.stack(best, 1))
    if not codes_out:
        return np.zeros((0, levels), dtype=np.int64), np.zeros(0), np.zeros((0, probes), dtype=np.int64)
    return np.concatenate(codes_out), np.concatenate(norms), np.concatenate(cells)


def lookup(table: np.ndarray, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the sums with codes ``a`` and ``b``, row by row, from the table of those of the words."""
    out = np.zeros(len(a), dtype=np.float32)
    coarse = table.shape[1] // size
    for m in range(coarse):
        left = (a[:, m] + m * size) * table.shape[1]
        for l in range(coarse):
            out += table.ravel()[left + b[:, l] + l * size]
    return out


def usable(vector: Column, dimension: int) -> Column:
    ok = (F.size(vector) == dimension) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(ok, F.lit(False))


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(items: DataFrame, key: str, vector: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, a, b), (classes of equal vectors: number, a, b, vector), the latter as a written table."""
    x = items.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"), dimension))
    x = x.withColumn("a", F.xxhash64("vector")).withColumn("b", F.xxhash64(F.lit(1), "vector"))
    classes = x.groupBy("a", "b").agg(F.first("vector").alias("vector")).withColumn("number", F.monotonically_increasing_id())
    return x.select("id", "a", "b").distinct(), written(classes, "vectors")


def fitted(classes: DataFrame, dimension: int, n: int) -> Codebooks | None:
    draw = F.pmod(F.xxhash64(F.lit(2), "a"), F.lit(1 << 30))
    share = min(1.0, 1.3 * SAMPLE / max(1, n))  # so that tasks send few more rows than are wanted
    rows = classes.where(draw < int(share * (1 << 30))).orderBy(draw, "number").limit(SAMPLE).select("vector").toPandas()
    if not len(rows):
        return None
    x = np.stack(rows.vector.to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size, depth = shape_for(n)
    return fit(x.astype(np.float32), size, depth)


def _entries(classes: DataFrame, books, dimension: int) -> DataFrame:
    """One row per vector and cell: cell, number, codes as bytes, norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, norms, cells = encode(_vectors(b.column(1), dimension), books.value)
            number = np.asarray(b.column(0))
            first = np.array([[j == 0 or c[j] not in c[:j] for j in range(len(c))] for c in cells])
            row, probe = np.nonzero(first)
            raw = np.ascontiguousarray(codes.astype(np.uint8)).view(f"V{codes.shape[1]}").ravel()
            as_bytes = np.array([v.tobytes() for v in raw], dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(cells[row, probe]), pa.array(number[row]), pa.array(as_bytes[row], pa.binary()), pa.array(norms[row].astype(np.float32))], names=["cell", "number", "codes", "norm"])

    return classes.select("number", "vector").mapInArrow(run, "cell bigint, number bigint, codes binary, norm float")


def _pairs_of_runs(runs: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within each run of equal values, a few million at a time; with ``side``, only across 0 and 1."""
    ends = np.append(np.flatnonzero(np.diff(runs)) + 1, len(runs))
    last = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    more = last - np.arange(len(runs)) - 1
    lo = 0
    total = np.cumsum(more)
    while lo < len(runs):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 2_000_000, "right")))
        left = np.repeat(np.arange(lo, hi), more[lo:hi])
        start = np.repeat(np.cumsum(more[lo:hi]) - more[lo:hi], more[lo:hi])
        right = left + 1 + np.arange(len(left)) - start
        if side is not None:
            ok = (side[left] == 2) & (side[right] == 2) | (side[left] + side[right] == 1)
            left, right = left[ok], right[ok]
        yield left, right
        lo = hi


def candidates(entries: DataFrame, model, least: float) -> DataFrame:
    """Pairs of numbers (one < other) that share a cell and whose looked-up cosine is at least ``least`` less a margin, once."""
    counts = entries.groupBy("cell").count().where(F.col("count") > BLOCK)
    n = counts.count()
    e = entries.withColumn("part", F.lit(0).cast("bigint")).withColumn("side", F.lit(2))
    if n:  # blocks of a large cell meet pairwise, each two in a group of their own
        hot = counts.select("cell", F.ceil(F.col("count") / BLOCK).cast("bigint").alias("blocks"))
        hot = F.broadcast(hot) if n <= HOT_ROWS else hot
        j = e.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("number"), F.col("blocks")))
        j = j.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        lo, hi = F.least("own", "other"), F.greatest("own", "other")
        e = j.withColumn("part", lo * F.col("blocks") + hi).withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)).select("cell", "number", "codes", "norm", "part", "side")
    e = e.repartition("cell", "part").sortWithinPartitions("cell", "part", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, table = model.value
        levels, size, _ = books.words.shape
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            cell, part = np.asarray(t.column("cell")), np.asarray(t.column("part"))
            number, norm, side = np.asarray(t.column("number")), np.asarray(t.column("norm")), np.asarray(t.column("side"))
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, levels).astype(np.int64)
            runs = np.cumsum(np.concatenate([[0], (np.diff(cell) != 0) | (np.diff(part) != 0)]))
            got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            full = books.sums(codes)
            full /= np.maximum(1e-6, np.linalg.norm(full, axis=1, keepdims=True))
            for i, j in _pairs_of_runs(runs, side if (side != 2).any() else None):
                near = lookup(table, size, codes[i], codes[j]) >= (least - MARGIN) * norm[i] * norm[j]
                i, j = i[near], j[near]
                for lo in range(0, len(i), 100_000):
                    x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
                    near = np.einsum("nd,nd->n", full[x], full[y]) >= least - FINE_MARGIN
                    got.append((number[x[near]], number[y[near]]))
            a, b = (np.concatenate(x) for x in zip(*got))
            u = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["one", "other"])

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            if t.num_rows < 50_000:
                continue
            cell = np.asarray(t.column("cell"))
            part = np.asarray(t.column("part"))
            tail = (cell == cell[-1]) & (part == part[-1])
            cut = int(np.argmax(tail))
            if cut:
                yield done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield done(t)

    return e.mapInArrow(run, "one bigint, other bigint").distinct()


def reranked(pairs: DataFrame, classes: DataFrame, least: float, dimension: int) -> DataFrame:
    """(one, other, cosine) of the pairs at ``least`` or above, by the vectors, in double."""
    v = classes.select("number", "vector")
    j = pairs.join(v.toDF("one", "x"), "one").join(v.toDF("other", "y"), "other").select("one", "other", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.einsum("nd,nd->n", _vectors(b.column(2), dimension), _vectors(b.column(3), dimension))
                ok = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[ok]), pa.array(np.asarray(b.column(1))[ok]), pa.array(c[ok])], names=["one", "other", "cosine"])

    return j.mapInArrow(run, "one bigint, other bigint, cosine double")


def neighbours(items: DataFrame, k: int = 5, least: float = 0.9, key: str = "id", vector: str = "vector", dimension: int = 64) -> DataFrame:
    """The k most similar others of each usable vector, of a cosine of at least ``least``: id, rank (from 1), other, cosine."""
    sc = ship(items.sparkSession).sparkContext
    members, classes = prepared(items, key, vector, dimension)
    books = fitted(classes, dimension, classes.count())
    if books is None:
        return items.sparkSession.createDataFrame([], "id string, rank int, other string, cosine double")
    model = sc.broadcast((books, books.table()))  # some hundred words of a vector's dimension: no larger with more rows
    entries = written(_entries(classes, sc.broadcast(books), dimension), "codes")
    pairs = reranked(candidates(entries, model, least), classes, least, dimension)
    both = pairs.unionByName(pairs.select(F.col("other").alias("one"), F.col("one").alias("other"), "cosine"))
    numbers = classes.select("a", "b", "number")
    named = members.join(numbers, ["a", "b"]).select("id", "number")
    return _listed(named, both, k)


def _listed(named: DataFrame, both: DataFrame, k: int) -> DataFrame:
    """The lists of the members (id, number), from the nearest other classes (one, other, cosine) of each class."""
    heads = named.withColumn("at", F.row_number().over(Window.partitionBy("number").orderBy("id"))).where(F.col("at") <= k + 1).drop("at")
    same = heads.select("number", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    near = both.join(heads.select(F.col("number").alias("other"), F.col("id").alias("name")), "other").select(F.col("one").alias("number"), F.col("name").alias("other"), "cosine")
    best = Window.partitionBy("number").orderBy(F.desc("cosine"), "other")
    lists = same.unionByName(near).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    lists = lists.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "other", "cosine"))).alias("best")).where(F.size("best") > 1)  # k + 1 at most
    own = named.join(lists, "number").select("id", F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k).alias("best"))
    return own.select("id", F.posexplode("best").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), F.col("x.other").alias("other"), F.col("x.cosine").alias("cosine"))


def nearest(items: DataFrame, k: int = 5, key: str = "id", vector: str = "vector", dimension: int = 64) -> DataFrame:
    """The k most similar others of each usable vector, at any cosine: id, rank (from 1), other, cosine (to 12 digits). Exact."""
    spark = ship(items.sparkSession)
    sc = spark.sparkContext
    members, classes = prepared(items, key, vector, dimension)
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "id string, rank int, other string, cosine double")
    named = written(members.join(classes.select("a", "b", "number"), ["a", "b"]).select("id", "number"), "names")
    count = -(-n // WIDE_BLOCK)
    block = F.pmod(F.xxhash64(F.lit(3), "a", "b"), F.lit(count)).cast("int")
    points = written(classes.join(named.groupBy("number").agg(F.min("id").alias("name")), "number").select("number", "name", "vector", block.alias("block")), "points")
    best = Window.partitionBy("one").orderBy(F.desc("cosine"), "name")
    found = None
    for i in range(count):
        rows = points.where(F.col("block") == i).select("number", "vector").toPandas()  # WIDE_BLOCK vectors, more or less
        if not len(rows):
            continue
        q = np.stack(rows.vector.to_numpy()).astype(np.float64)
        q, own = q / np.linalg.norm(q, axis=1, keepdims=True), rows.number.to_numpy()
        del rows
        asked = sc.broadcast((own, q))
        got = points.select("number", "name", "vector").mapInArrow(_nearest(asked, k, dimension), "one bigint, other bigint, name string, cosine double")
        got = written(got.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).select("one", "other", "cosine"), "nearest")
        asked.destroy()  # what was found is written
        found = got if found is None else found.unionByName(got)
    return _listed(named, found, k)


def _nearest(asked, k: int, dimension: int):
    """The k nearest of each query among the rows of a task, itself left out; equal cosines: the smaller name first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = asked.value
        single = q.astype(np.float32)
        held: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64))] * -(-len(q) // SLAB)
        floor = np.full(len(q), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            number, name, x = np.asarray(b.column(0)), np.array(b.column(1).to_pylist(), dtype=object), _vectors(b.column(2), dimension)
            width = -(-len(x) // STRIPES)
            wide = np.zeros((width * STRIPES, dimension), dtype=np.float32)
            wide[: len(x)] = x
            for at in range(len(held)):
                lo = at * SLAB
                mine, own = q[lo : lo + SLAB], numbers[lo : lo + SLAB]
                s = single[lo : lo + SLAB] @ wide.T
                s[:, len(x) :] = -np.inf
                s = s.reshape(len(mine), STRIPES, width)
                top = s.max(1)  # of the rows at every width-th place
                least = floor[lo : lo + SLAB]
                if width > k:  # k + 1 rows, one of which may be the query, are at least as near as this
                    least = np.maximum(least, np.partition(top, width - k - 1, 1)[:, width - k - 1])
                least = least - ROUNDING
                row, place = np.nonzero(top >= least[:, None])
                some, stripe = np.nonzero(s[row, :, place] >= least[row, None])
                row, col = row[some], stripe * width + place[some]
                ok = col < len(x)
                row, col = row[ok], col[ok]
                other = own[row] != number[col]
                row, col = row[other], col[other]
                score = np.concatenate([np.einsum("nd,nd->n", mine[row[i : i + 100_000]], x[col[i : i + 100_000]]) for i in range(0, len(row), 100_000)] or [np.zeros(0)])
                r, c, w, o = (np.concatenate(p) for p in zip(held[at], (row, np.round(score, 12), name[col], number[col])))
                _, w_at = np.unique(w.astype(str), return_inverse=True)
                order = np.lexsort((w_at, -c, r))
                r, c, w, o = r[order], c[order], w[order], o[order]
                first = np.searchsorted(r, r)
                rank = np.arange(len(r)) - first
                keep = rank < k
                last = rank == k - 1
                floor[lo + r[last]] = c[last]
                held[at] = (r[keep], c[keep], w[keep], o[keep])
        for at, (r, c, w, o) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at * SLAB + r]), pa.array(o), pa.array(w, pa.string()), pa.array(c)], names=["one", "other", "name", "cosine"])

    return run


def pairs(items: DataFrame, k: int = 5, least: float = 0.9, key: str = "id", vector: str = "vector", dimension: int = 64) -> DataFrame:
    """(id_1, id_2), once: pairs of which one is among the k most similar to the other and whose cosine is at least ``least``."""
    n = neighbours(items, k, least, key, vector, dimension)
    return n.select(F.least("id", "other").alias("id_1"), F.greatest("id", "other").alias("id_2")).distinct()


def search(items: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", vector: str = "vector", dimension: int = 64, rerank: int = RERANK) -> DataFrame:
    """The k most similar others of each query among all items: id, rank, other, cosine. ``queries``: ids (column ``key``) of items."""
    spark = ship(items.sparkSession)
    sc = spark.sparkContext
    members, classes = prepared(items, key, vector, dimension)
    books = fitted(classes, dimension, classes.count())
    schema = "id string, rank int, other string, cosine double"
    if books is None:
        return spark.createDataFrame([], schema)
    numbers = classes.select("a", "b", "number")
    named = written(members.join(numbers, ["a", "b"]).select("id", "number"), "names")
    wanted = named.join(queries.select(F.col(key).cast("string").alias("id")).distinct(), "id").select("number").distinct().join(classes.select("number", "vector"), "number")
    wanted = written(wanted.withColumn("block", F.floor(F.row_number().over(Window.partitionBy(F.pmod("number", F.lit(64))).orderBy("number")) / QUERY_BLOCK) * 64 + F.pmod("number", F.lit(64))), "queries")
    coded = written(_entries(classes, sc.broadcast(books), dimension).dropDuplicates(["number"]).drop("cell"), "codes")
    model = sc.broadcast(books)
    found = None
    todo = [r.block for r in wanted.select("block").distinct().collect()]  # one number per QUERY_BLOCK queries
    groups = [todo[i : i + SCANNED] for i in range(0, len(todo), SCANNED)]
    for g in groups:
        rows = wanted.where(F.col("block").isin(g)).select("number", "vector").toPandas()  # at most SCANNED x QUERY_BLOCK vectors
        q = np.stack(rows.vector.to_numpy()).astype(np.float64)
        q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
        block = sc.broadcast((rows.number.to_numpy(), q))
        got = coded.mapInArrow(_scan(block, model, rerank), "one bigint, other bigint, score float")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], schema)
    top = Window.partitionBy("one").orderBy(F.desc("score"), "other")
    near = found.withColumn("at", F.row_number().over(top)).where(F.col("at") <= rerank).select("one", "other")
    exact = reranked(near, classes, -2.0, dimension)
    ids = named.join(queries.select(F.col(key).cast("string").alias("id")).distinct(), "id").select("id", F.col("number").alias("one"))
    heads = named.withColumn("at", F.row_number().over(Window.partitionBy("number").orderBy("id"))).where(F.col("at") <= k + 1).select(F.col("number").alias("other"), F.col("id").alias("name"))
    out = exact.join(ids, "one").join(heads, "other").where(F.col("name") != F.col("id"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "name"))).where(F.col("rank") <= k)
    return ranked.select("id", "rank", F.col("name").alias("other"), "cosine")


def _scan(block, model, rerank: int):
    """The best ``rerank`` of each query by lookup, among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = block.value
        levels, size, _ = model.value.words.shape
        tables = q @ model.value.flat.T  # of each query with every word
        best = np.full((len(q), rerank), -np.inf, dtype=np.float32)
        which = np.zeros((len(q), rerank), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, levels).astype(np.int64)
            norm, number = np.maximum(1e-6, np.linalg.norm(model.value.sums(codes), axis=1)), np.asarray(b.column(0))
            codes += np.arange(levels) * size
            for i in range(len(q)):
                s = (tables[i][codes].sum(1) / norm).astype(np.float32)
                at = np.flatnonzero(s > best[i].min())
                if not len(at):
                    continue
                s, n = np.concatenate([best[i], s[at]]), np.concatenate([which[i], number[at]])
                keep = np.argpartition(-s, rerank - 1)[:rerank]
                best[i], which[i] = s[keep], n[keep]
        row, col = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(which[row, col]), pa.array(best[row, col])], names=["one", "other", "score"])

    return run
