"""Filling containers of a fixed capacity with texts, sizes in tokens.

What is planned is the histogram of sizes, never the list of texts: it has no more rows than the capacity. Shallow
combinations of sizes (one to ``DEPTH`` items) that fill a window under the capacity are the columns of a non-negative
least squares problem whose right side is the histogram; its solution, rounded down, says how often each combination is
used, and what is left is packed greedily, largest first, each into the fullest container it fits in. Texts then get
their places by their rank among those of equal size, counted in salted groups of some ``GROUP_ROWS`` at most, so that a
size that a third of all texts has makes no large task.

A capacity over ``MAX_SIZES`` is planned in units of several tokens, sizes rounded up and the capacity down, so that the
histogram keeps its bound, no container is overfull and no text is left out; at most a unit a text stays unused.

A text over the capacity is divided at natural boundaries into pieces that fit; no other text is. Empty texts take no
room and go to container 0; null texts get no container. Rows are one per text and piece.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import splitting, tokens
from codeloom.llm.common import rows_out
from codeloom.session import written

GROUP_ROWS = 50_000
DEPTH = 4
MAX_SIZES = 1 << 16
COLUMNS = 300_000  # of the least squares, about


def combinations(sizes: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For each size as the largest of a container: combinations of up to DEPTH sizes that come as near to the capacity as the sizes at hand allow."""
    out, have = set(), np.sort(sizes)
    steps = np.unique(have[np.linspace(0, len(have) - 1, min(len(have), max(4, min(48, COLUMNS // (3 * len(have)))))).astype(int)])

    def fitting(room: int) -> int | None:
        i = int(np.searchsorted(have, room, "right")) - 1
        return int(have[i]) if i >= 0 else None

    for a in map(int, have):
        if (b := fitting(min(a, capacity - a))) is None or b > capacity - a:
            out.add((a,))
            continue
        out.add((a, b))
        for b in map(int, steps[steps <= min(a, capacity - a)]):
            if (c := fitting(min(b, capacity - a - b))) is not None:
                out.add((a, b, c))
                rest = capacity - a - b
                for share in (2, 3):
                    c = fitting(min(b, rest // share))
                    d = c and fitting(min(c, rest - c))
                    if d:
                        out.add((a, b, c, d))
        k = capacity // a
        if 2 <= k <= DEPTH:
            out.add((a,) * k)
    return sorted(out, reverse=True)


def nnls(columns: list[tuple[int, ...]], sizes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes the sizes in x times each column come near to ``counts``: projected gradient with momentum."""
    row = np.searchsorted(sizes, np.array([s for c in columns for s in c]))
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    scale = 1 / np.sqrt(counts + 1.0)  # relative misfit: rare sizes count too

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[col], len(sizes)) * scale

    x = np.zeros(len(columns))
    v = np.ones(len(columns))
    for _ in range(12):
        v = np.bincount(col, (forward(v) * scale)[row], len(columns))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(1e-12, np.linalg.norm(np.bincount(col, (forward(v) * scale)[row], len(columns))))
    y, t = x.copy(), 1.0
    target = counts * scale
    for _ in range(rounds):
        new = np.maximum(0, y - step * np.bincount(col, ((forward(y) - target) * scale)[row], len(columns)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def greedy(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Containers for what is left: opened with the largest size, then always the largest that still fits; equal ones in one go."""
    out: dict[tuple[int, ...], int] = {}
    have = sorted(s for s, n in left.items() if n)
    left = dict(left)
    while have:
        room, made, use = capacity, [], {}
        i = len(have) - 1
        while i >= 0:
            s = have[i]
            fits = min(room // s, left[s]) if s <= room else 0
            if fits:
                made += [s] * fits
                use[s] = fits
                room -= s * fits
            i = min(i - 1, bisect_right(have, room) - 1)
        times = min(left[s] // k for s, k in use.items())
        for s, k in use.items():
            left[s] -= k * times
        have = [s for s in have if left[s]]
        out[tuple(made)] = out.get(tuple(made), 0) + times
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of sizes and how many containers each fills; together they use up the histogram."""
    histogram = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    if not histogram:
        return []
    if max(histogram) > capacity:
        raise ValueError("a size is over the capacity")
    sizes = np.array(sorted(histogram))
    counts = np.array([histogram[s] for s in sizes], dtype=float)
    columns = combinations(sizes, capacity)
    x = nnls(columns, sizes, counts)
    left, out = dict(histogram), []
    for k in np.argsort([sum(c) for c in columns])[::-1]:
        c = columns[k]
        need = {s: c.count(s) for s in c}
        times = min(int(x[k]), *(left[s] // n for s, n in need.items()))
        if times and sum(c) >= capacity * 0.995:
            out.append((c, times))
            for s, n in need.items():
                left[s] -= n * times
    return out + list(greedy(left, capacity).items())


def _sizes(batch: dict[str, list], capacity: int, tokenizer: str) -> Iterable[tuple]:
    count = tokens.counter(tokenizer).count
    for i, text in zip(batch["doc_id"], batch["text"]):
        n, h = count(text), xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
        if n <= capacity:
            yield i, 0, 1, 0, len(text), n, h
            continue
        spans = splitting.split(text, "tokens", capacity, 0, tokenizer)
        for k, (a, b) in enumerate(spans):
            yield i, k, len(spans), a, b, count(text[a:b]), h


def sized(documents: DataFrame, capacity: int, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Texts with their size, those over the capacity divided: doc_id, piece, pieces, start_char, end_char, tokens."""
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    out = "doc_id bigint, piece int, pieces int, start_char int, end_char int, tokens int"
    rows = rows_out(docs, lambda b: _sizes(b, capacity, tokenizer), f"{out}, hash bigint", scan=True)
    # rows of one doc_id count once; should they differ in text, the pieces of one of them
    one = rows.groupBy("doc_id", "piece", "hash").agg(*[F.first(c).alias(c) for c in ("pieces", "start_char", "end_char", "tokens")])
    least = one.withColumn("least", F.min("hash").over(Window.partitionBy("doc_id"))).where(F.col("hash") == F.col("least"))
    return least.select("doc_id", "piece", "pieces", "start_char", "end_char", "tokens")


def capacity_of(limits: DataFrame, limit_id: str = "pack_main") -> int:
    row = limits.where((F.col("limit_id") == limit_id) & (F.col("purpose") == "pack")).select("max_size", "unit").first()
    if row is None or row.unit != "tokens" or not row.max_size or row.max_size < 1:
        raise ValueError(f"{limit_id}: no capacity in tokens")
    return row.max_size


def pack(documents: DataFrame, capacity: int, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Each text or piece with its container: doc_id, piece, pieces, start_char, end_char, tokens, container."""
    unit = -(-capacity // MAX_SIZES)
    room = capacity // unit
    items = written(sized(documents, capacity, tokenizer).withColumn("size", F.least(F.ceil(F.col("tokens") / unit), F.lit(room)).cast("int")), "sizes")
    salts = -(-items.count() // GROUP_ROWS) or 1
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = items.groupBy("size", "salt").count()
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    rows = by_salt.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("size", "salt", "count", "base")
    histogram = {r["size"]: r.n for r in by_salt.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # at most MAX_SIZES + 1 rows
    starts: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for made, times in plan(histogram, room):
        for s in set(made):
            k = made.count(s)
            starts.setdefault(s, []).append((used.get(s, 0), k, container))
            used[s] = used.get(s, 0) + k * times
        container += times
    firsts = {s: [x[0] for x in v] for s, v in starts.items()}
    places = items.sparkSession.sparkContext.broadcast((starts, firsts))  # its size follows the number of sizes, not the texts

    def place(batch: dict[str, list]) -> Iterable[tuple]:
        starts, firsts = places.value
        for i, k, n, a, b, t, s, rank in zip(*(batch[c] for c in ("doc_id", "piece", "pieces", "start_char", "end_char", "tokens", "size", "rank"))):
            c = 0
            if s:
                first, each, base = starts[s][bisect_right(firsts[s], rank) - 1]
                c = base + (rank - first) // each
            yield i, k, n, a, b, t, c

    local = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("local", local).join(rows.select("size", "salt", "base"), ["size", "salt"]).withColumn("rank", F.col("base") + F.col("local"))
    return rows_out(ranked.select("doc_id", "piece", "pieces", "start_char", "end_char", "tokens", "size", "rank"), place, "doc_id bigint, piece int, pieces int, start_char int, end_char int, tokens int, container bigint")


def filling(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, divided texts, containers, tokens, share of the room used, and the fewest containers that could hold the tokens."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count_if((F.col("pieces") > 1) & (F.col("piece") == 0)).alias("cut"))
    return per.agg(F.sum("n").alias("items"), F.sum("cut").alias("divided"), F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).withColumn("used", F.round(F.col("tokens") / (F.col("containers") * capacity), 6)).withColumn("fewest", F.ceil(F.col("tokens") / capacity))
