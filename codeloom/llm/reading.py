"""Reading level of documents, by harmonic propagation over the graph of documents and words.

A document's edges go to the different words of its prose; each sentence gives its words equal parts of one, so that a
long sentence weighs no more than a short one, times the rarity of the word. Graded documents are clamped at the mean of
their grades. In turn, words take the weighted mean of their documents and documents that of their words, where what has
been reached only over other estimates counts less. Rounds go on until neither values nor trust move by ``TOLERANCE`` and
no further word is reached; from the second on they are accelerated (Anderson), which changes the way to the fixed point
and not the point. ``ROUNDS`` is a guard only: where it is reached, the operator raises.

The estimate of a graded document leaves its own grade out of the values of its words, so that all estimates are alike.
Over a histogram of those of the graded documents, the cut between any level and the next is where fewest of their grades
lie on the wrong side; between the cuts the scale is linear. On it, an own grade counts with ``GRADE_SHARE``.

A word is known by 64 bits of its hash. Edges stay where their documents are, in a table that each round reads; per
round, only the sums by word move, and the words' values go back to every executor: that is the way up to ``WORDS_SENT``
words. A larger vocabulary stays distributed: each round joins edges with values by word and with estimates by document,
words of more than ``HOT`` documents apart; it comes to the same point, by more rounds.

Code, tables, lists, headings and addresses are not prose; a document without prose (null, blank, all code) gets no
level. Rows of one doc_id count once; grades of null or outside 1 to 4 and of unknown documents do not count. Without any
grades no document gets a level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import ship, spread, written

WORDS_SENT, HOT = 1 << 22, 1_000_000
ROUNDS, TOLERANCE, HISTORY = 500, 1e-5, 8
TRUST = 0.3
BINS = 3000
GRADE_SHARE = 0.4
EXPERT = 4
GRADES_SENT = 200_000
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_LINE = re.compile(r"(?m)^(?:[ \t]*(?:[-*+•]|\d+[.)])[ \t].*|[ \t]*\|.*|[ \t]*#.*| {4,}.*|\t.*|[ \t]*\[[^\]]*\]\([^)]*\)[ \t]*)$")
_INLINE = re.compile(r"`[^`\n]*`|\]\([^)\n]*\)")
_STOP = re.compile(r"[.!?…]+[\s\"')\]]+|\n[ \t]*\n|[。！？]")
_WORD = re.compile(r"[^\W\d_]{2,}")


_BLANKS = {k: " " for k in range(128) if not chr(k).isalpha()}


def _addresses_out(prose: str) -> str:
    """Without words that hold an underscore or a slash."""
    if "_" not in prose and "/" not in prose:
        return prose
    keep = lambda w: "_" not in w and "/" not in w
    return "\n".join(" ".join(filter(keep, line.split(" "))) if "_" in line or "/" in line else line for line in prose.replace("\t", " ").replace("\r", " ").split("\n"))


def _words(sentence: str) -> list[str]:
    if sentence.isascii():  # the same words, faster
        return [w for w in sentence.translate(_BLANKS).split() if len(w) > 1]
    return _WORD.findall(sentence)


def sentences(text: str) -> list[list[str]]:
    """Words of two letters or more of each sentence of the prose, in lower case."""
    prose = _LINE.sub("", _FENCE.sub(" ", text))
    if "`" in prose or "](" in prose:
        prose = _INLINE.sub(" ", prose)
    return [ws for s in _STOP.split(_addresses_out(prose).lower()) if (ws := _words(s))]


@lru_cache(200_000)
def number(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def edges(text: str | None) -> tuple[list[int], list[float]]:
    """Numbers of the words of a document, and the parts of sentences they hold."""
    parts: dict[str, float] = {}
    for s in sentences(text or ""):
        words = set(s)
        part = 1.0 / len(words)
        for w in words:
            parts[w] = parts.get(w, 0.0) + part
    return [number(w) for w in parts], list(parts.values())


_EDGES = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("parts", pa.binary())])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [edges(t) for t in b.column(1).to_pylist()]
        words, parts = ([np.array(x, dtype=t).tobytes() for x in xs] for xs, t in (([w for w, _ in got], np.int64), ([p for _, p in got], np.float32)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(parts, pa.binary())], schema=_EDGES)


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers stored as the bytes of a binary column, one after the other, and how many there are in each row."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, kind), np.zeros(len(column), dtype=np.int64)
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]).view(kind), np.diff(at) // np.dtype(kind).itemsize


class Words:
    """The words that occur, in order, in how many documents, and the rarity that follows."""

    def __init__(self, number: np.ndarray, frequency: np.ndarray, documents: int) -> None:
        order = np.argsort(number)
        self.number, self.rarity = number[order], np.log(max(2, documents) / np.maximum(1.0, frequency[order])) + 0.1


def _ranked(edges_: DataFrame, words) -> DataFrame:
    """Edges with the place of each word among the words instead of its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value.number
        for b in batches:
            got, sizes = _numbers(b.column(1), np.int64)
            at = np.searchsorted(known, got).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
            ranks = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(at.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), ranks, b.column(2), b.column(3)], names=["doc_id", "words", "parts", "grade"])

    return edges_.mapInArrow(run, "doc_id bigint, words binary, parts binary, grade double")


@dataclass
class State:
    """What has been reached: sums by word of what its documents say, and the values that follow."""

    num: np.ndarray
    den: np.ndarray
    value: np.ndarray
    trust: np.ndarray


def _value(num, den, mean: float):
    return (num + 1e-3 * mean) / (den + 1e-3)


def _trust(den):
    return den / (den + 0.5)


def _flat(b: pa.RecordBatch, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each edge, its word, its weight."""
    (words, sizes), (parts, _) = _numbers(b.column(1), np.int32), _numbers(b.column(2), np.float32)
    return np.repeat(np.arange(len(sizes)), sizes), words, parts.astype(np.float64) * rarity[words]


def _free(row: np.ndarray, w: np.ndarray, value: np.ndarray, trust: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of ``n`` documents from the values and trust at their edges, and the trust in them (nan and 0 without words)."""
    t = np.bincount(row, w * trust, n)
    s = np.bincount(row, w * trust * value, n)
    all_ = np.bincount(row, w, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(t > 0, s / t, np.nan), np.where(all_ > 0, t / all_, 0.0)


def _by_word(edges_: DataFrame, words, state) -> DataFrame:
    """One half round: sums by word of what its documents say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, (value, trust) = words.value.rarity, state.value
        num, den = np.zeros(len(rarity)), np.zeros(len(rarity))
        for b in batches:
            if not b.num_rows:
                continue
            row, word, w = _flat(b, rarity)
            free, sure = _free(row, w, value[word], trust[word], b.num_rows)
            grade = b.column(3).to_numpy(zero_copy_only=False)
            graded = ~np.isnan(grade)
            f = np.where(graded, grade, np.nan_to_num(free))
            c = np.where(graded, 1.0, TRUST * sure * ~np.isnan(free))
            num += np.bincount(word, w * (c * f)[row], len(rarity))
            den += np.bincount(word, w * c[row], len(rarity))
        at = np.flatnonzero(den)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(num[at]), pa.array(den[at])], names=["word", "num", "den"])

    return edges_.mapInArrow(run, "word int, num double, den double").groupBy("word").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def _frequency(edges_: DataFrame) -> DataFrame:
    """Documents of each word: word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            some, counts = np.unique(_numbers(b.column(1), np.int64)[0], return_counts=True)
            known, at = np.unique(np.concatenate([known, some]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, counts]), len(known)).astype(np.int64)
            if len(known) > WORDS_SENT:
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["word", "n"])
                known, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["word", "n"])

    return edges_.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def cut(x: np.ndarray, below: np.ndarray, above: np.ndarray) -> float:
    """Between which of the points x (ascending) fewest of ``above`` lie before and of ``below`` behind; the middle of several. Infinite where one of them is empty."""
    if not above.any():
        return np.inf
    if not below.any():
        return -np.inf
    wrong = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([np.cumsum(below[::-1])[::-1], [0]])
    ends = np.concatenate([x[:1], x, x[-1:]])
    return float(np.mean([(ends[k] + ends[k + 1]) / 2 for k in np.flatnonzero(wrong == wrong.min())]))


def scale(x: np.ndarray, grades_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the way from estimates to the scale of the grades, for interpolation; ``grades_``: how many grades of each level (column) there are at x (ascending)."""
    cuts = [cut(x, grades_[:, :k].sum(1), grades_[:, k:].sum(1)) for k in (1, 2, 3)]
    xs, ys = [x[0]], [1.0 + sum(c == -np.inf for c in cuts)]
    for k, c in enumerate(cuts):
        if np.isfinite(c):
            xs.append(max(c, xs[-1] + 1e-9))
            ys.append(k + 1.5)
    return np.array([*xs, max(x[-1], xs[-1] + 1e-9)]), np.array([*ys, 4.0 - sum(c == np.inf for c in cuts)])


def grades(labels: DataFrame) -> DataFrame:
    """Mean grade of each graded document."""
    ok = labels.where(F.col("level").between(1, 4) & F.col("doc_id").isNotNull())
    return ok.groupBy("doc_id").agg(F.avg("level").alias("grade"))


class Accelerated:
    """The next point to try for a fixed point x = g(x), from the last few points and their g (Anderson's method)."""

    def __init__(self) -> None:
        self.tried: list[np.ndarray] = []
        self.moves: list[np.ndarray] = []
        self.least = np.inf

    def next(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        f = g - x
        moved = float(np.max(np.abs(f), initial=0.0))
        if moved > 2 * self.least:  # led astray: a plain step, and from there anew
            self.__init__()
            return g
        self.least = min(self.least, moved)
        self.tried, self.moves = [*self.tried[-HISTORY:], x], [*self.moves[-HISTORY:], f]
        if len(self.moves) < 3:
            return g
        dx, df = np.diff(self.tried, axis=0), np.diff(self.moves, axis=0)
        return g - np.linalg.lstsq(df.T, f, rcond=None)[0] @ (dx + df)


def _settled(edges_: DataFrame, words, size: int, mean: float, rounds: int) -> State:
    """The state that further rounds do not change."""
    sc = edges_.sparkSession.sparkContext
    value, trust = np.full(size, mean), np.zeros(size)
    reached, way = -1, Accelerated()
    for _ in range(rounds):
        state = sc.broadcast((value, trust))  # two numbers for each of WORDS_SENT words at most
        got = _by_word(edges_, words, state).toPandas()
        state.unpersist()
        at = got.word.to_numpy(dtype=int)
        num, den = np.zeros(size), np.zeros(size)
        num[at], den[at] = got.num.to_numpy(dtype=float), got.den.to_numpy(dtype=float)
        new, sure = _value(num, den, mean), _trust(den)
        x, g = np.concatenate([value, trust]), np.concatenate([new, sure])
        if len(at) == reached and np.max(np.abs(g - x), initial=0.0) < TOLERANCE:
            return State(num, den, new, sure)
        reached = len(at)
        y = way.next(x, g)
        value, trust = np.clip(y[:size], 1, 4), np.clip(y[size:], 0, 1)
    raise RuntimeError(f"the values of the words still move after {rounds} rounds")


def _estimates(edges_: DataFrame, words, settled, mean: float) -> DataFrame:
    """(doc_id, grade, free): estimates from the words, own grades left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, state = words.value.rarity, settled.value
        for b in batches:
            row, word, w = _flat(b, rarity)
            grade = b.column(3).to_numpy(zero_copy_only=False).astype(float)
            own = np.isnan(grade)[row]
            num, den = state.num[word] - np.where(own, 0.0, w * np.nan_to_num(grade)[row]), np.maximum(0.0, state.den[word] - np.where(own, 0.0, w))
            den = np.where(den < 1e-9, 0.0, den)
            free, _ = _free(row, w, _value(np.where(den > 0, num, 0.0), den, mean), _trust(den), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(free, mask=np.isnan(free))], names=["doc_id", "grade", "free"])

    return edges_.mapInArrow(run, "doc_id bigint, grade double, free double")


def _by_joins(edges_: DataFrame, vocabulary: DataFrame, documents: int, mean: float, rounds: int) -> DataFrame:
    """As ``_settled`` and ``_estimates``, for vocabularies of any size: nothing of theirs leaves the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (words, sizes), (parts, _) = _numbers(b.column(1), np.int64), _numbers(b.column(2), np.float32)
            row = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(3).take(pa.array(row)), pa.array(words), pa.array(parts.astype(np.float64))], names=["doc_id", "grade", "word", "part"])

    rarity = F.log(F.lit(float(max(2, documents))) / F.col("n")) + 0.1
    flat = edges_.mapInArrow(run, "doc_id bigint, grade double, word bigint, part double")
    hot = vocabulary.where(F.col("n") > HOT)
    is_hot = F.broadcast(hot.select("word", F.lit(True).alias("hot")))  # edges in all / HOT at most
    flat = flat.join(is_hot, "word", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    def with_words(e: DataFrame, of: DataFrame) -> DataFrame:
        """``e`` with what is said of its words: by a broadcast for hot ones, which would be large groups."""
        few = F.broadcast(of.join(F.broadcast(hot.select("word")), "word", "left_semi"))
        return e.where("hot").join(few, "word").unionByName(e.where("not hot").join(of, "word"))

    e = written(with_words(flat, vocabulary.select("word", rarity.alias("rarity"))).select("doc_id", "grade", "word", "hot", (F.col("part") * F.col("rarity")).alias("w")), "word-edges")
    state = written(vocabulary.select("word", F.lit(0.0).alias("num"), F.lit(0.0).alias("den")), "words")
    value, trust = _value(F.col("num"), F.col("den"), mean), _trust(F.col("den"))

    def estimated(x: DataFrame) -> DataFrame:
        t, s = F.sum(F.col("w") * _trust(F.col("den"))), F.sum(F.col("w") * _trust(F.col("den")) * _value(F.col("num"), F.col("den"), mean))
        return x.groupBy("doc_id").agg(F.first("grade").alias("grade"), (s / F.nullif(t, F.lit(0.0))).alias("free"), (t / F.sum("w")).alias("sure"))

    for _ in range(rounds):
        docs = estimated(with_words(e, state)).select("doc_id", F.coalesce("grade", "free").alias("f"), F.when(F.col("grade").isNotNull(), 1.0).when(F.col("free").isNotNull(), TRUST * F.col("sure")).otherwise(0.0).alias("c"))
        sums = e.join(docs, "doc_id").groupBy("word").agg(F.sum(F.col("w") * F.col("c") * F.coalesce("f", F.lit(0.0))).alias("num"), F.sum(F.col("w") * F.col("c")).alias("den"))
        new = written(sums, "words")
        old = state.select("word", value.alias("value"), trust.alias("trust"))
        j = new.select("word", value.alias("new"), trust.alias("sure")).join(old, "word")
        moved = j.agg(F.max(F.greatest(F.abs(F.col("new") - F.col("value")), F.abs(F.col("sure") - F.col("trust"))))).first()[0] or 0.0
        state = new
        if moved < TOLERANCE / 10:  # plain steps are shorter than what is left of the way
            break
    else:
        raise RuntimeError(f"the values of the words still move after {rounds} rounds")
    x = with_words(e, state)
    den = F.col("den") - F.when(F.col("grade").isNotNull(), F.col("w")).otherwise(0.0)
    den = F.when(den < 1e-9, 0.0).otherwise(den)
    x = x.withColumn("num", F.when(den > 0, F.col("num") - F.coalesce(F.col("w") * F.col("grade"), F.lit(0.0))).otherwise(0.0)).withColumn("den", den)
    none = edges_.select("doc_id", "grade").join(e.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("free", F.lit(None).cast("double"))
    return estimated(x).select("doc_id", "grade", "free").unionByName(none)


def levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, grade (null if not graded), difficulty on the scale of the grades, level (1 to 4) of each document."""
    sc = ship(documents.sparkSession).sparkContext
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    e = spread(docs).mapInArrow(_edges, "doc_id bigint, words binary, parts binary")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        e = e.dropDuplicates(["doc_id"])
    graded = grades(labels)
    graded = F.broadcast(graded) if graded.count() <= GRADES_SENT else graded  # a few MB at most; more are joined by a shuffle
    e = written(e.join(graded, "doc_id", "left").select("doc_id", "words", "parts", F.col("grade").cast("double")), "edges")
    head = e.agg(F.count("*").alias("n"), F.avg("grade").alias("mean")).first()
    out = "doc_id bigint, grade double, difficulty double, level int"
    if head["mean"] is None:
        return e.select("doc_id", "grade", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("int").alias("level"))
    vocabulary = written(_frequency(e), "vocabulary")
    size = vocabulary.count()
    if size <= WORDS_SENT:
        rows = vocabulary.toPandas()
        words = sc.broadcast(Words(rows.word.to_numpy(dtype=np.int64), rows.n.to_numpy(dtype=float), head.n))
        e = written(_ranked(e, words), "edges")
        free = _estimates(e, words, sc.broadcast(_settled(e, words, size, head["mean"], rounds)), head["mean"])
    else:
        free = written(_by_joins(e, vocabulary, head.n, head["mean"], rounds), "estimates")
    bins = F.round((F.col("free") - 1) * (BINS / 3)).cast("int")
    at = [F.count_if(F.floor(F.col("grade") + 0.5) == k).alias(f"g{k}") for k in (1, 2, 3, 4)]
    fit = free.where(F.col("grade").isNotNull() & F.col("free").isNotNull()).groupBy(bins.alias("bin")).agg(F.avg("free").alias("x"), *at).orderBy("x").toPandas()  # at most BINS + 1 rows
    xs, ys = scale(fit.x.to_numpy(dtype=float), fit[["g1", "g2", "g3", "g4"]].to_numpy(dtype=float)) if len(fit) else (np.array([head["mean"]]), np.array([head["mean"]]))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(2).to_numpy(zero_copy_only=False)
            grade = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            d = np.interp(f, xs, ys)
            d = np.where(np.isnan(grade), d, (1 - GRADE_SHARE) * d + GRADE_SHARE * np.nan_to_num(grade))
            none = np.isnan(f)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, mask=none), pa.array(np.clip(np.floor(np.nan_to_num(d) + 0.5), 1, 4).astype(np.int32), mask=none)], names=["doc_id", "grade", "difficulty", "level"])

    return free.mapInArrow(scaled, out)


def profile(read: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and mean difficulty by source and level."""
    d = documents.select("doc_id", F.lower(F.trim("source")).alias("source")).dropDuplicates(["doc_id"])
    return read.join(d, "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"), F.round(F.avg("difficulty"), 4).alias("difficulty"))
