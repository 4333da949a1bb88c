"""Exact search over vectors: filters first, then the nearest by products of matrices, of which each task keeps its best."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from codeloom.session import ship

QUERY_BLOCK = 4096


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows whose vector has the dimension and only numbers, and these vectors."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    ok = np.isfinite(x).all(1)
    return at[ok], x[ok]


def top_k(items: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding", where: dict[str, object] | None = None) -> DataFrame:
    """The k rows nearest to ``query``, with score = 1 - squared distance; equality filters apply before ranking, ties go to the smaller key (O-22, O-63, O-106)."""
    for c, v in (where or {}).items():
        items = items.where(F.col(c) == F.lit(v))
    q, names = np.array(query, dtype=np.float64), items.columns
    at_vector = names.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for b in batches:
            at, x = _matrix(b.column(at_vector), len(q))
            if not len(at):
                continue
            d = ((x - q) ** 2).sum(1)
            if len(d) > k:  # all that may be among the best, ties included
                near = d <= np.partition(d, k - 1)[k - 1]
                at, d = at[near], d[near]
            t = pa.Table.from_batches([b]).take(pa.array(at)).append_column("distance", pa.array(d))
            t = t if best is None else pa.concat_tables([best, t])
            best = t.take(pc.sort_indices(t, [("distance", "ascending"), (key, "ascending")])[:k])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    ship(items.sparkSession)
    near = items.mapInArrow(run, StructType([*items.schema.fields, StructField("distance", DoubleType())]))
    return near.orderBy("distance", key).limit(k).withColumn("score", F.round(1 - F.col("distance"), 6)).drop("distance")


def retrieve(items: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k nearest items of each query, exactly: query, key, score, rank (O-107, O-108).

    Queries, (number, vector) of one dimension, go to the executors in blocks of ``QUERY_BLOCK``; each block is one pass.
    """
    spark = ship(items.sparkSession)
    kind = items.schema[key]
    schema = StructType([StructField("query", IntegerType()), kind, StructField("distance", DoubleType())])
    found = spark.createDataFrame([], schema)
    for lo in range(0, len(queries), QUERY_BLOCK):
        some = queries[lo : lo + QUERY_BLOCK]
        block = spark.sparkContext.broadcast((np.array([i for i, _ in some], dtype=np.int32), np.array([v for _, v in some], dtype=np.float64)))
        got = items.select(key, vector).mapInArrow(_nearest(block, k), schema)
        found = got if not lo else found.unionByName(got)
    w = Window.partitionBy("query").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", key, (1 - F.col("distance")).alias("score"), "rank")


def _nearest(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = block.value
        own = (q * q).sum(1)
        best: list[pa.Table | None] = [None] * len(q)
        names = None
        for b in batches:
            names = b.schema.names
            at, x = _matrix(b.column(1), q.shape[1])
            if not len(at):
                continue
            squares = (x * x).sum(1)
            for lo in range(0, len(q), 64):
                rough = squares[:, None] - 2 * (x @ q[lo : lo + 64].T) + own[lo : lo + 64]
                for j in range(rough.shape[1]):
                    r = rough[:, j]
                    some = np.flatnonzero(r <= (np.partition(r, k - 1)[k - 1] if len(r) > k else np.inf) + 1e-9)
                    d = ((x[some] - q[lo + j]) ** 2).sum(1)
                    t = pa.table({"key": b.column(0).take(pa.array(at[some])), "distance": pa.array(d)})
                    t = t if best[lo + j] is None else pa.concat_tables([best[lo + j], t])
                    best[lo + j] = t.take(pc.sort_indices(t, [("distance", "ascending"), ("key", "ascending")])[:k])
        for n, t in zip(numbers, best):
            if t is not None:
                t = t.combine_chunks()
                for c in t.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(c.num_rows, n, dtype=np.int32)), c.column(0), c.column(1)], names=["query", names[0], "distance"])

    return run
