"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.session import ship, spread


def rows_out(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[tuple]], schema: str | StructType, scan: bool = False) -> DataFrame:
    """``mapInArrow`` for functions from the columns of a batch, as lists, to rows out: no pandas, no row objects. ``scan``: ``df`` is read from files as it is."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = df.columns
    ship(df.sparkSession)
    df = spread(df) if scan else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            got = list(fn({n: b.column(k).to_pylist() for k, n in enumerate(names)}))
            cols = list(zip(*got)) if got else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
