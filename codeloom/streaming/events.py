"""Streams of file events: debounce, refresh, rates, windows (O-104, O-175 to O-181)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "path string, kind string, target string, at timestamp"


def source(spark: SparkSession, directory: str, schema: str = EVENT, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A log of events as a stream of its files (O-175)."""
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).load(directory)


def marked(events: DataFrame, at: str, late: str | None) -> DataFrame:
    """With a watermark if it is a stream and ``late`` is given; a stream that already has one keeps it."""
    return events.withWatermark(at, late) if events.isStreaming and late else events


def touched(events: DataFrame) -> DataFrame:
    """(path, at) of events; a move touches both of its ends (O-175)."""
    both = F.filter(F.array("path", F.when(F.col("kind") == "moved", F.col("target"))), lambda p: p.isNotNull() & ~p.endswith("/"))
    return events.select(F.explode(both).alias("path"), "at")


def debounced(paths: DataFrame, quiet: str = "2 seconds", late: str | None = "10 seconds", *keys: str) -> DataFrame:
    """Bursts of paths, each ended by a time without events (O-176): start, end, paths, events. ``keys``: what is watched apart, as a repository, which also spreads the state.

    On a stream a burst comes out when the watermark passes its end; the paths of one burst are what its state holds.
    """
    p = marked(paths, "at", late)
    by = keys or [F.substring("path", 1, 0).alias("_all")]  # a stream wants a key
    g = p.groupBy(*by, F.session_window("at", quiet).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("events"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "events")


def refreshing(bursts: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs a refresh for each batch of bursts; batches run one by one, so a refresh never meets itself (O-177, O-178)."""
    w = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(refresh)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start()


def tumbling(events: DataFrame, at: str, size: str, late: str | None = "1 hour", *keys: str) -> DataFrame:
    e = marked(events, at, late)
    return e.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def sliding(events: DataFrame, at: str, size: str, step: str, late: str | None = "1 hour", *keys: str) -> DataFrame:
    e = marked(events, at, late)
    return e.groupBy(F.window(at, size, step).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Repeated deliveries of an event dropped, within the watermark on a stream."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def rolling_rate(items: DataFrame, keys: list[str], at: str, tie: str, size: int = 20) -> DataFrame:
    """Mean gap of the last ``size`` items and items per minute, at each item (O-104)."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    s = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    g = items.withColumn("gap", s - F.lag(s).over(w))
    mean = F.avg("gap").over(w.rowsBetween(-(size - 1), 0))
    return g.withColumn("mean_gap", mean).withColumn("per_minute", F.when(F.col("mean_gap") > 0, 60 / F.col("mean_gap")))


def phase_rate(done: Column, seconds: Column) -> Column:
    """Items per minute of a phase (O-104)."""
    return F.when(seconds > 0, done / seconds * 60)


def counted(events: DataFrame, key: str, at: str, idle_ms: int = 60_000) -> DataFrame:
    """Events of each key so far and the mean gap between them, by state that ends when a key is idle: key, events, mean_gap."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, first, last = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "events": [n], "mean_gap": [(last - first) / (n - 1) if n > 1 else None]})
            return
        n, first, last = state.get if state.exists else (0, float("inf"), float("-inf"))
        for b in batches:
            t = b["t"]
            n, first, last = n + len(b), min(first, float(t.min())), max(last, float(t.max()))
        state.update((n, first, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": [k[0]], "events": [n], "mean_gap": [(last - first) / (n - 1) if n > 1 else None]})

    e = events.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(at)) / 1e6).alias("t"))
    return e.groupBy("key").applyInPandasWithState(step, "key string, events long, mean_gap double", "n long, first double, last double", "update", "ProcessingTimeTimeout")
