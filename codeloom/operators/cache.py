"""The semantic cache of answers (O-85, O-165 to O-169)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import prompt_hash
from codeloom.functions.vectors import squared_distance

MAX_TEMPERATURE, THRESHOLD, FALLBACK = 0.3, 0.95, 5


def valid(created: Column, ttl: Column, now: Column) -> Column:
    """Whether an entry is younger than its time to live (O-168); false where a time is missing."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))
    return F.coalesce(age < ttl, F.lit(False))


def exact(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """The newest valid entry with the hash of each request: request, id (O-85). requests: request, system_prompt, prompt, temperature."""
    r = requests.where(F.coalesce("temperature", F.lit(0.0)) <= MAX_TEMPERATURE).select("request", prompt_hash(F.col("system_prompt"), F.col("prompt")).alias("exact_hash"))
    c = cache.where(valid(F.col("created_at"), F.col("ttl_seconds"), now))
    return r.join(c.select("exact_hash", "id", "created_at"), "exact_hash").groupBy("request").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def similar(cache: DataFrame, vector: list[float], model: str, now: Column, threshold: float = THRESHOLD) -> DataFrame:
    """For one request: of the five nearest entries the nearest that is valid, of the same model and similar enough (O-165). A top list."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    d = cache.withColumn("similarity", 1 - squared_distance(F.col("vector"), q)).where("similarity is not null and not isnan(similarity)")
    near = d.orderBy(F.desc("similarity"), "id").limit(FALLBACK)
    ok = (F.col("similarity") >= threshold) & (F.col("model_name") == model) & valid(F.col("created_at"), F.col("ttl_seconds"), now)
    return near.where(ok).orderBy(F.desc("similarity"), "id").limit(1)


def expired(cache: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Entries past their time, oldest first if only some are asked for (O-167)."""
    e = cache.where(~valid(F.col("created_at"), F.col("ttl_seconds"), now))
    return e if most is None else e.orderBy("created_at", "id").limit(most)


def evicted(cache: DataFrame, now: Column, max_entries: int, most: int = 100) -> DataFrame:
    """The cache after an eviction: nothing goes while it is not over its size, then up to ``most`` expired entries (O-167)."""
    if cache.count() <= max_entries:
        return cache
    return cache.join(expired(cache, now, most).select("id"), "id", "left_anti")


def put(cache: DataFrame, answers: DataFrame, now: Column, ttl: int, max_temperature: float = MAX_TEMPERATURE) -> DataFrame:
    """The cache with new answers, those of a high temperature left out (O-166). answers: id, system_prompt, prompt, response, temperature, model_name, vector."""
    a = answers.where(F.coalesce("temperature", F.lit(0.0)) <= max_temperature)
    own = {"exact_hash": prompt_hash(F.col("system_prompt"), F.col("prompt")), "created_at": now, "hit_count": F.lit(0), "ttl_seconds": F.lit(ttl)}
    types = dict(cache.dtypes)
    return cache.unionByName(a.select(*[(own.get(c, F.col(c) if c in a.columns else F.lit(None))).cast(types[c]).alias(c) for c in cache.columns]))


def usage(cache: DataFrame, now: Column) -> DataFrame:
    """Entries, valid ones and hits by model."""
    return cache.groupBy("model_name").agg(F.count("*").alias("entries"), F.count_if(valid(F.col("created_at"), F.col("ttl_seconds"), now)).alias("valid"), F.sum("hit_count").alias("hits"))


def hits(cache: DataFrame, log: DataFrame) -> DataFrame:
    """Hit counts and times brought up to date from a log of (id, at)."""
    g = log.groupBy("id").agg(F.count("*").alias("more"), F.max("at").alias("last"))
    return cache.join(g, "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("more", F.lit(0)).cast("int")).withColumn("last_hit_at", F.greatest("last_hit_at", "last")).drop("more", "last")


def slices(text: str, size: int = 100) -> list[str]:
    """A cached text as it is streamed (O-169)."""
    return [text[i * size : (i + 1) * size] for i in range(math.ceil(len(text) / size))]


def newest_per_hash(cache: DataFrame) -> DataFrame:
    w = Window.partitionBy("exact_hash").orderBy(F.desc("created_at"), "id")
    return cache.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
