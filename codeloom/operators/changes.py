"""Comparing snapshots, and pages with their sources (O-71, O-72, O-79, O-83, O-84, O-101, O-121 to O-126, O-173, O-191)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(current: DataFrame, previous: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Each file of either snapshot as added, changed, unchanged or removed; rows of one key in a snapshot must be one (O-71, O-126)."""
    now = current.select(key, F.col(value).alias("now"), F.lit(True).alias("in_now"))
    j = now.join(previous.select(key, F.col(value).alias("before"), F.lit(True).alias("in_before")), key, "full_outer")
    status = F.when(F.col("in_before").isNull(), "added").when(F.col("in_now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("changed")
    return j.select(key, status.alias("status"))


def next_snapshot(current: DataFrame, previous: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """The files of the current snapshot, unchanged ones with the row they had (O-71, O-121)."""
    same = current.select(key, F.col(value).alias("_h")).join(previous.where(F.col(value).isNotNull()), key).where(F.col("_h") == F.col(value)).select(previous.columns)
    return same.unionByName(current.join(same.select(key), key, "left_anti").select(previous.columns))


def pages_to_renew(before: DataFrame, now: DataFrame) -> DataFrame:
    """Of ``now``, the pages whose sources are others than before, or have other, missing or no hashes: page, renew. Rows: page, source, hash (O-72, O-124)."""
    j = now.alias("n").join(before.alias("b"), (F.col("n.page") == F.col("b.page")) & (F.col("n.source") == F.col("b.source")), "full_outer")
    changed = F.col("n.hash").isNull() | F.col("b.hash").isNull() | (F.col("n.hash") != F.col("b.hash"))
    per = j.groupBy(F.coalesce("n.page", "b.page").alias("page")).agg(F.bool_or(F.coalesce(changed, F.lit(True))).alias("renew"))
    return per.join(now.select("page").distinct(), "page", "left_semi")


def staleness(pages: DataFrame, sources: DataFrame, modified: DataFrame | None = None, days: int = 0) -> DataFrame:
    """Per page the newest of its dated sources, whole days it is newer than the page, and whether that is stale (O-79).

    pages: page, generated_at; sources: page, source; modified: source, at, or None if sources have ``at`` themselves.
    Pages without a dated source are not stale.
    """
    dated = sources if modified is None else sources.join(modified, "source")
    newest = dated.groupBy("page").agg(F.max("at").alias("newest"), F.count("at").alias("dated"))
    gap = F.floor((F.unix_timestamp(F.col("newest").cast("timestamp")) - F.unix_timestamp(F.col("generated_at").cast("timestamp"))) / 86400)
    j = pages.join(newest, "page", "left")
    stale = (F.col("newest") > F.col("generated_at")) & (gap >= days)
    return j.select("page", "generated_at", "newest", F.coalesce("dated", F.lit(0)).alias("dated"), F.when(F.col("newest") > F.col("generated_at"), gap).alias("days_stale"), F.coalesce(stale, F.lit(False)).alias("stale"))


def freshness(stale: DataFrame) -> DataFrame:
    """Pages, stale ones, fresh ones, and the share of these in percent (O-101)."""
    s = stale.agg(F.count("*").alias("pages"), F.count_if("stale").alias("stale"))
    return s.select("pages", "stale", (F.col("pages") - F.col("stale")).alias("fresh"), F.when(F.col("pages") == 0, F.lit(100.0)).otherwise(F.round((F.col("pages") - F.col("stale")) * 100.0 / F.col("pages"), 4)).alias("freshness"))


def banner(days: int) -> str:
    """What stands on top of a page that is some days behind its sources (O-191)."""
    return f"> **Note:** sources of this page changed {days} day{'s' * (days != 1)} after it was generated.\n\n" if days >= 1 else ""


def sources_of_pages(pages: DataFrame, lineage: DataFrame, file_pages: DataFrame, most: int = 10) -> DataFrame:
    """Per page its first sources in order, each with the page it has, if any, and how many there are (O-83, O-84, O-158).

    pages: page; lineage: page, source; file_pages: source, target. At most ``most`` sources of a page are gathered.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("page")
    s = lineage.join(pages.select("page").distinct(), "page", "left_semi").distinct().join(file_pages.select("source", "target"), "source", "left")
    s = s.withColumn("at", F.row_number().over(w.orderBy("source"))).withColumn("all", F.count("*").over(w)).where(F.col("at") <= most)
    link = F.struct("at", "source", F.when(F.col("target") != F.col("page"), F.col("target")).alias("target"))
    return s.groupBy("page").agg(F.max("all").alias("all"), F.array_sort(F.collect_list(link)).alias("x")).select("page", "all", F.transform("x", lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"))).alias("sources"))
