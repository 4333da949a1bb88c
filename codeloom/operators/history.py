"""Commits and blame (O-8 to O-11, O-77, O-78, O-98, O-118)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text


def commits_by_day(commits: DataFrame, shown: int = 5) -> DataFrame:
    """Commits, authors and the first files of each day (O-98): day, commits, authors, files. ``commits``: id, author, ts, file (null if none)."""
    day = F.to_date("ts").alias("day")
    w = Window.partitionBy("day")
    files = commits.where("file is not null").select(day, "file").distinct()
    files = files.withColumn("at", F.row_number().over(w.orderBy("file"))).withColumn("changed", F.count("*").over(w)).where(F.col("at") <= shown)
    files = files.groupBy("day").agg(F.max("changed").alias("changed"), F.array_sort(F.collect_list("file")).alias("files"))
    per = commits.groupBy(day, "id").agg(F.first("author", ignorenulls=True).alias("author"))
    all_ = per.groupBy("day").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))
    return all_.join(files, "day", "left").select("day", "commits", "authors", F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def contributors(commits: DataFrame) -> DataFrame:
    """Commits, first and last by author (O-98)."""
    return commits.groupBy("author").agg(F.countDistinct("id").alias("commits"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def last_changes(commits: DataFrame) -> DataFrame:
    """Time of the last commit of each file (O-11)."""
    return commits.where("file is not null").groupBy("file").agg(F.max("ts").alias("at"))


def blame_of_ranges(ranges: DataFrame, lines: DataFrame, block: int = 512) -> DataFrame:
    """The newest line of each range: range, line, author, ts (O-77, O-78).

    ranges: range, file, start_line, end_line; lines: file, line, author, ts. Both are keyed by file and block of lines, so
    that a range meets only the lines of its blocks, and a huge file spreads over tasks. Ranges without lines are left out.
    """
    r = ranges.where("end_line >= start_line").withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))))
    l = lines.withColumn("block", F.floor(F.col("line") / block))
    j = r.join(l, ["file", "block"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.max_by(F.struct("line", "author", "ts"), F.struct("ts", -F.col("line")))
    return j.where("ts is not null").groupBy("range").agg(best.alias("x")).select("range", "x.line", "x.author", "x.ts")


def blame_view(blame: DataFrame) -> DataFrame:
    """Author and summary cut for a table, newest first by ``ts`` (O-118)."""
    return blame.withColumn("author", text.shortened(F.col("author"), 20, 17)).withColumn("summary", text.shortened(F.col("summary"), 30, 27))


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each event with the state of its key at its time, null before the first: a merge of both by time, in one sort per key."""
    e = events.withColumn("_t", F.col(at)).withColumn("_s", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(states.dtypes)[value]))
    s = states.select(key, F.col(since).alias("_t"), F.lit(0).alias("_s"), F.col(value).alias("_v"))
    both = e.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_s = 1").drop("_t", "_s", "_v")
