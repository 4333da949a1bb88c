"""Retrieval for several questions, deduplication and ranking (O-102, O-103, O-107 to O-112, O-115, O-141, O-186)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators.search import retrieve  # noqa: F401  one of these operators

def follow_up_k(k: int) -> int:
    return max(3, k - 2)


def best_of(hits: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Each key once with its best score and where that was found, best first, the first found of equals; ``most`` at most (O-109, O-122). hits: key, score, query, rank."""
    g = hits.groupBy(key).agg(F.max("score").alias("score"), F.max_by(F.struct("query", "rank"), F.struct("score", -F.col("query"), -F.col("rank"))).alias("at"))
    g = g.select(key, "score", F.col("at.query").alias("query"), F.col("at.rank").alias("rank"))
    return g if most is None else g.orderBy(F.desc("score"), "query", "rank", key).limit(most)


def first_per(hits: DataFrame, by: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """The first hit of each file, or file and name, ``most`` at most (O-110, O-111)."""
    w = Window.partitionBy(*by).orderBy(*order)
    f = hits.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
    return f if most is None else f.orderBy(*order).limit(most)


def first_n(rows: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, numbered ``at``: context summaries, the tail of a chat (O-103, O-115)."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= n)


def subsequence(query: str, c: Column) -> Column:
    """Whether the letters of a query come in order in a text."""
    return c.rlike("(?is)" + ".*".join(f"\\Q{ch}\\E" for ch in query))


def search_score(query: str, title: Column, headings: Column, terms: Column, snippet: Column) -> Column:
    """Points of a page for a query, in lower case (O-112): title 100, 150 if it starts with it, else 30 if its letters come in order; first heading 40; the first term that counts 60, or 20 for its letters in order; snippet 10."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    by_title = F.when(has(title), F.when(F.startswith(F.lower(title), F.lit(q)), 150).otherwise(100)).when(subsequence(q, title), 30).otherwise(0)
    point = F.transform(terms, lambda t: F.when(has(t), 60).when(subsequence(q, t), 20).otherwise(0))
    by_term = F.coalesce(F.get(F.filter(point, lambda p: p > 0), F.lit(0)), F.lit(0))
    return F.coalesce(by_title, F.lit(0)) + F.when(F.exists(headings, has), 40).otherwise(0) + by_term + F.when(has(snippet), 10).otherwise(0)


def search_pages(index: DataFrame, query: str, most: int = 8) -> DataFrame:
    """The best pages for a query of two letters or more, ties by path (O-112): a top list."""
    if len(query) < 2:
        return index.limit(0).withColumn("score", F.lit(0))
    s = search_score(query, F.col("title"), F.col("headings"), F.col("terms"), F.col("snippet"))
    return index.withColumn("score", s).where("score > 0").orderBy(F.desc("score"), "path").limit(most)


def page_index(pages: DataFrame) -> DataFrame:
    """Search entries of pages (path, content): path, title, headings, terms, snippet (O-137 to O-139, O-186)."""
    c = F.col("content")
    return pages.select("path", text.title(c, F.col("path")).alias("title"), text.headings(c).alias("headings"), text.code_terms(c).alias("terms"), text.snippet(c).alias("snippet"))


def entity_index(chunks: DataFrame) -> DataFrame:
    """Search entries of classes, functions and methods (O-141)."""
    c = chunks.where(F.col("chunk_type").isin("class", "function", "method") & F.col("name").isNotNull())
    shown = F.when((F.col("chunk_type") == "method") & F.col("parent_name").isNotNull(), F.concat("parent_name", F.lit("."), "name")).otherwise(F.col("name"))
    return c.select("id", F.col("chunk_type").alias("type"), "name", shown.alias("display_name"), "file_path", text.brief(F.col("docstring"), 80).alias("description"), text.keywords(F.col("name")).alias("keywords"))
