"""Aggregates over chunks and files: coverage, glossary, directories, dependencies (O-64 to O-67, O-88 to O-97, O-102)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths, text

KINDS = ("class", "function", "method")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 100 of nothing."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(part * 100.0 / whole)


def coverage(chunks: DataFrame, *keys: str) -> DataFrame:
    """Documented and all classes, functions and methods per file, subtotals and all by rollup over ``keys`` (O-90, O-91)."""
    c = chunks.where(F.col("chunk_type").isin(*KINDS)).withColumn("ok", text.meaningful_docstring(F.col("docstring")))
    per = [x for k in KINDS for x in (F.count_if(F.col("chunk_type") == k).alias(f"{k}_total"), F.count_if((F.col("chunk_type") == k) & F.col("ok")).alias(f"{k}_documented"))]
    g = c.rollup(*keys).agg(*per, F.count("*").alias("total"), F.count_if("ok").alias("documented"))
    return g.withColumn("percent", F.round(percent(F.col("documented"), F.col("total")), 4))


def undocumented(chunks: DataFrame, *keys: str) -> DataFrame:
    """Per file what lacks documentation, in order: ``class X``, ``function f``, ``method P.m`` (O-90). At most a file's definitions are gathered."""
    label = F.when(F.col("chunk_type") == "method", F.concat(F.lit("method "), F.coalesce(F.concat("parent_name", F.lit(".")), F.lit("")), F.coalesce("name", F.lit("Unknown")))).otherwise(F.concat("chunk_type", F.lit(" "), F.coalesce("name", F.lit("Unknown"))))
    c = chunks.where(F.col("chunk_type").isin(*KINDS) & ~text.meaningful_docstring(F.col("docstring")))
    g = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("line"), label.alias("label"), "id"))).alias("x"))
    return g.select(*keys, F.transform("x", lambda s: s["label"]).alias("labels"))


def coverage_mark(pct: Column) -> Column:
    """Bucket of a percentage (O-92)."""
    return F.when(pct >= 90, "good").when(pct >= 70, "fair").when(pct >= 50, "low").otherwise("poor")


def attention(files: DataFrame, most: int = 10) -> DataFrame:
    """The files with the least coverage under 50 percent (O-92): a top list."""
    return files.where((F.col("percent") < 50) & (F.col("total") > 0)).orderBy("percent", *[c for c in ("repo", "file_path") if c in files.columns]).limit(most)


def letter(name: Column) -> Column:
    first = F.upper(F.substring(name, 1, 1))
    return F.when(first.rlike(r"^\p{L}$"), first).otherwise("#")


def entities(chunks: DataFrame) -> DataFrame:
    """Classes, functions and methods with their letter (O-94)."""
    name = F.coalesce("name", F.lit("Unknown"))
    return chunks.where(F.col("chunk_type").isin(*KINDS)).select("id", name.alias("name"), F.col("chunk_type").alias("type"), "file_path", "parent_name", "docstring", letter(name).alias("letter"))


def glossary(chunks: DataFrame) -> DataFrame:
    """Entities by letter and type (O-93, O-196): counts only; the entries of a letter are ``entities`` ordered by lower(name)."""
    return entities(chunks).groupBy("letter", "type").agg(F.count("*").alias("entries"), F.countDistinct(F.lower("name")).alias("names"))


def registered(chunks: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Entities that pages may link: no excluded word, no ``_`` in front, four letters or more, classes and functions only (O-67, O-199)."""
    ok = ~F.lower("name").isin([w.lower() for w in excluded] or [""]) & ~F.col("name").startswith("_") & (F.length("name") >= 4)
    return chunks.where(F.col("chunk_type").isin("class", "function") & ok).select("name", F.col("chunk_type").alias("type"), "file_path", text.camel_spaced(F.col("name")).alias("alias"))


def by_alias(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """The entity that each spelled-out name stands for: alias, name, type, file_path; of several the smallest by file and name (O-198). mentions: alias."""
    one = registry.where("alias is not null").groupBy("alias").agg(F.min(F.struct("file_path", "name", "type")).alias("x"))
    return mentions.select("alias").distinct().join(one, "alias").select("alias", "x.name", "x.type", "x.file_path")


def language_counts(files: DataFrame) -> DataFrame:
    """Files by known language, most first (O-88, O-97)."""
    return files.where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """Files by top directory and the one below (``_root`` for files right in it), ``src``, ``lib`` and ``pkg`` skipped, with subtotals (O-95, O-96)."""
    parts = F.split(path, "/")
    parts = F.when(F.get(parts, F.lit(0)).isin("src", "lib", "pkg"), F.slice(parts, 2, 1_000_000)).otherwise(parts)
    d = files.select(parts.alias("p")).where(F.size("p") >= 2)
    d = d.select(F.get("p", F.lit(0)).alias("top"), F.when(F.size("p") > 2, F.get("p", F.lit(1))).otherwise("_root").alias("sub"))
    return d.rollup("top", "sub").agg(F.count("*").alias("files"))


def modules(files: DataFrame, path: str = "path", least: int = 2) -> DataFrame:
    """Top directories with at least ``least`` files (O-95)."""
    return files.groupBy(paths.top_directory(F.col(path)).alias("module")).agg(F.count("*").alias("files")).where(F.col("files") >= least)


def significant(files: DataFrame, most: int | None = None, path: str = "path") -> DataFrame:
    """Files worth a page: no ``__init__.py``, not under ``tests``, two chunks or more; of more than ``most``, those with most chunks (O-65)."""
    f = files.where((paths.base_name(F.col(path)) != "__init__.py") & ~F.array_contains(F.split(path, "/"), "tests") & (F.col("chunk_count") >= 2))
    return f if most is None else f.orderBy(F.desc("chunk_count"), path).limit(most)


def is_test_module(module: Column, path: Column) -> Column:
    return module.startswith("test_") | module.contains(".test_") | path.contains("/tests/") | path.startswith("tests/")


# Words in package names by which dependencies are told apart, in this order.
CATEGORIES = {
    "Web Framework": ("flask", "fastapi", "django", "starlette", "aiohttp", "tornado", "express", "koa", "hapi"),
    "Database": ("sqlalchemy", "pymongo", "redis", "lancedb", "chromadb", "psycopg2", "mysql", "sqlite", "prisma", "typeorm", "sequelize"),
    "Testing": ("pytest", "unittest", "nose", "jest", "mocha", "vitest"),
    "CLI": ("click", "typer", "argparse", "commander", "yargs"),
    "AI/ML": ("openai", "anthropic", "langchain", "transformers", "torch", "tensorflow", "sentence-transformers", "ollama"),
}


def dependency_category(name: Column) -> Column:
    """First category of which a word is in the name without ``-`` and ``_`` (O-102)."""
    bare = F.lower(F.regexp_replace(name, "[-_]", ""))
    out = F.lit("Other")
    for cat, ws in reversed(CATEGORIES.items()):
        out = F.when(bare.rlike("|".join(ws)), cat).otherwise(out)
    return out


def latest(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The newest row of each key, by a column, ties by all other columns."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rows.columns if c not in keys and c != by])
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
