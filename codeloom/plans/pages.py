"""Pages as tables of path and content: API reference, file pages, glossary, coverage, changelog, inheritance, files index (O-53, O-92, O-98, O-158, O-164, O-192 to O-197, O-202).

Every page is an aggregate of the rows it shows, ordered within; a page's rows are those of one file, letter, day or
directory. Lists that could be long are cut where the reader is told so.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codeloom.functions import paths, text
from codeloom.operators import changes, graphs, history, reports
from codeloom.session import ship
from codeloom.sinks.output import sequence

KEPT_DUNDERS = ("__init__", "__call__", "__enter__", "__exit__")


def joined(rows: DataFrame, by: list[str], order: list[str], line: Column, head: Column | None = None, sep: str = "\n") -> DataFrame:
    """One text per group from lines in order: by, text."""
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["_line"]), sep)
    return g.select(*by, (body if head is None else F.concat(head, body)).alias("text"))


def page_of(path: Column) -> Column:
    """``a/b.py`` -> ``files/a/b.md`` (O-83)."""
    return F.concat(F.lit("files/"), F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".md"))


def public(name: Column) -> Column:
    """Whether an API page shows a name (O-164)."""
    return ~name.startswith("_") | name.isin(*KEPT_DUNDERS)


def api_reference(chunks: DataFrame) -> DataFrame:
    """(file_path, text): signatures, first lines and parameters of a file's classes and functions. Chunks with ``metadata`` of extraction (O-53, O-164)."""
    m = F.col("metadata")
    c = chunks.where(F.col("chunk_type").isin("class", "function", "method") & F.col("name").isNotNull() & public(F.col("name")))
    sign = F.when(F.col("chunk_type") == "class", F.coalesce(F.concat(F.lit("("), F.array_join(F.nullif(m["parent_classes"], F.array().cast("array<string>")), ", "), F.lit(")")), F.lit(""))).otherwise(text.signature(F.coalesce(m["parameter_types"], F.array().cast("array<struct<name:string,type:string>>")), m["return_type"], 100))
    shown = F.concat(F.when(F.coalesce(m["is_async"], F.lit(False)), "async ").otherwise(""), F.coalesce(F.concat("parent_name", F.lit(".")), F.lit("")), "name")
    rows = F.transform(F.coalesce(m["parameter_types"], F.array().cast("array<struct<name:string,type:string>>")), lambda p: F.concat(F.lit("| "), p["name"], F.lit(" | "), F.coalesce(p["type"], F.lit("")), F.lit(" | "), F.coalesce(F.element_at(m["parameter_defaults"], p["name"]), F.lit("")), F.lit(" |")))
    table = F.when(F.size(rows) > 0, F.concat(F.lit("\n\n| parameter | type | default |\n|-|-|-|\n"), F.array_join(rows, "\n"))).otherwise("")
    raises = F.when(F.size(m["raises"]) > 0, F.concat(F.lit("\n\nRaises: "), F.array_join(m["raises"], ", "))).otherwise("")
    line = F.concat(F.lit("### `"), shown, sign, F.lit("`\n\n"), F.coalesce(text.first_line(F.col("docstring")), F.lit("")), table, raises)
    return joined(c, ["file_path"], ["start_line", "id"], line, sep="\n\n")


def file_pages(chunks: DataFrame, callers: DataFrame | None = None, most_callers: int = 10) -> DataFrame:
    """A page per file: overview, API reference, who uses it (O-202). callers: file_path, caller_file."""
    api = api_reference(chunks).withColumnRenamed("text", "api")
    head = chunks.groupBy("file_path").agg(F.max(F.when(F.col("chunk_type") == "module", F.col("docstring"))).alias("doc"), F.count_if(F.col("chunk_type").isin("class", "function", "method")).alias("n"))
    out = head.join(api, "file_path", "left")
    used = F.lit("")
    if callers is not None:
        w = Window.partitionBy("file_path").orderBy("caller_file")
        u = callers.select("file_path", "caller_file").distinct().withColumn("at", F.row_number().over(w)).where(F.col("at") <= most_callers)
        u = joined(u, ["file_path"], ["caller_file"], F.concat(F.lit("- `"), "caller_file", F.lit("`")), F.lit("\n\n## Used by\n\n")).withColumnRenamed("text", "used")
        out, used = out.join(u, "file_path", "left"), F.coalesce("used", F.lit(""))
    content = F.concat(F.lit("# "), paths.base_name(F.col("file_path")), F.lit("\n\n"), F.coalesce(text.first_line(F.col("doc")), F.concat(F.col("n").cast("string"), F.lit(" definitions"))), F.coalesce(F.concat(F.lit("\n\n## API\n\n"), "api"), F.lit("")), used, F.lit("\n"))
    return out.select(page_of(F.col("file_path")).alias("path"), content.alias("content"))


def glossary_pages(chunks: DataFrame) -> DataFrame:
    """A page per letter, entries by lower-cased name with their kind and first line (O-93, O-196)."""
    e = reports.entities(chunks).withColumn("key", F.lower("name"))
    line = F.concat(F.lit("- **"), "name", F.lit("** ("), "type", F.lit(", `"), "file_path", F.lit("`)"), F.coalesce(F.concat(F.lit(": "), F.nullif(text.brief(F.col("docstring")), F.lit(""))), F.lit("")))
    g = joined(e, ["letter"], ["key", "file_path", "id"], line, F.concat(F.lit("# Glossary: "), "letter", F.lit("\n\n")))
    return g.select(F.concat(F.lit("glossary/"), F.when(F.col("letter") == "#", "other").otherwise(F.col("letter")), F.lit(".md")).alias("path"), F.concat("text", F.lit("\n")).alias("content"))


def coverage_page(chunks: DataFrame, shown: int = 20) -> DataFrame:
    """One page: totals, and the files that need attention most (O-92)."""
    cov = reports.coverage(chunks, "file_path")
    total = cov.where("file_path is null").select(F.concat(F.lit("# Documentation coverage\n\n"), F.col("documented").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" documented ("), F.round("percent", 1).cast("string"), F.lit("%)\n")).alias("head"))
    bad = reports.attention(cov.where("file_path is not null"), shown).withColumn("one", F.lit(1))
    rows = joined(bad, ["one"], ["percent", "file_path"], F.concat(F.lit("| `"), "file_path", F.lit("` | "), F.round("percent", 1).cast("string"), F.lit("% | "), reports.coverage_mark(F.col("percent")), F.lit(" |")), F.lit("\n| file | coverage | |\n|-|-|-|\n"))
    j = total.withColumn("one", F.lit(1)).join(rows, "one", "left")
    return j.select(F.lit("coverage.md").alias("path"), F.concat("head", F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))


def changelog_pages(commits: DataFrame) -> DataFrame:
    """A page per month with a line per day (O-98). commits: id, author, ts, file."""
    d = history.commits_by_day(commits).withColumn("month", F.date_format("day", "yyyy-MM"))
    more = F.when(F.col("changed") > F.size("files"), F.concat(F.lit(" (+"), (F.col("changed") - F.size("files")).cast("string"), F.lit(" more)"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("day").cast("string"), F.lit(": "), F.col("commits").cast("string"), F.lit(" commits by "), F.col("authors").cast("string"), F.lit(" authors: "), F.array_join("files", ", "), more)
    g = joined(d.withColumn("back", -F.unix_date("day")), ["month"], ["back"], line, F.concat(F.lit("# Changes of "), "month", F.lit("\n\n")))
    return g.select(F.concat(F.lit("changelog/"), "month", F.lit(".md")).alias("path"), F.concat("text", F.lit("\n")).alias("content"))


def files_index(files: DataFrame, path: str = "path") -> DataFrame:
    """A page per top directory that lists its files (O-193)."""
    f = files.select(F.col(path).alias("file")).distinct().withColumn("section", paths.top_directory(F.col("file")))
    g = joined(f, ["section"], ["file"], F.concat(F.lit("- ["), "file", F.lit("](../"), page_of(F.col("file")), F.lit(")")), F.concat(F.lit("# "), "section", F.lit("\n\n")))
    return g.select(F.concat(F.lit("modules/"), "section", F.lit(".md")).alias("path"), F.concat("text", F.lit("\n")).alias("content"))


def dependency_page(dependencies: DataFrame, most: int = 30, most_dev: int = 20) -> DataFrame:
    """Per repository its dependencies by category (O-102, O-194). dependencies: repo, name, version, is_dev."""
    d = dependencies.select("repo", "name", "version", "is_dev", reports.dependency_category(F.col("name")).alias("category")).distinct()
    w = Window.partitionBy("repo", "is_dev").orderBy("name", "version")
    d = d.withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.when(F.col("is_dev"), most_dev).otherwise(most))
    line = F.concat(F.lit("- "), "name", F.lit(" "), "version", F.lit(" ("), "category", F.when(F.col("is_dev"), F.lit(", development)")).otherwise(F.lit(")")))
    g = joined(d, ["repo"], ["is_dev", "category", "name"], line, F.lit("# Dependencies\n\n"))
    return g.select(F.concat("repo", F.lit("/dependencies.md")).alias("path"), F.concat("text", F.lit("\n")).alias("content"))


def inheritance_pages(classes: DataFrame) -> DataFrame:
    """A page per root class with all that inherit from it, as they come in a walk of the tree (O-132, O-197). classes: name, file_path, parents."""
    t = graphs.tree(classes).withColumn("root", F.get("path", F.lit(0)))
    g = joined(t, ["root"], ["path"], F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- `"), "name", F.lit("`")), F.concat(F.lit("# Inheritance: "), "root", F.lit("\n\n")))
    return g.select(F.concat(F.lit("inheritance/"), "root", F.lit(".md")).alias("path"), F.concat("text", F.lit("\n")).alias("content"))


def stale_page(stale: DataFrame, most: int = 20) -> DataFrame:
    """One page: how many pages are behind their sources, and those that are most (O-101, O-191). stale: page, days_stale, stale."""
    total = changes.freshness(stale).select(F.concat(F.lit("# Freshness\n\n"), F.col("stale").cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(" pages are behind their sources.\n")).alias("head"))
    worst = stale.where("stale").orderBy(F.desc("days_stale"), "page").limit(most).withColumn("back", -F.col("days_stale")).withColumn("one", F.lit(1))
    rows = joined(worst, ["one"], ["back", "page"], F.concat(F.lit("| "), F.col("page").cast("string"), F.lit(" | "), F.col("days_stale").cast("string"), F.lit(" |")), F.lit("\n| page | days |\n|-|-|\n"))
    j = total.withColumn("one", F.lit(1)).join(rows, "one", "left")
    return j.select(F.lit("freshness.md").alias("path"), F.concat("head", F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))


def diagram_pages(edges: DataFrame, kind: str = "flowchart TD") -> DataFrame:
    """A mermaid diagram per page of its edges, those on cycles dotted (O-190). edges: page, a, b, cyclic."""
    arrow = F.when(F.col("cyclic"), " -.-> ").otherwise(" --> ")
    line = F.concat(F.lit("    "), text.mermaid_name(F.col("a")), arrow, text.mermaid_name(F.col("b")))
    g = joined(edges.select("page", "a", "b", F.coalesce("cyclic", F.lit(False)).alias("cyclic")).distinct(), ["page"], ["a", "b"], line, F.lit(f"```mermaid\n{kind}\n"))
    return g.select(F.col("page").alias("path"), F.concat("text", F.lit("\n```\n")).alias("content"))


def language_pie(files: DataFrame, title: str = "Files by language") -> DataFrame:
    """One page: a pie of the files by language (O-97, O-190)."""
    n = reports.language_counts(files).withColumn("back", -F.col("files")).withColumn("one", F.lit(1))
    g = joined(n, ["one"], ["back", "language"], F.concat(F.lit('    "'), "language", F.lit('" : '), F.col("files").cast("string")), F.lit(f"```mermaid\npie title {title}\n"))
    return g.select(F.lit("languages.md").alias("path"), F.concat("text", F.lit("\n```\n")).alias("content"))


def call_sequences(calls: DataFrame, depth: int = 5) -> DataFrame:
    """A sequence diagram per file, from its function with most callees (O-116, O-130). calls: file_path, caller, callee, pos; those of one file are walked in one task."""
    kind = StructType([StructField("path", StringType()), StructField("content", StringType())])

    def one(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("pos", "caller", "callee"))))
        edges: dict[str, list[str]] = {}
        for _, a, b in rows:
            edges.setdefault(a, []).append(b)
        start = min(edges, key=lambda a: (-len(set(edges[a])), a))
        return pa.table({"path": [t.column("file_path")[0].as_py()], "content": [sequence(edges, start, depth)]})

    ship(calls.sparkSession)
    return calls.select("file_path", "caller", "callee", "pos").groupBy("file_path").applyInArrow(one, kind)


def assembled(pages: Sequence[DataFrame]) -> DataFrame:
    """All pages in one table; the first of a path wins (O-192)."""
    out = None
    for k, p in enumerate(pages):
        p = p.select("path", "content", F.lit(k).alias("rank"))
        out = p if out is None else out.unionByName(p)
    w = Window.partitionBy("path").orderBy("rank")
    return out.withColumn("at", F.row_number().over(w)).where("at = 1").drop("at", "rank")
