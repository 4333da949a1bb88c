"""Tables of contents and page listings (O-113, O-114, O-125, O-153, O-160, O-193, O-195, O-200, O-204)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the order of pages in the root.
ROOT_ORDER = ("index.md", "architecture.md", "dependencies.md", "changelog.md", "inheritance.md", "glossary.md", "coverage.md", "freshness.md")


def numbered(pages: DataFrame, depth: int = 32) -> DataFrame:
    """(key, number, depth) of every page and directory of ``path``: pages of a directory by path first, then its directories, numbered ``p.n`` (O-113, O-114).

    Root pages come in ROOT_ORDER, others behind them by name. One window per level, within its directory.
    """
    p = F.split("path", "/")
    steps = pages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.struct(F.array_join(F.slice(p, 1, k), "/").alias("key"), k.alias("depth"), (k < F.size(p)).alias("is_dir")))).alias("x")).select("x.*").distinct()
    parent = F.regexp_replace("key", r"/?[^/]*$", "")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in ROOT_ORDER]), F.col("key")), F.lit(0)), F.lit(len(ROOT_ORDER) + 1))
    w = Window.partitionBy("parent").orderBy("is_dir", "place", "key")
    n = steps.withColumn("parent", parent).withColumn("place", place).withColumn("n", F.row_number().over(w).cast("string"))
    deepest = min(n.agg(F.max("depth")).first()[0] or 0, depth)
    level = n.where("depth = 1").select("key", F.col("n").alias("number"), "depth", "is_dir")
    out = level
    for k in range(2, deepest + 1):
        up = level.where("is_dir").select(F.col("key").alias("parent"), F.col("number").alias("up"))
        level = n.where(F.col("depth") == k).join(up, "parent").select("key", F.concat_ws(".", "up", "n").alias("number"), "depth", "is_dir")
        out = out.unionByName(level)
    return out


def not_listed(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Pages that no entry lists (O-125)."""
    return pages.join(toc.select(F.col("key").alias("path")), "path", "left_anti")


def sections(pages: DataFrame) -> DataFrame:
    """Pages by first directory, those of the root under '' (O-193, O-195, O-204)."""
    return pages.select(F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("").alias("section"), "path").groupBy("section").agg(F.count("*").alias("pages"), F.min("path").alias("first"))


def tree_text(paths: list[str], depth: int = 3, most: int = 50) -> str:
    """A drawing of a directory tree, directories first, cut by depth and number of items (O-153). For the paths of one listing."""
    nodes: dict = {}
    for p in paths:
        at = nodes
        for x in p.split("/")[:depth]:
            at = at.setdefault(x, {})
    lines: list[str] = []

    def walk(at: dict, lead: str) -> None:
        names = sorted((n for n in at if not n.startswith(".")), key=lambda n: (not at[n], n))
        for k, n in enumerate(names):
            if len(lines) >= most:
                return
            last = k == len(names) - 1
            lines.append(f"{lead}{'└── ' if last else '├── '}{n}{'/' if at[n] else ''}")
            walk(at[n], lead + ("    " if last else "│   "))

    walk(nodes, "")
    return "\n".join(lines)
