"""Import lines, modules and the files they name (O-73 to O-75, O-81, O-99, O-120, O-123, O-133 to O-135, O-162)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PY = r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))"
_JS = r"""^\s*(?:import\b.*?\bfrom\s+|import\s+|(?:const|let|var)\b.*?\brequire\()["']([^"']+)["']"""
_OTHER = r"""^\s*(?:import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;|import\s+(?:\w+\s+)?"([^"]+)"|use\s+([\w:]+)|\#include\s+[<"]([^>"]+)|require(?:_relative)?\s+["']([^"']+))"""


def raw_module(line: Column) -> Column:
    """The module that an import line names first, in any of the languages, or null (O-135)."""
    some = lambda p, k: F.nullif(F.regexp_extract(line, p, k), F.lit(""))
    return F.coalesce(some(_JS, 1), some(_OTHER, 1), some(_OTHER, 2), some(_PY, 1), some(_PY, 2), *[some(_OTHER, k) for k in (3, 4, 5)])


def package(module: Column) -> Column:
    """Top package of a module; null for relative and private ones (O-135)."""
    top = F.regexp_extract(module, r"^@?[A-Za-z_][\w\-]*(?:/[\w\-]+)?", 0)
    top = F.when(top.startswith("@"), top).otherwise(F.regexp_extract(top, r"^[A-Za-z_][\w\-]*", 0))
    return F.when((top != "") & ~top.startswith("_") & ~module.startswith("."), top)


def of_chunks(chunks: DataFrame, *keys: str) -> DataFrame:
    """Modules of the import chunks: keys, line (within the chunk), module (O-162)."""
    lines = chunks.where(F.col("chunk_type") == "import").select(*keys, F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    return lines.where((F.trim("text") != "") & ~F.trim("text").rlike(r"^(#(?!include)|//|\*)")).select(*keys, (F.col("line") + 1).alias("line"), raw_module(F.col("text")).alias("module")).where("module is not null")


def external_counts(imports: DataFrame, most: int | None = None) -> DataFrame:
    """Import lines by top package, most first (O-99)."""
    g = imports.select(package(F.col("module")).alias("package")).where("package is not null").groupBy("package").agg(F.count("*").alias("imports"))
    return g if most is None else g.orderBy(F.desc("imports"), "package").limit(most)


def dotted(path: Column) -> Column:
    """``src/a/b.py`` -> ``a.b`` (O-134)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.\w+$", ""), "/", ".")


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """For each module the file it names: its dotted path equals the module or ends in it after a dot; the smallest of several (O-73, O-74).

    imports: module; files: path. Joined on the last part of the name, so only files of that stem are compared.
    """
    m = imports.select("module").distinct().withColumn("last", F.substring_index("module", ".", -1))
    f = files.select("path", dotted(F.col("path")).alias("dotted")).withColumn("last", F.substring_index("dotted", ".", -1))
    ok = (F.col("dotted") == F.col("module")) | F.endswith("dotted", F.concat(F.lit("."), F.col("module")))
    return m.join(f, "last").where(ok).groupBy("module").agg(F.min("path").alias("path"))


def shared(imports: DataFrame, item: str, module: str, least: int = 2) -> DataFrame:
    """(a, b, shared): pairs of items with at least ``least`` modules in common (O-75, O-123).

    Items with fewer modules and modules of one item only are left out first. What is paired is what shares a module, so
    callers put the repository into the module's key, as relations hold within one; skewed modules are split by AQE.
    """
    x = imports.select(F.col(item).alias("item"), F.col(module).alias("module")).where("item is not null and module is not null").distinct()
    n = x.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = x.groupBy("module").agg(F.count("*").alias("n")).where("n > 1")
    x = x.join(n.select("item"), "item", "left_semi").join(common.select("module"), "module", "left_semi")
    pairs = x.alias("a").join(x.alias("b"), (F.col("a.module") == F.col("b.module")) & (F.col("a.item") < F.col("b.item")))
    return pairs.groupBy(F.col("a.item").alias("a"), F.col("b.item").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def relations(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, other, kind): imports and imported_by, others than itself (O-75). imports: file_path, module; resolved: module, path."""
    j = imports.select("file_path", "module").distinct().join(resolved, "module").where(F.col("file_path") != F.col("path")).select(F.col("file_path").alias("path"), F.col("path").alias("other")).distinct()
    return j.withColumn("kind", F.lit("imports")).unionByName(j.select(F.col("other").alias("path"), F.col("path").alias("other"), F.lit("imported_by").alias("kind")))


def see_also(relation: DataFrame, shared_: DataFrame, most: int = 5, most_shared: int = 3) -> DataFrame:
    """Per file up to ``most`` others: those that use it, those it depends on, then those it shares most with; each once (O-120)."""
    both = shared_.select(F.col("a").alias("path"), F.col("b").alias("other"), "shared").unionByName(shared_.select(F.col("b").alias("path"), F.col("a").alias("other"), "shared"))
    top = Window.partitionBy("path").orderBy(F.desc("shared"), "other")
    s = both.withColumn("at", F.row_number().over(top)).where(F.col("at") <= most_shared).select("path", "other", F.lit(3).alias("rank"), F.concat(F.lit("shares "), F.col("shared").cast("string"), F.lit(" dependencies")).alias("why"))
    r = relation.select("path", "other", F.when(F.col("kind") == "imported_by", 1).otherwise(2).alias("rank"), F.when(F.col("kind") == "imported_by", "uses this").otherwise("dependency").alias("why"))
    once = r.unionByName(s).withColumn("first", F.row_number().over(Window.partitionBy("path", "other").orderBy("rank"))).where("first = 1")
    return once.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("rank", "other"))).where(F.col("at") <= most).select("path", "at", "other", "why")


def internal(imports: DataFrame, project: str) -> DataFrame:
    """(module, target): imports of the project's own modules, without the package name; dunder files left out (O-133)."""
    own = imports.where((F.col("module") == project) | F.col("module").startswith(project + "."))
    strip = lambda c: F.regexp_replace(c, rf"^{project}\.", "")
    m = own.select(strip(dotted(F.col("file_path"))).alias("module"), strip(F.col("module")).alias("target"))
    return m.where(~F.col("module").rlike(r"(^|\.)__\w+__$") & (F.col("module") != F.col("target"))).distinct()
