"""Functions of file paths: languages, stems, directories."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages known by file extension.
EXTENSIONS = {
    "py": "python",
    "pyi": "python",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "swift": "swift",
    "rb": "ruby",
    "rake": "ruby",
    "gemspec": "ruby",
    "php": "php",
    "phtml": "php",
    "kt": "kotlin",
    "kts": "kotlin",
    "cs": "csharp",
}


def language_of(path: str | None) -> str | None:
    """The language of a path by its extension, lower-cased; None if unknown (O-2)."""
    name = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name.lstrip(".") else None


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; null for dotfiles and names without one."""
    return F.nullif(F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1)), F.lit(""))


def language(path: Column) -> Column:
    """``language_of`` as an expression that stays in the JVM."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(EXTENSIONS.items())])
    return F.element_at(table, extension(path))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def directory(path: Column) -> Column:
    """Everything before the last slash, '' for a path without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def top_directory(path: Column) -> Column:
    """First path part, or 'root' for a file that lies in no directory (O-95)."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("root"))
