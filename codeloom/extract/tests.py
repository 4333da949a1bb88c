"""Test functions and usage snippets of Python test files (O-59, O-61, O-62)."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

from pyspark.sql import DataFrame

from codeloom.extract import python_code as py
from codeloom.extract.chunks import table_of


def bodies(path: str, source: str) -> Iterator[tuple[str, str, str]]:
    """(file, test, body) without the docstring, dedented."""
    tree = py.parsed(source)
    lines = source.split("\n")
    for cls, node in py.tests(tree) if tree else ():
        body = node.body[1:] if py.ast.get_docstring(node) is not None else node.body
        if body:
            yield path, f"{cls}.{node.name}" if cls else node.name, textwrap.dedent("\n".join(lines[body[0].lineno - 1 : node.end_lineno]))


def snippet(body: str, entity: str, most: int = 25) -> str | None:
    """From the first line that names the entity up to the second assertion with its brackets closed, or ``most`` lines; all of a short body."""
    lines = body.split("\n")
    first = next((k for k, x in enumerate(lines) if entity in x or "dedent(" in x), None)
    if first is None or entity not in body:
        return None
    if len(lines) <= 10:
        return body.strip("\n")
    out, asserts, depth = [], 0, 0
    for x in lines[first : first + most]:
        out.append(x)
        asserts += x.strip().startswith("assert")
        depth += sum(x.count(c) for c in "([{") - sum(x.count(c) for c in ")]}")
        if asserts >= 2 and depth <= 0:
            break
    return textwrap.dedent("\n".join(out)).strip("\n")


def test_bodies(files: DataFrame, path: str = "file_path", source: str = "source_text") -> DataFrame:
    """(test_file, test_name, code) of the test functions of Python files, in Arrow batches (O-59)."""
    return table_of(files.select(path, source), "test_file string, test_name string, code string", bodies)


def usage_snippets(uses: DataFrame) -> DataFrame:
    """(name, code) -> (name, snippet) of test bodies that use an entity (O-61); those that do not are left out."""
    rows = lambda name, code: [(name, s)] if (s := snippet(code, name)) is not None else []
    return table_of(uses.select("name", "code"), "name string, snippet string", rows)


test_bodies.__test__ = False  # no test of ours
