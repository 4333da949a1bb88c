"""Sections of Google and NumPy docstrings (O-54 to O-56).

Both styles are one thing here: a docstring is a row of blocks, each a title and the lines below it; the first block has
no title. The styles differ in how a title is told (a colon at its end, or a rule below it) and in how the first line of
an item names its type. Items start at the least indentation of their block; deeper lines belong to the item above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.session import ship

# Titles of sections, and what they hold.
TITLES = {"args": "args", "arguments": "args", "parameters": "args", "returns": "returns", "return": "returns", "raises": "raises", "raise": "raises", "example": "", "examples": "", "note": "", "notes": "", "yields": ""}
_GOOGLE_ITEM = re.compile(r"(?P<names>\*{0,2}\w+)\s*(?:\((?P<type>[^)]+)\))?\s*:(?P<rest>.*)", re.S)
_NUMPY_ITEM = re.compile(r"(?P<names>\*{0,2}\w+(?:\s*,\s*\*{0,2}\w+)*)\s*(?::(?P<type>.*))?(?P<rest>)", re.S)


@dataclass
class Block:
    title: str | None
    lines: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.lines).split())

    def items(self) -> list[list[str]]:
        """Lines of each item, the first at the least indentation of the block."""
        some = [x for x in self.lines if x.strip()]
        least = min((len(x) - len(x.lstrip()) for x in some), default=0)
        out: list[list[str]] = []
        for x in some:
            if len(x) - len(x.lstrip()) == least or not out:
                out.append([])
            out[-1].append(x.strip())
        return out


def _blocks(doc: str, numpy: bool) -> list[Block]:
    lines = doc.expandtabs(4).split("\n")
    out = [Block(None)]
    for k, x in enumerate(lines):
        name = x.strip()
        if numpy:
            if re.fullmatch(r"-{3,}", name):
                continue
            is_title = k + 1 < len(lines) and re.fullmatch(r"\s*-{3,}\s*", lines[k + 1]) is not None
        else:
            is_title = name.endswith(":") and name[:-1].lower() in TITLES
        if is_title:
            out.append(Block(name.rstrip(":").lower()))
        else:
            out[-1].lines.append(x)
    return out


def _parsed(doc: str | None, numpy: bool) -> dict:
    """description, returns (None without such a section), args and raises: name -> type and description."""
    found: dict = {"description": "", "args": {}, "returns": None, "raises": {}}
    for b in _blocks(doc, numpy) if doc else ():
        kind = "description" if b.title is None else TITLES.get(b.title, "")
        if kind in ("description", "returns"):
            found[kind] = b.text
        elif kind:
            last: list[dict] = []
            for first, *more in b.items():
                m = (_NUMPY_ITEM if numpy else _GOOGLE_ITEM).fullmatch(first)
                if m:
                    kept = (m["type"] or "").strip() or None
                    last = [found[kind].setdefault(n.strip(), {"type": kept, "description": ""}) for n in m["names"].split(",")]
                    more = [m["rest"].strip(), *more]
                else:
                    more = [first, *more]
                for e in last:
                    e["description"] = " ".join(x for x in (e["description"], *more) if x)
    return found


def google(doc: str | None) -> dict:
    return _parsed(doc, False)


def numpy(doc: str | None) -> dict:
    return _parsed(doc, True)


def parse(doc: str | None) -> dict:
    """By the style the docstring has; without rules under titles, Google's."""
    return _parsed(doc, bool(doc) and re.search(r"(?m)^\s*(?:Parameters|Returns|Raises|Yields)\s*\n\s*-{3,}", doc) is not None)


def described(chunks: DataFrame) -> DataFrame:
    """(id, description, args, returns) of docstrings (id, docstring), in Arrow batches; args: name -> description."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("description", pa.string()), ("args", pa.map_(pa.string(), pa.string())), ("returns", pa.string())])
        for b in batches:
            got = [parse(t) for t in b.column(1).to_pylist()]
            rows = [(i, g["description"], [(n, a["description"]) for n, a in g["args"].items()], g["returns"]) for i, g in zip(b.column(0).to_pylist(), got)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return chunks.select("id", "docstring").mapInArrow(run, "id string, description string, args map<string,string>, returns string")
