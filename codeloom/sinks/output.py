"""Pages, JSON files, diagrams and HTML (O-153, O-156, O-158, O-183 to O-192, O-196, O-197)."""

from __future__ import annotations

import html
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.session import ship


def safe_path(root: str, path: str) -> Path:
    """The file of a page under the root, an error for any path that leaves it (O-70)."""
    full = (Path(root) / path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path!r} is not under the output directory")
    return full


def write_pages(pages: DataFrame, root: str) -> DataFrame:
    """One file per page (path, content) under a directory all executors see; rows are written where they are. Returns path, bytes (O-185)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = safe_path(root, p)
                at.parent.mkdir(parents=True, exist_ok=True)
                part = at.with_name(f".{at.name}.{os.getpid()}")
                part.write_text(c or "", encoding="utf-8")
                part.replace(at)  # a task that runs twice leaves a whole file
                done.append((p, len((c or "").encode())))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "bytes"])

    return pages.select("path", "content").mapInArrow(run, "path string, bytes bigint")


def write_table(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """A table in Parquet, in files of a bounded number of rows (O-179, O-183)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, from every task (O-184, O-186): the form for indexes of any size."""
    df.write.mode("overwrite").json(path)


def search_json(pages: DataFrame, entities: DataFrame, path: str, most: int = 100_000) -> None:
    """One file {pages, entities, meta} for a browser (O-186); for more than ``most`` entries use ``write_json_lines``."""
    out = {}
    for key, df in (("pages", pages), ("entities", entities)):
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} {key}: not for a browser")
        out[key] = [r.asDict(recursive=True) for r in rows]
    out["meta"] = {"total_pages": len(out["pages"]), "total_entities": len(out["entities"])}
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")


def nested_toc(rows: Iterable[tuple[str, str, str | None]]) -> list[dict]:
    """Entries (number, title, path) as a tree (O-187, O-200)."""
    nodes: dict[str, dict] = {}
    top: list[dict] = []
    for number, title, path in sorted(rows, key=lambda r: [int(x) for x in r[0].split(".")]):
        node = {"number": number, "title": title, "path": path, "children": []}
        nodes[number] = node
        (nodes[number.rsplit(".", 1)[0]]["children"] if "." in number else top).append(node)
    return top


_INLINE = [(re.compile(r"`([^`]+)`"), r"<code>\1</code>"), (re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>"), (re.compile(r"\*([^*]+)\*"), r"<em>\1</em>")]


def _inline(s: str) -> str:
    s = html.escape(s, quote=False)
    s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: f'<a href="{re.sub(r"[.]md(?=#|$)", ".html", m[2])}">{m[1]}</a>', s)
    for p, r in _INLINE:
        s = p.sub(r, s)
    return s


def to_html(markdown: str) -> str:
    """HTML of headings, paragraphs, lists, tables, fences and quotes (O-188); mermaid fences stay for the browser."""
    out: list[str] = []
    lines, k = markdown.split("\n"), 0
    while k < len(lines):
        x = lines[k]
        if m := re.match(r"^(`{3}|~{3})(\w*)", x):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].startswith(m[1])), len(lines))
            body = html.escape("\n".join(lines[k + 1 : end]), quote=False)
            out.append(f'<pre class="mermaid">{body}</pre>' if m[2] == "mermaid" else f'<pre><code class="language-{m[2] or "text"}">{body}</code></pre>')
            k = end
        elif m := re.match(r"^(#{1,6})\s+(.*)", x):
            slug = re.sub(r"[^\w]+", "-", m[2].lower()).strip("-")
            out.append(f'<h{len(m[1])} id="{slug}">{_inline(m[2])}</h{len(m[1])}>')
        elif x.startswith("|") and k + 1 < len(lines) and re.match(r"^\|[\s:|\-]+$", lines[k + 1]):
            cells = lambda r: [_inline(c.strip()) for c in r.strip().strip("|").split("|")]
            rows = ["<tr>" + "".join(f"<th>{c}</th>" for c in cells(x)) + "</tr>"]
            k += 2
            while k < len(lines) and lines[k].startswith("|"):
                rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells(lines[k])) + "</tr>")
                k += 1
            out.append("<table>" + "".join(rows) + "</table>")
            continue
        elif m := re.match(r"^\s*(?:([-*+])|\d+[.)])\s+", x):
            tag = "ul" if m[1] else "ol"
            items = []
            while k < len(lines) and (n := re.match(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)", lines[k])):
                items.append(f"<li>{_inline(n[1])}</li>")
                k += 1
            out.append(f"<{tag}>{''.join(items)}</{tag}>")
            continue
        elif x.startswith(">"):
            out.append(f"<blockquote>{_inline(x.lstrip('> '))}</blockquote>")
        elif x.strip():
            para = [x]
            while k + 1 < len(lines) and lines[k + 1].strip() and not re.match(r"^(#|`{3}|~{3}|>|\||\s*[-*+]\s|\s*\d+[.)]\s)", lines[k + 1]):
                k += 1
                para.append(lines[k])
            out.append(f"<p>{_inline(' '.join(para))}</p>")
        k += 1
    return "\n".join(out)


def _mapped(pages: DataFrame, fn: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """(path, content) with the content by a function of both, made once a task, in Arrow batches."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = fn()
        for b in batches:
            got = [of(p or "", c or "") for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["path", "content"])

    return pages.select("path", "content").mapInArrow(run, "path string, content string")


def html_pages(pages: DataFrame) -> DataFrame:
    """(path, content) of pages as HTML files, titles from their text (O-188)."""
    clean = F.replace(F.replace(text.title(F.col("content"), F.col("path")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), clean, F.lit("</title></head>\n<body>\n"))
    titled = pages.select(F.to_json(F.struct("path", head.alias("head"))).alias("path"), "content")
    out = _mapped(titled, lambda: lambda p, c: to_html(c)).withColumn("h", F.from_json("path", "path string, head string"))
    return out.select(F.regexp_replace("h.path", r"\.md$", ".html").alias("path"), F.concat(F.coalesce("h.head", F.lit("")), "content", F.lit("\n</body></html>\n")).alias("content"))


_KEEP = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|(?m:^#+[^\n]*$)|!?\[[^\]]*\]\([^)]*\)")
_MENTION = re.compile(r"`(?P<code>[^`\n]*)`|\*\*(?P<bold>[^*\n]+)\*\*|(?<![\w`./\[])(?P<bare>[A-Za-z_]\w*)")


class Linker:
    """Turns mentions of entities into links (O-156): by name, or by what the name is spelled out as, the longest first.

    A mention is looked up word by word, so its cost does not grow with the number of names. Fences, headings, links and
    inline code other than a sole name stay.
    """

    def __init__(self, names: Mapping[str, str]) -> None:
        self.names = names
        self.phrases: dict[str, list[str]] = {}
        for n in names:
            if " " in n:
                self.phrases.setdefault(n.split(" ", 1)[0], []).append(n)
        for some in self.phrases.values():
            some.sort(key=lambda n: (-len(n), n))

    def linked(self, content: str, own: Iterable[str] = (), page: str = "") -> str:
        mine, out, at = set(own), [], 0
        for m in _KEEP.finditer(content):
            out += [self._prose(content[at : m.start()], mine, page), m[0]]
            at = m.end()
        return "".join(out) + self._prose(content[at:], mine, page)

    def _target(self, name: str, mine: set[str], page: str) -> str | None:
        to = self.names.get(name)
        return None if to is None or name in mine or to == page else os.path.relpath(to, os.path.dirname(page) or ".") if page else to

    def _prose(self, s: str, mine: set[str], page: str) -> str:
        out, pos, at = [], 0, 0
        while m := _MENTION.search(s, pos):
            shown, name, pos = m[0], m["code"] or m["bold"] or m["bare"] or "", m.end()
            if m["bare"]:
                for some in (*self.phrases.get(name, ()), name):
                    end = m.start() + len(some)
                    if s.startswith(some, m.start()) and not re.match(r"[\w`\]/(]", s[end : end + 1]) and self._target(some, mine, page):
                        shown = name = some
                        pos = end
                        break
                else:
                    continue
            if to := self._target(name, mine, page):
                out += [s[at : m.start()], f"[{shown}]({to})"]
                at = pos
        return "".join(out) + s[at:]


def linked(content: str, names: Mapping[str, str], own: Iterable[str] = (), page: str = "") -> str:
    return Linker(names).linked(content, own, page)


def link_pages(pages: DataFrame, registry: DataFrame, most: int = 100_000) -> DataFrame:
    """(path, content) with mentions linked. The registry (name, path; alias, if there is one) goes to every executor; its size is checked, more is an error."""
    columns = ["name", "path", "alias" if "alias" in registry.columns else F.lit(None).cast("string").alias("alias")]
    rows = registry.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a registry of more than {most} names is not broadcast")
    known = {r.alias: r.path for r in rows if r.alias} | {r.name: r.path for r in rows}
    names = pages.sparkSession.sparkContext.broadcast(known)

    def made() -> Callable[[str, str], str]:
        linker = Linker(names.value)
        return lambda p, c: linker.linked(c, (), p)

    return _mapped(pages, made)


def diagram(edges: Iterable[tuple[str, str]], kind: str = "flowchart TD", arrow: str = "-->", cyclic: Iterable[tuple[str, str]] = ()) -> str:
    """A mermaid graph of edges in order; those on cycles dotted (O-190). For the pruned edges of a page."""
    clean = lambda n: ("C" if n[:1].isdigit() else "") + re.sub(r"[<>\[\].\-: ]", "_", n)
    bad = set(cyclic)
    rows = [f"    {clean(a)} {'-.->' if (a, b) in bad else arrow} {clean(b)}" for a, b in sorted(set(edges))]
    return "\n".join(["```mermaid", kind, *rows, "```"])


def pie(counts: Iterable[tuple[str, int]], title: str = "Files by language") -> str:
    rows = sorted(counts, key=lambda x: (-x[1], x[0]))
    return "\n".join(["```mermaid", f"pie title {title}", *[f'    "{n}" : {c}' for n, c in rows], "```"])


def sequence(edges: dict[str, list[str]], start: str, depth: int = 5) -> str:
    """Calls below a function, depth first, each edge once (O-130)."""
    out, seen = ["```mermaid", "sequenceDiagram"], set()

    def walk(a: str, d: int) -> None:
        for b in edges.get(a, []):
            if d <= depth and (a, b) not in seen:
                seen.add((a, b))
                out.append(f"    {a}->>{b}: call")
                walk(b, d + 1)
                out.append(f"    {b}-->>{a}: return")

    walk(start, 1)
    return "\n".join([*out, "```"])


def class_diagram(classes: Iterable[tuple[str, list[str], list[str]]]) -> str:
    """Classes (name, parents, members) (O-190)."""
    rows = []
    for name, parents, members in sorted(classes):
        rows.append(f"    class {name} {{")
        rows += [f"        {m}" for m in members] + ["    }"]
        rows += [f"    {p} <|-- {name}" for p in sorted(parents)]
    return "\n".join(["```mermaid", "classDiagram", *rows, "```"])
