"""Files to chunks, calls and signatures, in Arrow batches (O-33 to O-53).

Python is read by its own parser; where that fails only the module chunk comes out. Other languages go by the islands of
declarations at the starts of lines and by balanced braces or ``end``, which is less exact than a full parser.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codeloom.extract import python_code as py
from codeloom.functions.paths import language_of
from codeloom.schemas import CALLS, CHUNKS, METADATA
from codeloom.session import ship, spread

SPLIT_LINES = 100
# Calls that say nothing about the structure of a program.
COMMON_CALLS = {
    "print", "println", "printf", "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "min", "max", "sum", "any", "all", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr", "type", "id", "repr", "hash", "format", "open", "close", "append", "extend", "insert", "remove", "pop", "clear", "get", "keys", "values", "items", "update", "join", "split", "strip", "replace", "startswith", "endswith", "lower", "upper", "find", "index", "count", "log", "debug", "info", "warn", "warning", "error", "console", "assert", "require", "include",
}
PYTHON_CALLS = {"super", "next", "iter", "abs", "round", "ord", "chr", "hex", "bin", "oct"}
SCRIPT_CALLS = {"setTimeout", "setInterval", "clearTimeout", "clearInterval", "fetch", "Promise"}

_NAME = r"[A-Za-z_$][\w$]*"
_CLASS = {
    "javascript": r"^[ \t]*(?:export\s+(?:default\s+)?)?class\s+(?P<n>\w+)",
    "typescript": r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface)\s+(?P<n>\w+)",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed)\s+)*(?:class|interface|enum|record)\s+(?P<n>\w+)",
    "csharp": r"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|enum|record)\s+(?P<n>\w+)",
    "go": r"^type\s+(?P<n>\w+)\s+(?:struct|interface)\b",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<n>\w+)",
    "c": r"^(?:typedef\s+)?(?:struct|enum|union)\s+(?P<n>\w+)\s*(?=\{)",
    "cpp": r"^[ \t]*(?:class|struct)\s+(?P<n>\w+)(?=\s*(?:final\b\s*)?[:{])",
    "ruby": r"^[ \t]*(?:class|module)\s+(?P<n>[\w:]+)",
    "php": r"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait)\s+(?P<n>\w+)",
    "kotlin": r"^[ \t]*(?:(?:public|private|internal|open|abstract|data|sealed|inner|enum)\s+)*(?:class|interface|object)\s+(?P<n>\w+)",
    "swift": r"^[ \t]*(?:(?:public|private|internal|open|final|indirect)\s+)*(?:class|struct|protocol|enum|extension)\s+(?P<n>\w+)",
}
# How the parents of a class are introduced: by words before lists of names, by a colon, or by a sign.
_WORDED, _COLONED = ("javascript", "typescript", "tsx", "java", "php"), ("cpp", "csharp", "kotlin", "swift")
_BLOCKED = r"(?!(?:if|for|while|switch|catch|return|with|else|do|new|throw|await|synchronized|try|sizeof|match|loop)\b)"
_FUNCTION = {
    "javascript": rf"^[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<a>{_NAME})|^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<b>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>)|^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*{_BLOCKED}(?P<c>{_NAME})\s*\([^(){{}};\n]*\)\s*(?::[^{{}};\n]+)?\{{",
    "go": r"^func\s*(?:\(\s*\w*\s*\*?(?P<r>\w+)[^)]*\)\s*)?(?P<a>\w+)",
    "java": rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|override|virtual|async)\s+)*(?:<[^>\n]+>\s*)?{_BLOCKED}[\w.$]+(?:<[^;{{}}()\n]*>)?(?:\[\])*\s+{_BLOCKED}(?P<a>{_NAME})\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w., ]+)?\s*\{{",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<a>\w+)",
    "c": rf"^(?![ \t]*(?:return|else|typedef)\b)[ \t]*(?:[A-Za-z_][\w:<>,*& \t]*?[\s*&])(?:\w+::)*{_BLOCKED}(?P<a>~?\w+)\s*\([^;{{}}()]*\)\s*(?:const\s*)?\{{",
    "ruby": r"^[ \t]*(?:(?:private|protected|public)\s+)?def\s+(?:self\.)?(?P<a>[\w?!=]+)",
    "php": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<a>\w+)",
    "kotlin": r"^[ \t]*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<a>\w+)\s*\(",
    "swift": r"^[ \t]*(?:\w+\s+)*func\s+(?P<a>\w+)",
}
for _l, _as in (("typescript", "javascript"), ("tsx", "javascript"), ("csharp", "java"), ("cpp", "c")):
    _FUNCTION[_l] = _FUNCTION[_as]
_CLASS["tsx"] = _CLASS["typescript"]
CLASSES = {k: re.compile(v, re.M) for k, v in _CLASS.items()}
FUNCTIONS = {k: re.compile(v, re.M) for k, v in _FUNCTION.items()}
IMPORT = {
    "javascript": re.compile(r"^[ \t]*(?:import\b|export\b.*\bfrom\b|(?:const|let|var)\b.*\brequire\()", re.M), "go": re.compile(r"^import\s*\((?s:.*?)\)|^import\b", re.M), "java": re.compile(r"^import\b", re.M), "rust": re.compile(r"^[ \t]*(?:pub\s+)?use\b", re.M), "c": re.compile(r"^[ \t]*#[ \t]*include\b", re.M),
    "ruby": re.compile(r"^[ \t]*require(?:_relative)?\b", re.M), "php": re.compile(r"^[ \t]*use\s", re.M), "kotlin": re.compile(r"^import\b", re.M), "swift": re.compile(r"^import\b", re.M), "csharp": re.compile(r"^using\b", re.M),
}
for _l, _as in (("typescript", "javascript"), ("tsx", "javascript"), ("cpp", "c")):
    IMPORT[_l] = IMPORT[_as]
_LITERAL = re.compile(r"//[^\n]*|/\*(?s:.*?)\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\(?s:.))*`")
_HASH = re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def digest(*parts: object) -> str:
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16]


def _blank(text: str, language: str) -> str:
    return (_HASH if language == "ruby" else _LITERAL).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(code: str, text: str, start: int, language: str) -> int:
    if language == "ruby":
        indent = re.match(r"[ \t]*", code[start:])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(code, start + 1)
        return m.end() if m else len(text)
    brace = code.find("{", start)
    line = code.find("\n", start)
    if brace < 0 or 0 <= code.find(";", start) < brace:
        return line if line >= 0 else len(text)
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, brace):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _comment(text: str, start: int, language: str) -> str | None:
    """The run of comment lines, or the block, right above a declaration (O-46, O-47)."""
    lines = text[:start].split("\n")[:-1]
    out: list[str] = []
    mark = r"^\s*#\s?" if language == "ruby" else r"^\s*(?:///?|//!)\s?"
    while lines and re.match(r"^\s*(?:@\w|#\[)", lines[-1]):
        lines.pop()
    if lines and lines[-1].rstrip().endswith("*/"):
        while lines:
            out.append(lines.pop())
            if "/*" in out[-1]:
                break
        return "\n".join(re.sub(r"^\s*(?:/\*+|\*+/|\*)\s?|\s*\*/\s*$", "", x).rstrip() for x in reversed(out)).strip() or None
    while lines and re.match(mark, lines[-1]):
        out.append(re.sub(mark, "", lines.pop()))
    return "\n".join(reversed(out)).strip() or None


def parents_of(language: str, head: str) -> list[str]:
    """Parent classes named in the head of a class, from behind its name up to its body (O-41).

    What stands in brackets of any kind (type arguments, arguments of constructors) is taken out first.
    """
    while (bare := re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", head)) != head:
        head = bare
    head = re.split(r"\bwhere\b|\{|;", head)[0]
    if language in _WORDED:
        lists = re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\b(?:extends|implements|permits)\b|$)", head, re.S)
    elif language in _COLONED:
        lists = re.findall(r"(?<!:):(?!:)(.*)", head, re.S)[:1]
    else:
        lists = re.findall(r"^\s*<\s*([\w:]+)", head) if language == "ruby" else []
    names = (re.sub(r"\b(?:public|private|protected|virtual|by)\b", "", x).split() for some in lists for x in some.split(","))
    return [(n[0].rsplit("::", 1)[-1] if language == "cpp" else n[0]) for n in names if n]


def _parents(code: str, end: int, language: str) -> list[str]:
    """As ``parents_of``, for the head that starts at ``end`` of blanked code."""
    stop = re.compile(r"\n" if language in ("ruby", "kotlin", "go", "rust") else r"[{;]").search(code, end)
    return parents_of(language, code[end : stop.start() if stop else len(code)])


def _base(kind: str, path: str, language: str, key: str, line: int, name: str | None, content: str, start: int, end: int, doc: str | None, parent: str | None, **meta) -> dict:
    return {"id": digest(path, key, line), "file_path": path, "language": language, "chunk_type": kind, "name": name, "content": content, "start_line": start, "end_line": end, "docstring": doc, "parent_name": parent, "metadata": meta}


def _summary(imports: list[str], classes: list[str], functions: list[str]) -> str:
    parts = []
    if imports:
        parts.append("# Imports:\n" + "\n".join(imports[:10]) + (f"\n... and {len(imports) - 10} more" if len(imports) > 10 else ""))
    parts += ["# Classes: " + ", ".join(classes)] * bool(classes) + ["# Functions: " + ", ".join(functions)] * bool(functions)
    return "\n\n".join(parts) or "# Empty file"


def chunks_of(path: str, source: str, split: int = SPLIT_LINES) -> Iterator[dict]:
    """Module, imports, classes (long ones as a summary and their methods) and functions outside classes."""
    language = language_of(path)
    if language is None:
        return
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    lines = source.split("\n")
    if language == "python":
        tree = py.parsed(source)
        if tree is None:
            yield _base("module", path, language, "module", 0, stem, "# Empty file", 1, len(lines), None, None, is_overview=True)
            return
        found = list(py.entities(tree))
        cut = lambda a, b: "\n".join(lines[a - 1 : b])
        nodes = sorted({(n.lineno, n.end_lineno or n.lineno) for n in py.ast.walk(tree) if isinstance(n, (py.ast.Import, py.ast.ImportFrom))})
        heads = [cut(a, b).strip() for a, b in nodes]
        yield _base("module", path, language, "module", 0, stem, _summary(heads, [e.name for e in found if e.kind == "class"], [e.name for e in found if e.kind == "function"]), 1, len(lines), py.ast.get_docstring(tree), None, is_overview=True)
        if nodes:
            yield _base("import", path, language, "imports", nodes[0][0], "imports", "\n".join(heads), nodes[0][0], max(b for _, b in nodes), None, None, import_count=len(nodes))
        for e in found:
            if e.kind == "class":
                methods = [x for x in found if x.kind == "method" and e.start <= x.start and x.end <= e.end]
                n = e.end - e.start + 1
                if n > split:
                    first = e.node.body[0].lineno if e.node.body else e.end
                    text = cut(e.start, max(e.start, first - 1)) + "\n    # Methods: " + ", ".join(m.name for m in methods)
                    yield _base("class", path, language, f"class_{e.name}", e.start - 1, e.name, text, e.start, e.end, e.doc, None, is_summary=True, method_count=len(methods), parent_classes=e.bases)
                    for m in methods:
                        yield _function(path, language, m, f"{e.name}.{m.name}", cut)
                else:
                    yield _base("class", path, language, f"class_{e.name}", e.start - 1, e.name, cut(e.start, e.end), e.start, e.end, e.doc, None, line_count=n, parent_classes=e.bases)
            elif e.kind == "function":
                yield _function(path, language, e, f"func_{e.name}", cut)
        return
    code = _blank(source, language)
    spans = []
    line_of = lambda at: source.count("\n", 0, at) + 1
    for m in CLASSES[language].finditer(code) if language in CLASSES else ():
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        spans.append((start, _end(code, source, start, language), m))
    functions = []
    for m in FUNCTIONS[language].finditer(code) if language in FUNCTIONS else ():
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        name = next(v for k, v in m.groupdict().items() if v and k != "r")
        inside = next((s for s in reversed(spans) if s[0] < start < s[1]), None)
        functions.append((start, _end(code, source, start, language), name, inside[2]["n"] if inside else m.groupdict().get("r")))
    heads = [source[m.start() : code.find("\n", m.end()) if code.find("\n", m.end()) >= 0 else len(source)].strip() for m in IMPORT[language].finditer(code)] if language in IMPORT else []
    yield _base("module", path, language, "module", 0, stem, _summary(heads, [m["n"] for _, _, m in spans], [f[2] for f in functions if f[3] is None]), 1, len(lines), None, None, is_overview=True)
    if heads:
        ms = list(IMPORT[language].finditer(code))
        yield _base("import", path, language, "imports", line_of(ms[0].start()), "imports", "\n".join(heads), line_of(ms[0].start()), line_of(ms[-1].end()), None, None, import_count=len(heads))
    for start, end, m in spans:
        a, b = line_of(start), line_of(end)
        own = [f for f in functions if start < f[0] < end]
        doc = _comment(source, start, language)
        if b - a + 1 > split:
            brace = code.find("\n" if language == "ruby" else "{", start)
            text = source[start : brace if brace > 0 else end].rstrip() + "\n    # Methods: " + ", ".join(f[2] for f in own)
            yield _base("class", path, language, f"class_{m['n']}", a - 1, m["n"], text, a, b, doc, None, is_summary=True, method_count=len(own), parent_classes=_parents(code, m.end(), language))
            for f in own:
                yield _base("method", path, language, f"{m['n']}.{f[2]}", line_of(f[0]) - 1, f[2], source[f[0] : f[1]], line_of(f[0]), line_of(f[1]), _comment(source, f[0], language), m["n"])
        else:
            yield _base("class", path, language, f"class_{m['n']}", a - 1, m["n"], source[start:end], a, b, doc, None, line_count=b - a + 1, parent_classes=_parents(code, m.end(), language))
    for start, end, name, parent in functions:
        if not any(a < start < b for a, b, _ in spans):
            kind = "method" if parent else "function"
            key = f"{parent}.{name}" if parent else f"func_{name}"
            yield _base(kind, path, language, key, line_of(start) - 1, name, source[start:end], line_of(start), line_of(end), _comment(source, start, language), parent)


def _function(path: str, language: str, e: py.Entity, key: str, cut: Callable[[int, int], str]) -> dict:
    return _base(
        e.kind, path, language, key, e.start - 1, e.name, cut(e.start, e.end), e.start, e.end, e.doc, e.parent, parameter_types=[{"name": n, "type": t} for n, t, _ in e.params if t],
        parameter_defaults=[(n, d) for n, _, d in e.params if d is not None], return_type=e.returns, decorators=e.decorators, is_async=e.is_async, raises=e.raises,
    )


def noise(name: str, language: str) -> bool:
    """Whether a call is left out of call graphs (O-51)."""
    return name.lower() in COMMON_CALLS or language == "python" and name in PYTHON_CALLS or language in ("javascript", "typescript", "tsx") and name in SCRIPT_CALLS


_CALL = re.compile(rf"(?<![\w$])(?:new\s+)?({_NAME})!?\s*\(")
NOT_CALLS = set("if for while switch catch return function def fn func class new await typeof elif and or not in is sizeof match loop when unless until else do try throw raise yield super".split())


def calls_of(path: str, source: str) -> Iterator[tuple[str, str, str, int]]:
    """(file, caller, callee, position) of each function's first calls of each name (O-49, O-52)."""
    language = language_of(path)
    rows: dict[str, list[str]] = {}
    if language == "python":
        tree = py.parsed(source)
        for e in py.entities(tree) if tree else ():
            if e.kind != "class":
                rows[f"{e.parent}.{e.name}" if e.parent else e.name] = [c for c in py.called(e.node) if not noise(c, language)]
    else:
        for c in chunks_of(path, source, 0) if language else ():
            if c["chunk_type"] in ("function", "method"):
                body = _blank(c["content"], language)
                named = re.search(rf"(?<![\w$]){re.escape(c['name'])}(?![\w$])[^(\n]*\(", body)
                body = body[named.end() if named else body.find("(") + 1 :]
                names = dict.fromkeys(n for n in _CALL.findall(body) if n not in NOT_CALLS and not noise(n, language))
                rows[f"{c['parent_name']}.{c['name']}" if c["parent_name"] else c["name"]] = list(names)
    for caller, names in rows.items():
        for k, n in enumerate(names):
            yield path, caller, n, k


def table_of(df: DataFrame, schema: str, rows: Callable[[str, str], Iterable]) -> DataFrame:
    """Rows by a function of two columns, in Arrow batches; none where one of them is null or the first is empty."""
    ship(df.sparkSession)
    types = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(types)
        names = arrow.names
        for b in batches:
            out = []
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path and source is not None:
                    out += [r if isinstance(r, dict) else dict(zip(names, r)) for r in rows(path, source)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return spread(df).mapInArrow(run, types)


def chunk_files(files: DataFrame, path: str = "file_path", source: str = "source_text", split: int = SPLIT_LINES) -> DataFrame:
    """The chunk table of files with their text."""
    return table_of(files.select(path, source), f"{CHUNKS}, metadata struct<{_struct(METADATA)}>", lambda p, s: chunks_of(p, s, split))


def call_edges(files: DataFrame, path: str = "file_path", source: str = "source_text") -> DataFrame:
    """The call graph of files with their text."""
    return table_of(files.select(path, source), CALLS, calls_of)


def _struct(fields: str) -> str:
    out, depth, start = [], 0, 0
    for k, ch in enumerate(fields + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, kind = fields[start:k].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = k + 1
    return ",".join(out)
