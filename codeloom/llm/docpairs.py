"""Functions paired with their documentation, by island grammars.

For each language only islands are parsed: documentation comments, annotations, signatures and balanced bodies. All else
is water: literals and comments are blanked out first, length for length, so that no island is found in them, and
whatever no island starts at is skipped. A comment documents the function whose signature or annotations it touches; in
Python it is the literal that opens the body. Where that describes nothing, the ``docstring`` of a function or method
chunk counts for its first function: such pairs are told apart by ``origin`` (comment, docstring, or chunk where no island
was found at all and name and text are those of the chunk).

A description is what is left after comment marks, tags, tool directives, notices, placeholders, rulers and disabled
code are taken away; it must have words of its own, not only the function's name in other words. Null and empty contents
yield nothing; repeated rows of one id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.llm.common import rows_out

_C_WATER = re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\(?s:.))*`")
_RUST_WATER = re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|r(#*)\"(?s:.*?)\"\1|\"(?s:(?:[^\"\\]|\\.)*)\"|'(?:[^'\\\n]|\\[^\n]{1,8})'")
_HASH_WATER = re.compile(r"#[^\n]*|\"{3}(?s:.*?)(?:\"{3}|\Z)|'{3}(?s:.*?)(?:'{3}|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
WATER = {"python": _HASH_WATER, "ruby": _HASH_WATER, "rust": _RUST_WATER}

_NOT = r"(?!(?:if|for|while|switch|catch|return|with|function|else|do|new|throw|case|await|typeof|synchronized|try|sizeof|match|loop|in|of|and|or|not|super|this|delete|yield|using|lock|foreach|fixed|elif|until|unless|when|defined)\b)"
_SCRIPT = [
    r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<a>[\w$]+)",
    r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>\n]*>\s*)?\((?:[^()]|\([^()]*\))*\)\s*(?::[^={\n]+)?=>|[\w$]+\s*=>)",
    rf"^[ \t]*(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+|\*\s*)*{_NOT}(?P<c>#?[\w$]+)\s*(?:<[^>\n]*>)?\((?:[^(){{}};]|\([^()]*\)|\{{[^{{}}]*\}})*\)\s*(?::\s*(?:[^{{}};=\n]|=>)+?)?\s*\{{",
    r"^[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*(?P<d>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?\((?:[^()]|\([^()]*\))*\)\s*(?::[^={\n]+)?=>",
]
_JAVA = [
    rf"^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|override|virtual|async|sealed|partial|strictfp|extern)\s+)*(?:<[^>\n]+>\s*)?{_NOT}(?:[\w.$]+(?:<[^;{{}}()]*>)?(?:\[\])*[?]?\s+){_NOT}(?P<a>[\w$]+)\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:throws\s+[\w.,\s]+?)?\s*(?:\{{|;|=>)",
    rf"^[ \t]*(?:(?:public|private|protected)\s+)+{_NOT}(?P<b>[A-Z][\w$]*)\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:throws\s+[\w.,\s]+?)?\s*\{{",
]
_C = [rf"^(?![ \t]*(?:return|else|typedef|goto)\b)[ \t]*(?:[A-Za-z_][\w:<>,*& \t]*?[\s*&])(?:[\w]+::)*{_NOT}(?P<a>~?\w+)\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{"]
ISLANDS = {
    k: re.compile("|".join(f"(?:{p})" for p in v), re.M)
    for k, v in {
        "python": [r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<a>\w+)"],
        "javascript": _SCRIPT,
        "typescript": _SCRIPT,
        "tsx": _SCRIPT,
        "go": [r"^func\s*(?:\([^)]*\)\s*)?(?P<a>\w+)\s*(?:\[[^\]]*\])?\("],
        "java": _JAVA,
        "csharp": _JAVA,
        "rust": [r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<a>\w+)"],
        "c": _C,
        "cpp": _C,
        "ruby": [r"^[ \t]*(?:(?:private|protected|public|private_class_method|module_function|memoize)\s+)?def\s+(?:self\.|\w+\.)?(?P<a>[\w]+[?!=]?(?![\w])|[+\-*/%<=>!~\[\]]+)"],
        "php": [r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<a>\w+)"],
        "kotlin": [r"^[ \t]*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<a>\w+)\s*\("],
        "swift": [r"^[ \t]*(?:[a-z@]+(?:\([^)]*\))?\s+)*func\s+(?P<a>\w+)"],
    }.items()
}
_ANNOTATION = re.compile(r"^\s*(?:@[\w.]+|#!?\[|\[[A-Z]\w*|(?:template\s*<))")
_BRACKET = re.compile(r"[()\[\]{}]")
_OPENING = re.compile(r"\s*(?:#[^\n]*\n\s*)*[rRuUbB]{0,2}(\"{3}(?s:(.*?))(?:\"{3}|\Z)|'{3}(?s:(.*?))(?:'{3}|\Z)|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')")
_END = re.compile(r"\n(?=[^\s])")


def blanked(text: str, language: str) -> str:
    """The text with comments as \\x01 and literals as blanks, line ends kept."""

    def one(m: re.Match) -> str:
        t = m[0]
        fill = "\1" if t[0] in "#/" else " "
        return "\n".join(fill * len(x) for x in t.split("\n")) if "\n" in t else fill * len(t)

    return WATER.get(language, _C_WATER).sub(one, text)


def balanced(code: str, at: int) -> int:
    """Behind the bracket that closes the one at or behind ``at``; the end of the text if none does."""
    depth = 0
    for m in _BRACKET.finditer(code, at):
        depth += 1 if m[0] in "([{" else -1
        if depth <= 0:
            return m.end()
    return len(code)


def comment_before(lines: list[str], blank: list[str], k: int) -> str:
    """The comment that touches line ``k``, or the annotations right above it."""
    while k and _ANNOTATION.match(blank[k - 1]):
        k -= 1
    end, inside = k, False
    while k:
        t = blank[k - 1].strip()
        if t and t.strip("\1 "):
            break
        if not t and not inside:
            break
        if t:
            o = lines[k - 1]
            if o.rstrip().endswith("*/") and "/*" not in o:
                inside = True
            elif "/*" in o:
                inside = False
        k -= 1
    return "\n".join(lines[k:end])


def islands(text: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, documentation as written, start, end) of each function."""
    code = blanked(text, language)
    lines = blank = None
    row = seen = 0
    for m in ISLANDS[language].finditer(code):
        name = next(v for v in m.groupdict().values() if v)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        start = m.start() if m[0][:1] != "\n" else start
        opening = code.find("(", m.end() - 1 if m[0].endswith("(") else m.start())
        if language == "python":
            closed = balanced(code, code.find("(", m.end())) if code.find("(", m.end()) >= 0 else m.end()
            colon = code.find(":", closed)
            while colon >= 0 and (b := code.rfind("[", closed, colon)) >= 0 and balanced(code, b) > colon:
                colon = code.find(":", colon + 1)
            d = _OPENING.match(text, colon + 1) if colon >= 0 else None
            doc = next((g for g in d.groups()[1:] if g is not None), "") if d else ""
            indent = len(m[0]) - len(m[0].lstrip(" \t"))
            e = re.compile(rf"\n(?=[ \t]{{0,{indent}}}[^\s#)\]}}])").search(code, max(colon, m.end()))
            yield name, doc, m.start(), e.end() if e else len(text)
            continue
        if lines is None:
            lines, blank = text.split("\n"), code.split("\n")
        row += code.count("\n", seen, start)
        seen = start
        doc = comment_before(lines, blank, row)
        if language == "ruby":
            indent = len(m[0]) - len(m[0].lstrip(" \t"))
            e = re.compile(rf"^[ \t]{{{indent}}}end\b", re.M).search(code, m.end())
            end = e.end() if e else len(text)
        else:
            closed = balanced(code, opening) if opening >= 0 else m.end()
            brace = code.find("{", closed)
            stop = code.find(";", closed)
            end = balanced(code, brace) if brace >= 0 and not 0 <= stop < brace else (stop + 1 if stop >= 0 else len(text))
        yield name, doc, start, end


_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//[/!]?|#+(?!\[))?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_TAG = re.compile(r"^\s*(?:[@\\](?!ts-)(\w+)|:(\w+)(?:\s+[^:]*)?:)(.*)$")
_SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns|Return|Raises|Throws|Yields|Examples?|Notes?|See also)\s*:?\s*$", re.I)
_DIRECTIVE = re.compile(r"^\s*(?:noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|pragma:|isort:|fmt:|yapf:|ruff:|eslint\b|eslint-|jshint|jslint|tslint:|prettier-|istanbul |c8 |@ts-|clang-format|NOLINT|nolint|lint:|rubocop:|go:\w|rustfmt|clippy::|cppcheck|NOSONAR|CHECKSTYLE|checkstyle:|@formatter|sonar|coverage:|frozen_string_literal|-\*-|vim?:|region\b|endregion\b|\w+[:-](?:ignore|disable|enable|off|on|skip)\b(?![\w ]*[a-z]{4,} [a-z]{3,} [a-z]{3,}))", re.I)
_NOTICE = re.compile(r"copyright|\(c\)|©|spdx-|all rights reserved|licen[cs]e|released under|generated by|do not edit", re.I)
_STUB = re.compile(r"^\W*(?:to-?do|fixme|xxx+|tbd|hack|\?+)\b", re.I)
# What stands for a description that nobody wrote.
_EMPTY = {
    "helper", "helper function", "helper method", "internal", "deprecated", "none", "n a", "na", "pass", "write me", "no docs yet", "no docs", "no documentation", "undocumented", "documentation goes here", "description goes here", "function description",
    "method description", "description", "auto generated method stub", "auto generated", "autogenerated", "generated", "see above", "see below", "to be documented", "to be done", "docs", "doc", "docstring", "documentation", "placeholder", "inheritdoc",
    "summary summary", "summary", "empty", "private", "public", "constructor", "getter", "setter", "stub", "nothing", "wip", "same as above", "ditto", "add description", "missing", "unused", "me", "add docs", "document me", "describe me", "blank",
}
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")
_CODE = re.compile(r"^[\w.\[\]'\"]+\s*(?:[+\-*/|&]?=|:=|<-|\+\+|--)(?!=)\s*\S|^(?:[\w.]+\.)?\w+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{]?$|[;{]$|^[})\]]+;?$|^(?:return|import|from|const|let|var|if|for|while|def|func|fn)\b[^a-z]*\S*[(=:;]|^(?:return|raise|throw)\s+\w+$|^\w+\s*=>|^(?:if|for|while)\b.*:$")
_SMALL = set("the a an this that of to in on for and or is are be it its as by with from at do does function method procedure routine func def".split())


def stem(word: str) -> str:
    w = word.lower()
    for end in ("ing", "ied", "ies", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) > 2:
            w = w[: -len(end)]
            break
    return w.rstrip("e")[:1] + w.rstrip("e")[1:].rstrip("y") if len(w) > 3 else w


def description(doc: str | None, name: str) -> str | None:
    """The words of a documentation comment that describe the function, or None."""
    if not doc or not doc.strip():
        return None
    keep: list[str] = []
    own: list[str] = []
    text = _MARKS.sub("", doc)
    text = re.sub(r"\s+(?=@(?:param|returns?|throws|raises?|see|since|author)\b)", "\n", text)
    for line in text.split("\n"):
        t = re.sub(r"<[/\w\s]*>|\{@\w+[^{}]*\}", " ", line).strip()
        if not _WORD.search(t) or _DIRECTIVE.match(t) or _SECTION.match(t) or _STUB.match(t):
            continue
        if m := _TAG.match(t):
            words = _WORD.findall(m[3])
            param = words[:1] if (m[1] or m[2] or "").lower() in ("param", "parameter", "arg", "throws", "exception", "raises", "type") else []
            rest = [w for w in words[len(param) :] if w.lower() not in _SMALL and w not in param]
            if len(rest) > 2:
                own.append(t)
            continue
        if _NOTICE.search(t):
            t = " ".join(s for s in re.split(r"(?<=[.!?])\s+", t) if not _NOTICE.search(s) and len(_WORD.findall(s)) > 3)
        if not t or _CODE.search(t) and not re.search(r"[a-z] [a-z]+ [a-z]+ [a-z]+", t):
            continue
        keep.append(t)
    for found in (keep, own):
        words = [w for t in found for w in _WORD.findall(t)]
        if not words:
            continue
        low = " ".join(words).lower()
        if low in _EMPTY:
            continue
        known = {stem(w) for w in _PARTS.findall(name)} | {stem(name)} | {stem("".join(_PARTS.findall(name)))}
        parts = [p for w in words for p in (_PARTS.findall(w) or [w])]
        fresh = [p for p in parts if p.lower() not in _SMALL and stem(p) not in known]
        if len(fresh) >= 2 or len(fresh) == 1 and len(words) > 4:
            return "\n".join(found)
    return None


def pairs(content: str, language: str, chunk_type: str, docstring: str | None = None, name: str | None = None) -> Iterator[tuple[str, str, str, str]]:
    """(name, description, code, origin) of each documented function of a chunk."""
    first = True
    for fn, doc, a, b in islands(content, language):
        got, origin = description(doc, fn), "comment"
        if first and chunk_type != "class" and not got:
            got, origin = description(docstring, fn), "docstring"
        first = False
        if got:
            yield fn, got, content[a:b].strip("\n"), origin
    if first and chunk_type != "class" and name and (got := description(docstring, name)):
        yield name, got, content, "chunk"


def _rows(batch: dict[str, list]) -> Iterable[tuple]:
    for i, lang, kind, name, doc, text in zip(*(batch[c] for c in ("id", "language", "chunk_type", "name", "docstring", "content"))):
        for pair in pairs(text, lang, kind, doc, name):
            yield i, *pair


def documented(chunks: DataFrame) -> DataFrame:
    """Code and description: id, name, description, code, origin; a function that a chunk defines twice has its rows twice."""
    lang = F.coalesce(F.lower("language"), paths.language("file_path"))
    c = chunks.where(F.col("chunk_type").isin("function", "method", "class") & F.col("content").isNotNull() & F.col("id").isNotNull() & lang.isin(*ISLANDS))
    return rows_out(c.select("id", lang.alias("language"), "chunk_type", "name", "docstring", "content"), _rows, "id string, name string, description string, code string, origin string", scan=True)


def names(chunks: DataFrame) -> DataFrame:
    """(id, name) of each documented function, once."""
    return documented(chunks).select("id", "name").distinct()
