"""Source files that do not parse.

Every text is cut at line ends into pieces of ``PIECE_CHARS``. A piece becomes a map: for each state a lexer may be in
before it, the state after it and the reduction of its letters, in which all that is balanced has been judged by the
local grammars of ``grammars`` and replaced. Maps of neighbours are put together associatively: up to ``RANGE`` pieces in
the task that reads the text, the ranges of a file, in whatever partition they come, after one shuffle of the reductions.
What then is left of a file holds no brackets and is judged by statements, in Python also by the columns of its lines.

All files and sizes go the same way. A null or empty text and one of comments only is valid; a file without a known
programming language is not judged; a file with several rows counts once, and is invalid if one of its texts is. Files
whose ``language`` is another than the one of their extension are judged in the former, by a second pass over those
files only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.llm.common import rows_out
from codeloom.llm.grammars import GRAMMARS, WRONG
from codeloom.llm.lexing import LEXERS, lex, pieces, starts

KNOWN = tuple(LEXERS)
PIECE_CHARS, RANGE = 4096, 4
BROADCAST_ROWS = 100_000
_HEREDOC = re.compile(r"<<[~-]?(['\"]?)([A-Z_]\w*)\1([^\n]*)\n(?s:.*?)^[ \t]*\2\b", re.M)
_JSX = re.compile(r"</[A-Za-z.]*\s*>|/>")
_TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*|(?=>))((?:=>|[^<>\"'{}]|\"[^\"]*\"|'[^']*'|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})*?)(/?)>")


def prepared(language: str, text: str) -> str:
    """Text without what the lexers leave to others: a mark of byte order, JSX elements, bodies of here documents."""
    text = text.lstrip("﻿")
    if language == "python":
        return "\n" + text
    if language == "ruby" and "<<" in text:
        text = _HEREDOC.sub(r'""\3', text)
    elif language in ("javascript", "tsx") and _JSX.search(text):
        text = without_jsx(text)
    return text


def without_jsx(text: str) -> str:
    """JSX elements replaced by null, where a tag stands in the place of a value and all tags up to its end are closed."""
    out, at = [], 0
    for m in re.finditer(r"(?:(?<=[=(>?:&|,{\[;])|(?<=return))\s*(?=<[A-Za-z>])", text):
        if m.end() < at:
            continue
        depth, pos = 0, m.end()
        while t := _TAG.search(text, pos):
            if depth == 0 and t.start() != pos:
                break
            pos = t.end()
            depth += -1 if t[1] else 0 if t[4] else 1
            if depth <= 0:
                break
        if depth == 0 and pos > m.end():
            out += [text[at : m.end()], " null "]
            at = pos
    return "".join(out) + text[at:]


Map = dict[str, tuple[str, str]]  # state before -> state after, reduction


def piece_map(language: str, text: str, states: tuple[str, ...]) -> Map:
    g = GRAMMARS[language]
    if language == "python" and "\0" in text:  # not even in a literal
        return {s: ("", WRONG) for s in states}
    return {s: (end, g.reduced(letters)) for s, (letters, end) in LEXERS[language].map(text, states).items()}


def joined(language: str, a: Map, b: Map, text: str) -> Map:
    """The map of two neighbours; ``text``: of the second, for states inside nested templates, which no map lists."""
    out, g = {}, GRAMMARS[language]
    for s, (middle, left) in a.items():
        if middle not in b:
            letters, end = lex(language, text, middle)
            b[middle] = (end, g.reduced(letters))
        end, right = b[middle]
        out[s] = (end, g.joined(left, right))
    return out


def reduced(language: str, maps: list[Map], texts: list[str]) -> Map:
    """The map of a row of neighbours, put together two by two."""
    while len(maps) > 1:
        maps = [joined(language, maps[k], maps[k + 1], texts[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        texts = ["".join(texts[k : k + 2]) for k in range(0, len(texts), 2)]
    return maps[0]


def ranges(language: str, text: str, piece_chars: int = PIECE_CHARS, range_: int = RANGE) -> Iterable[tuple[Map, str]]:
    """The map of each range of pieces of a prepared text, and the range's text."""
    cut = pieces(text, piece_chars)
    for k in range(0, len(cut), range_):
        some = cut[k : k + range_]
        yield reduced(language, [piece_map(language, p, starts(language) if k + j else ("",)) for j, p in enumerate(some)], some), "".join(some)


def accepted(language: str, whole: Map) -> bool:
    """Whether a file with this map, entered in code, is valid."""
    state, reduction = whole[""]
    return not state and GRAMMARS[language].file(reduction)


def valid(language: str, text: str | None, piece_chars: int = PIECE_CHARS, range_: int = RANGE) -> bool:
    """Whether ``text`` is a syntactically valid file of ``language``: the whole way of a file, in one place."""
    if not text or not text.strip():
        return True
    maps, texts = zip(*ranges(language, prepared(language, text), piece_chars, range_))
    return accepted(language, reduced(language, list(maps), list(texts)))


def _mapped(batch: dict[str, list], piece_chars: int, range_: int) -> Iterable[tuple]:
    for i, lang, h, text in zip(batch["file_id"], batch["lang"], batch["hash"], batch["source_text"]):
        if not text.strip():
            yield i, lang, h, 0, 1, None, [("", "", "")]
            continue
        text = prepared(lang, text)
        some = list(ranges(lang, text, piece_chars, range_))
        again = len(some) > 1 and LEXERS[lang].templates and "${" in text  # a range may be entered in a state that only its text can answer
        for k, (m, t) in enumerate(some):
            yield i, lang, h, k, len(some), t if again else None, [(s, *v) for s, v in m.items()]


def _folded(batch: dict[str, list]) -> Iterable[tuple]:
    for i, lang, rows in zip(batch["file_id"], batch["lang"], batch["ranges"]):
        by_text: dict[int, dict[int, dict]] = {}
        for r in rows:
            by_text.setdefault(r["hash"], {})[r["k"]] = r
        ok = True
        for some in by_text.values():
            some = [some[k] for k in sorted(some)]
            maps = [{m["state"]: (m["end"], m["reduction"]) for m in r["maps"]} for r in some]
            ok = ok and accepted(lang, reduced(lang, maps, [r["text"] or "" for r in some]))
        yield i, lang, ok


def judged(texts: DataFrame, piece_chars: int = PIECE_CHARS, range_: int = RANGE) -> DataFrame:
    """(file_id, lang, valid), once, of rows (file_id, lang, source_text) with a known language."""
    schema = "file_id bigint, lang string, hash bigint, k int, n int, text string, maps array<struct<state:string,end:string,reduction:string>>"
    rows = texts.select("file_id", "lang", F.xxhash64("source_text").alias("hash"), F.coalesce("source_text", F.lit("")).alias("source_text"))
    maps = rows_out(rows, lambda b: _mapped(b, piece_chars, range_), schema, scan=True)
    grouped = maps.groupBy("file_id", "lang").agg(F.collect_set(F.struct("hash", "k", "text", "maps")).alias("ranges"))  # of one file
    return rows_out(grouped, _folded, "file_id bigint, lang string, valid boolean")


def files_judged(file_info: DataFrame, parse_results: DataFrame, piece_chars: int = PIECE_CHARS, range_: int = RANGE) -> DataFrame:
    """One row per file of a programming language: file_id, repo, path, lang, valid. Files without a text are left out."""
    files = file_info.select("file_id", "repo", "path", F.lower("language").alias("language")).where(F.col("file_id").isNotNull()).dropDuplicates(["file_id"])
    files = files.withColumn("own", F.coalesce("language", paths.language("path")))
    texts = parse_results.select("file_id", paths.language("file_path").alias("lang"), "source_text").where(F.col("source_text").isNotNull())
    known = F.col("lang").isin(*KNOWN)
    first = judged(texts.where(known), piece_chars, range_)
    by_ext = files.where(F.col("own").eqNullSafe(paths.language("path"))).withColumnRenamed("own", "lang").join(first, ["file_id", "lang"])
    other = files.where(~F.col("own").eqNullSafe(paths.language("path")) & F.col("own").isin(*KNOWN)).select("file_id", F.col("own").alias("lang"))
    n = other.count()
    if not n:
        return by_ext.select("file_id", "repo", "path", "lang", "valid")
    other = F.broadcast(other) if n <= BROADCAST_ROWS else other
    again = judged(texts.drop("lang").join(other, "file_id").select("file_id", "lang", "source_text"), piece_chars, range_)
    rest = files.withColumnRenamed("own", "lang").join(again, ["file_id", "lang"])
    return by_ext.select("file_id", "repo", "path", "lang", "valid").unionByName(rest.select("file_id", "repo", "path", "lang", "valid"))


def invalid_files(file_info: DataFrame, parse_results: DataFrame, piece_chars: int = PIECE_CHARS, range_: int = RANGE) -> DataFrame:
    """Files that are not valid in their language: file_id, repo, path, lang."""
    return files_judged(file_info, parse_results, piece_chars, range_).where(~F.col("valid")).drop("valid")


def invalid_rates(file_info: DataFrame, parse_results: DataFrame, piece_chars: int = PIECE_CHARS, range_: int = RANGE) -> DataFrame:
    """Files, invalid ones and their share by repo and language, with subtotals (null) by repo, by language and over all."""
    j = files_judged(file_info, parse_results, piece_chars, range_)
    return j.cube("repo", "lang").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
