"""Cutting oversized items at natural boundaries.

The size of any stretch is a difference of two prefix sums (characters, bytes of UTF-8, line ends or tokens). From a
start, a binary search in the sums finds how far a piece may go, another one in the sorted boundaries the last one up to
there: an empty line, if the piece stays at least half full, else a line end, else a blank, else a hard cut. The next
piece starts the overlap before that cut: exactly so in characters and lines, with the rest of a started character in
bytes, and with the rest of a started token in tokens.

Pieces in order, each without its overlap, give the item back. Null and fitting contents yield no pieces; a language
without a limit of its own takes the one of the null language, and none at all if there is none; repeated rows of one id
count once; a null start_line counts as 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import tokens
from codeloom.llm.common import rows_out

MAX_LIMITS = 1000
UNITS = ("chars", "bytes", "lines", "tokens")
_EMPTY_LINE, _LINE, _BLANK = re.compile(r"\n[ \t\r]*\n"), re.compile(r"\n"), re.compile(r"[ \t]+")


def sums(text: str, unit: str, tokenizer: str = tokens.DEFAULT) -> np.ndarray:
    """Size of the first i characters, for i from 0 to all."""
    n = len(text)
    if unit == "chars":
        return np.arange(n + 1)
    out = np.zeros(n + 1, dtype=np.int64)
    if unit == "lines":
        out[1:] = np.cumsum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 10)
    elif unit == "bytes":
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[1:] = np.cumsum(1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
    else:
        ends = tokens.counter(tokenizer).ends(text)
        out = np.searchsorted(ends, np.arange(n + 1), "right")
        out[-1] = len(ends)
    return out


def size(text: str, unit: str, tokenizer: str = tokens.DEFAULT) -> int:
    if unit == "tokens":
        return tokens.counter(tokenizer).count(text)
    return len(text) if unit == "chars" else text.count("\n") + 1 if unit == "lines" else len(text.encode("utf-8", "surrogatepass"))


def split(text: str, unit: str, limit: int, overlap: int = 0, tokenizer: str = tokens.DEFAULT) -> list[tuple[int, int]]:
    """Start and end of each piece of at most ``limit``; one piece if all fits."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("a limit is positive and larger than its overlap")
    if size(text, unit, tokenizer) <= limit:
        return [(0, len(text))]
    total = sums(text, unit, tokenizer)
    ends = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in (_EMPTY_LINE, _LINE, _BLANK)]
    room = limit - (unit == "lines")
    out, start, done, n = [], 0, 0, len(text)
    while True:
        far = int(np.searchsorted(total, total[start] + room, "right")) - 1
        far = max(min(far, n), done + 1)
        if unit == "tokens":
            while far > done + 1 and (over := size(text[start:far], unit, tokenizer) - limit) > 0:
                far = max(done + 1, int(np.searchsorted(total, total[far] - over, "left")))
        if far >= n:
            return [*out, (start, n)]
        end = far - (text[far - 1 : far + 1] == "\r\n" and far - 1 > done)
        for k, at in enumerate(ends):
            i = int(np.searchsorted(at, far, "right")) - 1
            if i >= 0 and at[i] > max(done, (start + far) // 2 if k == 0 else start):
                end = int(at[i])
                break
        while unit == "tokens" and end > done + 1 and size(text[start:end], unit, tokenizer) > limit:
            end -= 1
        out.append((start, end))
        done = end
        start = end
        if overlap:
            at = total[end] - overlap
            start = int(np.searchsorted(total, at, "left")) if unit == "lines" else int(np.searchsorted(total, at, "right")) - 1
            last = out[-1][0]
            while start < end and (start <= last or total[end + 1] - total[start] > room):
                start += 1


def limits_of(limits: DataFrame, purpose: str = "split") -> dict[str | None, tuple[str, int, int]]:
    """language (None: the others) -> unit, max_size, overlap; the smallest limit_id where a language has several. More than MAX_LIMITS languages are an error."""
    one = limits.where(F.col("purpose") == purpose).groupBy(F.lower("language").alias("language")).agg(F.min_by(F.struct("unit", "max_size", F.coalesce("overlap", F.lit(0)).alias("overlap")), "limit_id").alias("x"))
    rows = one.limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError("more limits than languages can have")
    return {r.language: tuple(r.x) for r in rows}


def over_limit(content: Column, unit: Column, limit: Column) -> Column:
    """Whether a content is over its limit in characters, bytes or lines; in tokens, whether it may be, as there are no more tokens than bytes."""
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return F.when(unit == "chars", F.length(content)).when(unit == "lines", lines).otherwise(F.octet_length(content)) > limit


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks over their limit, with it; judged before anything is moved, and in the JVM."""
    c = chunks.select("id", F.lower("language").alias("language"), "content", "start_line").where(F.col("id").isNotNull())
    table = limits_of(limits)
    limit = F.lit(None).cast("struct<unit:string,max_size:bigint,overlap:bigint>")
    for lang, (unit, most, overlap) in sorted(table.items(), key=lambda x: x[0] or ""):
        v = F.struct(F.lit(unit).alias("unit"), F.lit(most).cast("bigint").alias("max_size"), F.lit(overlap).cast("bigint").alias("overlap"))
        limit = v if lang is None else F.when(F.col("language") == lang, v).otherwise(limit)
    c = c.withColumn("limit", limit)
    return c.where(over_limit(F.col("content"), F.col("limit.unit"), F.col("limit.max_size")))


def _cut(batch: dict[str, list], tokenizer: str) -> Iterable[tuple]:
    for i, text, line, lim in zip(batch["id"], batch["content"], batch["start_line"], batch["limit"]):
        spans = split(text, lim["unit"], lim["max_size"], lim["overlap"], tokenizer)
        if len(spans) < 2:
            continue
        for k, (a, b) in enumerate(spans):
            first = (line or 1) + text.count("\n", 0, a)
            yield i, k, text[a:b], first, first + text.count("\n", a, max(a, b - 1)), a, b, size(text[a:b], lim["unit"], tokenizer)


def split_chunks(chunks: DataFrame, limits: DataFrame, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Pieces of the contents over their limit: id, piece (from 0), content, start_line, end_line, start_char, end_char, size."""
    rows = oversized(chunks, limits).dropDuplicates(["id"])
    return rows_out(rows.select("id", "content", "start_line", "limit"), lambda b: _cut(b, tokenizer), "id string, piece int, content string, start_line int, end_line int, start_char int, end_char int, size bigint")
