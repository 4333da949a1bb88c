"""Files that nobody in their repository wrote by hand: generated, minified, vendored, or data saved as code.

Vendored code is found first by hashes over directory trees: a file's hash is that of its text, a directory's the sum,
commutative, of those of its children, mixed; names do not count, as copies get others. The sum makes every directory
above a file get its share of it in one aggregation, combined bottom-up in each task before anything is moved, whatever
the depth, and no list of children is ever gathered. A subtree of
``EVIDENCE_LINES`` lines of code or more that lies in unrelated repositories marks its files as vendored, unless their
header names their own repository; shorter texts are alike by chance, and count within such a directory only.
Repositories are related, as forks and mirrors are, if of one's files (``FEW`` at least) ``RELATED`` are in others as well: they and
the repository they share most with are one family, and what only one family has is its own work.

What no tree marks is judged by itself: banners of other projects, then directories of package managers; generated files
by the head comments, by a layout of few line shapes with names numbered on, then by names and directories that tools
use; minified ones by long dense lines outside literals; data by literals that outnumber all other words. ``rule`` says
which of them decided.

Judged by text and path only, one pass over the texts without a shuffle; only hashes and flags move. Settings files,
files without a known language and blank texts do not count; a null path or text gives no flag; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.llm.common import rows_out
from codeloom.session import written

EVIDENCE_LINES = 5
RELATED, FEW = 0.5, 5
NUMBERED_ON = 0.8  # of the steps from one number to the next go up
FAMILIES_SENT = 100_000
# Directories and names by which tools mark what they copy or write.
VENDOR_DIRS = "vendor|third_party|third-party|node_modules|bower_components|site-packages|dist-packages|jspm_packages|_vendor|_vendored|vendored|deps|external|externals|extern|3rdparty|Pods|Carthage"
GENERATED_DIRS = "generated|__generated__|_generated|autogen|gen|codegen_out|generated-sources|protogen"
VENDOR_PATH = re.compile(rf"(?:^|/)(?:{VENDOR_DIRS})/(?=[^/])")
GENERATED_PATH = re.compile(rf"(?:^|/)(?:{GENERATED_DIRS})/|(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|rs|ts|js)|_pb\.(?:js|ts|rb|d\.ts)|\.pb-c\.[ch]|_grpc\.pb\.go|Grpc\.java|_Impl\.java|OuterClass\.java|\.g\.(?:ts|dart|cs|py)|\.gen\.\w+|\.generated\.\w+|_generated\.\w+|_gen\.\w+|\.designer\.cs|\.tab\.[ch]|\.yy\.[ch]|lex\.yy\.c|_string\.go|zz_generated[\w.]*)$")
MINIFIED_PATH = re.compile(r"[.-]min\.(?:js|mjs|cjs|css)$")
_COMMENT = re.compile(r"//[^\n]*|/\*(?s:.*?)\*/|#[^\n]*|--[^\n]*|<!--(?s:.*?)-->|\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}")
GENERATED = re.compile(
    r"(?:code|file|source|sources|class|module|parser|bindings?)?\s*(?:is |was |were |has been )?(?:auto[- ]?generated|automatically (?:generated|created|produced)|(?:generated|produced|created|written) automatically|machine[- ](?:generated|written|made))\b(?! (?:reports?|docs?|documentation|method stub))|\b(?:code|file|this) generated (?:by|from|with)\b|^\W*generated (?:by|from|with)\b|@generated\b|<auto-?generated|autogenerated file|do not (?:edit|modify|change)\b(?: this file| by hand)?|do not edit|changes? (?:to this file )?will be (?:lost|overwritten)|regenerate instead of editing|created by (?:the )?[\w.\- ]+ (?:compiler|generator)\b",
    re.I,
)
BANNER = re.compile(r"^[\W_]*(?P<name>[A-Za-z@][\w.\-/@]*?)[\s,]+(?:v(?:ersion)?\s*)?\d+(?:\.\d+)+\S*", re.I)
LIBRARY = re.compile(r"^[\W_]*(?P<name>[A-Za-z@][\w.\-/]*)\s+-\s+.*\b(?:library|toolkit|framework|plugin|polyfill|helpers?)\b", re.I)
FOREIGN = re.compile(r"contributors|upstream|released under|licen[cs]ed under|\bMIT\b|\bBSD|apache|\(c\)|©|copyright", re.I)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?)(?![\w])")
_TEMPLATE = re.compile(r"`(?:[^`\\]|\\(?s:.))*`")
_NAME = re.compile(r"[^\W\d]\w*")


def head(text: str) -> list[str]:
    """Lines of the comments before the first code, without their marks."""
    out, pos = [], 0
    text = text.lstrip("﻿")
    while m := re.compile(r"\s*(?:#![^\n]*\n\s*)?(//[^\n]*|/\*(?s:.*?)\*/|#(?!include|define|if|pragma)[^\n]*|<!--(?s:.*?)-->)").match(text, pos):
        out += [x for line in m[1].split("\n") if (x := re.sub(r"^[\s/*#!<\-]+|[\s*/\->]+$", "", line)) or "<auto" in line and (x := line)]
        pos = m.end()
    return out


def generated_head(lines: list[str]) -> bool:
    return any(GENERATED.search(x) for x in lines)


def foreign_head(lines: list[str], repo: str | None) -> bool:
    """Whether the head is the banner of another project."""
    for x in lines[:3]:
        m = BANNER.match(x) or LIBRARY.match(x)
        if m and m["name"].lower() != (repo or "").lower() and (FOREIGN.search(" ".join(lines[:8])) or m.re is BANNER and len(x) < 60):
            return not re.match(r"(?:version|python|copyright|since|release|build|part)$", m["name"], re.I)
    return False


def own_head(lines: list[str], repo: str | None) -> bool:
    return bool(repo) and any(re.search(rf"(?<![\w-]){re.escape(repo)}(?![\w-])", x) for x in lines)


def layout(text: str) -> tuple[bool, bool, bool, int]:
    """(numbered shapes of a generator, minified, data, lines of code)."""
    code = re.sub(r"(?m)^[ \t]*(?://|#(?!\w)|\*|/\*|--)[^\n]*$", "", text)
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return False, False, False, 0
    literals = _LITERAL.findall(code)
    bare = _LITERAL.sub("0", _TEMPLATE.sub("0", code))
    names = len(_NAME.findall(bare))
    inside = sum(map(len, literals))
    data = len(literals) >= 10 and names <= 0.25 * len(literals) + 6 and inside >= 0.5 * len(re.sub(r"\s", "", code)) and (len(literals) >= 20 or inside > 400)
    rest = bare.split("\n")
    long = [x for x in rest if len(x) > 300]
    size = sum(map(len, long))
    minified = not data and size > 0.6 * len(bare) and size > 300 and sum(x.count(" ") for x in long) < 0.12 * size
    numbered = False
    if len(lines) >= 15 and not data:
        row = [int(n) for n in re.findall(r"[_A-Za-z](\d{1,9})\b", bare)]
        counted = set(row)
        steps = [b > a for a, b in zip(row, row[1:]) if a != b]
        if len(counted) >= 5 and max(counted) - min(counted) <= 3 * len(counted) and sum(steps) >= NUMBERED_ON * len(steps):
            shapes = {re.sub(r"\d+", "0", _NAME.sub(lambda m: re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", m[0])), x.strip())) for x in lines}
            numbered = len(shapes) <= max(6, 0.12 * len(lines))
    return numbered, minified, data, len(lines)


def kinds(path: str | None, text: str | None, repo: str | None) -> tuple[str | None, str | None, bool, int]:
    """(kind by the file itself, the rule that says so, whether the head names its own repository, lines of code)."""
    if not text or not text.strip() or not path:
        return None, None, False, 0
    lines = head(text)
    own = own_head(lines, repo)
    numbered, minified, data, n = layout(text)
    page = re.match(r"\s*<(?:!doctype|html)", text, re.I)
    rules = [
        ("vendored", "banner", not own and foreign_head(lines, repo)), ("vendored", "path", VENDOR_PATH.search(path)), ("generated", "header", generated_head(lines)), ("generated", "layout", numbered), ("generated", "path", GENERATED_PATH.search(path)),
        ("minified", "layout", minified), ("minified", "path", MINIFIED_PATH.search(path)), ("data", "layout", data),
    ]
    kind, rule = next(((k, r) for k, r, hit in rules if hit), (None, None))
    return kind, rule, own, 0 if page and kind is None else n


def _rows(batch: dict[str, list]) -> Iterable[tuple]:
    for i, repo, path, text, h in zip(*(batch[c] for c in ("file_id", "repo", "file_path", "source_text", "hash"))):
        kind, rule, own, n = kinds(path, text, repo)
        yield i, repo, path, h, kind, rule, own, n


def _mix(h: Column, seed: int) -> Column:
    """40 bits, so that sums over the children of a directory stay within a long."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), h), 24)


def families(leaves: DataFrame) -> DataFrame:
    """(repo, family) of the repositories that share ``RELATED`` of their files with others; any other is a family of its own."""
    one = leaves.groupBy("hash").agg(F.min("repo").alias("one"), F.max("repo").alias("other")).where(F.col("one") != F.col("other")).select("hash", "one")
    total = leaves.groupBy("repo").agg(F.count("*").alias("files"))
    with_ = leaves.join(one, "hash").groupBy("repo", "one").agg(F.count("*").alias("n")).groupBy("repo").agg(F.sum("n").alias("n"), F.max_by("one", F.struct("n", "one")).alias("family"))
    return total.join(with_, "repo").where((F.col("files") >= FEW) & (F.col("n") >= RELATED * F.col("files"))).select("repo", "family")


def nodes_of(leaves: DataFrame) -> DataFrame:
    """(repo, node, a, b, files, lines) of all files and directories; ``leaves``: repo, node (path), hash, lines. (a, b) is the hash of a node."""
    parts = F.split("node", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    up = leaves.select("repo", up.alias("node"), F.xxhash64("hash").alias("h"), "lines")
    return up.groupBy("repo", "node").agg(F.sum(_mix(F.col("h"), 1)).alias("a"), F.sum(_mix(F.col("h"), 2)).alias("b"), F.count("*").alias("files"), F.sum("lines").alias("lines"))


def shared_subtrees(files: DataFrame) -> DataFrame:
    """(repo, node) of the files and directories whose hash lies in repositories of more than one family; ``files``: repo, node (path), hash, lines."""
    leaves = files.groupBy("repo", "node").agg(F.first("hash").alias("hash"), F.coalesce(F.max("lines"), F.lit(0)).cast("bigint").alias("lines"))
    related = written(families(leaves.where(F.col("lines") >= EVIDENCE_LINES)), "families")
    few = related.count() <= FAMILIES_SENT
    known = nodes_of(leaves).where(F.col("lines") >= EVIDENCE_LINES)
    known = written(known.join(F.broadcast(related) if few else related, "repo", "left").withColumn("family", F.coalesce("family", "repo")), "nodes")
    shared = known.groupBy("a", "b", "files", "lines").agg(F.min("family").alias("one"), F.max("family").alias("other")).where(F.col("one") != F.col("other"))
    return known.join(shared, ["a", "b", "files", "lines"], "left_semi").select("repo", "node")


def classified(file_info: DataFrame, parse_results: DataFrame) -> DataFrame:
    """One row per source file that is not hand-written: file_id, repo, path, kind (generated, minified, vendored or data), rule (tree, banner, path, header or layout)."""
    texts = parse_results.where(F.col("file_id").isNotNull() & F.col("source_text").isNotNull()).select("file_id", "repo", "file_path", "source_text", F.sha2("source_text", 256).alias("hash"))
    seen = rows_out(texts, _rows, "file_id bigint, repo string, file_path string, hash string, kind string, rule string, own boolean, lines int", scan=True).dropDuplicates(["file_id"])
    info = file_info.select("file_id", F.col("repo").alias("in_repo"), "path", F.lower("language").alias("language")).where(F.col("file_id").isNotNull()).dropDuplicates(["file_id"])
    files = written(info.join(seen, "file_id").withColumn("repo", F.coalesce("in_repo", "repo")).withColumn("path", F.coalesce("path", "file_path")).where(F.coalesce("language", paths.language("path")).isNotNull()).drop("in_repo", "file_path"), "origins")
    leaves = files.where(F.col("repo").isNotNull() & F.col("path").isNotNull()).select("repo", F.col("path").alias("node"), "hash", "lines")
    shared = shared_subtrees(leaves)
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    open_ = files.where(~F.col("own") & (F.col("lines") > 0) & F.col("repo").isNotNull() & F.col("path").isNotNull())
    tree = open_.select("file_id", "repo", F.explode(up).alias("node")).join(shared, ["repo", "node"], "left_semi").select("file_id").distinct().withColumn("tree", F.lit(True))
    out = files.join(tree, "file_id", "left").where(F.col("tree") | F.col("kind").isNotNull())
    return out.select("file_id", "repo", "path", F.when(F.col("tree"), "vendored").otherwise(F.col("kind")).alias("kind"), F.when(F.col("tree"), "tree").otherwise(F.col("rule")).alias("rule"))
