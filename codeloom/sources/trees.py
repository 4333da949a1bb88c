"""Source trees, repositories and their logs (O-1 to O-12, O-16, O-17)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from codeloom.functions import paths, text
from codeloom.session import ship, written

MAX_SIZE, BATCH_BYTES, WALKED = 1 << 20, 16 << 20, 2000
EXCLUDED = ("node_modules/**", "venv/**", ".venv/**", "__pycache__/**", ".git/**", "dist/**", "build/**", "*.min.js", "*.lock")


def glob_regex(pattern: str) -> str:
    out = ""
    for ch in pattern:
        out += ".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in ".^$+{}()|[]\\" else ch
    return f"^{out}$"


def excluded(path: Column, patterns: Sequence[str] = EXCLUDED) -> Column:
    """Whether a relative path lies in a hidden or excluded directory, or matches a glob (O-1, O-68)."""
    dirs = [p[:-3] for p in patterns if p.endswith("/**")]
    hit = path.rlike(r"(^|/)\.[^/]+/")
    for d in dirs:
        hit = hit | path.rlike(rf"(^|/)\Q{d}\E/")
    for p in patterns:
        if not p.endswith("/**"):
            hit = hit | path.rlike(glob_regex(p))
    return hit


def listed(spark: SparkSession, root: str, patterns: Sequence[str] = EXCLUDED) -> DataFrame:
    """Files below a root that all executors see (a path, or a URI of a file system Arrow knows): path, size_bytes, last_modified.

    Tasks walk down from the directories they get; what one leaves after ``WALKED`` entries is shared out anew. Excluded
    directories are not entered. Names may start with ``_``, which Spark's own readers hide.
    """
    ship(spark)
    uri, skipped = root.removeprefix("file://").rstrip("/") or "/", {p[:-3] for p in patterns if p.endswith("/**")}
    hidden = bool(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa_fs.FileSystem.from_uri(uri)
        for b in batches:
            todo, rows, seen = b.column(0).to_pylist(), [], 0
            while todo and seen < WALKED:
                d = todo.pop()
                for x in fs.get_file_info(pa_fs.FileSelector(f"{base}/{d}" if d else base, recursive=False, allow_not_found=True)):
                    path = f"{d}/{x.base_name}" if d else x.base_name
                    seen += 1
                    if x.type == pa_fs.FileType.File:
                        rows.append((path, False, x.size or 0, x.mtime))
                    elif x.type == pa_fs.FileType.Directory and x.base_name not in skipped and not (hidden and x.base_name.startswith(".")):
                        todo.append(path)
            cols = list(zip(*rows, *((d, True, 0, None) for d in todo))) if rows or todo else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")))], names=["path", "is_dir", "size_bytes", "last_modified"])

    level, out = spark.createDataFrame([("",)], "dir string"), None
    while True:
        found = written(level.mapInArrow(run, "path string, is_dir boolean, size_bytes bigint, last_modified timestamp"), "listing")
        files = found.where("not is_dir").drop("is_dir")
        out = files if out is None else out.unionByName(files)
        level = found.where("is_dir").select(F.col("path").alias("dir"))
        n = level.count()
        if not n:
            return out
        level = level.repartition(max(1, min(n, 10 * spark.sparkContext.defaultParallelism)))


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """Listed files with their bytes as ``content``, in Arrow batches of some MB, spread over all cores."""
    spark = ship(files.sparkSession)
    uri = root.removeprefix("file://").rstrip("/") or "/"
    names = files.columns
    at, schema = names.index("path"), StructType([*files.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa_fs.FileSystem.from_uri(uri)
        for b in batches:
            start, size, got = 0, 0, []
            for k, p in enumerate(b.column(at).to_pylist()):
                with fs.open_input_stream(f"{base}/{p}") as f:
                    got.append(f.read())
                size += len(got[-1])
                if size > BATCH_BYTES or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(got)).columns, pa.array(got, pa.binary())], names=[*names, "content"])
                    start, size, got = k + 1, 0, []

    return files.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(run, schema)


def scan(spark: SparkSession, root: str, patterns: Sequence[str] = EXCLUDED, languages: Sequence[str] | None = None, max_size: int = MAX_SIZE) -> DataFrame:
    """Files of a tree with text and hash: path, language, size_bytes, last_modified, hash, source_text. Size, name and directory are judged before contents are read."""
    lang = paths.language(F.col("path"))
    f = listed(spark, root, patterns).where((F.col("size_bytes") <= max_size) & lang.isNotNull() & ~excluded(F.col("path"), patterns))
    if languages is not None:
        f = f.where(lang.isin(*languages))
    f = with_contents(f.select("path", lang.alias("language"), "size_bytes", "last_modified"), root)
    return f.select("path", "language", "size_bytes", "last_modified", F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("source_text"))


def pages(spark: SparkSession, root: str) -> DataFrame:
    """Markdown pages of a tree: path, title, content (O-16, O-17)."""
    t = with_contents(listed(spark, root, ()).where("path like '%.md'").select("path"), root).select("path", F.decode("content", "UTF-8").alias("content"))
    return t.select("path", text.title(F.col("content"), F.col("path")).alias("title"), "content")


RECORD = "\x1e"  # starts each commit of a log


def _git(repo: str, *args: str) -> str | None:
    r = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    return r.stdout.strip() if r.returncode == 0 else None


def git_remote(repo: str) -> str | None:
    """The address of the remote ``origin``, null without one (O-12)."""
    return _git(repo, "remote", "get-url", "origin") or None


def git_branch(repo: str) -> str:
    """The default branch (O-12): what the remote's HEAD names, else the branch checked out, else ``main``."""
    head = _git(repo, "symbolic-ref", "--short", "refs/remotes/origin/HEAD")
    here = _git(repo, "rev-parse", "--abbrev-ref", "HEAD")
    return (head or "").removeprefix("origin/") or (here if here and here != "HEAD" else "main")


def write_git_log(repo: str, path: str, most: int | None = None) -> bool:
    """The log of a repository as a file that ``git_logs`` reads, written by git itself; False where there is none."""
    args = ["git", "-C", repo, "log", f"--pretty=format:{RECORD}%h|%H|%an|%aI|%s", "--name-only"] + ([f"--max-count={most}"] if most else [])
    with open(path, "wb") as f:
        return subprocess.run(args, stdout=f, stderr=subprocess.DEVNULL).returncode == 0


def git_logs(spark: SparkSession, path: str) -> DataFrame:
    """Commits of log files, one a repository, whose name is the repository's: see ``commits``."""
    t = spark.read.option("lineSep", RECORD).text(path).where(F.trim("value") != "")
    return commits(t.select(paths.stem(F.col("_metadata.file_name")).alias("repo"), F.col("value").alias("record")))


def commits(records: DataFrame) -> DataFrame:
    """Commits of log records (repo, record): repo, hash, full_hash, author, ts (zone dropped), message, file, one row per file or one with null (O-8).

    A record is a header of five parts between bars, whose message keeps its own, and the files below it; others are left out.
    """
    lines = F.split("record", "\n")
    p = F.split(F.get(lines, F.lit(0)), r"\|", 5)
    at = lambda k: F.get(p, F.lit(k))
    files = F.array_distinct(F.filter(F.transform(F.slice(lines, 2, F.size(lines)), F.trim), lambda x: x != ""))
    ts = F.try_to_timestamp(F.substring(F.regexp_replace(at(3), "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    x = records.where(F.size(p) >= 5).select("repo", at(0).alias("hash"), at(1).alias("full_hash"), at(2).alias("author"), ts.alias("ts"), at(4).alias("message"), files.alias("files"))
    return x.select("repo", "hash", "full_hash", "author", "ts", "message", F.explode_outer("files").alias("file")).distinct()


def blame(lines: DataFrame) -> DataFrame:
    """Blamed lines of porcelain output (file, at, text): file, line, commit, author, email, ts, summary (O-9, O-10).

    What is said of a commit only once is carried to its other lines.
    """
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = lines.withColumn("commit", F.last(F.nullif(F.regexp_extract("text", head, 1), F.lit("")), ignorenulls=True).over(w)).withColumn("line", F.last(F.nullif(F.regexp_extract("text", head, 2), F.lit("")), ignorenulls=True).over(w).cast("int"))
    field = lambda k: F.max(F.when(F.col("text").startswith(k + " "), F.substring("text", len(k) + 2, 2**31 - 1)))
    about = x.groupBy("file", "commit").agg(field("author").alias("author"), field("author-mail").alias("email"), field("author-time").cast("bigint").alias("t"), field("summary").alias("summary"))
    at = x.where(F.col("text").startswith("\t")).select("file", "line", "commit")
    j = at.join(about, ["file", "commit"]).where("author is not null and t is not null")
    return j.select("file", "line", "commit", "author", F.regexp_replace("email", "[<>]", "").alias("email"), F.timestamp_seconds("t").alias("ts"), "summary")
