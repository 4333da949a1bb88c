"""More registered queries of the core, one for each operator that those of ``queries`` do not reach, with their SQL.

What an operator reads that the tables do not hold as such (logs, blame, manifests, events of files) is written from them
first, in full, in the form that the operator parses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.extract import chunks as extract
from codeloom.extract import tests
from codeloom.functions import paths, text
from codeloom.operators import cache, changes, context, history, imports, ranking, reports, store, toc
from codeloom.plans import pages, queries
from codeloom.plans.queries import CHUNKS, FILES, PARSED, chunks, files, parsed, query
from codeloom.session import shared_dir
from codeloom.sinks import output
from codeloom.sources import manifests, trees
from codeloom.sources.tables import table
from codeloom.streaming import events as stream


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


# Sources


@query("SELECT o_orderstatus AS repo, left(sha1(CAST(o_orderkey AS VARCHAR)), 7) AS hash, sha1(CAST(o_orderkey AS VARCHAR)) AS full_hash, 'c' || o_custkey AS author, o_orderdate AS ts, 'order|' || o_orderpriority AS message, 'p/' || l_partkey || '.py' AS file FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def git_log(spark: SparkSession, d: str) -> DataFrame:
    """O-8: logs with a commit for each order and its parts as files."""
    o, key = table(spark, d, "orders"), F.sha1(F.col("o_orderkey").cast("string"))
    head = F.concat_ws("|", F.left(key, F.lit(7)), key, F.concat(F.lit("c"), "o_custkey"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.concat(F.lit("order|"), "o_orderpriority"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p/"), "l_partkey", F.lit(".py"))).alias("files"))  # of one order
    r = o.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderstatus").alias("repo"), F.concat_ws("\n", F.array(head), F.coalesce("files", F.array().cast("array<string>"))).alias("record"))
    return trees.commits(r)


_BLAMED = "b AS (SELECT event_type AS file, event_id AS line, sha1(event_type || user_id) AS commit, 'user ' || user_id AS author, user_id || '@example.invalid' AS email, min(ts) OVER (PARTITION BY event_type, user_id) AS ts, 'work of ' || user_id AS summary FROM events)"


def _blame(spark: SparkSession, d: str) -> DataFrame:
    """Porcelain blame of a file per type of event, a line per event, a commit per user, told of once."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.min("ts").over(Window.partitionBy("event_type", "user_id")).alias("ts"), F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")).alias("n"))
    user = F.col("user_id").cast("string")
    head = F.concat(F.sha1(F.concat("event_type", user)), F.lit(" 1 "), F.col("event_id").cast("string"))
    about = F.array(F.concat(F.lit("author user "), user), F.concat(F.lit("author-mail <"), user, F.lit("@example.invalid>")), F.concat(F.lit("author-time "), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")), F.concat(F.lit("summary work of "), user))
    lines = F.concat(F.array(head), F.when(F.col("n") == 1, about).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("\t"), "event_type")))
    return e.select(F.col("event_type").alias("file"), "event_id", F.posexplode(lines).alias("k", "text")).select("file", (F.col("event_id") * 10 + F.col("k")).alias("at"), "text")


@query(f"WITH {_BLAMED} SELECT file, CAST(line AS INT) AS line, commit, author, email, summary, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM b")
def git_blame(spark: SparkSession, d: str) -> DataFrame:
    """O-9, O-10."""
    return trees.blame(_blame(spark, d)).select("file", "line", "commit", "author", "email", "summary", F.unix_timestamp("ts").alias("seconds"))


@query(f"WITH {_BLAMED} SELECT file, CAST(line AS INT) AS line, CASE WHEN length(author) > 20 THEN left(author, 17) || '...' ELSE author END AS author, CASE WHEN length(summary) > 30 THEN left(summary, 27) || '...' ELSE summary END AS summary FROM (SELECT file, line, author || ' of the ' || file || ' team' AS author, summary || ' for the ' || file || ' events of the month' AS summary FROM b)")
def blame_table(spark: SparkSession, d: str) -> DataFrame:
    """O-118."""
    b = trees.blame(_blame(spark, d)).withColumn("author", F.concat("author", F.lit(" of the "), "file", F.lit(" team"))).withColumn("summary", F.concat("summary", F.lit(" for the "), "file", F.lit(" events of the month")))
    return history.blame_view(b).select("file", "line", "author", "summary")


@query(f"WITH {PARSED} SELECT repo || '/' || file_path AS path, strlen(source_text) AS size_bytes, sha256(source_text) AS hash, length(source_text) AS chars FROM parsed WHERE strlen(source_text) <= 1048576 AND regexp_matches(lower(file_path), '[^/]\\.(py|pyi|js|jsx|mjs|ts|tsx|go|rs|java|c|h|rb|rake|gemspec)$') AND NOT (regexp_matches(file_path, '(^|/)\\.[^/]+/') OR regexp_matches(file_path, '(^|/)(node_modules|venv|\\.venv|__pycache__|\\.git|dist|build)/') OR file_path LIKE '%.min.js' OR file_path LIKE '%.lock')")
def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """O-1, O-3 to O-5: all texts written as a tree of files, scanned."""
    root = _place(spark, "tree").removeprefix("file://")
    p = parsed(spark, d).select(F.concat("repo", F.lit("/"), "file_path").alias("path"), F.col("source_text").alias("content"))
    output.write_pages(p, root).agg(F.sum("bytes")).collect()
    return trees.scan(spark, root).select("path", "size_bytes", "hash", F.length("source_text").alias("chars"))


@query("SELECT 'd' || doc_id || '.md' AS path, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def page_scan(spark: SparkSession, d: str) -> DataFrame:
    """O-16, O-17, O-185: pages written one file each, and read again."""
    root = _place(spark, "pages").removeprefix("file://")
    p = documents(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    output.write_pages(p, root).agg(F.sum("bytes")).collect()
    return trees.pages(spark, root).select("path", F.sha2("content", 256).alias("hash"))


_NEEDS = "n AS (SELECT DISTINCT 'r' || l_suppkey AS repo, 'p' || l_partkey AS name, l_partkey % 4 AS kind FROM lineitem)"


def _needs(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of each of four kinds for every supplier, of the parts it delivers."""
    n = table(spark, d, "lineitem").select(F.concat(F.lit("r"), "l_suppkey").alias("repo"), F.concat(F.lit("p"), "l_partkey").alias("name"), (F.col("l_partkey") % 4).alias("kind")).distinct()
    g = n.groupBy("repo", "kind").agg(F.sort_array(F.collect_list("name")).alias("names"))  # of one manifest
    each = lambda f, sep: F.array_join(F.transform("names", f), sep)
    body = (
        F.when(F.col("kind") == 0, F.concat(F.lit('{"name": "x", "devDependencies": {'), each(lambda x: F.concat(F.lit('"'), x, F.lit('": "^1"')), ", "), F.lit("}}")))
        .when(F.col("kind") == 1, F.concat(F.lit("# needs\n-r other.txt\n"), each(lambda x: F.concat(x, F.lit("[more]>=2 ; python_version > '3'")), "\n")))
        .when(F.col("kind") == 2, F.concat(F.lit("module h.example/o/x\n\nrequire (\n"), each(lambda x: F.concat(F.lit("\th.example/o/"), x, F.lit(" v3.0.0 // indirect")), "\n"), F.lit("\n)\n")))
        .otherwise(F.concat(F.lit('<project xmlns="m"><dependencies>'), each(lambda x: F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>"), x, F.lit("</artifactId></dependency>")), ""), F.lit("</dependencies></project>")))
    )
    name = F.element_at(F.array(*[F.lit(x) for x in ("package.json", "requirements.txt", "go.mod", "pom.xml")]), (F.col("kind") + 1).cast("int"))
    return g.select("repo", F.concat("repo", F.lit("/"), name).alias("path"), body.alias("text"))


@query(f"WITH {_NEEDS} SELECT repo, ['package.json', 'requirements.txt', 'go.mod', 'pom.xml'][kind + 1] AS file, name, ['^1', '>=2', 'v3.0.0', '*'][kind + 1] AS version, kind = 0 AS is_dev FROM n")
def manifest_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """O-14, O-151, O-152."""
    return manifests.dependencies(_needs(spark, d))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'p' || p_partkey END AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN '>=' || p_size ELSE '*' END AS version FROM part")
def requirement_lines(spark: SparkSession, d: str) -> DataFrame:
    """O-150."""
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), "p_name")).otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("[x] "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(">="), F.col("p_size").cast("string"))).otherwise(""), F.lit("  # needed")))
    return table(spark, d, "part").select("p_partkey", text.requirement(line).alias("r")).select("p_partkey", "r.name", "r.version")


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(regexp_replace(name, '[-_]', '', 'g')), '{'|'.join(ws)}') THEN '{c}'" for c, ws in reports.CATEGORIES.items()) + " ELSE 'Other' END"
_PACKAGES = [w + t for ws in reports.CATEGORIES.values() for w in ws for t in ("", "-Plus", "_x")]


@query("WITH w AS (SELECT " + "[" + ", ".join(f"'{x}'" for x in _PACKAGES) + f"] AS w), p AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN w[1 + p_partkey % len(w)] ELSE p_type END AS name FROM part, w) SELECT name, {_CATEGORY} AS category FROM p")
def dependency_categories(spark: SparkSession, d: str) -> DataFrame:
    """O-102."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in _PACKAGES]), (1 + F.col("p_partkey") % len(_PACKAGES)).cast("int"))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select(name.alias("name")).distinct().select("name", reports.dependency_category(F.col("name")).alias("category"))


# The chunk table


@query(f"WITH {CHUNKS} SELECT id, file_path FROM chunks WHERE repo || '/' || file_path NOT IN (SELECT repo || '/' || file_path FROM chunks WHERE language IN ('go', 'rust')) OR language IN ('go', 'rust') AND chunk_type = 'function'")
def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """O-20, O-21, O-25, O-27, O-183: created, appended to, files deleted and some put back."""
    c = chunks(spark, d).select("id", F.concat("repo", F.lit("/"), "file_path").alias("file_path"), "language", "chunk_type")
    s = store.ChunkStore(spark, _place(spark, "store"))
    s.create(c.where("chunk_type <> 'function'"))
    s.append(c.where("chunk_type in ('function', 'class')"))
    gone = c.where("language in ('go', 'rust')")
    s.delete_files(gone)
    s.append(gone.where("chunk_type = 'function'"))
    return s.read().select("id", F.regexp_replace("file_path", "^[^/]*/", "").alias("file_path"))


@query(f"WITH {CHUNKS}, f AS (SELECT min(file_path) AS p, min(id) AS i FROM chunks) SELECT 'file' AS kind, id FROM chunks WHERE file_path = (SELECT p FROM f) UNION ALL SELECT 'id', i FROM f")
def chunk_lookups(spark: SparkSession, d: str) -> DataFrame:
    """O-23, O-24, O-28: by literals that nothing has to escape."""
    c = chunks(spark, d).select("id", "file_path")
    s = store.ChunkStore(spark, _place(spark, "store"), 8)
    s.create(c)
    first = c.agg(F.min("file_path").alias("p"), F.min("id").alias("i")).first()
    return s.by_file(first.p).select(F.lit("file").alias("kind"), "id").unionByName(s.by_id(first.i).select(F.lit("id").alias("kind"), "id"))


@query(f"WITH {CHUNKS} SELECT id, chunk_type, length(content) AS chars FROM chunks")
def table_sink(spark: SparkSession, d: str) -> DataFrame:
    """O-179, O-183: written in files of a bounded number of rows."""
    at = _place(spark, "table")
    output.write_table(chunks(spark, d), at, 1000)
    return spark.read.parquet(at).select("id", "chunk_type", F.length("content").alias("chars"))


@query(f"WITH {FILES} SELECT file_id, path, hash FROM files")
def status_sink(spark: SparkSession, d: str) -> DataFrame:
    """O-15, O-184, O-186: a snapshot as lines of JSON."""
    at = _place(spark, "status")
    output.write_json_lines(files(spark, d).select("file_id", "path", "hash"), at)
    return spark.read.schema("file_id bigint, path string, hash string").json(at)


# Texts

_RELATIVE = """a AS (SELECT DISTINCT path AS source, lead(path) OVER (ORDER BY path) AS target FROM (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL)), b AS (SELECT source, target, string_split(source, '/')[:-2] AS s, string_split(target, '/') AS t FROM a WHERE target IS NOT NULL),
c AS (SELECT *, len(list_filter(range(1, least(len(s), len(t) - 1) + 1), lambda k: s[1:k] = t[1:k])) AS n FROM b)"""


@query(f"WITH {_RELATIVE} SELECT source, target, array_to_string(list_concat(list_transform(range(0, len(s) - n), lambda k: '..'), t[n + 1:]), '/') AS way FROM c")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """O-144: from each page to the next by path."""
    p = table(spark, d, "documents").select("path").where("path is not null").distinct()
    section = F.substring_index("path", "/", 1)  # the next of all is that of the section, or the first of the next section
    inner = p.withColumn("section", section).select("section", F.col("path").alias("source"), F.lead("path").over(Window.partitionBy("section").orderBy("path")).alias("target"))
    firsts = p.groupBy(section.alias("section")).agg(F.min("path").alias("first"))
    after = firsts.select("section", F.lead("first").over(Window.orderBy("first")).alias("after"))  # a row for each section
    j = inner.join(after, "section").withColumn("target", F.coalesce("target", "after")).where("target is not null")
    return j.select("source", "target", text.relative_path(F.col("source"), F.col("target")).alias("way"))


@query("SELECT DISTINCT path, array_to_string(list_transform(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/')), '|') AS crumbs FROM documents WHERE path IS NOT NULL")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """O-160."""
    return table(spark, d, "documents").where("path is not null").select("path", F.array_join(text.breadcrumbs(F.col("path")), "|").alias("crumbs")).distinct()


@query(f"WITH e AS (SELECT event_id, ts, date_diff('day', CAST(ts AS DATE), DATE '2024-02-10') AS d FROM events) SELECT event_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 14 THEN '1 week ago' WHEN d < 30 THEN d // 7 || ' weeks ago' ELSE strftime(ts, '%b %d, %Y') END AS ago FROM e")
def dates_ago(spark: SparkSession, d: str) -> DataFrame:
    """O-147."""
    return table(spark, d, "events").select("event_id", text.days_ago(F.col("ts"), F.to_date(F.lit("2024-02-10"))).alias("ago"))


@query("WITH p AS (SELECT p_partkey, p_partkey * p_size AS s FROM part) SELECT p_partkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm' END AS took FROM p")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """O-148."""
    return table(spark, d, "part").select("p_partkey", text.duration(F.col("p_partkey") * F.col("p_size")).alias("took"))


@query(r"SELECT doc_id, sha256(regexp_replace(text || chr(10) || '## See Also' || chr(10) || 'a' || chr(10) || '## End' || chr(10), '(?s)## See Also.*?(## |\z)', '\1', 'g')) AS hash FROM documents WHERE text IS NOT NULL")
def pages_without_section(spark: SparkSession, d: str) -> DataFrame:
    """O-157."""
    return documents(spark, d).select("doc_id", F.sha2(text.without_section(F.concat("text", F.lit("\n## See Also\na\n## End\n")), "See Also"), 256).alias("hash"))


@query(r"WITH p AS (SELECT doc_id, regexp_split_to_array(text, '(?m)^[ \t]*(?:```|~~~)[^\n]*$\n?') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(p) AS parts, CAST(list_sum(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN k % 2 = 0 THEN length(p[k]) ELSE 0 END)) AS BIGINT) AS code_chars FROM p")
def fence_segments(spark: SparkSession, d: str) -> DataFrame:
    """O-155."""
    s = text.segments(F.col("text"))
    chars = F.aggregate(s, F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["is_code"], F.length(x["text"])).otherwise(0))
    return documents(spark, d).select("doc_id", F.size(s).cast("bigint").alias("parts"), chars.alias("code_chars"))


@query(r"SELECT 'd' || doc_id || '.html' AS path, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '# '))) AS titles FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '~~~')")
def html_titles(spark: SparkSession, d: str) -> DataFrame:
    """O-188: pages without fences as HTML, and the headings of the first order in it."""
    p = documents(spark, d).where("not contains(text, '```') and not contains(text, '~~~')").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return output.html_pages(p).select("path", F.size(F.regexp_extract_all("content", F.lit("<h1 "), F.lit(0))).cast("bigint").alias("titles"))


@query(f"WITH {CHUNKS} SELECT id, CASE WHEN language = 'python' THEN length(docstring) ELSE 0 END >= 0 AS ok, trim(regexp_replace(regexp_extract(docstring, '(?s)^(.*?)(?:$|\\n\\s*(?i:args|arguments|parameters|returns|return|raises|raise|example|examples|note|notes|yields):\\s*(?:\\n|$))', 1), '\\s+', ' ', 'g')) AS description FROM chunks WHERE docstring IS NOT NULL AND NOT contains(docstring, '---')")
def docstring_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """O-54 to O-56."""
    from codeloom.extract.docstrings import described

    return described(chunks(spark, d).where("docstring is not null and not contains(docstring, '---')").select("id", "docstring")).withColumn("ok", F.lit(True)).select("id", "ok", "description")


# Snapshots, pages and their sources


@query(f"WITH {FILES}, {PARSED} SELECT f.file_id, f.path, CASE WHEN f.hash = sha256(p.source_text) THEN 'before' ELSE 'now' END AS from_ FROM files f LEFT JOIN parsed p USING (file_id)")
def next_files(spark: SparkSession, d: str) -> DataFrame:
    """O-71, O-121: unchanged files keep their row."""
    now = files(spark, d).select("file_id", "path", "hash", F.lit("now").alias("from_"))
    before = parsed(spark, d).select("file_id", F.col("file_path").alias("path"), F.sha2("source_text", 256).alias("hash"), F.lit("before").alias("from_"))
    return changes.next_snapshot(now, before, "file_id").select("file_id", "path", "from_")


@query("WITH l AS (SELECT DISTINCT 'o' || l_orderkey AS page, 'p' || l_partkey AS source, l_partkey FROM lineitem), r AS (SELECT page, source, CASE WHEN l_partkey % 3 = 0 THEN 'files/' || source || '.md' END AS target, row_number() OVER w AS n, count(*) OVER (PARTITION BY page) AS every FROM l WINDOW w AS (PARTITION BY page ORDER BY source)) SELECT page, CAST(max(every) AS BIGINT) AS every, string_agg(source || coalesce('>' || target, ''), ',' ORDER BY source) FILTER (WHERE n <= 3) AS links FROM r GROUP BY page")
def page_sources(spark: SparkSession, d: str) -> DataFrame:
    """O-84, O-158."""
    l = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("page"), F.concat(F.lit("p"), "l_partkey").alias("source"), "l_partkey")
    targets = l.where("l_partkey % 3 = 0").select("source", F.concat(F.lit("files/"), "source", F.lit(".md")).alias("target")).distinct()
    s = changes.sources_of_pages(l.select("page").distinct(), l.select("page", "source"), targets, 3)
    link = F.transform("sources", lambda x: F.concat(x["source"], F.coalesce(F.concat(F.lit(">"), x["target"]), F.lit(""))))
    return s.select("page", F.col("all").alias("every"), F.array_join(link, ",").alias("links"))


@query("WITH p AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL) SELECT path FROM p WHERE NOT starts_with(path, 'files/')")
def unlisted_pages(spark: SparkSession, d: str) -> DataFrame:
    """O-125."""
    p = table(spark, d, "documents").where("path is not null").select("path").distinct()
    return toc.not_listed(p, p.where("path like 'files/%'").select(F.col("path").alias("key")))


_ORDER = "[" + ", ".join(f"'{x}'" for x in toc.ROOT_ORDER) + "]"


@query(
    f"""WITH RECURSIVE p AS (SELECT DISTINCT string_split(path, '/') AS p FROM documents WHERE path IS NOT NULL), s AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS key, k AS depth, k < len(p) AS is_dir FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM p)),
    n AS (SELECT *, regexp_replace(key, '/?[^/]*$', '') AS parent, row_number() OVER (PARTITION BY regexp_replace(key, '/?[^/]*$', '') ORDER BY is_dir, coalesce(list_position({_ORDER}, key), {len(toc.ROOT_ORDER) + 1}), key) AS n FROM s),
    t AS (SELECT key, CAST(n AS VARCHAR) AS number, depth, is_dir FROM n WHERE depth = 1 UNION ALL SELECT n.key, t.number || '.' || n.n, n.depth, n.is_dir FROM t JOIN n ON n.parent = t.key AND t.is_dir AND n.depth = t.depth + 1) SELECT key, number, CAST(depth AS INT) AS depth, is_dir FROM t"""
)
def contents(spark: SparkSession, d: str) -> DataFrame:
    """O-113, O-114."""
    return toc.numbered(table(spark, d, "documents").where("path is not null").select("path").distinct())


# Use of entities


@query(
    f"WITH {FILES}, f AS (SELECT DISTINCT path, replace(string_split(path, '/')[-1], '.py', '') AS b FROM files WHERE path LIKE '%.py'), t AS (SELECT DISTINCT regexp_replace(path, '[^/]*$', '') || 'tests/test_' || b || '_more.py' AS test_path, b FROM f WHERE NOT starts_with(b, 'test_')), p AS (SELECT test_path, array_to_string(string_split(b || '_more', '_')[1:k], '_') AS n FROM t, LATERAL (SELECT unnest(range(1, len(string_split(b || '_more', '_')) + 1)) AS k)) SELECT DISTINCT f.path, p.test_path FROM f JOIN p ON f.b = p.n WHERE NOT starts_with(f.b, 'test_')"
)
def test_files(spark: SparkSession, d: str) -> DataFrame:
    """O-19: with a test file beside each Python file."""
    f = files(spark, d).select("path").where("path like '%.py'").distinct()
    base = F.regexp_replace(paths.base_name(F.col("path")), r"\.py$", "")
    more = f.where(~base.startswith("test_")).select(F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.lit("tests/test_"), base, F.lit("_more.py")).alias("path"))
    return context.test_files(f.unionByName(more))


@query(f"WITH {FILES} SELECT file_id, starts_with(m, 'test_') OR contains(m, '.test_') OR contains(path, '/tests/') OR starts_with(path, 'tests/') AS is_test FROM (SELECT *, replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.\\w+$', ''), '/', '.') AS m FROM files)")
def test_modules(spark: SparkSession, d: str) -> DataFrame:
    """O-66."""
    return files(spark, d).select("file_id", reports.is_test_module(imports.dotted(F.col("path")), F.col("path")).alias("is_test"))


_SIGNS = " + ".join(f"contains(c, '{x}')::INT" for x in ("mock", "Mock", "patch(", "MagicMock", "monkeypatch", "side_effect"))


@query(f"WITH {CHUNKS}, t AS (SELECT id, CASE WHEN start_line % 3 = 0 THEN content || ' monkeypatch.setattr(mock)' ELSE content END AS c FROM chunks) SELECT id, ({_SIGNS}) >= 2 AS heavy FROM t WHERE c IS NOT NULL")
def mock_heavy(spark: SparkSession, d: str) -> DataFrame:
    """O-60."""
    c = F.when(F.col("start_line") % 3 == 0, F.concat("content", F.lit(" monkeypatch.setattr(mock)"))).otherwise(F.col("content"))
    return chunks(spark, d).select("id", context.mock_heavy(c).alias("heavy")).where("heavy is not null")


@query(
    f"""WITH {CHUNKS}, e AS (SELECT DISTINCT name FROM chunks WHERE chunk_type = 'function' AND name IS NOT NULL), t AS (SELECT repo || '/' || file_path AS test_file, id AS test_name, content AS code FROM chunks WHERE chunk_type IN ('function', 'method') AND length(content) >= 10),
    w AS (SELECT DISTINCT test_file, test_name, code, unnest(regexp_extract_all(code, '[A-Za-z_]\\w*')) AS name FROM t), j AS (SELECT w.* FROM w JOIN e USING (name) QUALIFY row_number() OVER (PARTITION BY name, code ORDER BY test_file, test_name) = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY name, test_file ORDER BY test_name, code) AS k FROM j) SELECT name, test_file, test_name, CAST(row_number() OVER v AS INT) AS "at" FROM k WHERE k <= 2 WINDOW v AS (PARTITION BY name ORDER BY test_file, test_name) QUALIFY row_number() OVER v <= 5"""
)
def usage_examples(spark: SparkSession, d: str) -> DataFrame:
    """O-62, O-87: functions and methods as the tests of functions."""
    c = chunks(spark, d)
    t = c.where("chunk_type in ('function', 'method')").select(F.concat_ws("/", "repo", "file_path").alias("test_file"), F.col("id").alias("test_name"), F.col("content").alias("code"))
    return context.examples(c.where("chunk_type = 'function' and name is not null"), t).select("name", "test_file", "test_name", "at")


_HEADED = f"""{CHUNKS}, c AS (SELECT id, repo || '/' || file_path AS file_path, name, parent_name, chunk_type FROM chunks WHERE name IS NOT NULL), h AS (SELECT file_path AS page, id AS "at", coalesce(parent_name || '.', '') || name AS name, name AS simple, parent_name AS class FROM c WHERE chunk_type IN ('function', 'method', 'class')),
j AS (SELECT page, "at", h.name, c.id, CASE WHEN c.parent_name IS NOT NULL AND h.name = c.parent_name || '.' || simple THEN 1 WHEN c.parent_name IS NULL AND c.chunk_type <> 'class' OR c.parent_name IS NOT DISTINCT FROM class THEN 2 WHEN c.chunk_type = 'class' THEN 3 END AS r FROM h JOIN c ON c.file_path = h.page AND c.name = h.simple),
t AS (SELECT page, "at", name, id FROM j WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, "at" ORDER BY r, id) = 1)"""


def _headed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, d).withColumn("file_path", F.concat_ws("/", "repo", "file_path"))
    h = c.where("chunk_type in ('function', 'method', 'class') and name is not null").select(F.col("file_path").alias("page"), "file_path", F.col("id").alias("at"), F.concat_ws(".", "parent_name", "name").alias("name"), F.col("parent_name").alias("class"))
    return h, c


@query(f'WITH {_HEADED} SELECT page, "at", name, id FROM t')
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    """O-86."""
    return context.heading_chunks(*_headed(spark, d))


@query(f"WITH {_HEADED} SELECT id FROM chunks WHERE id NOT IN (SELECT id FROM t)")
def unused_chunks(spark: SparkSession, d: str) -> DataFrame:
    """O-119."""
    h, c = _headed(spark, d)
    return context.unused_chunks(c, context.heading_chunks(h, c)).select("id")


@query(f"WITH {CHUNKS}, r AS (SELECT DISTINCT name, repo || ':' || file_path AS file_path, regexp_replace(regexp_replace(name, '([^A-Z ])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS alias FROM chunks WHERE chunk_type IN ('class', 'function') AND name NOT LIKE '\\_%' ESCAPE '\\' AND length(name) >= 4 AND NOT contains(name, '_') AND name <> lower(name) AND name <> upper(name)) SELECT alias, min(file_path) AS file_path, min(name) AS name FROM r WHERE alias <> name GROUP BY alias")
def alias_pages(spark: SparkSession, d: str) -> DataFrame:
    """O-198: what each spelled-out name stands for."""
    c = chunks(spark, d).withColumn("file_path", F.concat("repo", F.lit(":"), "file_path"))
    r = reports.registered(c)
    return reports.by_alias(r.select("alias").distinct(), r).select("alias", "file_path", "name")


@query(f"{queries._MODULES}, x AS (SELECT DISTINCT replace(regexp_replace(regexp_replace(file_path, '^src/', ''), '\\.\\w+$', ''), '/', '.') AS module, module AS target FROM mods WHERE module = 'ledger' OR module LIKE 'ledger.%') SELECT DISTINCT regexp_replace(module, '^ledger\\.', '') AS module, regexp_replace(target, '^ledger\\.', '') AS target FROM x WHERE NOT regexp_matches(regexp_replace(module, '^ledger\\.', ''), '(^|\\.)__\\w+__$') AND regexp_replace(module, '^ledger\\.', '') <> regexp_replace(target, '^ledger\\.', '')")
def internal_modules(spark: SparkSession, d: str) -> DataFrame:
    """O-133: of the package ``ledger``."""
    return imports.internal(imports.of_chunks(chunks(spark, d), "file_path"), "ledger")


_RELATED = f"""{queries._MODULES}, {FILES}, f AS (SELECT path, replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.\\w+$', ''), '/', '.') AS dotted FROM files), n AS (SELECT DISTINCT module, string_split(module, '.')[-1] AS last FROM mods),
res AS (SELECT module, min(path) AS path FROM n JOIN f ON string_split(f.dotted, '.')[-1] = n.last WHERE dotted = module OR ends_with(dotted, '.' || module) GROUP BY module), d AS (SELECT DISTINCT m.file_path AS path, res.path AS other FROM mods m JOIN res USING (module) WHERE m.file_path <> res.path), rel AS (SELECT path, other, 'imports' AS kind FROM d UNION ALL SELECT other, path, 'imported_by' FROM d)"""


def _related(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = imports.of_chunks(chunks(spark, d), "file_path", "file_id", "repo")
    return m, imports.relations(m, imports.module_files(m, files(spark, d)))


@query(f"{_RELATED} FROM rel")
def related_files(spark: SparkSession, d: str) -> DataFrame:
    """O-75, O-81."""
    return _related(spark, d)[1]


@query(
    f"""{_RELATED}, x AS (SELECT DISTINCT repo || '/' || file_path AS p, repo || ':' || module AS module FROM mods), s AS (SELECT a.p AS a, b.p AS b, count(*) AS shared FROM x a JOIN x b ON a.module = b.module AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2),
    both_ AS (SELECT a AS path, b AS other, shared FROM s UNION ALL SELECT b, a, shared FROM s), top AS (SELECT path, other, 3 AS rank, 'shares ' || shared || ' dependencies' AS why FROM both_ QUALIFY row_number() OVER (PARTITION BY path ORDER BY shared DESC, other) <= 3),
    al AS (SELECT path, other, CASE kind WHEN 'imported_by' THEN 1 ELSE 2 END AS rank, CASE kind WHEN 'imported_by' THEN 'uses this' ELSE 'dependency' END AS why FROM rel UNION ALL FROM top), once AS (FROM al QUALIFY row_number() OVER (PARTITION BY path, other ORDER BY rank) = 1)
    SELECT path, CAST(row_number() OVER w AS INT) AS "at", other, why FROM once WINDOW w AS (PARTITION BY path ORDER BY rank, other) QUALIFY row_number() OVER w <= 5"""
)
def see_also(spark: SparkSession, d: str) -> DataFrame:
    """O-75, O-120."""
    m, rel = _related(spark, d)
    shared = imports.shared(m.withColumn("module", F.concat_ws(":", "repo", "module")).withColumn("p", F.concat_ws("/", "repo", "file_path")), "p", "module")
    return imports.see_also(rel, shared)


# Search and pages

_INDEX = r"""i AS (SELECT coalesce(path || '#', '') || doc_id AS path, doc_id, coalesce(nullif(trim(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: starts_with(x, '# ') OR regexp_matches(x, '^\*\*.+\*\*$'))[1], '^# |^\*\*|\*\*$', '', 'g')), ''), '') AS title,
list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '#')), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^#+', ''), '[*`]', '', 'g'))), lambda x: x <> '') AS headings, list_filter(regexp_extract_all(text, '`([^`\n]+)`', 1), lambda x: length(x) < 50) AS f, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT path, title, headings, list_sort(list_distinct(list_filter(list_concat(list_transform(f, lambda x: string_split(x, '.')[-1]), list_filter(f, lambda x: contains(x, '.'))), lambda x: x <> ''))) AS terms, """ + queries._PLAIN.replace("text", "text") + r""" AS plain FROM i),
q AS (SELECT path, title, headings, terms, CASE WHEN length(plain) > 200 THEN regexp_replace(substr(plain, 1, 200), '\s+\S*$', '') || '...' ELSE plain END AS snippet FROM p)"""
_SUB = "'(?is)" + ".*".join("anchor") + "'"


@query(
    f"""WITH {_INDEX}, r AS (SELECT path, title, CASE WHEN title = '' THEN 0 WHEN starts_with(lower(title), 'anchor') THEN 150 WHEN contains(lower(title), 'anchor') THEN 100 WHEN regexp_matches(title, {_SUB}) THEN 30 ELSE 0 END + CASE WHEN len(list_filter(headings, lambda x: contains(lower(x), 'anchor'))) > 0 THEN 40 ELSE 0 END
    + coalesce(list_filter(list_transform(terms, lambda x: CASE WHEN contains(lower(x), 'anchor') THEN 60 WHEN regexp_matches(x, {_SUB}) THEN 20 ELSE 0 END), lambda x: x > 0)[1], 0) + CASE WHEN contains(lower(snippet), 'anchor') THEN 10 ELSE 0 END AS score FROM q) SELECT path, title, CAST(score AS INT) AS score FROM r WHERE score > 0 AND title <> '' ORDER BY score DESC, path LIMIT 8"""
)
def search_rank(spark: SparkSession, d: str) -> DataFrame:
    """O-112: over the pages with a title of their own."""
    docs = documents(spark, d).select(F.concat_ws("#", "path", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    own = text.title(F.col("content"), F.lit(""))
    index = ranking.page_index(docs).drop("title").join(docs.select("path", own.alias("title")), "path").where("title <> ''")
    return ranking.search_pages(index, "anchor").select("path", "title", "score")


_BRIEF = "CASE WHEN regexp_matches(l, '(?i)^(args|arguments|parameters|params|returns|return|raises|yields|example|examples|note|notes|attributes)\\s*:') THEN '' WHEN length(l) > {0} THEN substr(l, 1, {0} - 3) || '...' ELSE l END"


@query(
    f"WITH {CHUNKS}, e AS (SELECT *, trim(string_split(trim(docstring, ' '), chr(10))[1], ' ') AS l FROM chunks WHERE chunk_type IN ('class', 'function', 'method') AND name IS NOT NULL) SELECT id, chunk_type AS type, name, CASE WHEN chunk_type = 'method' AND parent_name IS NOT NULL THEN parent_name || '.' || name ELSE name END AS display_name, file_path, "
    + _BRIEF.format(80)
    + " AS description, array_to_string(list_sort(list_distinct(list_filter(list_concat([lower(name)], list_filter(string_split(lower(name), '_'), lambda x: length(x) > 2), list_filter(list_transform(regexp_extract_all(name, '[A-Z][a-z]+|[a-z]+'), lambda x: lower(x)), lambda x: length(x) > 2)), lambda x: x <> ''))), ' ') AS keywords FROM e"
)
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    """O-140, O-141."""
    return ranking.entity_index(chunks(spark, d)).withColumn("keywords", F.array_join("keywords", " "))


_GLOSSARY = (
    f"e AS (SELECT *, coalesce(name, 'Unknown') AS n, trim(string_split(trim(docstring, ' '), chr(10))[1], ' ') AS l FROM chunks WHERE chunk_type IN ('class', 'function', 'method')), g AS (SELECT CASE WHEN regexp_matches(upper(substr(n, 1, 1)), '^\\p{{L}}$') THEN upper(substr(n, 1, 1)) ELSE '#' END AS letter, lower(n) AS k, file_path, id, '- **' || n || '** (' || chunk_type || ', `' || file_path || '`)' || coalesce(': ' || nullif("
    + _BRIEF.format(60)
    + ", ''), '') AS line FROM e), pg AS (SELECT 'glossary/' || CASE letter WHEN '#' THEN 'other' ELSE letter END || '.md' AS path, '# Glossary: ' || letter || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY k, file_path, id) || chr(10) AS content FROM g GROUP BY letter)"
)


@query(f"WITH {CHUNKS}, {_GLOSSARY} SELECT path, sha256(content) AS hash, length(content) AS chars FROM pg")
def glossary_pages(spark: SparkSession, d: str) -> DataFrame:
    """O-93, O-196."""
    return pages.glossary_pages(chunks(spark, d)).select("path", F.sha2("content", 256).alias("hash"), F.length("content").alias("chars"))


_CHANGELOG = f"{queries._COMMITS}, days AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT id) AS commits, count(DISTINCT author) AS authors, count(DISTINCT file) AS changed, list_sort(list(DISTINCT file) FILTER (WHERE file IS NOT NULL))[:5] AS files FROM c GROUP BY 1), cl AS (SELECT 'changelog/' || strftime(day, '%Y-%m') || '.md' AS path, '# Changes of ' || strftime(day, '%Y-%m') || chr(10) || chr(10) || string_agg('- ' || day || ': ' || commits || ' commits by ' || authors || ' authors: ' || coalesce(array_to_string(files, ', '), '') || CASE WHEN changed > coalesce(len(files), 0) THEN ' (+' || (changed - len(files)) || ' more)' ELSE '' END, chr(10) ORDER BY day DESC) || chr(10) AS content FROM days GROUP BY strftime(day, '%Y-%m'))"
_FILES_INDEX = f"{FILES}, fi AS (SELECT 'modules/' || s || '.md' AS path, '# ' || s || chr(10) || chr(10) || string_agg('- [' || p || '](../files/' || regexp_replace(p, '\\.[^./]+$', '') || '.md)', chr(10) ORDER BY p) || chr(10) AS content FROM (SELECT DISTINCT path AS p, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS s FROM files) GROUP BY s)"


@query(f"WITH {CHUNKS}, {_GLOSSARY}, {_CHANGELOG}, {_FILES_INDEX} SELECT path, sha256(content) AS hash FROM (FROM pg UNION ALL FROM cl UNION ALL FROM fi)")
def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    """O-98, O-192, O-193."""
    out = pages.assembled([pages.changelog_pages(queries._commits(spark, d)), pages.files_index(files(spark, d)), pages.glossary_pages(chunks(spark, d)), pages.glossary_pages(chunks(spark, d).limit(0))])
    return out.select("path", F.sha2("content", 256).alias("hash"))


@query(f"WITH RECURSIVE {queries._KIN}, t AS (SELECT name, [name] AS path, 0 AS depth FROM r UNION ALL SELECT e.child, list_append(t.path, e.child), t.depth + 1 FROM t JOIN e ON e.parent = t.name), w AS (FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) = 1) SELECT 'inheritance/' || path[1] || '.md' AS path, sha256('# Inheritance: ' || path[1] || chr(10) || chr(10) || string_agg(repeat('  ', depth) || '- `' || name || '`', chr(10) ORDER BY w.path) || chr(10)) AS hash FROM w GROUP BY path[1]")
def inheritance_pages(spark: SparkSession, d: str) -> DataFrame:
    """O-132, O-197."""
    return pages.inheritance_pages(queries._kin(spark, d)).select("path", F.sha2("content", 256).alias("hash"))


@query(
    f"WITH s AS ({queries._STALE}), t AS (SELECT page, CASE WHEN newest > generated_at THEN date_diff('day', generated_at, newest) END AS d, coalesce(newest > generated_at AND date_diff('day', generated_at, newest) >= 30, false) AS stale FROM s), w AS (SELECT page, d FROM t WHERE stale ORDER BY d DESC, page LIMIT 20) SELECT 'freshness.md' AS path, '# Freshness' || chr(10) || chr(10) || (SELECT count(*) FROM t WHERE stale) || ' of ' || (SELECT count(*) FROM t) || ' pages are behind their sources.' || chr(10) || coalesce(chr(10) || '| page | days |' || chr(10) || '|-|-|' || chr(10) || (SELECT string_agg('| ' || page || ' | ' || d || ' |', chr(10) ORDER BY d DESC, page) FROM w), '') || chr(10) AS content"
)
def stale_page(spark: SparkSession, d: str) -> DataFrame:
    """O-101, O-191."""
    return pages.stale_page(queries._stale(spark, d))


@query(r"SELECT 'd' || doc_id || '.md' AS path, 'Uses [`Alpha`](../x/alpha.md) and [Beta Gamma](../x/beta.md) in ' || lower(lang) || '.' AS content FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL")
def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """O-156: names, and what they are spelled out as."""
    p = table(spark, d, "documents").where("doc_id is not null and lang is not null").select(F.concat(F.lit("w/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Uses `Alpha` and Beta Gamma in "), F.lower("lang"), F.lit(".")).alias("content"))
    r = spark.createDataFrame([("Alpha", None, "x/alpha.md"), ("BetaGamma", "Beta Gamma", "x/beta.md")], "name string, alias string, path string")
    return output.link_pages(p, r).select(F.substring("path", 3, 1000).alias("path"), "content")


_NODE = "CASE WHEN regexp_matches({0}, '^\\d') THEN 'C' ELSE '' END || regexp_replace({0}, '[<>\\[\\].\\-: ]', '_', 'g')"


@query(
    f"""{_RELATED}, e AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS page, path AS a, other AS b, length(path) % 2 = 0 AS cyclic FROM d)
    SELECT page AS path, '```mermaid' || chr(10) || 'flowchart TD' || chr(10) || string_agg('    ' || {_NODE.format("a")} || CASE WHEN cyclic THEN ' -.-> ' ELSE ' --> ' END || {_NODE.format("b")}, chr(10) ORDER BY a, b) || chr(10) || '```' || chr(10) AS content FROM e GROUP BY page"""
)
def dependency_diagrams(spark: SparkSession, d: str) -> DataFrame:
    """O-190: what the files of each top directory import; every second edge as if on a cycle."""
    e = _related(spark, d)[1].where("kind = 'imports'")
    return pages.diagram_pages(e.select(paths.top_directory(F.col("path")).alias("page"), F.col("path").alias("a"), F.col("other").alias("b"), (F.length("path") % 2 == 0).alias("cyclic")))


@query(f"WITH {FILES}, n AS (SELECT language, count(*) AS c FROM files WHERE language IS NOT NULL GROUP BY language) SELECT 'languages.md' AS path, '```mermaid' || chr(10) || 'pie title Files by language' || chr(10) || string_agg('    \"' || language || '\" : ' || c, chr(10) ORDER BY c DESC, language) || chr(10) || '```' || chr(10) AS content FROM n")
def language_pie(spark: SparkSession, d: str) -> DataFrame:
    """O-97, O-190."""
    return pages.language_pie(files(spark, d))


@query()
def call_sequences(spark: SparkSession, d: str) -> DataFrame:
    """O-116, O-130: of every file."""
    return pages.call_sequences(extract.call_edges(parsed(spark, d).withColumn("file_path", F.concat("repo", F.lit("/"), "file_path"))))


# Cache


@query(f"WITH {queries._CACHE}, x AS (SELECT id FROM c WHERE NOT {queries._VALID} ORDER BY created_at NULLS FIRST, id LIMIT 100) SELECT id FROM c WHERE id NOT IN (FROM x)")
def cache_evicted(spark: SparkSession, d: str) -> DataFrame:
    """O-167: over its size, so a hundred of the expired entries go."""
    return cache.evicted(queries._cache(spark, d), queries._now(), 10).select("id")


@query(f"WITH {queries._CACHE}, h AS (SELECT id, count(*) AS n, max(last_hit_at) AS last FROM llm_cache WHERE last_hit_at IS NOT NULL GROUP BY id) SELECT c.id, CAST(coalesce(c.hit_count, 0) + coalesce(n, 0) AS INT) AS hit_count FROM c LEFT JOIN h USING (id)")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """O-165: counts brought up to date from a log."""
    log = table(spark, d, "llm_cache").where("last_hit_at is not null").select("id", F.col("last_hit_at").alias("at"))
    return cache.hits(queries._cache(spark, d), log).select("id", "hit_count")


@query(f"WITH {queries._CACHE}, n AS (SELECT 'new-' || id AS id, sha256(prompt) AS h FROM c WHERE prompt IS NOT NULL AND coalesce(temperature, 0) <= 0.3), a AS (SELECT id, exact_hash FROM c UNION ALL FROM n) SELECT id, exact_hash FROM a")
def cache_put(spark: SparkSession, d: str) -> DataFrame:
    """O-166: answers put into the table of the cache."""
    c = queries._cache(spark, d)
    new = c.where("prompt is not null").select(F.concat(F.lit("new-"), "id").alias("id"), F.lit(None).cast("string").alias("system_prompt"), "prompt", "response", "temperature", "model_name", "vector")
    return cache.put(c, new, queries._now(), 3600).select("id", "exact_hash")


# Streams


def _event_log(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The events as a log of files, read as a stream, and a folder for its state."""
    at = _place(spark, "events")
    table(spark, d, "events").select(F.col("event_type").alias("path"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("target"), F.col("ts").cast("timestamp").alias("at")).repartitionByRange(8, "at").write.parquet(f"{at}/log")
    return stream.source(spark, f"{at}/log"), at


def _streamed(spark: SparkSession, df: DataFrame, at: str, mode: str = "append") -> DataFrame:
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


@query("SELECT event_type AS path, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def file_events(spark: SparkSession, d: str) -> DataFrame:
    """O-175."""
    log, at = _event_log(spark, d)
    return _streamed(spark, stream.touched(log), at).select("path", F.unix_timestamp("at").alias("seconds"))


@query("WITH s AS (SELECT event_type, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s), b AS (SELECT event_type AS path, max(ts) AS last, count(*) AS events FROM g GROUP BY event_type, g), m AS (SELECT max(ts) AS m FROM events) SELECT path, CAST(floor(epoch(last)) AS BIGINT) AS seconds, events FROM b, m WHERE last + INTERVAL 30 MINUTE <= m - INTERVAL 1 DAY")
def streamed_bursts(spark: SparkSession, d: str) -> DataFrame:
    """O-176 to O-178: bursts by type on a stream, each handed to a refresh once the watermark, a day behind, has passed its end."""
    log, at = _event_log(spark, d)
    b = stream.debounced(log, "30 minutes", "1 day", "path").select("path", (F.unix_timestamp("end") - 1800).alias("seconds"), "events")
    stream.refreshing(b, lambda batch, k: batch.write.mode("append").parquet(f"{at}/out"), f"{at}/state", once=True).awaitTermination()
    return spark.read.schema("path string, seconds bigint, events bigint").parquet(f"{at}/out")


# Extraction

_BY_PATH = queries.LANGUAGE.replace("lower(path)", "lower(file_path)")
_LINES = f"{PARSED}, src AS (SELECT repo || '/' || file_path AS file_path, {_BY_PATH} AS language, source_text FROM parsed), l AS (SELECT file_path, language, unnest(range(1, len(s) + 1)) AS line, unnest(s) AS t FROM (SELECT *, string_split(source_text, chr(10)) AS s FROM src WHERE language IS NOT NULL))"


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunk_files(parsed(spark, d).withColumn("file_path", F.concat("repo", F.lit("/"), "file_path")))


@query(f"WITH {_LINES} SELECT left(sha256(file_path || ':module:0'), 16) AS id, file_path, language, regexp_replace(string_split(file_path, '/')[-1], '\\.[^.]*$', '') AS name, CAST(count(*) AS INT) AS end_line FROM l GROUP BY ALL")
def extracted_modules(spark: SparkSession, d: str) -> DataFrame:
    """O-33, O-34, O-161."""
    return _extracted(spark, d).where("chunk_type = 'module' and start_line = 1").select("id", "file_path", "language", "name", "end_line")


@query(f"WITH {_LINES}, i AS (SELECT * FROM l WHERE language IN ('java', 'c', 'rust', 'ruby') AND regexp_matches(t, CASE language WHEN 'java' THEN '^import\\b' WHEN 'c' THEN '^\\s*#\\s*include\\b' WHEN 'rust' THEN '^\\s*(?:pub\\s+)?use\\b' ELSE '^\\s*require(?:_relative)?\\b' END)) SELECT file_path, language, CAST(min(line) AS INT) AS start_line, CAST(max(line) AS INT) AS end_line, CAST(count(*) AS INT) AS import_count FROM i GROUP BY ALL")
def extracted_imports(spark: SparkSession, d: str) -> DataFrame:
    """O-36, in the languages whose imports are lines."""
    c = _extracted(spark, d).where("chunk_type = 'import' and language in ('java', 'c', 'rust', 'ruby')")
    return c.select("file_path", "language", "start_line", "end_line", F.col("metadata.import_count").alias("import_count"))


@query(f"WITH {_LINES}, f AS (SELECT *, regexp_extract(t, '^func\\s*(?:\\(\\s*\\w*\\s*\\*?(\\w+)[^)]*\\)\\s*)?(\\w+)', ['r', 'n']) AS m FROM l WHERE language = 'go') SELECT file_path, m.n AS name, nullif(m.r, '') AS parent_name, CAST(line AS INT) AS start_line FROM f WHERE m.n <> ''")
def extracted_functions(spark: SparkSession, d: str) -> DataFrame:
    """O-39, O-48, of all Go files: their functions and the methods of their types."""
    return _extracted(spark, d).where("language = 'go' and chunk_type in ('function', 'method')").select("file_path", "name", "parent_name", "start_line")


_RUBY_CLASS, _OTHER_CLASS = "'^\\s*(?:class|module)\\s+([\\w:]+)(?:\\s*<\\s*([\\w:]+))?'", "'^\\s*(?:export\\s+(?:default\\s+)?|public\\s+|abstract\\s+|final\\s+)*class\\s+(\\w+)(?:\\s+extends\\s+(\\w+))?'"


@query(f"WITH {_LINES}, k AS (SELECT *, CASE language WHEN 'ruby' THEN regexp_extract(t, {_RUBY_CLASS}, ['n', 'p']) ELSE regexp_extract(t, {_OTHER_CLASS}, ['n', 'p']) END AS m FROM l WHERE language IN ('java', 'javascript', 'typescript', 'ruby') AND NOT regexp_matches(t, '^\\s*(//|\\*|#)')) SELECT file_path, m.n AS name, CAST(line AS INT) AS start_line, m.p AS parents FROM k WHERE m.n <> ''")
def extracted_classes(spark: SparkSession, d: str) -> DataFrame:
    """O-37, O-38, O-41: classes with what they extend, in four languages."""
    c = _extracted(spark, d).where("chunk_type = 'class' and language in ('java', 'javascript', 'typescript', 'ruby') and not content rlike '^[^{\\n]*interface '")
    return c.select("file_path", "name", "start_line", F.array_join("metadata.parent_classes", ",").alias("parents"))


_NOISE = ", ".join(f"'{x}'" for x in sorted(extract.COMMON_CALLS))
_NO_CALLS = ", ".join(f"'{x}'" for x in sorted(extract.NOT_CALLS))


@query(
    f"""WITH {_LINES}, b AS (SELECT file_path, line, regexp_replace(t, '"(?:[^"\\\\]|\\\\.)*"|`[^`]*`|''(?:[^''\\\\]|\\\\.)*''|//.*', ' ', 'g') AS t FROM l WHERE language = 'go'),
    f AS (SELECT file_path, line AS start, regexp_extract(t, '^func\\s*(?:\\(\\s*\\w*\\s*\\*?(\\w+)[^)]*\\)\\s*)?(\\w+)', ['r', 'n']) AS m FROM b WHERE regexp_matches(t, '^func\\s*(?:\\(\\s*\\w*\\s*\\*?\\w+[^)]*\\)\\s*)?\\w+')),
    o AS (SELECT f.file_path, f.start, CASE WHEN m.r <> '' THEN m.r || '.' || m.n ELSE m.n END AS caller, b.line, CASE WHEN b.line = f.start THEN regexp_replace(b.t, '^func\\s*(?:\\([^)]*\\)\\s*)?\\w+[^(]*\\(', '') ELSE b.t END AS t, sum(length(b.t) - length(replace(b.t, '{{', '')) - length(b.t) + length(replace(b.t, '}}', ''))) OVER (PARTITION BY f.file_path, f.start ORDER BY b.line) AS depth FROM f JOIN b ON b.file_path = f.file_path AND b.line >= f.start),
    e AS (SELECT file_path, start, min(line) AS stop FROM o WHERE depth <= 0 GROUP BY ALL), k AS (SELECT o.file_path, o.caller, o.start, o.line, unnest(range(0, len(c))) AS i, unnest(c) AS callee FROM (SELECT *, regexp_extract_all(t, '([A-Za-z_$][\\w$]*)!?\\s*\\(', 1) AS c FROM o) o LEFT JOIN e USING (file_path, start) WHERE o.line <= coalesce(e.stop, 1000000000)),
    once AS (SELECT file_path, caller, start, callee, min(line * 10000 + i) AS p FROM k WHERE callee NOT IN ({_NO_CALLS}) AND lower(callee) NOT IN ({_NOISE}) GROUP BY ALL), last AS (SELECT file_path, caller, max(start) AS start FROM f0 GROUP BY ALL)
    SELECT file_path, caller, callee, CAST(row_number() OVER (PARTITION BY file_path, caller ORDER BY p) - 1 AS INT) AS pos FROM once JOIN last USING (file_path, caller, start)""".replace("last AS (", "f0 AS (SELECT file_path, start, CASE WHEN m.r <> '' THEN m.r || '.' || m.n ELSE m.n END AS caller FROM f), last AS (", 1)
)
def go_calls(spark: SparkSession, d: str) -> DataFrame:
    """O-49 to O-52, of all Go files."""
    c = extract.call_edges(parsed(spark, d).withColumn("file_path", F.concat("repo", F.lit("/"), "file_path")))
    return c.where(paths.language(F.col("file_path")) == "go")


_TESTED = f"{CHUNKS}, n AS (SELECT DISTINCT repo || '/' || file_path AS file, name FROM chunks WHERE chunk_type = 'function' AND regexp_matches(name, '^[a-z_]\\w*$') AND language = 'python')"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """A test file for each file with Python functions, with a test of each."""
    n = chunks(spark, d).where("chunk_type = 'function' and language = 'python'").where(F.col("name").rlike(r"^[a-z_]\w*$")).select(F.concat_ws("/", "repo", "file_path").alias("file"), "name").distinct()
    body = F.concat(F.lit("def test_"), "name", F.lit("():\n    '''Of it.'''\n    r = "), "name", F.lit("(1)\n    assert r\n\n\n"))
    return n.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(body)), "").alias("source"))  # of one file


@query(f"WITH {_TESTED} SELECT file AS test_file, 'test_' || name AS test_name, 'r = ' || name || '(1)' || chr(10) || 'assert r' AS code FROM n")
def test_bodies(spark: SparkSession, d: str) -> DataFrame:
    """O-59."""
    return tests.test_bodies(_tests(spark, d), "file", "source")


@query(f"WITH {_TESTED} SELECT DISTINCT name, 'r = ' || name || '(1)' || chr(10) || 'assert r' AS snippet FROM n")
def usage_snippets(spark: SparkSession, d: str) -> DataFrame:
    """O-61."""
    t = tests.test_bodies(_tests(spark, d), "file", "source")
    return tests.usage_snippets(t.select(F.substring("test_name", 6, 1000).alias("name"), "code").distinct()).distinct()


@query("SELECT o_orderkey, round(CASE WHEN o_custkey > 0 THEN o_totalprice / o_custkey * 60 END, 4) AS per_minute FROM orders")
def phase_rates(spark: SparkSession, d: str) -> DataFrame:
    """O-104."""
    return table(spark, d, "orders").select("o_orderkey", F.round(stream.phase_rate(F.col("o_totalprice"), F.col("o_custkey")), 4).alias("per_minute"))
