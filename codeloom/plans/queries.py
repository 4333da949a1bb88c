"""The registered queries of the core over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.extract import chunks as extract
from codeloom.functions import paths, text
from codeloom.operators import cache, changes, context, graphs, history, imports, ranking, reports, search, store, toc
from codeloom.plans import pages
from codeloom.sources import trees
from codeloom.sources.tables import table
from codeloom.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "2025-06-30 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_info").select("file_id", "repo", "path", "language", "hash", "chunk_count", "last_modified").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").drop("indexed_at").dropDuplicates(["id"])


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_results").select("file_id", "repo", "file_path", "source_text").dropDuplicates(["file_id"])


FILES = "files AS (SELECT DISTINCT file_id, repo, path, language, hash, chunk_count, last_modified FROM file_info)"
CHUNKS = "chunks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at) AS n_ FROM code_chunks) WHERE n_ = 1)"
PARSED = "parsed AS (SELECT file_id, min(repo) AS repo, min(file_path) AS file_path, min(source_text) AS source_text FROM parse_results GROUP BY file_id)"
LANGUAGE = "CASE regexp_extract(lower(path), '[^/]\\.([^./]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in paths.EXTENSIONS.items()) + " END"


# Files


@query(f"WITH {FILES} SELECT file_id, {LANGUAGE} AS by_extension FROM files")
def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", paths.language(F.col("path")).alias("by_extension"))


@query(f"WITH {FILES} SELECT language, count(*) AS files FROM files WHERE language IS NOT NULL GROUP BY language")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.language_counts(files(spark, d))


@query(f"WITH {PARSED} SELECT file_id, sha256(source_text) AS hash, strlen(source_text) AS size_bytes FROM parsed")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("file_id", F.sha2("source_text", 256).alias("hash"), F.octet_length("source_text").cast("bigint").alias("size_bytes"))


@query(
    r"""WITH t AS (SELECT repo, regexp_replace(trim(remote_url), '(\.git)?/?$', '') AS u FROM repos), p AS (SELECT repo, u, CASE WHEN regexp_matches(u, '^git@([^:]+):(.+)/([^/]+)$') THEN '^git@([^:]+):(.+)/([^/]+)$'
    WHEN regexp_matches(u, '^ssh://git@([^/:]+)(?::\d+)?/(.+)/([^/]+)$') THEN '^ssh://git@([^/:]+)(?::\d+)?/(.+)/([^/]+)$' WHEN regexp_matches(u, '^https?://(?:[^@/]+@)?([^/]+)/(.+)/([^/]+)$') THEN '^https?://(?:[^@/]+@)?([^/]+)/(.+)/([^/]+)$' END AS k FROM t)
    SELECT repo, regexp_extract(u, k, 1) AS host, regexp_extract(u, k, 2) AS owner, regexp_extract(u, k, 3) AS name FROM p WHERE k IS NOT NULL"""
)
def remote_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repos").select("repo", text.remote_parts(F.col("remote_url")).alias("r")).where("r is not null").select("repo", "r.host", "r.owner", "r.name")


@query(
    rf"""WITH {CHUNKS}, u AS (SELECT repo, default_branch, regexp_replace(trim(remote_url), '(\.git)?/?$', '') AS u FROM repos), p AS (SELECT repo, coalesce(default_branch, 'main') AS branch, regexp_extract(u, '^https?://(?:[^@/]+@)?([^/]+)/(.+)/([^/]+)$', ['host', 'owner', 'name']) AS r FROM u WHERE regexp_matches(u, '^https?://(?:[^@/]+@)?([^/]+)/(.+)/([^/]+)$'))
    SELECT c.id, 'https://' || r.host || '/' || r.owner || '/' || r.name || '/blob/' || branch || '/' || c.file_path || CASE WHEN c.start_line IS NULL THEN '' ELSE '#L' || c.start_line || CASE WHEN c.end_line IS NULL OR c.end_line = c.start_line THEN '' ELSE '-L' || CAST(c.end_line AS INT) END END AS url FROM chunks c JOIN p USING (repo)"""
)
def source_urls(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repos").where(F.col("remote_url").rlike("^ *https?://")).select("repo", F.coalesce("default_branch", F.lit("main")).alias("branch"), text.remote_parts(F.col("remote_url")).alias("r")).where("r is not null")
    c = chunks(spark, d).join(r, "repo")
    return c.select("id", text.source_url(F.col("r.host"), F.col("r.owner"), F.col("r.name"), F.col("branch"), F.col("file_path"), F.col("start_line"), F.col("end_line").cast("int")).alias("url"))


@query(rf"WITH {FILES} SELECT file_id, path FROM files WHERE regexp_matches(path, '(^|/)\.[^/]+/') OR regexp_matches(path, '(^|/)(node_modules|venv|\.venv|__pycache__|\.git|dist|build)/') OR regexp_matches(path, '^.*\.min\.js$') OR regexp_matches(path, '^.*\.lock$')")
def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(trees.excluded(F.col("path"))).select("file_id", "path")


@query("SELECT file_id, attempt, error FROM (SELECT DISTINCT file_id, attempt, error, parsed_at FROM parse_results) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC, attempt, error NULLS LAST) = 1")
def latest_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parse_results").select("file_id", "attempt", "error", "parsed_at").distinct()
    return reports.latest(p, ["file_id"], "parsed_at").select("file_id", "attempt", "error")


# Chunk table


@query("SELECT id, indexed_at FROM (SELECT id, indexed_at, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS n FROM code_chunks) WHERE n = 1")
def newest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.deduplicated(table(spark, d, "code_chunks").select("id", "indexed_at"), "indexed_at")


@query(f"WITH {CHUNKS} SELECT CASE grouping(language) * 2 + grouping(chunk_type) WHEN 1 THEN 'language' WHEN 2 THEN 'chunk_type' ELSE 'total' END AS kind, coalesce(language, chunk_type) AS value, count(*) AS chunks, count(DISTINCT repo || ':' || file_path) AS files FROM chunks GROUP BY GROUPING SETS ((language), (chunk_type), ())")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(chunks(spark, d).withColumn("file_path", F.concat_ws(":", "repo", "file_path")))


@query(f"WITH {CHUNKS} SELECT id, chunk_type || ':' || coalesce(' ' || nullif(name, ''), '') || coalesce(' in ' || nullif(parent_name, ''), '') || coalesce(' (' || language || ')', '') || coalesce(' ' || chr(10) || nullif(docstring, ''), '') || ' ' || chr(10) || content AS text FROM chunks")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return store.embedding_texts(chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT id, file_path, name, chunk_type AS type, language, start_line || '-' || CAST(end_line AS INT) AS lines, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS preview, docstring FROM chunks")
def search_views(spark: SparkSession, d: str) -> DataFrame:
    return store.search_view(chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT id FROM chunks c WHERE EXISTS (SELECT 1 FROM file_info f WHERE f.file_id = c.file_id AND f.chunk_count >= 5)")
def chunks_of_files(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).where("chunk_count >= 5").select(F.col("file_id").alias("file_path"))
    return store.of_files(chunks(spark, d).select("id", F.col("file_id").alias("file_path")), f).select("id")


@query(f"WITH {CHUNKS} SELECT file_id, name, chunk_type, start_line, end_line FROM chunks WHERE chunk_type IN ('class', 'function') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY chunk_type = 'class' DESC, start_line NULLS LAST, id) = 1")
def main_definitions(spark: SparkSession, d: str) -> DataFrame:
    return store.main_definitions(chunks(spark, d), "file_id")


# Reports

_DOC = "(docstring IS NOT NULL AND length(trim(docstring, ' ')) >= 10 AND lower(trim(docstring, ' ')) NOT IN ('todo', 'fixme', 'xxx', 'pass', '...'))"
_KINDS = ", ".join(f"count(*) FILTER (WHERE chunk_type = '{k}') AS {k}_total, count(*) FILTER (WHERE chunk_type = '{k}' AND ok) AS {k}_documented" for k in reports.KINDS)
_COVER = f"SELECT repo, file_path, {_KINDS}, count(*) AS total, count(*) FILTER (WHERE ok) AS documented, round(count(*) FILTER (WHERE ok) * 100.0 / count(*), 4) AS percent FROM (SELECT *, {_DOC} AS ok FROM chunks WHERE chunk_type IN ('class', 'function', 'method'))"


@query(f"WITH {CHUNKS} {_COVER} GROUP BY ROLLUP (repo, file_path)")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage(chunks(spark, d), "repo", "file_path")


@query(f"WITH {CHUNKS}, f AS ({_COVER} GROUP BY repo, file_path) SELECT repo, file_path, percent, CASE WHEN percent >= 90 THEN 'good' WHEN percent >= 70 THEN 'fair' WHEN percent >= 50 THEN 'low' ELSE 'poor' END AS mark FROM f WHERE percent < 50 AND total > 0 ORDER BY percent, repo, file_path LIMIT 10")
def coverage_attention(spark: SparkSession, d: str) -> DataFrame:
    per = reports.coverage(chunks(spark, d), "repo", "file_path").where("file_path is not null")
    return reports.attention(per).select("repo", "file_path", "percent", reports.coverage_mark(F.col("percent")).alias("mark"))


@query(
    f"""WITH {CHUNKS} SELECT repo, file_path, array_to_string(list(CASE WHEN chunk_type = 'method' THEN 'method ' || coalesce(parent_name || '.', '') || coalesce(name, 'Unknown') ELSE chunk_type || ' ' || coalesce(name, 'Unknown') END ORDER BY coalesce(start_line, 0),
    CASE WHEN chunk_type = 'method' THEN 'method ' || coalesce(parent_name || '.', '') || coalesce(name, 'Unknown') ELSE chunk_type || ' ' || coalesce(name, 'Unknown') END, id), ', ') AS labels FROM chunks WHERE chunk_type IN ('class', 'function', 'method') AND NOT {_DOC} GROUP BY repo, file_path"""
)
def undocumented(spark: SparkSession, d: str) -> DataFrame:
    return reports.undocumented(chunks(spark, d), "repo", "file_path").select("repo", "file_path", F.array_join("labels", ", ").alias("labels"))


@query(f"WITH {CHUNKS} SELECT CASE WHEN regexp_matches(upper(substr(n, 1, 1)), '^\\p{{L}}$') THEN upper(substr(n, 1, 1)) ELSE '#' END AS letter, chunk_type AS type, count(*) AS entries, count(DISTINCT lower(n)) AS names FROM (SELECT *, coalesce(name, 'Unknown') AS n FROM chunks WHERE chunk_type IN ('class', 'function', 'method')) GROUP BY ALL")
def glossary(spark: SparkSession, d: str) -> DataFrame:
    return reports.glossary(chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT name, chunk_type AS type, file_path FROM chunks WHERE chunk_type IN ('class', 'function') AND name NOT LIKE '\\_%' ESCAPE '\\' AND length(name) >= 4 AND lower(name) NOT IN ('main', 'test', 'init')")
def registry(spark: SparkSession, d: str) -> DataFrame:
    return reports.registered(chunks(spark, d), ("main", "test", "init")).drop("alias")


@query(
    f"""WITH {FILES}, p AS (SELECT string_split(path, '/') AS p FROM files), q AS (SELECT CASE WHEN p[1] IN ('src', 'lib', 'pkg') THEN p[2:] ELSE p END AS p FROM p)
    SELECT p[1] AS top, CASE WHEN len(p) > 2 THEN p[2] ELSE '_root' END AS sub, count(*) AS files FROM q WHERE len(p) >= 2 GROUP BY ROLLUP (top, sub)"""
)
def directories(spark: SparkSession, d: str) -> DataFrame:
    return reports.directories(files(spark, d))


@query(f"WITH {FILES} SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS module, count(*) AS files FROM files GROUP BY module HAVING count(*) >= 2")
def modules(spark: SparkSession, d: str) -> DataFrame:
    return reports.modules(files(spark, d))


@query(f"WITH {FILES} SELECT file_id, path, chunk_count FROM files WHERE string_split(path, '/')[-1] <> '__init__.py' AND NOT list_contains(string_split(path, '/'), 'tests') AND chunk_count >= 2")
def significant_files(spark: SparkSession, d: str) -> DataFrame:
    return reports.significant(files(spark, d)).select("file_id", "path", "chunk_count")


# Snapshots and pages


@query(f"WITH {FILES}, {PARSED}, p AS (SELECT file_id, sha256(source_text) AS hash FROM parsed) SELECT file_id, CASE WHEN p.file_id IS NULL THEN 'added' WHEN f.file_id IS NULL THEN 'removed' WHEN f.hash IS NOT DISTINCT FROM p.hash THEN 'unchanged' ELSE 'changed' END AS status FROM files f FULL JOIN p USING (file_id)")
def file_changes(spark: SparkSession, d: str) -> DataFrame:
    before = parsed(spark, d).select("file_id", F.sha2("source_text", 256).alias("hash"))
    return changes.file_changes(files(spark, d).select("file_id", "hash"), before, "file_id")


@query(
    f"""WITH {FILES}, {PARSED}, n AS (SELECT repo || '/' || regexp_replace(path, '/?[^/]*$', '') AS page, path AS source, hash FROM files), b AS (SELECT repo || '/' || regexp_replace(file_path, '/?[^/]*$', '') AS page, file_path AS source, sha256(source_text) AS hash FROM parsed WHERE source_text <> '')
    SELECT coalesce(n.page, b.page) AS page, bool_or(coalesce(n.hash IS NULL OR b.hash IS NULL OR n.hash <> b.hash, true)) AS renew FROM n FULL JOIN b ON n.page = b.page AND n.source = b.source GROUP BY 1 HAVING count(n.page) > 0"""
)
def pages_to_renew(spark: SparkSession, d: str) -> DataFrame:
    join = lambda p: F.concat("repo", F.lit("/"), paths.directory(F.col(p))).alias("page")
    now = files(spark, d).select(join("path"), F.col("path").alias("source"), "hash")
    before = parsed(spark, d).where("source_text <> ''").select(join("file_path"), F.col("file_path").alias("source"), F.sha2("source_text", 256).alias("hash"))
    return changes.pages_to_renew(before, now)


_STALE = "SELECT o_orderkey AS page, o_orderdate AS generated_at, max(l_shipdate) AS newest, count(l_shipdate) AS dated FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def _stale(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderdate").alias("generated_at"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_shipdate").alias("at"))
    return changes.staleness(pages, lines, days=30)


@query(f"WITH s AS ({_STALE}) SELECT page, newest, CASE WHEN newest > generated_at THEN date_diff('day', generated_at, newest) END AS days_stale, coalesce(newest > generated_at AND date_diff('day', generated_at, newest) >= 30, false) AS stale FROM s")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    return _stale(spark, d).select("page", "newest", "days_stale", "stale")


@query(f"WITH s AS ({_STALE}), t AS (SELECT coalesce(newest > generated_at AND date_diff('day', generated_at, newest) >= 30, false) AS stale FROM s) SELECT count(*) AS pages, count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE NOT stale) AS fresh, round(count(*) FILTER (WHERE NOT stale) * 100.0 / count(*), 4) AS freshness FROM t")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return changes.freshness(_stale(spark, d))


# Imports

_MODULES = (
    f"WITH {CHUNKS}, "
    + r"""l AS (SELECT id, file_id, repo, file_path, u.i AS line, u.t AS t FROM (SELECT *, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS s FROM chunks WHERE chunk_type = 'import'), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i, unnest(s) AS t) u),
    m AS (SELECT id, file_id, repo, file_path, CAST(line AS INT) AS line, coalesce(nullif(regexp_extract(t, '^\s*(?:import\b.*?\bfrom\s+|import\s+|(?:const|let|var)\b.*?\brequire\()["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(t, '^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;', 1), ''), nullif(regexp_extract(t, '^\s*import\s+(?:\w+\s+)?"([^"]+)"', 1), ''),
    nullif(regexp_extract(t, '^\s*from\s+([\w.]+)\s+import\b', 1), ''), nullif(regexp_extract(t, '^\s*import\s+([\w.]+)', 1), ''), nullif(regexp_extract(t, '^\s*use\s+([\w:]+)', 1), ''), nullif(regexp_extract(t, '^\s*#include\s+[<"]([^>"]+)', 1), ''), nullif(regexp_extract(t, '^\s*require(?:_relative)?\s+["'']([^"'']+)', 1), '')) AS module
    FROM l WHERE trim(t) <> '' AND NOT regexp_matches(t, '^\s*(//|\*)') AND (NOT regexp_matches(t, '^\s*#') OR regexp_matches(t, '^\s*#include'))), mods AS (SELECT * FROM m WHERE module IS NOT NULL)"""
)


def _imports(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return imports.of_chunks(chunks(spark, d), *keys)


@query(f"{_MODULES} SELECT id, line, module FROM mods")
def import_modules(spark: SparkSession, d: str) -> DataFrame:
    return _imports(spark, d, "id")


@query(f"{_MODULES}, p AS (SELECT regexp_extract(module, '^[A-Za-z_][\\w\\-]*', 0) AS package FROM mods WHERE module NOT LIKE '.%' AND module NOT LIKE '@%') SELECT package, count(*) AS imports FROM p WHERE package <> '' AND package NOT LIKE '\\_%' ESCAPE '\\' GROUP BY package")
def external_packages(spark: SparkSession, d: str) -> DataFrame:
    return imports.external_counts(_imports(spark, d, "id").where("module not like '@%'"))


@query(f"{_MODULES}, x AS (SELECT DISTINCT file_id, repo || ':' || module AS module FROM mods) SELECT a.file_id AS a, b.file_id AS b, count(*) AS shared FROM x a JOIN x b ON a.module = b.module AND a.file_id < b.file_id GROUP BY 1, 2 HAVING count(*) >= 2")
def shared_modules(spark: SparkSession, d: str) -> DataFrame:
    m = _imports(spark, d, "file_id", "repo").withColumn("module", F.concat_ws(":", "repo", "module"))
    return imports.shared(m, "file_id", "module")


@query(
    f"""{_MODULES}, {FILES}, f AS (SELECT path, replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.\\w+$', ''), '/', '.') AS dotted FROM files), n AS (SELECT DISTINCT module, string_split(module, '.')[-1] AS last FROM mods)
    SELECT module, min(path) AS path FROM n JOIN f ON string_split(f.dotted, '.')[-1] = n.last WHERE dotted = module OR ends_with(dotted, '.' || module) GROUP BY module"""
)
def module_files(spark: SparkSession, d: str) -> DataFrame:
    return imports.module_files(_imports(spark, d, "id"), files(spark, d))


# Graphs

_CLASSES = rf"WITH {CHUNKS}, k AS (SELECT name, repo || ':' || file_path AS file_path, nullif(regexp_extract(content, '^(?:export |public |abstract )*class\s+\w+\s*(?:extends\s+|<\s*|\()(\w+)', 1), '') AS parent FROM chunks WHERE chunk_type = 'class' AND name IS NOT NULL)"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("chunk_type = 'class' and name is not null")
    p = F.nullif(F.regexp_extract("content", r"^(?:export |public |abstract )*class\s+\w+\s*(?:extends\s+|<\s*|\()(\w+)", 1), F.lit(""))
    return c.select("name", F.concat("repo", F.lit(":"), "file_path").alias("file_path"), F.filter(F.array(p), lambda x: x.isNotNull()).alias("parents"))


@query(f"{_CLASSES} SELECT name, min(file_path) AS file_path, coalesce(string_agg(DISTINCT parent, ',' ORDER BY parent), '') AS parents FROM k GROUP BY name")
def class_table(spark: SparkSession, d: str) -> DataFrame:
    return graphs.class_table(_classes(spark, d)).withColumn("parents", F.array_join("parents", ","))


# Classes that inherit, over all customers: each from the one of a quarter of its number, every third also from the one of a fifth.
_KIN = """k AS (SELECT 'C' || c_custkey AS name, c_mktsegment AS file_path, unnest(list_filter([CASE WHEN c_custkey >= 4 THEN 'C' || (c_custkey // 4) END, CASE WHEN c_custkey % 3 = 0 AND c_custkey >= 5 THEN 'C' || (c_custkey // 5) END], lambda x: x IS NOT NULL)) AS parent FROM customer),
n AS (SELECT 'C' || c_custkey AS name FROM customer), e AS (SELECT DISTINCT name AS child, parent FROM k WHERE parent IN (SELECT name FROM n)), r AS (SELECT DISTINCT parent AS name FROM e WHERE parent NOT IN (SELECT child FROM e))"""


def _kin(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    up = lambda n: F.concat(F.lit("C"), F.floor(key / n).cast("string"))
    parents = F.filter(F.array(F.when(key >= 4, up(4)), F.when((key % 3 == 0) & (key >= 5), up(5))), lambda x: x.isNotNull())
    return table(spark, d, "customer").select(F.concat(F.lit("C"), key.cast("string")).alias("name"), F.col("c_mktsegment").alias("file_path"), parents.alias("parents"))


@query(f"WITH {_KIN} SELECT child, parent FROM e")
def inheritance(spark: SparkSession, d: str) -> DataFrame:
    return graphs.inheritance(_kin(spark, d))


@query(f"WITH {_KIN} FROM r")
def inheritance_roots(spark: SparkSession, d: str) -> DataFrame:
    return graphs.roots(_kin(spark, d))


@query(f"WITH RECURSIVE {_KIN}, t AS (SELECT name, [name] AS path, 0 AS depth FROM r UNION ALL SELECT e.child, list_append(t.path, e.child), t.depth + 1 FROM t JOIN e ON e.parent = t.name) SELECT name, array_to_string(path, '/') AS path, depth FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) = 1")
def inheritance_tree(spark: SparkSession, d: str) -> DataFrame:
    return graphs.tree(_kin(spark, d)).withColumn("path", F.array_join("path", "/"))


@query(f"WITH {_KIN} SELECT name, count(*) AS links FROM (SELECT child AS name FROM e UNION ALL SELECT parent FROM e) GROUP BY name ORDER BY links DESC, name LIMIT 50")
def connected_classes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.connected_classes(_kin(spark, d))


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee")).distinct()


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS caller, 'p' || l_partkey AS callee FROM lineitem)"


@query(f"WITH {_EDGES} SELECT callee, caller FROM e")
def reverse_graph(spark: SparkSession, d: str) -> DataFrame:
    return graphs.reversed_edges(_supply(spark, d))


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT caller AS node FROM e UNION ALL SELECT callee FROM e) GROUP BY node")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graphs.degrees(_supply(spark, d))


@query(f"WITH {_EDGES} SELECT caller, count(*) AS targets FROM e GROUP BY caller ORDER BY targets DESC, caller LIMIT 1")
def busiest_node(spark: SparkSession, d: str) -> DataFrame:
    return graphs.busiest(_supply(spark, d))


_STEPS = "e AS (SELECT DISTINCT a, b FROM (SELECT event_type || ':' || extract('hour' FROM ts) AS a, lead(event_type || ':' || extract('hour' FROM ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    node = F.concat_ws(":", "event_type", F.hour("ts"))
    e = table(spark, d, "events").select(node.alias("a"), F.lead(node).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    return e.where("b is not null").distinct()


@query(f"WITH {_STEPS}, g AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node), t AS (SELECT node FROM g ORDER BY n DESC, node LIMIT 30) SELECT a, b FROM e WHERE a IN (FROM t) AND b IN (FROM t)")
def strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.strongest(_steps(spark, d), 30, "a", "b")


@query(f"WITH RECURSIVE {_STEPS}, r AS (SELECT a AS s, b AS t FROM e UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a) SELECT e.a, e.b FROM e JOIN r ON r.s = e.b AND r.t = e.a")
def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.cycle_edges(_steps(spark, d), "a", "b")


@query(f"WITH RECURSIVE {_STEPS}, h AS (SELECT a AS start, b AS node, 1 AS hops FROM e UNION SELECT h.start, e.b, h.hops + 1 FROM h JOIN e ON h.node = e.a WHERE h.hops < 6) SELECT start, node, min(hops) AS hops FROM h GROUP BY start, node")
def bounded_reach(spark: SparkSession, d: str) -> DataFrame:
    e = _steps(spark, d)
    return graphs.reachable(e, e.select(F.col("a").alias("start")), 6, "a", "b")


@query()
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return extract.call_edges(parsed(spark, d))


@query()
def extracted_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunk_files(parsed(spark, d)).drop("metadata")


# History


def _commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    return o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("file")), "id", "left")


_COMMITS = "c AS (SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS ts, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS file FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"WITH {_COMMITS} SELECT CAST(ts AS DATE) AS day, count(DISTINCT id) AS commits, count(DISTINCT author) AS authors, count(DISTINCT file) AS changed, coalesce(array_to_string(list_sort(list(DISTINCT file) FILTER (WHERE file IS NOT NULL))[:5], ','), '') AS files FROM c GROUP BY 1")
def commits_by_day(spark: SparkSession, d: str) -> DataFrame:
    return history.commits_by_day(_commits(spark, d)).withColumn("files", F.array_join("files", ","))


@query(f"WITH {_COMMITS} SELECT author, count(DISTINCT id) AS commits, min(ts) AS first, max(ts) AS last FROM c GROUP BY author")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    return history.contributors(_commits(spark, d))


@query(f"WITH {_COMMITS} SELECT file, max(ts) AS \"at\" FROM c WHERE file IS NOT NULL GROUP BY file")
def last_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.last_changes(_commits(spark, d))


@query("WITH r AS (SELECT DISTINCT event_type AS file, event_id // 100 AS b FROM events), j AS (SELECT r.file || ':' || r.b AS range, e.event_id AS line, e.user_id AS author, e.ts FROM r JOIN events e ON e.event_type = r.file AND e.event_id BETWEEN r.b * 100 AND r.b * 100 + 99) SELECT range, line, author, ts FROM j QUALIFY row_number() OVER (PARTITION BY range ORDER BY ts DESC, line) = 1")
def blame_of_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    b = F.floor(F.col("event_id") / 100)
    r = e.select(F.col("event_type").alias("file"), b.alias("b")).distinct().select(F.concat_ws(":", "file", "b").alias("range"), "file", (F.col("b") * 100).alias("start_line"), (F.col("b") * 100 + 99).alias("end_line"))
    return history.blame_of_ranges(r, e.select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.col("user_id").alias("author"), "ts"))


@query("SELECT e.event_id, v.event_id AS last_view FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'purchase'")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_view"))
    return history.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", "last_view").select("event_id", "last_view")


# Retrieval

_D = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


def _vector(spark: SparkSession, d: str, key: int) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == key).select("embedding").first()[0])


@query(f"SELECT vec_id, label, round(1 - d, 6) AS score FROM (SELECT e.vec_id, e.label, {_D} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY d, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, "vec_id").select("vec_id", "label", "score")


@query(f"SELECT vec_id, label, round(1 - d, 6) AS score FROM (SELECT e.vec_id, e.label, {_D} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3) ORDER BY d, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, "vec_id", where={"label": 3}).select("vec_id", "label", "score")


_BATCH = f"SELECT CAST(q.vec_id AS INT) AS query, e.vec_id, {_D} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 5"


def _batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    qs = [(int(r.vec_id), list(r.embedding)) for r in e.where("vec_id % 100 = 0").select("vec_id", "embedding").collect()]  # the questions: one row in a hundred
    return ranking.retrieve(e, qs, 5, "vec_id")


@query(f"WITH b AS ({_BATCH}) SELECT query, vec_id, round(1 - d, 6) AS score, CAST(rank AS INT) AS rank FROM b")
def vector_batch(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH b AS ({_BATCH}) SELECT vec_id, round(max(1 - d), 6) AS score FROM b GROUP BY vec_id ORDER BY max(1 - d) DESC, vec_id LIMIT 30")
def retrieve_best(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_of(_batch(spark, d), "vec_id").orderBy(F.desc("score"), "vec_id").limit(30).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS} SELECT file_id, id, CAST(n AS INT) AS \"at\" FROM (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, id) AS n FROM chunks) WHERE n <= 3")
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_n(chunks(spark, d).select("file_id", "id", "start_line"), ["file_id"], ["start_line", "id"], 3).select("file_id", "id", "at")


@query(f"WITH {CHUNKS} SELECT repo, name, min(id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY file_path, id) AS n FROM chunks WHERE chunk_type = 'class') WHERE n = 1 GROUP BY repo, name")
def first_per_name(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_per(chunks(spark, d).where("chunk_type = 'class'").select("repo", "name", "file_path", "id"), ["repo", "name"], ["file_path", "id"]).select("repo", "name", "id")


@query("SELECT repo, id, CAST(row_number() OVER w AS INT) AS \"at\" FROM (SELECT DISTINCT repo, id, created_at FROM llm_cache) WINDOW w AS (PARTITION BY repo ORDER BY created_at DESC, id) QUALIFY row_number() OVER w <= 3")
def chat_tail(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "llm_cache").select("repo", "id", "created_at").distinct()
    return ranking.first_n(c, ["repo"], [F.desc("created_at"), "id"], 3).select("repo", "id", "at")


# Texts


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: starts_with(x, '# ') OR regexp_matches(x, '^\*\*.+\*\*$'))[1], '^# |^\*\*|\*\*$', '', 'g')), ''), '?') AS title FROM documents WHERE text IS NOT NULL""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.title(F.col("text"), F.lit("?")).alias("title"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '#')), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^#+', ''), '[*`]', '', 'g'))), lambda x: x <> ''), '|') AS headings FROM documents WHERE text IS NOT NULL""")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(text.headings(F.col("text")), "|").alias("headings"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '`([^`\n]+)`', 1), lambda x: length(x) < 50) AS f FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_transform(f, lambda x: string_split(x, '.')[-1]), list_filter(f, lambda x: contains(x, '.'))), lambda x: x <> ''))), '|') AS terms FROM t""")
def code_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(text.code_terms(F.col("text")), "|").alias("terms"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```(?s:.*?)```', '', 'g'), '(?m)^#+.*$', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_`]', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, CASE WHEN length(p) > 200 THEN regexp_replace(substr(p, 1, 200), '\s+\S*$', '') || '...' ELSE p END AS snippet FROM (SELECT doc_id, {_PLAIN} AS p FROM documents WHERE text IS NOT NULL)")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(f"WITH {CHUNKS} SELECT id, array_to_string(list_sort(list_distinct(list_concat([lower(name)], list_filter(string_split(lower(name), '_'), lambda x: length(x) > 2), list_filter(list_transform(regexp_extract_all(name, '[A-Z][a-z]+|[a-z]+'), lambda x: lower(x)), lambda x: length(x) > 2)))), ' ') AS keywords FROM chunks WHERE name IS NOT NULL AND name <> ''")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("name is not null and name <> ''").select("id", F.array_join(text.keywords(F.col("name")), " ").alias("keywords"))


@query(f"WITH {CHUNKS}, n AS (SELECT DISTINCT name, regexp_replace(regexp_replace(name, '([^A-Z ])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS s FROM chunks WHERE name IS NOT NULL) SELECT name, CASE WHEN name = '' OR contains(name, '_') OR name = lower(name) OR name = upper(name) OR s = name THEN NULL ELSE s END AS spaced FROM n")
def spaced_names(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("name is not null").select("name").distinct().select("name", text.camel_spaced(F.col("name")).alias("spaced"))


@query(f"WITH {CHUNKS}, l AS (SELECT id, trim(string_split(trim(docstring, ' '), chr(10))[1], ' ') AS l FROM chunks WHERE docstring IS NOT NULL) SELECT id, CASE WHEN regexp_matches(l, '(?i)^(args|arguments|parameters|params|returns|return|raises|yields|example|examples|note|notes|attributes)\\s*:') THEN '' WHEN length(l) > 60 THEN substr(l, 1, 57) || '...' ELSE l END AS brief FROM l")
def briefs(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("docstring is not null").select("id", text.brief(F.col("docstring")).alias("brief"))


@query(
    f"WITH {CHUNKS}, "
    + r"""h AS (SELECT id, regexp_extract(content, 'def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?:', 1) AS n, regexp_extract(content, 'def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?:', 2) AS p, trim(regexp_extract(content, 'def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?:', 3)) AS r FROM chunks WHERE language = 'python' AND chunk_type IN ('function', 'method')),
    a AS (SELECT *, list_filter(list_transform(string_split(p, ','), lambda x: regexp_extract(x, '^\s*([*\w]+)', 1)), lambda x: x NOT IN ('self', 'cls', '')) AS s FROM h) SELECT id, CASE WHEN n <> '' THEN n || '(' || array_to_string(CASE WHEN len(s) > 4 THEN list_concat(s[:3], ['...']) ELSE s END, ', ') || ')' || CASE WHEN r <> '' THEN ' ' || r ELSE '' END END AS signature FROM a"""
)
def method_signatures(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("language = 'python' and chunk_type in ('function', 'method')").select("id", text.method_signature(F.col("content")).alias("signature"))


@query(f"WITH {CHUNKS} SELECT DISTINCT name, CASE WHEN regexp_matches(t, '^\\d') THEN 'C' || t ELSE t END AS node FROM (SELECT name, regexp_replace(name, '[<>\\[\\].\\-: ]', '_', 'g') AS t FROM chunks WHERE name IS NOT NULL)")
def mermaid_names(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("name is not null").select("name").distinct().select("name", text.mermaid_name(F.col("name")).alias("node"))


@query(
    r"""WITH t AS (SELECT DISTINCT id, response FROM llm_cache), j AS (SELECT id, nullif(regexp_extract(response, '(?s)\{.*\}', 0), '') AS j FROM t), q AS (SELECT id, json_extract(j, '$.sub_questions[*]') AS q FROM j WHERE j IS NOT NULL AND json_valid(j)), u AS (SELECT id, unnest(range(0, len(q))) AS i, unnest(q) AS q FROM q)
    SELECT id, CAST(i AS INT) AS "at", q ->> '$.question' AS question, coalesce(q ->> '$.category', 'structure') AS category FROM u WHERE trim(q ->> '$.question') <> ''"""
)
def sub_questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "llm_cache").select("id", "response").distinct().select("id", F.posexplode(text.sub_questions(F.col("response"))).alias("at", "q"))
    return q.select("id", "at", "q.question", "q.category")


@query(r"SELECT doc_id, len(b) AS blocks, coalesce(sha256(array_to_string(list_transform(b, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '|')), '') AS hash FROM (SELECT doc_id, regexp_extract_all(text, '```[^\n`]*[ \t]*\n((?s:.*?))```', 1) AS b FROM documents WHERE text IS NOT NULL)")
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = text.code_blocks(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(b).cast("bigint").alias("blocks"), F.sha2(F.array_join(b, "|"), 256).alias("hash"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL")
def page_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.page_hash(F.col("text")).alias("hash"))


@query(
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '#')), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^#+', ''), '[*`]', '', 'g'))), lambda x: x <> '') AS h, coalesce(path, '') AS path FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(coalesce(list_sum(list_transform(h, lambda x: CASE WHEN contains(lower(x), 'anchor') THEN 1 ELSE 0 END)), 0) AS BIGINT) AS hits FROM p"""
)
def heading_hits(spark: SparkSession, d: str) -> DataFrame:
    h = F.filter(text.headings(F.col("text")), lambda x: F.contains(F.lower(x), F.lit("anchor")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(h).cast("bigint").alias("hits"))


# Pages


@query()
def api_reference(spark: SparkSession, d: str) -> DataFrame:
    return pages.api_reference(extract.chunk_files(parsed(spark, d).withColumn("file_path", F.concat("repo", F.lit("/"), "file_path"))))


@query()
def file_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.file_pages(extract.chunk_files(parsed(spark, d).withColumn("file_path", F.concat("repo", F.lit("/"), "file_path"))))


@query(f"WITH {CHUNKS}, a AS (SELECT id, list_distinct(list_concat(regexp_extract_all(content, '(?m)^\\s{{4}}([A-Za-z_]\\w*)\\s*:\\s*\\w', 1), regexp_extract_all(content, 'self\\.([A-Za-z_]\\w*)\\s*(?::[^=\\n]+)?=[^=]', 1))) AS n FROM chunks WHERE chunk_type = 'class' AND language = 'python') SELECT id, CAST(least(10, len(list_filter(n, lambda x: NOT starts_with(x, '__')))) AS INT) AS attributes FROM a")
def class_attributes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("chunk_type = 'class' and language = 'python'").select("id", F.size(text.class_attributes(F.col("content"))).alias("attributes"))


# Use of entities


@query(
    f"""WITH {CHUNKS}, e AS (SELECT DISTINCT repo || ':' || file_path AS file_path, name FROM chunks WHERE chunk_type IN ('function', 'class') AND length(name) >= 4), w AS (SELECT DISTINCT repo || ':' || file_path AS caller_file, unnest(regexp_extract_all(content, '([A-Za-z_]\\w{{3,}})\\s*\\(', 1)) AS name FROM chunks)
    SELECT e.file_path, e.name, w.caller_file, CAST(row_number() OVER v AS INT) AS "at" FROM e JOIN w ON e.name = w.name AND e.file_path <> w.caller_file WINDOW v AS (PARTITION BY e.file_path, e.name ORDER BY w.caller_file) QUALIFY row_number() OVER v <= 10"""
)
def callers(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("file_path", F.concat("repo", F.lit(":"), "file_path"))
    return context.callers(c.where("chunk_type in ('function', 'class')"), c).select("file_path", "name", "caller_file", "at")


@query(
    f"""WITH {CHUNKS}, u AS (SELECT DISTINCT repo || ':' || file_path AS file_path, unnest(regexp_extract_all(content, '(?::|->)\\s*([A-Z][A-Za-z0-9]{{3,}})', 1)) AS name FROM chunks), c AS (SELECT name, min(repo || ':' || file_path) AS class_file FROM chunks WHERE chunk_type = 'class' GROUP BY name)
    SELECT u.file_path, u.name, c.class_file FROM u JOIN c USING (name) QUALIFY row_number() OVER (PARTITION BY u.file_path ORDER BY u.name) <= 10"""
)
def used_types(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("file_path", F.concat("repo", F.lit(":"), "file_path"))
    return context.used_types(c, c.where("chunk_type = 'class'")).select("file_path", "name", "class_file")


# Cache

_CACHE = "c AS (SELECT DISTINCT ON (id) * FROM llm_cache)"
_VALID = f"coalesce(epoch(TIMESTAMP '{NOW}') - floor(epoch(created_at)) < ttl_seconds, false)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_cache").dropDuplicates(["id"])


def _now() -> F.Column:
    return F.to_timestamp_ntz(F.lit(NOW))


@query(f"WITH {_CACHE} SELECT id, created_at FROM c WHERE NOT {_VALID}")
def cache_expired(spark: SparkSession, d: str) -> DataFrame:
    return cache.expired(_cache(spark, d), _now()).select("id", "created_at")


@query(f"WITH {_CACHE} SELECT model_name, count(*) AS entries, count(*) FILTER (WHERE {_VALID}) AS valid, CAST(sum(hit_count) AS BIGINT) AS hits FROM c GROUP BY model_name")
def cache_usage(spark: SparkSession, d: str) -> DataFrame:
    return cache.usage(_cache(spark, d), _now())


@query(
    f"WITH {_CACHE}, r AS (SELECT id AS request, sha256(CASE WHEN coalesce(system_prompt, '') = '' THEN prompt ELSE system_prompt || chr(10) || '---' || chr(10) || prompt END) AS h FROM c WHERE coalesce(temperature, 0) <= 0.3) SELECT request, arg_max(c.id, (c.created_at, c.id)) AS id FROM r JOIN c ON r.h = c.exact_hash WHERE {_VALID} GROUP BY request"
)
def cache_exact(spark: SparkSession, d: str) -> DataFrame:
    c = _cache(spark, d)
    return cache.exact(c.select(F.col("id").alias("request"), "system_prompt", "prompt", "temperature"), c, _now())


@query(f"WITH {_CACHE} SELECT exact_hash, id FROM c QUALIFY row_number() OVER (PARTITION BY exact_hash ORDER BY created_at DESC, id) = 1")
def cache_newest(spark: SparkSession, d: str) -> DataFrame:
    return cache.newest_per_hash(_cache(spark, d)).select("exact_hash", "id")


@query(
    f"WITH {_CACHE}, q AS (SELECT vector AS v, model_name AS m FROM c WHERE len(vector) = 64 AND model_name IS NOT NULL ORDER BY id LIMIT 1), n AS (SELECT id, model_name, m, 1 - list_sum(list_transform(list_zip(vector, v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS s, created_at, ttl_seconds FROM c, q WHERE len(vector) = 64), t AS (SELECT * FROM n WHERE NOT isnan(s) ORDER BY s DESC, id LIMIT 5) SELECT id, model_name, round(s, 6) AS similarity FROM t WHERE s >= 0.95 AND model_name = m AND {_VALID} ORDER BY s DESC, id LIMIT 1"
)
def cache_similar(spark: SparkSession, d: str) -> DataFrame:
    c = _cache(spark, d)
    first = c.where("size(vector) = 64 and model_name is not null").orderBy("id").select("vector", "model_name").first()
    return cache.similar(c, list(first[0]), first[1], _now()).select("id", "model_name", F.round("similarity", 6).alias("similarity"))


# Contents


@query("WITH p AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL) SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS section, count(*) AS pages, min(path) AS first FROM p GROUP BY section")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return toc.sections(table(spark, d, "documents").where("path is not null").select("path").distinct())


# Events


@query("WITH s AS (SELECT user_id, event_type, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS start, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths, count(*) AS events FROM g GROUP BY user_id, g")
def event_bursts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("path"), F.col("ts").alias("at"))
    return stream.debounced(e, "2 hours", "1 hour", "user_id").select("user_id", "start", F.array_join("paths", ",").alias("paths"), "events")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return stream.tumbling(table(spark, d, "events"), "ts", "1 hour", "1 hour", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - o.o * INTERVAL 1 HOUR AS start, count(*) AS events FROM events, (SELECT unnest(range(0, 3)) AS o) o GROUP BY ALL")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return stream.sliding(table(spark, d, "events"), "ts", "3 hours", "1 hour")


@query("WITH g AS (SELECT event_id, user_id, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT event_id, round(avg(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 3) AS mean_gap FROM g")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    return stream.rolling_rate(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", F.round("mean_gap", 3).alias("mean_gap"))


# Relational queries over the star schema


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    price = F.col("l_extendedprice")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    j = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def local_suppliers(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def discount_revenue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount between 0.05 and 0.07 and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey AS key, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_with_orders(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return c.join(o, "key", "left_semi").withColumn("kind", F.lit("with")).unionByName(c.join(o, "key", "left_anti").withColumn("kind", F.lit("without")))


@query("SELECT nation, 'both' AS kind FROM (SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT nation, 'customers' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def nations_of_both(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return s.intersect(c).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("customers")))


@query("SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def events_by_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("event_date")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
