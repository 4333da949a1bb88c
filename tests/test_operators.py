import pytest
from pyspark.sql import functions as F

from codeloom.operators import cache, changes, context, graphs, history, imports, ranking, reports, store, toc


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


CHUNK = "id string, file_path string, language string, chunk_type string, name string, content string, start_line int, end_line int, docstring string, parent_name string"


def chunk(i, path="a.py", lang="python", kind="function", name="f", content="x", start=1, end=2, doc=None, parent=None):
    return (i, path, lang, kind, name, content, start, end, doc, parent)


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), buckets=4)
    df = spark.createDataFrame([chunk("1"), chunk("1"), chunk("2", "b'q.py"), chunk("3", "c.py", None, "class", None)], CHUNK)
    s.create(df)
    assert s.read().count() == 3 and s.by_id("2").first().file_path == "b'q.py" and s.by_id("nope").count() == 0
    s.append(spark.createDataFrame([chunk("2"), chunk("4", "d.py")], CHUNK))
    assert sorted(r.id for r in s.read().collect()) == ["1", "2", "3", "4"]
    s.delete_files(spark.createDataFrame([("a.py",), ("none.py",)], "file_path string"))
    assert sorted(r.id for r in s.read().collect()) == ["2", "3", "4"]
    s.replace_files(spark.createDataFrame([chunk("9", "d.py"), chunk("8", "d.py")], CHUNK))
    assert sorted(r.id for r in s.by_file("d.py").collect()) == ["8", "9"]
    assert rows(store.stats(s.read()).where("kind = 'total'")) == [("total", None, 4, 3)]
    s.create(df.limit(0))
    assert s.read().count() == 0


def test_filters_check_their_values(spark):
    df = spark.createDataFrame([chunk("1"), chunk("2", lang="go")], CHUNK)
    assert store.filtered(df, "go").count() == 1 and store.filtered(df).count() == 2
    with pytest.raises(ValueError):
        store.filtered(df, "cobol")
    with pytest.raises(ValueError):
        store.filtered(df, chunk_type="thing")


def test_main_definitions(spark):
    df = spark.createDataFrame([chunk("1", start=1), chunk("2", kind="class", start=9, name="C"), chunk("3", "b.py", start=5, name="g"), chunk("4", "b.py", start=3, name="h")], CHUNK)
    assert [(r.file_path, r.name) for r in store.main_definitions(df).orderBy("file_path").collect()] == [("a.py", "C"), ("b.py", "h")]


def test_coverage(spark):
    df = spark.createDataFrame([chunk("1", doc="Says what it does."), chunk("2", doc="TODO", start=3), chunk("3", kind="method", name="m", parent="P", start=2), chunk("4", "b.py", kind="module")], CHUNK)
    all_ = reports.coverage(df, "file_path").where("file_path is null").first()
    assert (all_.total, all_.documented, all_.percent) == (3, 1, 33.3333)
    assert reports.undocumented(df, "file_path").first().labels == ["method P.m", "function f"]
    assert reports.coverage(df.limit(0), "file_path").where("total > 0").count() == 0


def test_glossary_and_registry(spark):
    df = spark.createDataFrame([chunk(str(k), name=n, kind=t) for k, (n, t) in enumerate([("alpha", "function"), ("Alpha", "class"), ("_private", "function"), ("123func", "function"), (None, "class"), ("get", "function"), ("VectorStore", "class")])], CHUNK)
    assert {(r.letter, r.type): r.entries for r in reports.glossary(df).collect()} == {("A", "function"): 1, ("A", "class"): 1, ("#", "function"): 2, ("U", "class"): 1, ("G", "function"): 1, ("V", "class"): 1}
    assert sorted((r.name, r.alias) for r in reports.registered(df, ["alpha"]).collect()) == [("123func", None), ("VectorStore", "Vector Store")]
    assert rows(spark.createDataFrame([("flask-sql",), ("py-test",), ("left",)], "n string").select(reports.dependency_category(F.col("n")))) == [("Web Framework",), ("Testing",), ("Other",)]


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("new", None)], "path string, hash string")
    before = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("gone", "5")], "path string, hash string")
    assert rows(changes.file_changes(now, before), "path") == [("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("gone", "removed"), ("new", "added")]
    assert changes.file_changes(now, before.limit(0)).where("status = 'added'").count() == 4
    kept = before.withColumn("extra", F.lit("old"))
    snap = changes.next_snapshot(now.withColumn("extra", F.lit("new")), kept)
    assert rows(snap.where("path = 'a'")) == [("a", "1", "old")] and snap.count() == 4
    old = spark.createDataFrame([("p", "x", "1"), ("p", "y", "1"), ("q", "x", "1"), ("r", "x", "1")], "page string, source string, hash string")
    new = spark.createDataFrame([("p", "x", "1"), ("q", "x", "2"), ("r", "x", "1"), ("s", "x", "1")], "page string, source string, hash string")
    assert rows(changes.pages_to_renew(old, new), "page") == [("p", True), ("q", True), ("r", False), ("s", True)]


def test_staleness(spark):
    pages = spark.createDataFrame([("p", "2025-01-01 00:00:00"), ("q", "2025-01-05 00:00:00"), ("r", "2025-01-01 00:00:00")], "page string, generated_at string").withColumn("generated_at", F.to_timestamp_ntz("generated_at"))
    src = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("r", "none")], "page string, source string")
    mod = spark.createDataFrame([("a", "2025-01-03 12:00:00"), ("b", "2025-01-02 00:00:00")], "source string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    s = changes.staleness(pages, src, mod, 2)
    assert [(r.page, r.days_stale, r.stale) for r in s.orderBy("page").collect()] == [("p", 2, True), ("q", None, False), ("r", None, False)]
    assert tuple(changes.freshness(s).first()) == (3, 1, 2, 66.6667)
    assert changes.staleness(pages, src, mod, 3).where("stale").count() == 0
    links = changes.sources_of_pages(pages.select("page"), src, spark.createDataFrame([("a", "q")], "source string, target string"), 1)
    assert {r.page: (r.all, [tuple(x) for x in r.sources]) for r in links.collect()}["p"] == (2, [("a", "q")])
    assert changes.banner(0) == "" and "1 day after" in changes.banner(1)


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "f"), ("f", "g"), ("g", "f"), ("x", "a"), ("a", "b")], "caller string, callee string")
    assert rows(graphs.cycle_edges(e), "caller", "callee") == [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("f", "g"), ("g", "f")]
    assert graphs.cycle_edges(spark.createDataFrame([("a", "b"), ("b", "c")], "caller string, callee string")).count() == 0
    assert graphs.cycle_edges(e.limit(0)).count() == 0
    r = graphs.reachable(e, spark.createDataFrame([("x",)], "start string"), 3)
    assert rows(r, "node") == [("x", "a", 1), ("x", "b", 2), ("x", "c", 3)]
    assert tuple(graphs.busiest(e).first()) == ("c", 2)
    assert graphs.degrees(e).where("node = 'a'").first().degree == 3
    assert rows(graphs.strongest(e, 2)) and graphs.reversed_edges(e).count() == 9


def test_inheritance(spark):
    c = spark.createDataFrame([("Base", "b.py", []), ("Mid", "a.py", ["Base", "Ext"]), ("Mid", "c.py", ["Other"]), ("Leaf", "a.py", ["Mid"]), ("Other", "o.py", None), ("Loop", "l.py", ["Loop"])], "name string, file_path string, parents array<string>")
    t = {r.name: (r.file_path, r.parents) for r in graphs.class_table(c).collect()}
    assert t["Mid"] == ("a.py", ["Base", "Ext", "Other"]) and t["Other"] == ("o.py", [])
    assert rows(graphs.roots(c), "name") == [("Base",), ("Other",)]
    tree = graphs.tree(c).orderBy("path").collect()
    assert [(r.name, r.depth) for r in tree] == [("Base", 0), ("Mid", 1), ("Leaf", 2), ("Other", 0)]
    assert graphs.connected_classes(c, 1).first().name == "Mid"


def test_imports(spark):
    df = spark.createDataFrame([chunk("1", kind="import", content="from a.b import c\nimport os, sys\n# import no\nimport _x\nfrom . import y"), chunk("2", "b.js", "javascript", "import", content='import { q } from "./z";\nconst w = require("@s/pkg");'), chunk("3", "c.go", "go", "import", content='import "net/http"'), chunk("4", "D.java", "java", "import", content="import java.util.List;")], CHUNK)
    m = imports.of_chunks(df, "id", "file_path")
    assert rows(m.select("id", "line", "module"), "id", "line") == [("1", 1, "a.b"), ("1", 2, "os"), ("1", 4, "_x"), ("1", 5, "."), ("2", 1, "./z"), ("2", 2, "@s/pkg"), ("3", 1, "net/http"), ("4", 1, "java.util.List")]
    assert {r.package for r in imports.external_counts(m).collect()} == {"a", "os", "@s/pkg", "net", "java"}
    files = spark.createDataFrame([("src/x/a/b.py",), ("lib/a/b.py",), ("os.py",), ("xa/b.py",)], "path string")
    assert rows(imports.module_files(m, files), "module") == [("a.b", "lib/a/b.py"), ("os", "os.py")]
    s = spark.createDataFrame([("p", "m"), ("p", "n"), ("q", "m"), ("q", "n"), ("q", "o"), ("r", "o"), ("r", None)], "item string, module string")
    assert rows(imports.shared(s, "item", "module")) == [("p", "q", 2)]
    rel = spark.createDataFrame([("p", "q", "imports"), ("p", "z", "imported_by")], "path string, other string, kind string")
    see = imports.see_also(rel, spark.createDataFrame([("p", "q", 3), ("p", "w", 2)], "a string, b string, shared bigint"))
    assert [(r.other, r.why) for r in see.where("path = 'p'").orderBy("at").collect()] == [("z", "uses this"), ("q", "dependency"), ("w", "shares 2 dependencies")]
    inner = spark.createDataFrame([("src/app/core/x.py", "app.util.y"), ("src/app/__init__.py", "app.z"), ("src/app/a.py", "os")], "file_path string, module string")
    assert rows(imports.internal(inner, "app")) == [("core.x", "util.y")]


def test_history(spark):
    r = spark.createDataFrame([("r1", "f", 1, 3), ("r2", "f", 500, 1200), ("r3", "g", 1, 9), ("bad", "f", 5, 4)], "range string, file string, start_line int, end_line int")
    l = spark.createDataFrame([("f", 1, "a", 5), ("f", 2, "b", 7), ("f", 3, "c", 7), ("f", 1100, "d", 1), ("f", 4, "e", 99), ("f", 600, None, None)], "file string, line int, author string, ts int")
    assert rows(history.blame_of_ranges(r, l), "range") == [("r1", 2, "b", 7), ("r2", 1100, "d", 1)]
    e = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("j", 1)], "key string, at int")
    s = spark.createDataFrame([("k", 5, "v5"), ("k", 7, "v7")], "key string, since int, v string")
    assert rows(history.as_of(e, s, "key", "at", "since", "v"), "key", "at") == [("j", 1, None), ("k", 1, None), ("k", 5, "v5"), ("k", 9, "v7")]


def test_ranking(spark):
    items = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(6)] + [(9, None)], "id int, embedding array<float>")
    h = ranking.retrieve(items, [(0, [0.0, 0.0]), (1, [5.0, 0.0])], 2, "id")
    assert rows(h.select("query", "id", "rank"), "query", "rank") == [(0, 0, 1), (0, 1, 2), (1, 5, 1), (1, 4, 2)]
    assert [r.id for r in ranking.best_of(h, "id", 3).collect()] == [0, 5, 1]
    assert ranking.retrieve(items, [], 2, "id").count() == 0 and ranking.follow_up_k(4) == 3
    tie = spark.createDataFrame([(k, [0.1]) for k in (3, 1, 2)], "id int, embedding array<float>")
    assert [r.id for r in ranking.retrieve(tie, [(0, [0.1])], 2, "id").orderBy("rank").collect()] == [1, 2]
    idx = spark.createDataFrame([("a", "Vector Store", ["Search"], ["knn"], "text"), ("b", "Other", ["vector things"], ["vector"], "a vector"), ("c", "None", [], [], None)], "path string, title string, headings array<string>, terms array<string>, snippet string")
    assert [(r.path, r.score) for r in ranking.search_pages(idx, "Vector").collect()] == [("a", 150), ("b", 110)]
    assert ranking.search_pages(idx, "v").count() == 0
    assert ranking.search_pages(idx, "vcs").first().score == 30


def test_cache(spark):
    now = F.to_timestamp_ntz(F.lit("2025-01-02 00:00:00"))
    import hashlib

    h = lambda s, p: hashlib.sha256((f"{s}\n---\n{p}" if s else p).encode()).hexdigest()
    c = spark.createDataFrame([("1", h(None, "p"), [1.0, 0.0], "m", "2025-01-01 00:00:00", 100_000, 1), ("2", h("s", "p"), [0.9, 0.1], "n", "2025-01-01 00:00:00", 10, None), ("3", h(None, "p"), None, "m", "2025-01-01 10:00:00", 100_000, 2)], "id string, exact_hash string, vector array<float>, model_name string, created_at string, ttl_seconds bigint, hit_count int").withColumn("created_at", F.to_timestamp_ntz("created_at")).withColumn("last_hit_at", F.lit(None).cast("timestamp_ntz"))
    req = spark.createDataFrame([("r1", None, "p", 0.0), ("r2", "s", "p", 0.0), ("r3", None, "p", 0.9), ("r4", "", "p", None)], "request string, system_prompt string, prompt string, temperature double")
    assert rows(cache.exact(req, c, now), "request") == [("r1", "3"), ("r4", "3")]
    assert [r.id for r in cache.similar(c, [1.0, 0.0], "m", now).collect()] == ["1"] and cache.similar(c, [1.0, 0.0], "n", now).count() == 0
    assert [r.id for r in cache.expired(c, now).collect()] == ["2"]
    assert cache.evicted(c, now, 10).count() == 3 and cache.evicted(c, now, 2).count() == 2
    assert "".join(cache.slices("x" * 250)) == "x" * 250 and len(cache.slices("x" * 250)) == 3
    log = spark.createDataFrame([("1", "2025-01-05 00:00:00"), ("1", "2025-01-04 00:00:00")], "id string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    assert {r.id: r.hit_count for r in cache.hits(c, log).collect()} == {"1": 3, "2": 0, "3": 2}


def test_contents(spark):
    p = spark.createDataFrame([("index.md",), ("z.md",), ("glossary.md",), ("files/b.md",), ("files/a.md",), ("files/sub/c.md",), ("modules/m.md",)], "path string")
    n = {r.key: r.number for r in toc.numbered(p).collect()}
    assert n == {"index.md": "1", "glossary.md": "2", "z.md": "3", "files": "4", "files/a.md": "4.1", "files/b.md": "4.2", "files/sub": "4.3", "files/sub/c.md": "4.3.1", "modules": "5", "modules/m.md": "5.1"}
    assert toc.numbered(p.limit(0)).count() == 0
    assert toc.not_listed(p, toc.numbered(p).where("key <> 'z.md'")).first().path == "z.md"
    assert toc.tree_text(["a/b.py", "a/c/d/e.py", "z.py", ".git/x"]) == "├── a/\n│   ├── c/\n│   │   └── d\n│   └── b.py\n└── z.py"


def test_context(spark):
    df = spark.createDataFrame([chunk("1", "a.py", name="load_it"), chunk("2", "b.py", content="load_it(1)"), chunk("3", "c.py", content="x = load_it (2)\ny: Store = 1"), chunk("4", "d.py", content="load_it"), chunk("5", "s.py", kind="class", name="Store")], CHUNK)
    got = context.callers(df.where("id = '1'"), df)
    assert [r.caller_file for r in got.orderBy("at").collect()] == ["b.py", "c.py"]
    assert rows(context.used_types(df, df.where("chunk_type = 'class'")).select("file_path", "name", "class_file")) == [("c.py", "Store", "s.py")]
    files = spark.createDataFrame([("src/utils.py",), ("tests/test_utils.py",), ("test/test_utils_more.py",), ("tests/utils_test.py",), ("tests/test_other.py",)], "path string")
    assert [r.test_path for r in context.test_files(files).where("path = 'src/utils.py'").orderBy("test_path").collect()] == ["test/test_utils_more.py", "tests/test_utils.py", "tests/utils_test.py"]
    t = spark.createDataFrame([("t1", "a", "x = load_it(1)"), ("t1", "b", "x = load_it(1)"), ("t1", "c", "y = load_it(2)"), ("t1", "d", "z = load_it(3)"), ("t2", "e", "short")], "test_file string, test_name string, code string")
    assert context.examples(df.where("id = '1'"), t).count() == 2
    h = spark.createDataFrame([("p", 1, "P.m", None, "a.py"), ("p", 2, "f", None, "a.py"), ("p", 3, "gone", None, "a.py")], "page string, at int, name string, class string, file_path string")
    c = spark.createDataFrame([("x", "a.py", "m", "P", "method"), ("y", "a.py", "f", None, "function"), ("z", "a.py", "m", "Q", "method")], "id string, file_path string, name string, parent_name string, chunk_type string")
    got = context.heading_chunks(h, c)
    assert rows(got.select("at", "id"), "at") == [(1, "x"), (2, "y")] and [r.id for r in context.unused_chunks(c, got).collect()] == ["z"]


def test_deep_trees_are_whole(spark):
    n = 53
    c = spark.createDataFrame([(f"C{k:02d}", "a.py", [f"C{k - 1:02d}"] if k else []) for k in range(n)], "name string, file_path string, parents array<string>")
    assert graphs.tree(c).count() == n
