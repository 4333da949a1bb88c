import json
from datetime import datetime

import pytest

from codeloom.engine import Engine
from codeloom.extract import chunks, docstrings, python_code, tests
from codeloom.plans import research
from codeloom.sinks import output
from codeloom.sources import manifests, trees

PY = '"""Mod doc."""\nimport os\nfrom a.b import c\n\nclass A(B, x.C):\n    """Doc."""\n    def m(self, a: int, *args, b="x", **kw) -> str:\n        raise errors.Bad("x")\n\n@deco\nasync def f(x, y: list[int] = None):\n    def inner():\n        raise KeyError\n    g(h(x)); os.path.join(y); print(x)\n'


def by_type(path, source, **kw):
    out = {}
    for c in chunks.chunks_of(path, source, **kw):
        out.setdefault(c["chunk_type"], []).append(c)
    return out


def test_python_chunks():
    c = by_type("p/q.py", PY)
    assert c["module"][0]["docstring"] == "Mod doc." and c["module"][0]["name"] == "q" and "# Classes: A" in c["module"][0]["content"]
    assert c["import"][0]["content"] == "import os\nfrom a.b import c" and c["import"][0]["metadata"]["import_count"] == 2
    assert c["class"][0]["metadata"] == {"line_count": 4, "parent_classes": ["B"]} and "method" not in c
    f = {x["name"]: x for x in c["function"]}
    assert set(f) == {"f", "inner"} and f["f"]["metadata"]["is_async"] and f["f"]["metadata"]["decorators"] == ["@deco"] and f["f"]["metadata"]["raises"] == []
    assert f["f"]["metadata"]["parameter_defaults"] == [("y", "None")] and f["f"]["id"] == chunks.digest("p/q.py", "func_f", f["f"]["start_line"] - 1)
    long = by_type("p/q.py", PY, split=2)
    assert long["class"][0]["metadata"]["is_summary"] and "# Methods: m" in long["class"][0]["content"] and long["method"][0]["parent_name"] == "A"
    assert long["method"][0]["metadata"]["raises"] == ["errors.Bad"] and long["method"][0]["metadata"]["parameter_types"] == [{"name": "a", "type": "int"}]
    assert [x["chunk_type"] for x in chunks.chunks_of("x.py", "def (")] == ["module"] and not list(chunks.chunks_of("x.txt", "a"))


@pytest.mark.parametrize("path,source,cls,parents,fns", [
    ("a.js", 'import x from "y";\n/** Doc. */\nexport class A extends B {\n  m(a) { return 1; }\n}\nfunction f(a) { g(a); }\nconst h = (x) => { y(x); };\n', "A", ["B"], {"f", "h"}),
    ("a.ts", "export class A extends B implements C, D {\n  m(a: string): void { x(a); }\n}\nexport function f(a: number): string { return g(a); }\n", "A", ["B", "C", "D"], {"f"}),
    ("a.go", 'package a\nimport "x"\ntype A struct {\n\tB int\n}\n// Doc.\nfunc f(a int) int {\n\treturn g(a)\n}\n', "A", [], {"f"}),
    ("A.java", "import x.Y;\npublic class A extends B implements C {\n  public int m(int a) {\n    return g(a);\n  }\n}\n", "A", ["B", "C"], set()),
    ("a.rs", "use x::y;\npub struct A { b: u32 }\n/// Doc.\npub fn f(a: u32) -> u32 {\n    g(a)\n}\n", "A", [], {"f"}),
    ("a.rb", "require 'x'\nclass A < B\n  def m(a)\n    g(a)\n  end\nend\n# Doc.\ndef f(a)\n  h(a)\nend\n", "A", ["B"], {"f"}),
    ("a.c", '#include "x.h"\nstruct A { int b; };\n/* Doc. */\nint f(int a)\n{\n  return g(a);\n}\n', "A", [], {"f"}),
])
def test_other_languages(path, source, cls, parents, fns):
    c = by_type(path, source)
    assert [x["name"] for x in c["class"]] == [cls] and c["class"][0]["metadata"]["parent_classes"] == parents
    assert {x["name"] for x in c.get("function", [])} == fns
    assert len(c["module"]) == 1 and (path == "a.ts" or len(c["import"]) == 1)
    if path in ("a.go", "a.rs", "a.rb", "a.c"):
        assert c["function"][0]["docstring"] == "Doc."


def test_calls():
    got = [(a, b) for _, a, b, _ in chunks.calls_of("q.py", PY)]
    assert got == [("A.m", "Bad"), ("f", "g"), ("f", "h")]
    js = [(a, b) for _, a, b, _ in chunks.calls_of("a.js", "class A {\n  m(a) { this.n(a); log(a); new B(a); }\n}\nfunction f() { g(h()); setTimeout(x); }\n")]
    assert ("f", "g") in js and ("f", "h") in js and ("A.m", "n") in js and not any(b in ("log", "setTimeout") for _, b in js)
    assert python_code.imports(python_code.parsed(PY)) == [(2, "os"), (3, "a.b")]


def test_docstrings():
    g = docstrings.parse("Does it.\n\nArgs:\n    a (int): first\n        more\n    *b: rest\n\nReturns:\n    A thing.\n\nRaises:\n    ValueError: if bad\n")
    assert g["description"] == "Does it." and g["args"]["a"] == {"type": "int", "description": "first more"} and g["returns"] == "A thing." and "ValueError" in g["raises"]
    n = docstrings.parse("Does it.\n\nParameters\n----------\na : int\n    first\nb\n\nReturns\n-------\nstr\n    text\n")
    assert n["args"]["a"] == {"type": "int", "description": "first"} and n["args"]["b"]["type"] is None and n["returns"] == "str text"
    assert docstrings.google("Long\ntext.\n\nNote:\n    none")["description"] == "Long text." and docstrings.parse("x")["returns"] is None
    assert docstrings.parse("D.\n\nArgs:\n    a: one\n    b (dict[str, int]): two\n        lines: more\n\nReturns:\n    x\n    y")["args"]["b"] == {"type": "dict[str, int]", "description": "two lines: more"}
    assert docstrings.parse(None)["args"] == {} and docstrings.parse("Only text.")["description"] == "Only text."


def test_snippets():
    src = "class TestA:\n    def test_x(self):\n        '''Doc.'''\n        a = make(1)\n        assert a\n\ndef test_y():\n    make(2)\n\nclass B:\n    def test_z(self): pass\n"
    got = list(tests.bodies("t.py", src))
    assert [(n, b.split("\n")[0]) for _, n, b in got] == [("TestA.test_x", "a = make(1)"), ("test_y", "make(2)")]
    long = "\n".join(["setup()"] * 6 + ["r = make(", "  1)", "assert r", "assert (r ==", "  2)", "more()"])
    assert tests.snippet(long, "make").endswith("  2)") and tests.snippet("x", "make") is None


def test_manifests(spark):
    py = '[project]\nname = "a"\nversion = "1"\nrequires-python = ">=3.11"\nlicense = {text = "MIT"}\nauthors = [{name = "N"}, {email = "e@x"}]\ndependencies = ["x>=1", "y[z]", "???"]\n[project.optional-dependencies]\ndev = ["pytest"]\n[project.scripts]\nrun = "a:main"\n'
    p = manifests.parse("pyproject.toml", py)
    assert p.name == "a" and p.dependencies == {"x": ">=1", "y": "*"} and p.dev_dependencies == {"pytest": "*"} and p.authors == ["N", "e@x"]
    assert (p.license, p.language_version, p.entry_points) == ("MIT", ">=3.11", {"run": "a:main"})
    poetry = manifests.parse("pyproject.toml", '[tool.poetry]\nname = "p"\n[tool.poetry.dependencies]\npython = "^3"\nq = "1"\nr = {version = "2"}\n[tool.poetry.dev-dependencies]\nt = "3"\n')
    assert poetry.name == "p" and poetry.dependencies == {"q": "1", "r": "2"} and poetry.dev_dependencies == {"t": "3"}
    node = manifests.parse("package.json", '{"name": "b", "main": "i.js", "bin": "c.js", "engines": {"node": ">=18"}, "scripts": {"build": "x"}, "repository": {"url": "u"}, "devDependencies": {"typescript": "^5"}}')
    assert node.language == "TypeScript" and node.entry_points == {"main": "i.js", "b": "c.js"} and node.language_version == "Node >=18" and node.scripts == {"build": "x"} and node.repository == "u"
    rust = manifests.parse("Cargo.toml", '[package]\nname="c"\nedition="2021"\n[dependencies]\ns = { version = "1" }\nl = { path = "x" }\n[[bin]]\nname = "m"\npath = "src/m.rs"\n')
    assert rust.dependencies == {"s": "1", "l": "*"} and rust.language_version == "Edition 2021" and rust.entry_points == {"m": "src/m.rs"}
    go = manifests.parse("go.mod", "module h.org/o/d\n\ngo 1.21\n\nrequire h.org/x v1.2.0\nrequire (\n\th.org/gin-gonic/gin v1.9.0 // indirect\n\t// h.org/no v1\n)\nreplace (\n\ta b\n)\n")
    assert go.name == "d" and go.language_version == "1.21" and go.dependencies == {"x": "v1.2.0", "gin": "v1.9.0"}
    pom = '<project xmlns="u"><artifactId>e</artifactId><properties><java.version>17</java.version></properties><dependencies><dependency><groupId>g</groupId><artifactId>i</artifactId><scope>test</scope></dependency><dependency><groupId>g</groupId><artifactId>k</artifactId><version>2</version></dependency></dependencies></project>'
    java = manifests.parse("pom.xml", pom)
    assert (java.name, java.language_version, java.dev_dependencies, java.dependencies) == ("e", "17", {"i": "*"}, {"k": "2"})
    assert manifests.parse("Gemfile", "gem 'rails', '~> 7'\ngem \"pg\"\n").dependencies == {"rails": "~> 7", "pg": "*"}
    gradle = manifests.parse("build.gradle", "dependencies {\n testImplementation 'g:i:1'\n implementation(\"g:k:2\")\n}\n")
    assert gradle.dev_dependencies == {"i": "1"} and gradle.dependencies == {"k": "2"}
    setup = manifests.parse("setup.py", "from setuptools import setup\nneeds = ['a>=1', 'b']\nsetup(name='s', version='2', install_requires=needs, python_requires='>=3', extras_require={'t': ['c']})\n")
    assert (setup.name, setup.version, setup.dependencies, setup.dev_dependencies, setup.language_version) == ("s", "2", {"a": ">=1", "b": "*"}, {"c": "*"}, ">=3")
    assert manifests.parse("package.json", "{bad") == manifests.parse("setup.py", "def (") == manifests.Manifest()
    f = manifests.fold({"pyproject.toml": py, "requirements.txt": "x==9\nq\n", "setup.py": 'setup(name="no")'})
    assert f.name == "a" and f.dependencies["x"] == ">=1" and "q" in f.dependencies and f.manifest_files == ["pyproject.toml", "setup.py", "requirements.txt"]
    rows = spark.createDataFrame([("r", "s/requirements.txt", "x==1\n# c\n-r y\nz\n"), ("r", "other.txt", "x"), ("r", "package.json", None), ("r", "p/pyproject.toml", py)], "repo string, path string, text string")
    assert sorted((r.name, r.version, r.is_dev) for r in manifests.dependencies(rows).collect()) == [("pytest", "*", True), ("x", "==1", False), ("x", ">=1", False), ("y", "*", False), ("z", "*", False)]
    assert manifests.unchanged({"go.mod": 1.0, "x": 2.0}, {"go.mod": 1.0}) and not manifests.unchanged({"go.mod": 1.0}, {"go.mod": 2.0})



def test_logs(spark):
    log = "\x1ea1|aa11|Ann|2025-01-02T03:04:05+02:00|fix | pipes\nsrc/a.py\nsrc/b.py\n\n\x1eb2|bb22|Bob|bad|no files\n\x1eno header\n"
    df = spark.createDataFrame([("r", x) for x in log.split("\x1e")], "repo string, record string")
    got = sorted((r.hash, r.message, r.file or "") for r in trees.commits(df).collect())
    assert got == [("a1", "fix | pipes", "src/a.py"), ("a1", "fix | pipes", "src/b.py"), ("b2", "no files", "")]
    assert trees.commits(df).where("hash = 'a1'").first().ts == datetime(2025, 1, 2, 3, 4, 5)
    sha = "a" * 40
    blame = f"{sha} 1 1 2\nauthor Ann\nauthor-mail <a@x>\nauthor-time 1700000000\nsummary first\n\tline one\n{sha} 2 2\n\tline two\n{'b' * 40} 3 3 1\n\tline three\n"
    b = spark.createDataFrame([("f", k, x) for k, x in enumerate(blame.split("\n"))], "file string, at int, text string")
    assert [(r.line, r.author, r.email) for r in trees.blame(b).orderBy("line").collect()] == [(1, "Ann", "a@x"), (2, "Ann", "a@x")]


def test_git(spark, tmp_path):
    import subprocess

    repo, logs = tmp_path / "r", tmp_path / "logs"
    repo.mkdir()
    logs.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-b", "trunk")
    assert not trees.write_git_log(str(tmp_path / "none"), str(logs / "none.log"))
    for k in range(3):
        (repo / f"f{k}.py").write_text(f"x = {k}\n")
        git("add", ".")
        git("commit", "-m", f"add | {k}")
    assert trees.write_git_log(str(repo), str(logs / "r.log"))
    got = sorted((r.repo, r.author, r.message, r.file) for r in trees.git_logs(spark, str(logs)).collect())
    assert got == [("r", "Ann", f"add | {k}", f"f{k}.py") for k in range(3)]
    assert trees.git_remote(str(repo)) is None and trees.git_branch(str(repo)) == "trunk" and trees.git_branch(str(tmp_path / "none")) == "main"
    git("remote", "add", "origin", "https://h.example/o/r.git")
    assert trees.git_remote(str(repo)) == "https://h.example/o/r.git"


def test_scan_of_underscored_names(spark, tmp_path):
    for p in ("pkg/__init__.py", "pkg/_in/a.py", "node_modules/b.js", "pkg/empty.py", ".git/c.py", "pkg/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("" if "empty" in p else "x = 1\n")
    got = {r.path: r.source_text for r in trees.scan(spark, str(tmp_path)).collect()}
    assert got == {"pkg/__init__.py": "x = 1\n", "pkg/_in/a.py": "x = 1\n", "pkg/empty.py": ""}
    assert {r.path for r in trees.listed(spark, f"file://{tmp_path}").collect()} == set(got) | {"pkg/note.txt"}


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    (src / "pkg" / "node_modules").mkdir(parents=True)
    (src / ".hidden").mkdir()
    (src / "pkg" / "a.py").write_text(PY)
    (src / "pkg" / "b.py").write_text('def load_user(name):\n    """Loads a user by name."""\n    return name\n')
    (src / "pkg" / "node_modules" / "c.js").write_text("x()")
    (src / ".hidden" / "d.py").write_text("x = 1")
    (src / "e.txt").write_text("no")
    e = Engine(spark, str(tmp_path / "index"))
    assert e.index(str(src))["added"] == 2
    assert {r.file_path for r in e.chunks().select("file_path").distinct().collect()} == {"pkg/a.py", "pkg/b.py"}
    top = e.search("load_user function", 3)
    assert "load_user" in [r.name for r in top.limit(2).collect()] and top.count() == 3 and e.search("x", 5, language="go").count() == 0
    with pytest.raises(ValueError):
        e.search("x", language="cobol")
    (src / "pkg" / "a.py").unlink()
    (src / "pkg" / "b.py").write_text("def save_user(n):\n    return n\n")
    (src / "f.py").write_text("def new_one():\n    return 1\n")
    assert e.index(str(src)) == {"added": 1, "changed": 1, "unchanged": 0, "removed": 1}
    assert {r.name for r in e.chunks().where("chunk_type = 'function'").collect()} == {"save_user", "new_one"}
    assert e.index(str(src))["unchanged"] == 2 and e.stats().where("kind = 'total'").first().files == 2
    assert e.glossary().count() == 2 and e.cycles().count() == 0 and e.inheritance().count() == 0 and e.relationships("f.py").count() == 0
    paths_ = {r.path for r in e.pages().collect()}
    assert {"files/f.md", "glossary/S.md", "coverage.md", "modules/root.md"} <= paths_ and {r.path for r in e.search_index().collect()} == paths_ and paths_ <= {r.key for r in e.toc().collect()}
    old = spark.createDataFrame([("files/f.md", datetime(2000, 1, 1))], "path string, generated_at timestamp")
    assert e.staleness(old).first().stale
    a = e.ask("What saves a user?")
    assert a["sources"] and len(a["trace"]) == 5 and e.coverage().count() == 3


def test_research():
    class Bad:
        name = "bad"

        def generate(self, prompt, system=None):
            return "not json"

    r = research.Research(None, research.HashEmbedder(8), Bad())
    assert r.questions("why?") == ["why?"]
    r = research.Research(None, research.HashEmbedder(8), Bad(), cancelled=lambda: True)
    with pytest.raises(InterruptedError):
        r.run("why?")
    with pytest.raises(ValueError):
        research.provider("none")
    calls = []
    g = research.CachedGenerator(type("G", (), {"name": "g", "generate": lambda self, p, s=None: calls.append(p) or "a" * 250})())
    assert g.generate("p") == g.generate("p") and len(calls) == 1 and len(list(g.stream("p"))) == 3
    g.generate("p", temperature=0.9)
    assert len(calls) == 2
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert research.retried(flaky, sleep=lambda s: None) == "ok"
    busy = ["429 Too many", "rate limit"]
    assert research.retried(lambda: "ok" if not busy else (_ for _ in ()).throw(RuntimeError(busy.pop())), sleep=lambda s: None) == "ok"
    with pytest.raises(KeyError):
        research.retried(lambda: {}["x"], sleep=lambda s: pytest.fail("no second try"))
    assert "Q: b" in research.with_history("q", [("x", "1"), ("a", "1"), ("b", "2"), ("c", "3")], "ctx") and "Q: x" not in research.with_history("q", [("x", "1"), ("a", "1"), ("b", "2"), ("c", "3")], "ctx")


PARENTS = [
    ("python", "a.py", "class Child(Parent, Mixin): pass\n", ["Parent", "Mixin"]), ("typescript", "a.ts", "class Child<T extends X> extends Parent<Map<A, B>> implements I1, I2<T> {\n}\n", ["Parent", "I1", "I2"]), ("javascript", "a.js", "class Child extends Parent {\n}\n", ["Parent"]),
    ("java", "A.java", "public class Child<T> extends Parent<T>\n    implements I1, I2 {\n}\n", ["Parent", "I1", "I2"]), ("swift", "a.swift", "class Child: Parent, Proto {\n}\n", ["Parent", "Proto"]), ("cpp", "a.cpp", "class Child final : public ns::Parent, private Mixin<int> {\n};\n", ["Parent", "Mixin"]), ("ruby", "a.rb", "class Child < Base::Parent\nend\n", ["Base::Parent"]),
    ("php", "A.php", "<?php\nclass Child extends Parent implements I1 {\n}\n", ["Parent", "I1"]), ("kotlin", "a.kt", "class Child(val a: Int) : Parent(a), I1 {\n}\n", ["Parent", "I1"]), ("csharp", "A.cs", "public class Child<T> : Parent, I1<T> where T : class {\n}\n", ["Parent", "I1"]), ("java", "B.java", "class Alone {\n}\n", []),
]


@pytest.mark.parametrize("lang,path,text,want", PARENTS)
def test_parents(lang, path, text, want):
    c = next(c for c in chunks.chunks_of(path, text) if c["chunk_type"] == "class")
    assert c["language"] == lang and c["metadata"]["parent_classes"] == want


class Scripted:
    name = "scripted"

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def generate(self, prompt, system=None):
        self.asked.append((prompt, system))
        return self.answers.pop(0) if self.answers else "{}"


def test_research_follows_gaps(spark):
    rows = chunks.chunk_files(spark.createDataFrame([("a.py", "def load_user(name):\n    return name\n"), ("b.py", "def save_order(order):\n    return order\n")], "file_path string, source_text string"))
    e = research.HashEmbedder(16)
    table = research.embedded(rows, "content", e)
    g = Scripted('{"sub_questions": [{"question": "load user"}]}', 'text {"follow_up_queries": ["save order", "", 3, "a", "b", "c"]}', "The answer.")
    r = research.Research(table, e, g)
    events = list(research.events_of(r, "How are users kept?"))
    assert [x.split("\n")[0] for x in events] == ["event: step"] * 6 + ["event: result"]
    assert [x["step"] for x in r.trace] == ["decompose", "retrieve", "gap_analysis", "follow_up", "rank", "answer"]
    assert '"follow_ups": ["save order", "a", "b"]' in events[-1] and "The answer." in events[-1]
    assert "- a.py: " in g.asked[1][0] and "load user" in g.asked[1][0]
    assert research.Research(table, e, Scripted("{}")).gaps("q", ["q"], r.hits(["q"], 3).limit(0)) == ["q"]
    assert research.Research(table, e, Scripted("no json")).gaps("q", ["q"], r.hits(["q"], 3)) == []
    assert list(research.events_of(research.Research(table, e, Scripted(), cancelled=lambda: True), "q"))[-1].startswith("event: error")


def test_cache_in_a_table(spark):
    e = research.HashEmbedder(16)
    empty = spark.createDataFrame([], "id string, exact_hash string, vector array<float>, system_prompt string, prompt string, response string, temperature double, model_name string, created_at timestamp_ntz, hit_count int, last_hit_at timestamp_ntz, ttl_seconds bigint")
    time = [datetime(2025, 1, 1)]
    g = Scripted("one", "two", "three")
    c = research.CachedGenerator(g, e, empty, 3600, 0.9, now=lambda: time[0])
    assert c.generate("load the user", "sys") == c.generate("load the user", "sys") == "one" and c.hits == 1
    assert c.flush().count() == 1 and c.generate("load the user", "sys") == "one" and c.hits == 2
    assert c.generate("user the load", "sys") == "one" and c.hits == 3  # the same words: similar
    time[0] = datetime(2025, 1, 2)
    assert c.generate("load the user", "sys") == "two" and c.generate("other words here", temperature=0.9) == "three"


def test_output(spark, tmp_path):
    pages = spark.createDataFrame([("a.md", "# A & B\n\ntext `x` **b**\n\n- one\n- two\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```py\na < b\n```\n"), ("d/b.md", None)], "path string, content string")
    done = output.write_pages(output.html_pages(pages), str(tmp_path)).collect()
    assert len(done) == 2
    html = (tmp_path / "a.html").read_text()
    assert "<title>A &amp; B</title>" in html and "<li>one</li>" in html and "<td>2</td>" in html and "a &lt; b" in html and (tmp_path / "d" / "b.html").exists()
    with pytest.raises(ValueError):
        output.safe_path(str(tmp_path), "../x")
    names = {"VectorStore": "files/v.md", "Store": "files/s.md", "own": "files/o.md"}
    t = output.linked("# VectorStore\nThe VectorStore and `Store` use **Store**. [VectorStore](x.md)\n```\nStore\n```\n`a Store`", names, page="files/o.md")
    assert t == "# VectorStore\nThe [VectorStore](v.md) and [`Store`](s.md) use [**Store**](s.md). [VectorStore](x.md)\n```\nStore\n```\n`a Store`"
    assert output.nested_toc([("1", "A", "a.md"), ("2", "B", None), ("2.1", "C", "b/c.md")])[1]["children"][0]["title"] == "C"
    assert "C1a --> b_c" in output.diagram([("1a", "b.c")])
    assert output.sequence({"a": ["b", "a"], "b": ["a"]}, "a").count(": call") == 3 and '"go" : 2' in output.pie([("go", 2)])
    output.search_json(pages.selectExpr("path"), pages.selectExpr("path as name"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["meta"]["total_pages"] == 2
    linked = output.link_pages(pages, spark.createDataFrame([("text", "t.md")], "name string, path string"))
    assert "[text](t.md)" in linked.where("path = 'a.md'").first().content


def test_config(tmp_path):
    from codeloom import config

    assert config.current() == config.Config() and config.Config().research == (30, 5)
    (tmp_path / "c.json").write_text('{"preset": "quick", "languages": ["go"], "other": 1}')
    c = config.load(str(tmp_path / "none.json"), str(tmp_path / "c.json"))
    assert c.preset == "quick" and c.languages == ("go",) and c.extra == {"other": 1}
    with config.override(search_limit=3) as o:
        assert config.current() is o and o.search_limit == 3
    assert config.current().search_limit == 10
    config.set_global(c)
    assert config.current() is c
    config.set_global(None)
    for bad in ({"preset": "none"}, {"languages": ["cobol"]}, {"cache_threshold": 2}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)


def test_pages(spark):
    from codeloom.plans import pages

    files = spark.createDataFrame([("p/q.py", PY), ("p/e.py", ""), ("p/n.py", None)], "file_path string, source_text string")
    c = chunks.chunk_files(files)
    ref = {r.file_path: r.text for r in pages.api_reference(c).collect()}
    assert set(ref) == {"p/q.py"} and "### `A(B)`" in ref["p/q.py"] and "### `async f(y: list[int])`" in ref["p/q.py"] and "| y | list[int] | None |" in ref["p/q.py"]
    calls = spark.createDataFrame([("p/q.py", "x.py"), ("p/q.py", "x.py")], "file_path string, caller_file string")
    made = {r.path: r.content for r in pages.file_pages(c, calls).collect()}
    assert made["files/p/q.md"].startswith("# q.py\n\nMod doc.") and made["files/p/q.md"].count("- `x.py`") == 1 and "0 definitions" in made["files/p/e.md"]
    assert {r.path for r in pages.glossary_pages(c).collect()} == {"glossary/A.md", "glossary/F.md", "glossary/I.md"}
    assert "0 of 3 documented" in pages.coverage_page(c).first().content
    deps = spark.createDataFrame([("r", "flask", "*", False), ("r", "pytest", "1", True)], "repo string, name string, version string, is_dev boolean")
    assert pages.dependency_page(deps).first().content == "# Dependencies\n\n- flask * (Web Framework)\n- pytest 1 (Testing, development)\n"
    a = spark.createDataFrame([("x", "1")], "path string, content string")
    assert [tuple(r) for r in pages.assembled([a, a.selectExpr("path", "'2' AS content")]).collect()] == [("x", "1")]
