import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, text, vectors


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, v if hasattr(v, "alias") else F.lit(v))
    return df.select(expr.alias("x")).first()[0]


c = F.col


@pytest.mark.parametrize("name,want", [("VectorStore", "Vector Store"), ("LLMProvider", "LLM Provider"), ("HTTPClient", "HTTP Client"), ("lower", None), ("UPPER", None), ("snake_case", None), ("", None), ("Single", None)])
def test_camel(spark, name, want):
    assert one(spark, text.camel_spaced(c("n")), n=name) == want


@pytest.mark.parametrize("doc,want", [(None, False), ("", False), ("hi", False), ("TODO", False), ("...", False), ("pass", False), ("A real sentence here.", True), ("  padded    ", False)])
def test_meaningful(spark, doc, want):
    assert one(spark, text.meaningful_docstring(c("d")), d=F.lit(doc).cast("string")) is want


@pytest.mark.parametrize("path,want", [("a/b.py", "python"), ("a/b.PYI", "python"), ("x.tsx", "tsx"), ("c.h", "c"), (".gitignore", None), ("noext", None), ("a.b/c", None), ("x.unknown", None)])
def test_language(spark, path, want):
    assert one(spark, paths.language(c("p")), p=path) == want == paths.language_of(path)


def test_urls(spark):
    for url, want in {"git@h.org:o/r.git": ("h.org", "o", "r"), "https://h.org/a/b/r": ("h.org", "a/b", "r"), "ssh://git@h.org/o/r.git": ("h.org", "o", "r"), "file:///x": None}.items():
        got = one(spark, text.remote_parts(c("u")), u=url)
        assert (tuple(got) if got else None) == want
    args = {"h": "github.com", "o": "o", "n": "r", "b": "main", "p": "a.py"}
    url = lambda a, b: one(spark, text.source_url(c("h"), c("o"), c("n"), c("b"), c("p"), F.lit(a), F.lit(b)), **args)
    assert url(3, 9) == "https://github.com/o/r/blob/main/a.py#L3-L9" and url(3, 3).endswith("#L3")
    assert one(spark, text.source_url(F.lit("gitlab.x"), c("o"), c("n"), c("b"), c("p"), F.lit(3), F.lit(9)), **args) == "https://gitlab.x/o/r/-/blob/main/a.py#L3-9"


def test_markdown(spark):
    t = "# Title `x`\n\nSome `a.b` and `c` text [link](u.md).\n\n```py\n# no\n```\n## Second *one*\n"
    assert one(spark, text.headings(c("t")), t=t) == ["Title x", "no", "Second one"]
    assert one(spark, text.code_terms(c("t")), t=t) == ["a.b", "b", "c", "x"]
    assert one(spark, text.snippet(c("t")), t=t) == "Some a.b and c text link."
    assert one(spark, text.snippet(c("t")), t="word " * 60).endswith("word...")
    assert one(spark, text.title(c("t"), c("p")), t="no title", p="a/my_page.md") == "My Page"
    assert one(spark, text.title(c("t"), c("p")), t="**Bold**", p="x") == "Bold"
    assert one(spark, text.code_blocks(c("t"), "mermaid"), t="```mermaid\na-->b\n```\n```py\nx\n```") == ["a-->b"]
    assert one(spark, text.without_section(c("t"), "Relevant Source Files"), t="a\n## Relevant Source Files\nx\n## Next\ny") == "a\n## Next\ny"
    assert [r["is_code"] for r in one(spark, text.segments(c("t")), t=t)] == [False, True, False]


def test_names_and_signatures(spark):
    assert one(spark, text.mermaid_name(c("n")), n="1a.b-c<T>") == "C1a_b_c_T_"
    assert one(spark, text.method_signature(c("t")), t="def f(self, a: int, b=2, *c, **d) -> str:\n") == "f(a, b, *c, **d) str"
    assert one(spark, text.method_signature(c("t")), t="def f(a, b, c, d, e):\n") == "f(a, b, c, ...)"
    assert one(spark, text.method_signature(c("t")), t="x = 1") is None
    assert one(spark, text.class_attributes(c("t")), t="class A:\n    x: int\n    def f(self):\n        self._y = 1\n        self.__z__ = 2\n") == ["+x", "-_y"]
    p = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).cast("string").alias("type")) for n, t in (("a", "int"), ("b", None), ("c", None), ("d", None))])
    assert one(spark, text.signature(p, F.lit("str"))) == "(a: int, b, c, +1) → str"
    assert "validation" in one(spark, text.keywords(c("n"), raises=F.array(F.lit("ValidationError"))), n="load_user")
    assert one(spark, text.requirement(c("t")), t="a-b[x]>=1 # c") == ("a-b", ">=1") and one(spark, text.requirement(c("t")), t="# c") is None
    assert one(spark, text.relative_path(c("a"), c("b")), a="files/x/a.md", b="modules/m.md") == "../../modules/m.md"
    assert one(spark, text.relative_path(c("a"), c("b")), a="files/a.md", b="files/b/c.md") == "b/c.md"
    assert one(spark, text.relative_path(c("a"), c("b")), a="a.md", b="b.md") == "b.md"
    assert one(spark, text.breadcrumbs(c("p")), p="a/b/c.md") == ["a", "a/b"]
    assert one(spark, text.chunk_id(c("p"), F.lit("module"), F.lit(0)), p="a.py") == __import__("hashlib").sha256(b"a.py:module:0").hexdigest()[:16]


def test_times(spark):
    day = lambda d: one(spark, text.days_ago(F.date_sub(F.lit("2025-03-31").cast("date"), d), F.lit("2025-03-31").cast("date")))
    assert [day(d) for d in (0, 1, 3, 8, 60)] == ["today", "yesterday", "3 days ago", "1 week ago", "Jan 30, 2025"]
    assert [one(spark, text.duration(F.lit(s))) for s in (5, 65, 3700)] == ["5s", "1m 5s", "1h 1m"]


def test_sub_questions(spark):
    q = lambda t: [tuple(x) for x in one(spark, text.sub_questions(c("t")), t=F.lit(t).cast("string"))]
    assert q('Sure: {"sub_questions": [{"question": "a", "category": "flow"}, {"question": "b"}, {"question": " "}]} ok') == [("a", "flow"), ("b", "structure")]
    assert q("no json") == [] and q("{bad}") == [] and q(None) == []


def test_vectors(spark):
    a = F.array(*[F.lit(x).cast("float") for x in (1.0, 0.0)])
    b = F.array(*[F.lit(x).cast("float") for x in (0.0, 2.0)])
    assert one(spark, vectors.squared_distance(a, b)) == 5 and one(spark, vectors.cosine(a, b)) == 0 and one(spark, vectors.cosine(a, a)) == 1
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, z)) is None
