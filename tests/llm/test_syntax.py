from pathlib import Path

import pytest

from codeloom.llm import syntax
from codeloom.llm.grammars import GRAMMARS
from codeloom.llm.lexing import LEXERS, lex, pieces, starts

GOOD = {
    "python": 'import os\n\n@deco(1)\ndef f(a: int, *b, **c) -> None:\n    """Doc\n  ( [ """\n    x = f"{a}"\n    return [y for y in (a, b)]\n\nif os:\n    pass\nelse:\n    f(1)\n',
    "javascript": 'import { a as b } from "./c";\n/* ( <<<<<<< */\nconst r = /[/(]+/g, t = `x ${b({ q: `n ${1}` })} (`;\nexport default class A extends B {\n  get x() { return this.y ? 1 : 2; }\n  async m({ a, b: [c] }, ...d) {\n    for (const k of d) { if (k) continue; else break }\n    const o = { p: 1, default: 2, async q() {}, [k]: (u) => u };\n    return o.default\n  }\n}\nlabel: for (;;) {}\nf(function () {}, async (x) => { await x })\nconst v = a\n  .b()\n  .c\nswitch (a) { case 1: b(); default: c() }\n',
    "typescript": "interface A<T> { a?: string; readonly b: Map<string, T[]>; [k: string]: any }\ntype U = 'a' | 'b';\nenum E { A = 1, B }\nexport abstract class C<T> implements A<T> {\n  private x: number = 1;\n  constructor(private readonly y?: string) { super(); }\n  m(a: string, b?: number[]): Promise<void> { return (a as any)!.b; }\n}\nexport const f = (a: number): string => `${a}`;\ndeclare module 'x' {}\n",
    "go": 'package main\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\ntype T struct {\n\tA, B int\n\tC map[string][]*T\n}\n\nconst (\n\tA = iota\n\tB\n)\n\nfunc (t *T) F(a int, b ...string) (n int, err error) {\n\tfor i := range b {\n\t\tif v, ok := t.C[b[i]]; !ok {\n\t\t\tgo func() { fmt.Println(v) }()\n\t\t} else if n > 1 {\n\t\t\tbreak\n\t\t}\n\t}\n\tswitch a {\n\tcase 1, 2:\n\t\tn++\n\tdefault:\n\t}\n\treturn t.F(1, `raw (`)\n}\n',
    "java": 'package a.b;\n\nimport static java.util.*;\n\n@Anno(x = 1)\npublic final class A<T extends B> extends C implements D, E {\n    private static final Map<String, List<T>> M = new HashMap<>();\n    int[] a = {1, 2};\n    @Override\n    public <R> R f(final String s, int... n) throws X {\n        for (String k : keys) { if (k == null) continue; }\n        String t = (String) s + """\n          text ( block""";\n        return x -> y ? (int) z : w[0];\n    }\n    enum F { P, Q; }\n}\n',
    "c": '#include <a.h>\n#define M(x) do { \\\n  y(x); } while (0)\nstruct s { int a; char *b[3]; unsigned c : 2; };\ntypedef struct s s_t;\nstatic const int t[] = { 1, 2, };\nint main(int argc, char **argv)\n{\n    struct s *p = malloc(sizeof(struct s));\n    for (int i = 0; i < 3; i++) {\n        if (p->a == \'(\') goto end;\n    }\n    switch (p->a) {\n    case 1: break;\n    default: return -1;\n    }\nend:\n    return x ? 1 : 2;\n}\n',
    "rust": 'use std::{fmt, io::Read};\n\n#[derive(Debug)]\npub struct A<\'a, T: Clone> { pub x: &\'a str, y: Vec<Option<T>> }\n\nimpl<\'a, T> A<\'a, T> where T: Clone {\n    pub async fn f(&mut self, c: char) -> Result<u32, String> {\n        let r = r#"raw " ( "#;\n        match c { \'a\'..=\'z\' if self.x == r => return Ok(1), _ => {} }\n        for i in 0..10 { println!("{}", i); }\n        let g = |a: u32| a + 1;\n        Ok(if c == \'(\' { 1 } else { g(2)? })\n    }\n}\n',
    "ruby": 'require "a"\n\nmodule A\n  class B < C\n    attr_reader :x\n    def f(a, b = 1, *c)\n      return 1 if a.nil?\n      x = if b then 1 else 2 end\n      c.each do |i|\n        puts "#{i} (" unless i > 1\n      end\n      t = <<~TEXT\n        def ( end\n      TEXT\n      case a\n      when 1 then 2\n      else 3\n      end\n    rescue E => e\n      y { |k| k =~ /(/ }\n    end\n  end\nend\n',
}


@pytest.mark.parametrize("lang", GOOD)
def test_good_and_spoilt_files(lang):
    text = GOOD[lang]
    assert syntax.valid(lang, text)
    assert syntax.valid(lang, text.replace("\n", "\r\n"))
    n = text.count("\n")
    lines = text.split("\n")
    spoilt = {
        "conflict": "\n".join([*lines[: n // 2], "<<<<<<< HEAD", lines[n // 2], "=======", "x", ">>>>>>> b", *lines[n // 2 + 1 :]]),
        "nul": text[: len(text) - 3] + "\0" + text[-3:],
        "bracket": text + ")\n",
        "prose": text + "\nPlease read this page before you change it, and ask (\n",
        "numbers": "".join(f"{k:>3} | {x}\n" for k, x in enumerate(lines, 1)),
        "html": "<!DOCTYPE html>\n<html><head><title>Sign in</title></head><body><h1>Sign in</h1></body></html>\n",
    }
    for what, s in spoilt.items():
        assert not syntax.valid(lang, s), what


def test_empty_and_comments():
    for lang in syntax.KNOWN:
        assert syntax.valid(lang, None) and syntax.valid(lang, "") and syntax.valid(lang, " \n")
        assert syntax.valid(lang, "# a ( comment\n" if lang in ("python", "ruby") else "// a ( comment\n") or lang == "go"


def test_other_languages_are_not_valid():
    pairs = [("javascript", "python"), ("javascript", "typescript"), ("go", "java"), ("java", "rust"), ("rust", "ruby"), ("c", "typescript"), ("ruby", "python"), ("python", "go"), ("typescript", "c")]
    for lang, other in pairs:
        assert not syntax.valid(lang, GOOD[other]), (lang, other)


def test_jsx():
    assert syntax.valid("javascript", 'const A = (p) => (\n  <div className="a" onClick={() => f({ a: 1 })}>\n    some text here <b>x</b>\n  </div>\n);\nexport default A;\n')


@pytest.mark.parametrize("lang", GOOD)
def test_pieces_give_what_the_whole_file_gives(lang):
    text = syntax.prepared(lang, GOOD[lang])
    for size in (1, 20, 60, 200):
        ps = pieces(text, size)
        assert "".join(ps) == text
        for bad in ("", ")", "\n(", "\n<<<<<<< a\n"):
            assert syntax.valid(lang, GOOD[lang] + bad, size, 3) == syntax.valid(lang, GOOD[lang] + bad) == (not bad)


@pytest.mark.parametrize("lang", GOOD)
def test_maps_hold_what_the_lexer_gives(lang):
    for p in pieces(syntax.prepared(lang, GOOD[lang]), 40):
        for state, got in LEXERS[lang].map(p, starts(lang)).items():
            assert got == lex(lang, p, state)


@pytest.mark.parametrize("lang", GOOD)
def test_maps_are_put_together_in_any_order(lang):
    text = syntax.prepared(lang, GOOD[lang])
    ps = pieces(text, 30)
    maps = [syntax.piece_map(lang, p, starts(lang)) for p in ps]
    left, seen = dict(maps[0]), ps[0]
    for m, p in zip(maps[1:], ps[1:]):
        left = syntax.joined(lang, left, dict(m), p)
    right, tail = dict(maps[-1]), ps[-1]
    for m, p in zip(maps[-2::-1], ps[-2::-1]):
        right = syntax.joined(lang, dict(m), right, tail)
        tail = p + tail
    assert left[""] == right[""] == syntax.reduced(lang, [dict(m) for m in maps], ps)[""]
    assert syntax.accepted(lang, left)


def test_reductions_are_associative():
    parts = ["i({", "i)[n", "s]}", ")", "]", "", "((", "i=n;"]
    for lang in ("javascript", "c", "python"):
        g = GRAMMARS[lang]
        for a in parts:
            for b in parts:
                for c in parts:
                    x, y, z = map(g.reduced, (a, b, c))
                    assert g.joined(g.joined(x, y), z) == g.joined(x, g.joined(y, z))


PYTHON = """x = 1 if a else lambda *b, c=2: b[1:2, ::3]
async def f(a: int = 1, /, *, b, **c) -> list[int]:
    async with a as b, c() as (d, e): pass
    return [y async for y in z if y], {**a, 'b': 1}, {*a}, (yield)
@a.b(c=1)
class C(D, metaclass=E):
    x: int
    y: str = ''
    try:
        pass
    except* (A, B) as e:
        raise F from e
    else: pass
    finally:
        del x, y[0]
match a:
    case [1, *b] if b: pass
    case C(x=1) | {'a': 1, **c} as d:
        pass
    case _: pass
match = case = type = 1
type X[T] = list[T]
for i, in a: break
else:
    continue
while (n := f()): print(*n, sep='')
global q; assert a, b; a += 1; a @= b; x = y = z
from . import (a, b as c,)
from ..a.b import *
import a.b as c, d
f(x for x in y)
print(f"{a['b']!r:>{w}}", not a in b is not c, -a ** ~b)
if a:
\tx
\tif b: y
\telse:
\t\tz
elif b: x""".replace("\\t", "\t")


def compiles(text):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "f", "exec", 0x400 | 0x200, dont_inherit=True)
            return True
        except (SyntaxError, ValueError):
            return False


def test_python_as_its_own_parser():
    assert compiles(PYTHON) and syntax.valid("python", PYTHON)
    lines = PYTHON.split("\n")
    for k in range(len(lines)):  # a line left out, doubled, moved in, without its end
        for bad in (lines[:k] + lines[k + 1 :], lines[:k] + ["  " + lines[k]] + lines[k + 1 :], lines[:k] + [lines[k][:-1]] + lines[k + 1 :], lines[:k], lines[:k] + [lines[k] + " b"] + lines[k + 1 :]):
            text = "\n".join(bad)
            assert syntax.valid("python", text) == compiles(text), text


DATA = "/root/testdata/sf0.01/parse_results.parquet"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_python_files_of_the_tables(spark):
    rows = spark.read.parquet(DATA).where("file_path like '%.py' and source_text <> ''").select("source_text").distinct().collect()
    assert rows
    for r in rows:
        assert syntax.valid("python", r.source_text) == syntax.valid("python", r.source_text, 100, 2) == compiles(r.source_text)


def test_operator(spark):
    files = spark.createDataFrame(
        [(1, "r", "a.py", "python", 9), (1, "r", "a.py", "python", 9), (2, "r", "b.js", None, 9), (3, "q", "c.py", "javascript", 9), (4, "q", "d.yaml", None, 9), (5, "q", "e.go", "go", 9), (None, "q", "f.go", "go", 9), (6, "q", None, None, 9)],
        "file_id bigint, repo string, path string, language string, lang int",
    )
    texts = spark.createDataFrame(
        [(1, "a.py", "x = (\n", None), (1, "a.py", "x = (\n", None), (2, "b.js", "const a = 1;\n", "error"), (3, "c.py", "const a = 1;\n", None), (4, "d.yaml", "(", None), (5, "e.go", None, None), (None, "z.go", "(", None), (7, None, "(", None)],
        "file_id bigint, file_path string, source_text string, error string",
    )
    for size, some in ((1 << 20, 4), (3, 1), (3, 2)):
        got = {r.file_id: r.valid for r in syntax.files_judged(files, texts, size, some).collect()}
        assert got == {1: False, 2: True, 3: True}
        assert [r.file_id for r in syntax.invalid_files(files, texts, size, some).collect()] == [1]
    assert syntax.invalid_files(files.limit(0), texts.limit(0)).count() == 0
    rates = {(r.repo, r.lang): (r.files, r.invalid) for r in syntax.invalid_rates(files, texts).collect()}
    assert rates[None, None] == (3, 1) and rates["r", "python"] == (1, 1)


def test_long_texts_take_no_longer_than_their_length():
    import time

    from codeloom.llm import credentials, docpairs, origins

    began = time.time()
    line = '{"a": ["' + '", "'.join(f"value {k} of x9" for k in range(20_000)) + '"]}'
    assert not credentials.find(line) and not credentials.find("`" + "word9 and text " * 30_000 + "`")
    tag = "const a = (\n  <div " + 'a="b" ' * 2000 + "\n"
    assert not syntax.valid("javascript", tag)
    assert len(list(docpairs.islands("// Doc of it.\nfunction f(a) { return 1; }\n" * 5000, "javascript"))) == 5000
    assert origins.layout(line)[2]
    assert time.time() - began < 60


CUT = [
    ("python", 'd = {"(": 1}\nx = f"{d["("]}"\ny = 2\n', True),
    ("python", 'd = {"(": 1}\nx = f"{d["("]}"\ny = (2\n', False),
    ("ruby", "a = 1\n=begin\ndef ( end\nIt's prose [\n=end\nb = 2\n", True),
    ("ruby", "a = 1\n=begin\ndef ( end\nb = 2\n", False),
    *(("ruby", f"a = %{kind}{o}\n  one's\n  two {other}\n  three\n{c}\nb = 2\n", True) for kind in ("w", "I", "q", "") for o, c, other in ("[](", "(){", "{}[")),
    ("ruby", "a = %w(\n  one's\n  two\nb = 2\n", False),
]


@pytest.mark.parametrize("lang,text,want", CUT)
def test_cut_inside_a_construct(lang, text, want):
    for size in (1, 8, 20, 1 << 20):
        for some in (1, 2, 4):
            assert syntax.valid(lang, text, size, some) == want


def test_ranges_in_all_partitions(spark):
    long = {lang: (GOOD[lang] + "\n") * (1 if lang in ("go", "java", "rust") else 30) for lang in GOOD}
    deep = "const x = `a ${ { b: `c ${\n" + "d +\n" * 50 + "e } f` } } g`;\n"
    ext = {"python": "py", "javascript": "js", "typescript": "ts", "go": "go", "java": "java", "c": "c", "rust": "rs", "ruby": "rb"}
    texts = [t for lang in long for t in ((f"a.{ext[lang]}", long[lang], True), (f"a.{ext[lang]}", long[lang] + "(\n", False))] + [("a.js", deep, True), ("a.ts", deep + "}", False)]
    rows = [(k, p, t) for k, (p, t, _) in enumerate(texts)]
    files = spark.createDataFrame([(k, "r", p, None) for k, p, _ in rows], "file_id bigint, repo string, path string, language string")
    got = {r.file_id: r.valid for r in syntax.files_judged(files, spark.createDataFrame(rows, "file_id bigint, file_path string, source_text string"), 64, 2).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(texts)}


def test_deep_and_long_files():
    import time

    began = time.time()
    n = 50_000
    for lang, head in (("python", "x = "), ("javascript", "const x = "), ("c", "int x = ")):
        tail = "" if lang == "python" else ";"
        assert syntax.valid(lang, head + "(" * n + "1" + ")" * n + tail + "\n") and not syntax.valid(lang, head + "(" * n + "1" + ")" * (n - 1) + tail + "\n")
        assert not syntax.valid(lang, head + "(" * n + "1" + "]" + ")" * (n - 1) + tail + "\n")
        assert not syntax.valid(lang, head + "([" * n + "\n")
    assert not syntax.valid("python", "f(" + ", ".join(f"a{k}=1" for k in range(2000)) + ", b c)\n")
    assert syntax.valid("python", "x = [" + "\n".join(f"    ({k}, 'a', b[{k}:])," for k in range(30_000)) + "]\n")
    assert time.time() - began < 120


def test_walk_gives_what_passes_give(monkeypatch):
    from codeloom.llm import grammars

    for lang, text in GOOD.items():
        want = [syntax.valid(lang, text), syntax.valid(lang, text + ")"), syntax.valid(lang, text + "(")]
        with monkeypatch.context() as m:
            m.setattr(grammars, "PASSES", 0)
            assert [syntax.valid(lang, text), syntax.valid(lang, text + ")"), syntax.valid(lang, text + "(")] == want == [True, False, False]
