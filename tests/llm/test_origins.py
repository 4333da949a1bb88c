import pytest

from codeloom.llm import origins

HAND = "import os\n\ndef load(path):\n    with open(path) as f:\n        text = f.read()\n    if not text:\n        return None\n    return text.split()\n\ndef main():\n    print(load('a.txt'))\n"
MIN = "!function(){" + ";".join(f"function a{k}(b){{return c+{k}}}if(a{k})d(e,{k})" for k in range(60)) + "}();\n"
DATA = "TABLE = [\n" + ",\n".join(f'"entry{k * 37}"' for k in range(60)) + "\n]\n"
GEN = "".join(f"def get_value_{k}(msg):\n    return msg._values[{k}]\n\n" for k in range(20))
CASES = [
    (None, "src/a.py", HAND), (None, "src/vendors/a.py", HAND), (None, "external_orders/a.py", HAND), (None, "src/generators/code_generator.py", HAND), (None, "a/build_plan.py", HAND),
    (None, "src/a.py", "# Copyright the my-app authors. Use under the terms in LICENSE.\n\n" + HAND), (None, "src/a.py", "# Code here feeds the generated reports of my-app.\n\n" + HAND), (None, "src/a.py", 'BANNER = "Code generated by my-app. DO NOT EDIT."\n' + HAND), (None, "src/a.py", "# This module is maintained by the my-app team; please edit with care.\n" + HAND),
    (None, "src/a.py", HAND + 'PATTERN = "' + "|".join(f"word_{k}" for k in range(200)) + '"\n'), (None, "src/a.py", HAND + "SIZES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]\n"),
    ("generated", "src/a.py", "# Code generated by gen v8. DO NOT EDIT.\n\n" + HAND), ("generated", "src/a.go", "// @generated from a.idl, rev 46\n\npackage a\n"), ("generated", "src/a.ts", "/* <auto-generated> tool: x, version 3 </auto-generated> */\nexport const a = 1;\n"), ("generated", "src/a.rs", "// This file was produced automatically from the a schema; changes will be lost.\nfn a() {}\n"),
    ("generated", "src/a_pb2.py", HAND), ("generated", "gen/a.py", HAND), ("generated", "src/a.py", GEN), ("minified", "web/a.js", MIN), ("minified", "web/a.min.js", HAND), ("minified", "web/a.js", MIN + "//# sourceMappingURL=a.js.map\n"), ("data", "src/a.py", DATA),
    ("vendored", "node_modules/a/b.js", HAND), ("vendored", "web/third_party/a.py", HAND), ("vendored", "src/kit_1.js", "/*! tinykit v1.4.4 | (c) the tinykit contributors | MIT */\n\nexport const a = 1;\n"), ("vendored", "src/kit.py", "# tinykit - a small helper library\n# version 1.0, see upstream for changes\n# Released under BSD-2-Clause\n" + HAND),
    (None, "src/my.py", "# my-app v1.2 | (c) the my-app contributors | MIT\n" + HAND), (None, None, HAND), (None, "src/a.py", " \n"), (None, "src/a.py", None),
]


@pytest.mark.parametrize("want,path,text", CASES)
def test_kinds(want, path, text):
    assert origins.kinds(path, text, "my-app")[0] == want


def test_operator(spark):
    lib = HAND.replace("load", "fetch")
    files = [
        (1, "a", "x/lib/f.py", "python", HAND), (1, "a", "x/lib/f.py", "python", HAND), (2, "b", "y/other/g.py", "python", HAND), (3, "a", "x/own.py", "python", lib), (4, "b", "y/e.yaml", None, HAND), (5, "a", "p/q/m.py", "python", lib + "\n#1"), (6, "a", "p/q/__init__.py", "python", "A = 1\n"),
        (7, "c", "v/m2.py", "python", lib + "\n#1"), (8, "c", "v/__init__.py", "python", "A = 1\n"), (9, "b", "s/t.py", "python", "A = 1\n"), (10, "b", "s/blank.py", "python", ""), (11, "b", None, "python", HAND), (12, "d", "w/h.py", "python", "# d owns this\n" + HAND), (13, "c", "w/h.py", "python", "# d owns this\n" + HAND), (None, "c", "w/k.py", "python", HAND), (14, "c", "gen/z.js", None, "let a = 1\n"),
    ]
    info = spark.createDataFrame([f[:4] for f in files], "file_id bigint, repo string, path string, language string").selectExpr("*", "1 AS kind", "'h' AS hash")
    texts = spark.createDataFrame([(f[0], f[1], f[2], f[4]) for f in files], "file_id bigint, repo string, file_path string, source_text string")
    rows = origins.classified(info, texts).collect()
    got = {r.file_id: r.kind for r in rows}
    assert {r.file_id: r.rule for r in rows}[1] == "tree"
    assert got == {1: "vendored", 2: "vendored", 5: "vendored", 6: "vendored", 7: "vendored", 8: "vendored", 13: "vendored", 14: "generated"}
    assert origins.classified(info.limit(0), texts.limit(0)).count() == 0


def test_forks_are_no_evidence(spark):
    own = {r: [HAND.replace("load", f"load_{r}_{k}") for k in range(8)] for r in "abc"}
    lib = HAND.replace("load", "library")
    files = [(f"{repo}{k}", repo, f"src/{'sub/' * (k * 20)}f{k}.py", t) for repo, of in (("a", "a"), ("fork", "a"), ("b", "b"), ("c", "c")) for k, t in enumerate(own[of])]
    files += [(f"{repo}-lib", repo, f"lib/{repo}.py", lib) for repo in ("a", "fork", "b")]
    ids = {f[0]: k for k, f in enumerate(files)}
    info = spark.createDataFrame([(ids[n], repo, p, "python") for n, repo, p, _ in files], "file_id bigint, repo string, path string, language string")
    texts = spark.createDataFrame([(ids[n], repo, p, t) for n, repo, p, t in files], "file_id bigint, repo string, file_path string, source_text string")
    assert {r.file_id for r in origins.classified(info, texts).collect()} == {ids[x] for x in ("a-lib", "fork-lib", "b-lib")}
    only = texts.where("repo in ('a', 'fork')")
    assert origins.classified(info, only).count() == 0


def test_hand_written_numbers_are_not_numbered_on():
    import random

    rng = random.Random(1)
    body = "".join(f"    int limit{n} = shard + {n};\n    if (a{rng.randrange(2, 99)} == null) {{\n        return {n};\n    }}\n" for n in (rng.randrange(2, 99) for _ in range(90)))
    assert origins.kinds("a/b.java", "class A {\n" + body + "}\n", "r")[0] is None
