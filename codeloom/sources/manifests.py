"""Package manifests (O-14, O-150 to O-152, O-173).

Each kind of file has a reader that turns its text into the fields of one record; ``fold`` lays the records of a
repository over each other. A text that does not parse gives an empty record, an entry that does not is left out.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codeloom.session import ship

# Fixed value: the kinds of manifests, in the order in which they are folded.
KINDS = ("pyproject.toml", "setup.py", "requirements.txt", "package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile")
FILLING = ("setup.py", "requirements.txt")  # these only add what is missing


@dataclass
class Manifest:
    name: str | None = None
    version: str | None = None
    description: str | None = None
    language: str | None = None
    language_version: str | None = None
    repository: str | None = None
    license: str | None = None
    authors: list[str] = field(default_factory=list)
    dependencies: dict[str, str] = field(default_factory=dict)
    dev_dependencies: dict[str, str] = field(default_factory=dict)
    entry_points: dict[str, str] = field(default_factory=dict)
    scripts: dict[str, str] = field(default_factory=dict)
    manifest_files: list[str] = field(default_factory=list)


def requirement(line: str) -> tuple[str, str] | None:
    """Name and version (``*`` if none) of a Python requirement; None for blanks, comments, options and what is none."""
    bare = re.split(r"\s+#|;", line.strip())[0].strip()
    m = re.match(r"([A-Za-z0-9][\w.\-]*)(?:\[[^\]]*\])?", bare)
    return (m[0].split("[")[0], bare[m.end() :].strip() or "*") if m else None


def _requirements(lines: Iterable[object]) -> dict[str, str]:
    return dict(r for x in lines if isinstance(x, str) and (r := requirement(x)))


def _versions(table: object, but: str = "") -> dict[str, str]:
    """Versions of a table whose values are a version or a table that holds one."""
    rows = table.items() if isinstance(table, Mapping) else ()
    return {n: str(v.get("version", "*") if isinstance(v, Mapping) else v) for n, v in rows if n.lower() != but}


def _texts(table: object) -> dict[str, str]:
    return {str(k): v for k, v in table.items() if isinstance(v, str)} if isinstance(table, Mapping) else {}


def _one(value: object, key: str) -> str | None:
    """A text, or the one under ``key`` of a table."""
    value = value.get(key) if isinstance(value, Mapping) else value
    return value if isinstance(value, str) else None


def _pyproject(text: str) -> Manifest:
    d = tomllib.loads(text)
    p, poetry = d.get("project", {}), d.get("tool", {}).get("poetry", {})
    extra = p.get("optional-dependencies", {})
    groups = [poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
    return Manifest(
        *(p.get(k) or poetry.get(k) for k in ("name", "version", "description")), "Python", p.get("requires-python"), license=_one(p.get("license"), "text"),
        authors=[str(a.get("name") or a.get("email") or "") for a in p.get("authors", []) if isinstance(a, Mapping)],
        dependencies=_requirements(p.get("dependencies", [])) | _versions(poetry.get("dependencies", {}), "python"),
        dev_dependencies=_requirements(x for xs in extra.values() for x in xs) | {n: v for g in groups for n, v in _versions(g).items()}, entry_points=_texts(p.get("scripts", {})),
    )


def _setup(text: str) -> Manifest:
    """The literal arguments of the ``setup`` call, names assigned to literals before it included."""
    tree = ast.parse(text)
    known = {t.id: n.value for n in ast.walk(tree) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
    call = next((n for n in ast.walk(tree) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", None)) == "setup"), None)
    given: dict[str, object] = {}
    for k in call.keywords if call else ():
        value = known.get(k.value.id, k.value) if isinstance(k.value, ast.Name) else k.value
        try:
            given[k.arg or ""] = ast.literal_eval(value)
        except ValueError:
            continue
    extra = given.get("extras_require")
    return Manifest(
        *(_one(given.get(k), "") for k in ("name", "version", "description")), "Python", _one(given.get("python_requires"), ""), _one(given.get("url"), ""), _one(given.get("license"), ""), [given["author"]] if isinstance(given.get("author"), str) else [],
        _requirements(given.get("install_requires") or ()), _requirements(x for xs in extra.values() for x in xs) if isinstance(extra, dict) else {},
    )


def _package(text: str) -> Manifest:
    d = json.loads(text)
    deps, dev, binary = _versions(d.get("dependencies")), _versions(d.get("devDependencies")), d.get("bin")
    node = (d.get("engines") or {}).get("node")
    entry = {"main": d["main"]} if d.get("main") else {}
    entry |= {d.get("name") or "bin": binary} if isinstance(binary, str) else _texts(binary)
    language = "TypeScript" if "typescript" in deps | dev else "JavaScript"
    return Manifest(d.get("name"), d.get("version"), d.get("description"), language, node and f"Node {node}", _one(d.get("repository"), "url"), _one(d.get("license"), "type"), [], deps, dev, entry, _texts(d.get("scripts")))


def _cargo(text: str) -> Manifest:
    d = tomllib.loads(text)
    p = d.get("package", {})
    bins = {b["name"]: b.get("path", "") for b in d.get("bin", []) if b.get("name")}
    edition = p.get("edition") and f"Edition {p['edition']}"
    return Manifest(_one(p.get("name"), ""), _one(p.get("version"), ""), _one(p.get("description"), ""), "Rust", edition, _one(p.get("repository"), ""), _one(p.get("license"), ""), [], _versions(d.get("dependencies")), _versions(d.get("dev-dependencies")), bins)


def _go_mod(text: str) -> Manifest:
    """Directives, one a line or in a block of brackets; modules go by the last part of their path."""
    m, block = Manifest(language="Go"), ""
    for line in text.split("\n"):
        ws = line.split("//")[0].split()
        if block and ws[:1] == [")"]:
            block = ""
            continue
        if len(ws) > 1 and ws[1] == "(":
            block = ws[0]
            continue
        directive, rest = (block, ws) if block else (ws[0] if ws else "", ws[1:])
        last = rest[0].rsplit("/", 1)[-1] if rest else ""
        if directive == "module" and rest:
            m.name = last
        elif directive == "go" and rest:
            m.language_version = rest[0]
        elif directive == "require" and len(rest) > 1:
            m.dependencies[last] = rest[1]
    return m


def _pom(text: str) -> Manifest:
    root = ET.fromstring(text)
    for e in root.iter():  # names without their namespace
        e.tag = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else e.tag
    m = Manifest(root.findtext("artifactId"), root.findtext("version"), root.findtext("description"), "Java", root.findtext("properties/java.version"))
    for d in root.iter("dependency"):
        if name := d.findtext("artifactId"):
            (m.dev_dependencies if d.findtext("scope") == "test" else m.dependencies)[name] = d.findtext("version") or "*"
    return m


def _gradle(text: str) -> Manifest:
    m = Manifest(language="Kotlin" if "kotlin" in text.lower() else "Java")
    for kind, place in re.findall(r"\b(\w*[iI]mplementation|api|\w*[cC]ompile)\b[\s(]*[\"']([^\"'\s]+)[\"']", text):
        parts = place.split(":")
        if len(parts) > 2:
            (m.dev_dependencies if kind.startswith("test") else m.dependencies)[parts[1]] = parts[2]
    return m


def _gems(text: str) -> Manifest:
    rows = re.findall(r"(?m)^\s*gem[\s(]+([\"'])(?P<n>[^\"']+)\1(?:\s*,\s*([\"'])([^\"']+)\3)?", text)
    return Manifest(language="Ruby", dependencies={n: v or "*" for _, n, _, v in rows})


READERS: dict[str, Callable[[str], Manifest]] = {
    "pyproject.toml": _pyproject, "setup.py": _setup, "requirements.txt": lambda t: Manifest(language="Python", dependencies=_requirements(x for x in t.splitlines() if not x.lstrip().startswith("-"))), "package.json": _package, "Cargo.toml": _cargo, "go.mod": _go_mod, "pom.xml": _pom, "build.gradle": _gradle, "build.gradle.kts": _gradle,
    "Gemfile": _gems,
}


def parse(name: str, text: str | None) -> Manifest:
    """The record of one manifest; an empty one for a text that does not parse."""
    try:
        return READERS[name](text or "")
    except (ValueError, TypeError, KeyError, AttributeError, SyntaxError, ET.ParseError):
        return Manifest()


def fold(files: Mapping[str, str]) -> Manifest:
    """One record of a repository's manifests: later ones overwrite what they have, setup.py and requirements only fill in (O-14)."""
    out = Manifest()
    for kind in KINDS:
        if kind not in files:
            continue
        for key, value in asdict(parse(kind, files[kind])).items():
            mine = getattr(out, key)
            if isinstance(mine, dict):
                setattr(out, key, value | mine if kind in FILLING else mine | value)
            elif value and (key == "language" or kind not in FILLING or not mine):
                setattr(out, key, value)
        out.manifest_files.append(kind)
    return out


_RECORD = "name string, version string, description string, language string, language_version string, repository string, license string, authors array<string>, dependencies map<string,string>, dev_dependencies map<string,string>, entry_points map<string,string>, scripts map<string,string>, manifest_files array<string>"


def records(manifests: DataFrame) -> DataFrame:
    """(repo, path, record) of manifests (repo, path, text), one row a file, in Arrow batches."""
    ship(manifests.sparkSession)
    types = _parse_datatype_string(f"repo string, path string, {_RECORD}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(types)
        for b in batches:
            rows = [{"repo": repo, "path": path} | asdict(parse(path.rsplit("/", 1)[-1], t)) for repo, path, t in zip(*(c.to_pylist() for c in b.columns))]
            for r in rows:
                r |= {k: list(v.items()) for k, v in r.items() if isinstance(v, dict)}
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    known = F.substring_index("path", "/", -1).isin(*READERS)
    return manifests.select("repo", "path", "text").where(known).mapInArrow(run, types)


def dependencies(manifests: DataFrame) -> DataFrame:
    """(repo, file, name, version, is_dev) of manifests (repo, path, text)."""
    r = records(manifests)

    def of(column: str, is_dev: bool) -> Column:
        return F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(is_dev).alias("is_dev")))

    rows = F.concat(of("dependencies", False), of("dev_dependencies", True))
    return r.select("repo", F.substring_index("path", "/", -1).alias("file"), F.explode(rows).alias("d")).select("repo", "file", "d.*")


def unchanged(kept: Mapping[str, float], now: Mapping[str, float]) -> bool:
    """Whether a record that was kept still holds: the same manifests with the same times (O-173)."""
    return {k: v for k, v in kept.items() if k in KINDS} == {k: v for k, v in now.items() if k in KINDS}
