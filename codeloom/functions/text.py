"""Functions of text columns: names, docs, markdown, signatures. All are expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortened(c: Column, limit: int, keep: int, tail: str = "...") -> Column:
    """``c`` if at most ``limit`` characters, else its first ``keep`` and ``tail``."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(tail))).otherwise(c)


def preview(c: Column, size: int = 500) -> Column:
    """First ``size`` characters, with dots if there are more (O-30, O-31)."""
    return shortened(c, size, size)


def embedding_text(kind: Column, name: Column, parent: Column, language: Column, doc: Column, content: Column) -> Column:
    """``<type>: <name> in <parent> (<language>) \\n<doc> \\n<content>``; parts that are null or empty are left out (O-29)."""
    some = lambda c: F.nullif(c, F.lit(""))
    lead = F.concat(kind, F.lit(":"))
    return F.concat_ws(" ", lead, some(name), F.concat(F.lit("in "), some(parent)), F.concat(F.lit("("), language, F.lit(")")), F.concat(F.lit("\n"), some(doc)), F.concat(F.lit("\n"), content))


def meaningful_docstring(doc: Column) -> Column:
    """Whether a docstring says something: ten characters or more and no placeholder; null says nothing (O-64)."""
    t = F.trim(doc)
    return F.coalesce((F.length(t) >= 10) & ~F.lower(t).isin("todo", "fixme", "xxx", "pass", "..."), F.lit(False))


def first_line(c: Column) -> Column:
    return F.trim(F.substring_index(F.trim(c), "\n", 1))


def brief(doc: Column, limit: int = 60) -> Column:
    """First line, '' where a section of parameters starts at once, cut to ``limit`` (O-145)."""
    line = first_line(doc)
    return F.when(line.rlike(r"(?i)^(args|arguments|parameters|params|returns|return|raises|yields|example|examples|note|notes|attributes)\s*:"), F.lit("")).otherwise(shortened(line, limit, limit - 3))


def camel_spaced(name: Column) -> Column:
    """``LLMProvider`` -> ``LLM Provider``; null where nothing is to split: empty, with ``_``, all lower or all upper case (O-142)."""
    s = F.regexp_replace(name, r"(?<=[^A-Z ])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    plain = (name == "") | F.contains(name, F.lit("_")) | (name == F.lower(name)) | (name == F.upper(name)) | (s == name)
    return F.when(plain, F.lit(None)).otherwise(s)


def mermaid_name(name: Column) -> Column:
    """A node name for diagrams: special characters to ``_``, a digit in front gets a ``C`` (O-143)."""
    t = F.regexp_replace(name, r"[<>\[\].\-: ]", "_")
    return F.when(t.rlike(r"^\d"), F.concat(F.lit("C"), t)).otherwise(t)


def headings(markdown: Column) -> Column:
    """Texts of the lines that start with ``#``, without marks, empty ones dropped (O-137)."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.ltrim(x).startswith("#"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^#+", ""), r"[*`]", ""))), lambda x: x != "")


def code_terms(markdown: Column) -> Column:
    """Terms between single backticks, under 50 characters: their last dotted part and the whole; sorted (O-138)."""
    found = F.filter(F.regexp_extract_all(markdown, F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda x: F.length(x) < 50)
    last = F.transform(found, lambda x: F.substring_index(x, ".", -1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(last, F.filter(found, lambda x: F.contains(x, F.lit(".")))), lambda x: x != "")))


def plain(markdown: Column) -> Column:
    """Markdown without fenced blocks, headings, link targets and marks, blanks collapsed."""
    t = F.regexp_replace(markdown, r"(?s)```.*?```", "")
    t = F.regexp_replace(t, r"(?m)^#+.*$", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[*_`]", ""), r"\s+", " "))


def snippet(markdown: Column, limit: int = 200) -> Column:
    """The plain text, cut at a word if longer than ``limit`` (O-139)."""
    t = plain(markdown)
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+\S*$", ""), F.lit("..."))).otherwise(t)


def title(markdown: Column, path: Column) -> Column:
    """First ``# `` heading or line in bold, else the stem of the path in title case (O-17, O-18)."""
    lines = F.transform(F.split(markdown, "\n"), lambda x: F.trim(x))
    found = F.filter(lines, lambda x: x.startswith("# ") | x.rlike(r"^\*\*.+\*\*$"))
    text = F.trim(F.regexp_replace(F.get(found, F.lit(0)), r"^# |^\*\*|\*\*$", ""))
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), r"[_\-]", " ")
    return F.coalesce(F.nullif(text, F.lit("")), F.initcap(stem))


def keywords(name: Column, types: Column | None = None, raises: Column | None = None) -> Column:
    """Search keywords of an entity: its name, parts by ``_`` and by camel case over two letters, base types, exceptions also without ``Error``; sorted (O-140)."""
    parts = F.filter(F.split(F.lower(name), "_"), lambda x: F.length(x) > 2)
    camel = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z][a-z]+|[a-z]+"), F.lit(0)), F.lower), lambda x: F.length(x) > 2)
    all_ = [F.array(F.lower(name)), parts, camel]
    none = F.array().cast("array<string>")
    if types is not None:
        all_.append(F.coalesce(F.transform(types, lambda x: F.lower(F.regexp_extract(x, r"^\w*", 0))), none))
    if raises is not None:
        all_ += [F.coalesce(F.transform(raises, F.lower), none), F.coalesce(F.transform(F.filter(raises, lambda x: x.endswith("Error")), lambda x: F.lower(F.regexp_replace(x, "Error$", ""))), none)]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*all_), lambda x: x.isNotNull() & (x != ""))))


def signature(params: Column, returns: Column, most: int = 3) -> Column:
    """``(a: T, b, ...) → R`` of an array of ``name`` and ``type``, at most ``most`` shown (O-146)."""
    shown = F.transform(F.slice(params, 1, most), lambda p: F.concat_ws(": ", p["name"], p["type"]))
    more = F.when(F.size(params) > most, F.array(F.concat(F.lit("+"), (F.size(params) - most).cast("string")))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.lit("("), F.array_join(F.concat(shown, more), ", "), F.lit(")"))
    return F.concat(F.when(F.size(params) > 0, body).otherwise(F.lit("(...)")), F.coalesce(F.concat(F.lit(" → "), returns), F.lit("")))


def class_attributes(content: Column, most: int = 10) -> Column:
    """Attributes of a Python class from its text: annotated ones of the body and those set on self, no dunders (O-57)."""
    body = F.regexp_extract_all(content, F.lit(r"(?m)^\s{4}([A-Za-z_]\w*)\s*:\s*\w"), F.lit(1))
    own = F.regexp_extract_all(content, F.lit(r"self\.([A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)"), F.lit(1))
    names = F.filter(F.array_distinct(F.concat(body, own)), lambda x: ~x.startswith("__"))
    return F.slice(F.transform(names, lambda x: F.concat(F.when(x.startswith("_"), F.lit("-")).otherwise(F.lit("+")), x)), 1, most)


def method_signature(content: Column) -> Column:
    """``name(a, b) R`` of the first Python function in a text: no self, cls, types or defaults, at most four shown, else three and dots (O-58)."""
    head = r"def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?:"
    ps = F.transform(F.split(F.regexp_extract(content, head, 2), ","), lambda p: F.trim(F.regexp_extract(p, r"^\s*([*\w]+)", 1)))
    ps = F.filter(ps, lambda p: ~p.isin("self", "cls", ""))
    ps = F.when(F.size(ps) > 4, F.concat(F.slice(ps, 1, 3), F.array(F.lit("...")))).otherwise(ps)
    r = F.trim(F.regexp_extract(content, head, 3))
    text = F.concat(F.regexp_extract(content, head, 1), F.lit("("), F.array_join(ps, ", "), F.lit(")"), F.when(r != "", F.concat(F.lit(" "), r)).otherwise(F.lit("")))
    return F.when(F.regexp_extract(content, head, 1) != "", text)


def remote_parts(url: Column) -> Column:
    """host, owner, name of a remote in one of the usual notations, null for others (O-13)."""
    t = F.regexp_replace(F.trim(url), r"(\.git)?/?$", "")
    ssh, at, web = r"^ssh://git@([^/:]+)(?::\d+)?/(.+)/([^/]+)$", r"^git@([^:]+):(.+)/([^/]+)$", r"^https?://(?:[^@/]+@)?([^/]+)/(.+)/([^/]+)$"
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(t, p, k), F.lit("")) for p in (at, ssh, web)])
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("host"), part(2).alias("owner"), part(3).alias("name")))


def source_url(host: Column, owner: Column, name: Column, branch: Column, path: Column, start: Column, end: Column) -> Column:
    """Address of a range of lines: GitLab's way where the host says so, else GitHub's (O-149)."""
    lab = F.lower(host).contains("gitlab")
    one = F.concat(F.lit("#L"), start.cast("string"))
    to = F.when(end.isNull() | (end == start), F.lit("")).otherwise(F.concat(F.when(lab, F.lit("-")).otherwise(F.lit("-L")), end.cast("string")))
    base = F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/"), name, F.when(lab, F.lit("/-/blob/")).otherwise(F.lit("/blob/")), branch, F.lit("/"), path)
    return F.concat(base, F.coalesce(F.concat(one, to), F.lit("")))


def days_ago(then: Column, now: Column) -> Column:
    """today, yesterday, n days, n weeks ago, from 30 days on the date (O-147)."""
    d = F.datediff(now, then)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))
    return F.when(d <= 0, F.lit("today")).when(d == 1, F.lit("yesterday")).when(d < 7, ago(d, "day")).when(d < 30, ago(F.floor(d / 7), "week")).otherwise(F.date_format(then, "MMM dd, yyyy"))


def duration(seconds: Column) -> Column:
    """s, m s or h m (O-148)."""
    s = F.floor(seconds).cast("int")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", (s / 60).cast("int"), s % 60)).otherwise(F.format_string("%dh %dm", (s / 3600).cast("int"), (s % 3600 / 60).cast("int")))


def requirement(line: Column) -> Column:
    """name and version (``*`` if none) of a dependency line; null for blanks, comments and options (O-150)."""
    t = F.trim(F.regexp_replace(line, r"\s*(#|;).*$", ""))
    name = F.regexp_extract(t, r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(.*)$", 1)
    version = F.trim(F.regexp_extract(t, r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(.*)$", 2))
    return F.when((name != "") & ~t.startswith("-"), F.struct(name.alias("name"), F.coalesce(F.nullif(version, F.lit("")), F.lit("*")).alias("version")))


def json_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a text, null if there is none (O-154)."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def sub_questions(text: Column) -> Column:
    """question and category (``structure`` if none) of the JSON in a model's answer; [] where it is not valid (O-154)."""
    parsed = F.from_json(json_part(text), "sub_questions array<struct<question:string,category:string>>")
    ok = F.filter(parsed["sub_questions"], lambda q: q["question"].isNotNull() & (F.trim(q["question"]) != ""))
    return F.coalesce(F.transform(ok, lambda q: F.struct(q["question"].alias("question"), F.coalesce(q["category"], F.lit("structure")).alias("category"))), F.array().cast("array<struct<question:string,category:string>>"))


def code_blocks(markdown: Column, tag: str | None = None) -> Column:
    """Trimmed bodies of fenced blocks, of one tag if given (O-155, O-159)."""
    head = tag or r"[^\n`]*"
    return F.transform(F.regexp_extract_all(markdown, F.lit(rf"(?s)```{head}[ \t]*\n(.*?)```"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def segments(markdown: Column) -> Column:
    """text and is_code of the parts between fence lines of backticks or tildes (O-155)."""
    parts = F.split(markdown, r"(?md)^[ \t]*(?:```|~~~)[^\n]*$\n?")
    return F.transform(parts, lambda x, k: F.struct(x.alias("text"), (k % 2 == 1).alias("is_code")))


def without_section(markdown: Column, heading: str) -> Column:
    """The text without the section of a ``## `` heading, up to the next (O-157)."""
    return F.regexp_replace(markdown, rf"(?s)## {heading}.*?(?=## |\z)", "")


def breadcrumbs(path: Column) -> Column:
    """Every directory a path lies in, from the root down (O-160)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def relative_path(source: Column, target: Column) -> Column:
    """How to reach a page from another: ``..`` up to the common directory, then down (O-144)."""
    a, b = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1), F.split(target, "/")
    least = F.least(F.size(a), F.size(b) - 1)
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(least, F.lit(1)) - 1), F.lit(0), lambda n, k: F.when((n == k) & (k < least) & (F.get(a, k) == F.get(b, k)), n + 1).otherwise(n))
    ups = F.array_repeat(F.lit(".."), F.size(a) - same)
    return F.array_join(F.concat(ups, F.slice(b, same + 1, F.size(b) - same)), "/")


def page_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def chunk_id(path: Column, key: Column, line: Column) -> Column:
    """First 16 hex digits of the hash of path, key and line (O-161)."""
    return F.substring(F.sha2(F.concat_ws(":", path, key, line.cast("string")), 256), 1, 16)


def prompt_hash(system: Column, prompt: Column) -> Column:
    """Hash of a request; without a system prompt, of the prompt alone (O-85)."""
    return F.sha2(F.when(F.coalesce(system, F.lit("")) == "", prompt).otherwise(F.concat(system, F.lit("\n---\n"), prompt)), 256)
