"""Credentials embedded in source code and settings.

Each literal, joined literal, settings value and word of a comment is segmented by Viterbi into words of a dictionary
and characters no word explains; the dictionary is the vocabulary of a public tokenizer, whose ranks give the costs. What
stays unexplained, in bits, is weighed with the context: where the name assigned to, the function called or the words
before say that a secret follows, a short remainder is enough; elsewhere a long one is needed. Formats of hashes, ids and
embedded data are out, as are references and placeholders. Addresses with a password, headers, signed tokens, access key
ids, keyed hexadecimal values and key blocks only name the part to be segmented: that, too, is a secret by what no word
explains in it. The rest of a content stays as it is: masks have the length of what they hide.

The name before a value is read backwards from it, the call around it comes from the brackets open there, kept on the
way through the content; so a context may be as long as its line, and the work stays linear.

Null contents hold nothing; repeated rows of one id count once; the line is where the value, its first part if joined,
or the BEGIN line starts.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import tokens
from codeloom.llm.common import rows_out

STRONG_BITS, ID_BITS, HOOK_BITS, WEAK_BITS = 6.0, 40.0, 50.0, 90.0
SECRET_WORDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "credential", "credentials", "auth", "apikey", "dbpass", "passwort", "contraseña"}
KEY_OF = {"api", "access", "secret", "private", "signing", "encryption", "master", "session", "auth", "account", "service"}
NOT_WORDS = {"label", "field", "name", "names", "hint", "title", "type", "format", "length", "len", "count", "policy", "path", "file", "page", "param", "header_name", "placeholder", "regex", "pattern", "column", "prefix", "suffix"}
OTHER_WORDS = {"checksum", "digest", "etag", "commit", "sha", "sha1", "sha256", "md5", "hash", "build", "revision", "uuid", "guid", "trace", "icon", "image", "integrity", "fingerprint", "public", "thumbnail", "font", "etags", "version"}
CALLS = {"connect", "login", "authenticate", "authorize", "auth", "signin", "password", "credentials", "token"}
PLACEHOLDERS = {"example", "changeme", "dummy", "placeholder", "your", "replace", "fake", "redacted", "insert", "todo", "none", "null", "undefined"}

_LIT = r'"""(?s:(?:[^\\]|\\.)*?)"""|\'\'\'(?s:(?:[^\\]|\\.)*?)\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
TOKEN = re.compile(rf"(?P<lit>(?P<concat>concat!\(\s*)?(?:{_LIT})(?(concat)(?:\s*,\s*(?:{_LIT}))*|(?:[ \t]*(?:\+|\.\.|\\\n|\n)?\s*(?:{_LIT}))*))|(?P<com>(?://|\#|/\*|(?<![^\s])\*(?=\s)|(?<![^\s])--(?=\s))[^\n]*)")
PART = re.compile(_LIT)
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?s:(?:(?!-----BEGIN ).)*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|\Z)")
SETTING = re.compile(r"""^[ \t]*(?:export[ \t]+|-[ \t]+)?["']?([\w.\-]+)["']?[ \t]*[:=][ \t]*([^\s"'#\[{][^\n]*?)[ \t]*,?[ \t\r]*$""", re.M)
SETTING_FILE = r"(?i)\.(env|ya?ml|json|toml|ini|cfg|conf|properties|tfvars)$|(^|/)\.env[^/]*$"
# Read backwards from a value: what is assigned to, with its type; what stands between a bracket and its call; the argument a value is for.
ASSIGNED = re.compile(r"""(?:[&*]|[brfu]|\(morf::gnirtS|\(gnirtS wen)?[ \t]*(?:=:|>=|=|:)[ \t]*(?:[\w&' \t<>*\[\]]+?[ \t]*:)?[ \t]*["'\]]?((?:\w+[.\-])*\w*[A-Za-z_])(?!\w)""")
ARGUMENT = re.compile(r"[ \t]*(?:[=:][ \t]*\w+[ \t]*)?(?=[(,])")
CALLED = re.compile(r"\(!?(\w*[A-Za-z_])(?!\w)")
BRACKET = re.compile(r"[()]")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")
REFERENCE = re.compile(r"^(?:\$\{?\w|\{\{|%\(|<[^<>]*>$|\$\(|process\.env|os\.environ|env[(:.\[]|vault[:.(]|secrets?\.|@)|\$\{|\{\{|%\(|^\*{3,}|^(.)\1{5,}$|^\.\.\.")
HEX, UUID = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
HASH_SIZES = {32, 40, 56, 64, 96, 128}
DSN = re.compile(r"\b[a-z][a-z0-9+.\-]*://[^\s:/@\"']*:([^\s@/\"']+)@[\w.\-]+")
URL = re.compile(r"https?://\S+")
BASIC = re.compile(r"\b(?:Basic|basic)\s+([A-Za-z0-9+/]{8,}={0,2})(?![\w+/])")
JWT = re.compile(r"\beyJ[\w\-]{8,}\.[\w\-]{10,}(?:\.[\w\-]+)?")
# How data and hashes begin, the former also in base64 (images, fonts, archives, documents).
DATA = re.compile(r"^data:|;base64,|sourceMappingURL|^sha\d+-|^\$2[aby]\$|^(?:iVBORw0KGgo|/9j/|R0lGOD|UklGR|AAEAAA|d09GR|UEsDB|H4sI|JVBERi0|PHN2Zy|PD94bWw|AGFzbQ)")
RUN = re.compile(r"[A-Za-z]+|\d+|[^A-Za-z\d]")


@lru_cache(2)
def dictionary(path: str = tokens.DEFAULT) -> dict[str, float]:
    """Word -> bits, from the vocabulary file of a tokenizer: letters only, four or more, or three of the commonest."""
    out: dict[str, float] = {}
    with open(path, "rb") as f:
        for line in f:
            word, rank = line.split()
            word = base64.b64decode(word).strip().lower()
            if word.isalpha() and word.isascii() and (len(word) > 3 or len(word) == 3 and int(rank) < 3000):
                out.setdefault(word.decode(), math.log2(int(rank) + 2))
    return out


@lru_cache(2)
def longest_of(path: str = tokens.DEFAULT) -> int:
    return max(map(len, dictionary(path)), default=0)


@lru_cache(100_000)
def segment(value: str, path: str = tokens.DEFAULT) -> tuple[tuple[str, ...], float, int]:
    """Words of the cheapest segmentation, bits of what no word explains, and the characters of the longest stretch of that."""
    known, longest_word = dictionary(path), longest_of(path)
    words, bits, stretch, longest = [], 0.0, 0, 0
    for m in RUN.finditer(value):
        r = m[0]
        if r.isdigit():
            bits += 3.32 * len(r)
            stretch += len(r)
        elif not r.isalpha() or not r.isascii():
            if r not in "-_./ ":
                bits += 4
                stretch += 1
        else:
            n, low = len(r), r.lower()
            best = [0.0] + [math.inf] * n
            back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
            for i in range(n):
                c = best[i] + 8.0
                if c < best[i + 1]:
                    best[i + 1], back[i + 1] = c, (i, False)
                for j in range(i + 3, min(n, i + longest_word) + 1):
                    b = known.get(low[i:j])
                    if b is not None and best[i] + b < best[j]:
                        s = r[i:j]
                        if s.islower() or s.isupper() or s[1:].islower():
                            best[j], back[j] = best[i] + b, (i, True)
            parts, j = [], n
            while j:
                i, is_word = back[j]
                parts.append((r[i:j], is_word))
                j = i
            for s, is_word in reversed(parts):
                if is_word:
                    words.append(s.lower())
                    stretch = 0
                else:
                    bits += 5.7
                    stretch += 1
                longest = max(longest, stretch)
        longest = max(longest, stretch)
    return tuple(words), bits, longest


def name_words(name: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(name)]


def says_secret(words: list[str]) -> bool:
    if not words or NOT_WORDS & set(words[-2:]):
        return False
    return bool(SECRET_WORDS & set(words)) or any(b in ("key", "keys") and a in KEY_OF for a, b in zip(words, words[1:])) or "apikey" in "".join(words)


def placeholder(value: str, path: str) -> bool:
    if REFERENCE.search(value) or len(set(value)) <= 2:
        return True
    words, bits, _ = segment(value, path)
    return bool(PLACEHOLDERS & set(words)) and bits < 25 or not bits


def password_like(value: str, path: str, least: int = 8) -> bool:
    if len(value) < least or placeholder(value, path):
        return False
    _, bits, longest = segment(value, path)
    return bits >= STRONG_BITS and (any(c.isdigit() for c in value) and any(c.isalpha() for c in value) or longest >= 10 or bits >= 35)


def secret_span(value: str, words: list[str], kind: str, path: str = tokens.DEFAULT) -> tuple[int, int] | None:
    """Where in ``value`` its secret is, or None. ``words``: of the name, function or text before it; ``kind``: name, call, text or none."""
    strong = says_secret(words)
    if DATA.search(value):
        return None
    if m := DSN.search(value):
        return m.span(1) if len(m[1]) > 4 and not placeholder(m[1], path) and segment(m[1], path)[1] >= STRONG_BITS else None
    if m := BASIC.search(value):
        try:
            user, colon, word = base64.b64decode(m[1] + "=" * (-len(m[1]) % 4)).decode("ascii").partition(":")
        except (ValueError, binascii.Error, UnicodeDecodeError):
            return m.span(1) if segment(m[1], path)[1] >= WEAK_BITS else None
        return m.span(1) if colon and len(word) > 3 and not placeholder(word, path) else None
    if m := JWT.search(value):
        return m.span() if segment(m[0], path)[1] >= WEAK_BITS else None
    if value.startswith(("Bearer ", "bearer ", "token ")):
        at = value.index(" ") + 1
        s = secret_span(value[at:], ["token"], "name", path)
        return s and (s[0] + at, s[1] + at)
    if m := URL.search(value):
        if "hook" not in m[0] and "hook" not in words and not strong:
            return None
        tail = re.search(r"[A-Za-z0-9_\-]{20,}(?=/?$)", m[0])
        if tail and segment(tail[0], path)[1] >= HOOK_BITS and not placeholder(tail[0], path):
            return m.start() + tail.start(), m.start() + tail.end()
        return None
    if re.search(r"\s", value) or REFERENCE.search(value) or UUID.fullmatch(value):
        return None
    whole = (0, len(value))
    if HEX.fullmatch(value) and (len(value) in HASH_SIZES or len(value) >= 24):
        keyed = strong and ({"secret", "signing", "hmac"} & set(words) or "key" in words)
        keyed = keyed and len(value) not in HASH_SIZES - {32} and not OTHER_WORDS & set(words)
        return whole if keyed and segment(value, path)[1] >= HOOK_BITS else None
    if (strong or kind == "call" and CALLS & set(words)) and password_like(value, path):
        return whole
    if kind == "none" or len(value) < 16:
        return None
    if m := re.fullmatch(r"(?:AKIA|ASIA|AGPA|AIDA|AROA)([A-Z0-9]{16})", value):
        return whole if segment(m[1], path)[1] >= ID_BITS and not PLACEHOLDERS & set(segment(m[1], path)[0]) else None
    mixed = sum(map(bool, (re.search(r"\d", value), re.search("[a-z]", value), re.search("[A-Z]", value))))
    if not re.fullmatch(r"[\w+/=.~\-]+", value) or placeholder(value, path):
        return None
    body = re.sub(r"^(?:[a-z]{2,8}[_\-])+", "", value)
    if body == value and (OTHER_WORDS & set(words) and not strong or kind == "text" and not words):
        return None
    _, bits, longest = segment(body, path)
    return whole if mixed == 3 and bits >= WEAK_BITS and longest >= 8 else None


def _text_spans(text: str, at: int, path: str) -> Iterable[tuple[int, int]]:
    """Secrets among the words of a comment or running text."""
    for p in (DSN, BASIC, JWT):
        for m in p.finditer(text):
            if s := secret_span(m[0], [], "text", path):
                yield at + m.start() + s[0], at + m.start() + s[1]
    names = [(m.end(), m[0]) for m in re.finditer(r"[A-Za-z][\w\-]*|\n", text)]
    ends = [e for e, _ in names]
    for m in re.finditer(r"[^\s\"'`,;()]{8,}", text):
        v = m[0].rstrip(".:")
        if "://" in v and DSN.search(v) or not any(c.isdigit() for c in v) and len(v) < 16:
            continue
        k = bisect_right(ends, m.start())
        before = [w for _, w in names[max(0, k - 3) : k]]
        if "\n" in before:
            before = before[len(before) - before[::-1].index("\n") :]
        words = [w for b in before for w in name_words(b)]
        eq = re.match(r"([A-Za-z_][\w.\-]*)[=:](?=.{8})", v)
        if eq and says_secret(name_words(eq[1])):
            words, v, off = name_words(eq[1]), v[eq.end() :], eq.end()
        else:
            off = 0
        if s := secret_span(v, words, "text", path):
            yield at + m.start() + off + s[0], at + m.start() + off + s[1]


def find(content: str, settings: bool = False, path: str = tokens.DEFAULT) -> list[tuple[int, list[tuple[int, int]]]]:
    """(start of the value, spans to mask) of each credential, in order."""
    out: list[tuple[int, list[tuple[int, int]]]] = []
    blocks = []
    if "PRIVATE KEY" in content:
        for m in BLOCK.finditer(content):
            body = content.find("\n", m.start(), m.end())
            if body < 0:
                body = m.start() + 27
            end = content.rfind("-----END", m.start(), m.end())
            spans = [(m.start() + x.start() + body - m.start(), m.start() + x.end() + body - m.start()) for x in re.finditer(r"[^\s\"'+\\*]{16,}", content[body : end if end > 0 else m.end()])]
            if sum(segment(content[a:b], path)[1] for a, b in spans) >= WEAK_BITS:
                blocks.append(m.span())
                out.append((m.start(), spans))
    back, calls, seen = None, [], 0  # the content reversed; places of the brackets open here
    for m in TOKEN.finditer(content):
        for x in BRACKET.finditer(content, seen, m.start()):
            if x[0] == "(":
                calls.append(x.start())
            elif calls:
                calls.pop()
        seen = m.end()
        if blocks and any(a < m.end() and m.start() < b for a, b in blocks):
            continue
        if m.lastgroup == "com" or m["com"] is not None:
            text = m["com"]
            if len(text) > 10:
                out += [(a, [(a, b)]) for a, b in _text_spans(text, m.start(), path)]
            continue
        if m.end() - m.start() < 10:
            continue
        spans = []
        for p in PART.finditer(content, m.start("lit"), m.end("lit")):
            q = 3 if p[0][:3] in ('"""', "'''") and len(p[0]) > 5 else 1
            if p.end() - p.start() > 2 * q:
                spans.append((p.start() + q, p.end() - q))
        value = "".join(content[a:b] for a, b in spans)
        if len(value) < 8 or len(value) < 16 and value.isalpha():
            continue
        if "\n" in value or " " in value and not BASIC.match(value) and not value.startswith(("Bearer ", "bearer ")):
            if len(value) > 12:
                for a, b in spans:
                    out += [(x, [(x, y)]) for x, y in _text_spans(content[a:b], a, path)]
            continue
        if back is None:
            back = content[::-1]
        at = len(content) - m.start()
        if k := ASSIGNED.match(back, at):
            s = secret_span(value, name_words(k[1][::-1]), "name", path)
        elif calls and content.find("\n", calls[-1], m.start()) < 0 and ARGUMENT.match(back, at) and (k := CALLED.match(back, len(content) - calls[-1] - 1)):
            s = secret_span(value, name_words(k[1][::-1]), "call", path)
        else:
            s = secret_span(value, [], "none", path)
        if s:
            mask, pos = [], 0
            for a, b in spans:
                lo, hi = max(s[0], pos), min(s[1], pos + b - a)
                if lo < hi:
                    mask.append((a + lo - pos, a + hi - pos))
                pos += b - a
            out.append((spans[0][0], mask))
    if settings:
        for m in SETTING.finditer(content):
            if s := secret_span(m[2], name_words(m[1]), "name", path):
                out.append((m.start(2), [(m.start(2) + s[0], m.start(2) + s[1])]))
    first = {}
    for start, spans in sorted(out):
        first.setdefault((start, spans[0]), spans)
    return [(start, spans) for (start, _), spans in first.items()]


def masked(content: str, found: list[tuple[int, list[tuple[int, int]]]]) -> str:
    """The content with the spans of what was found under asterisks of equal number."""
    out, at = [], 0
    for a, b in sorted(s for _, spans in found for s in spans):
        if b > at:
            out += [content[at : max(a, at)], "*" * (b - max(a, at))]
            at = b
    return "".join(out) + content[at:]


def _found(batch: dict[str, list], path: str) -> Iterable[tuple]:
    for i, text, settings in zip(batch["id"], batch["content"], batch["settings"]):
        for start, _ in find(text, settings, path):
            yield i, text.count("\n", 0, start) + 1


def _redacted(batch: dict[str, list], path: str) -> Iterable[tuple]:
    for i, text, settings in zip(batch["id"], batch["content"], batch["settings"]):
        if found := find(text, settings, path):
            yield i, masked(text, found), len(found)


def _rows(chunks: DataFrame) -> DataFrame:
    where = F.col("content").isNotNull() & F.col("id").isNotNull()
    return chunks.where(where).select("id", "content", F.coalesce(F.col("file_path").rlike(SETTING_FILE), F.lit(False)).alias("settings"))


def credentials(chunks: DataFrame, dictionary_path: str = tokens.DEFAULT) -> DataFrame:
    """(id, line) of each credential, once."""
    return rows_out(_rows(chunks), lambda b: _found(b, dictionary_path), "id string, line bigint", scan=True).distinct()


def redacted(chunks: DataFrame, dictionary_path: str = tokens.DEFAULT) -> DataFrame:
    """Contents that hold credentials, masked: id, content, found. Other contents are as they were."""
    return rows_out(_rows(chunks), lambda b: _redacted(b, dictionary_path), "id string, content string, found int", scan=True).dropDuplicates(["id"])
