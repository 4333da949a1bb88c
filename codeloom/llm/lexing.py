"""Lexers that can start in any state, and summaries of pieces of a file that are put together associatively.

A lexer turns text into one class letter a token. Brackets keep their own characters, ``#`` is a character or word that
no program of the language has, ``N`` is a line end where the language minds them. ``i`` identifier, ``n`` number,
``s`` string, other letters are keywords or operators (see the tables). In Python a line end is the letter ``LINE`` plus
the column the next line of code starts in. A state is ``''`` (code) or the opener of what is still open: ``/*``,
``=begin``, a backtick, a triple quote, ``%(`` and its like in Ruby, or the opener of a raw string.

The map of a piece holds, for each state it may be entered in, the state behind it and its letters. Letters are put
together, and what is balanced in them reduced, by ``grammars``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)"
C_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
DQ, SQ = r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'"
NUM = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]+)?(?:\.(?![\w.]))?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)%s(?![\w$])"
LINE, MAX_COLUMN = 0x100, 0xD000  # letters above the tables of the lexers and below the surrogates
TABS, MAX_TABS = 0xE000, 0x18FF  # letters above these


def words(**classes: str) -> dict[str, str]:
    """Keyword -> class letter, from class letter=words."""
    return {w: c for c, ws in classes.items() for w in ws.split()}


COMMENTS = ("/*", "=begin")


@dataclass
class Lexer:
    """``code``: pattern of tokens with the groups of ``kinds``; ``opens``: pattern of an opener without its end; ``ends``: opener -> pattern of its end."""

    ident: str
    code: list[tuple[str, str]]
    kw: dict[str, str]
    ops: dict[str, str]
    opens: str = r"(?!)"
    ends: dict[str, str] = field(default_factory=dict)
    templates: bool = False

    def __post_init__(self) -> None:
        ops = "|".join(re.escape(o) for o in sorted(self.ops, key=len, reverse=True))
        quick = rf"{self.ident}(?![\w\"'#])"  # most tokens; what may be the prefix of a literal comes later
        line = [x for x in self.code if x[0].startswith(r"\n")]
        alts = [(quick, "i"), (r"[()\[\]{},]", "#"), *line, (CONFLICT, "#"), *[x for x in self.code if x not in line], (self.opens, "~"), (self.ident, "i"), (ops, "#"), (r"[^\s]", "#")]
        self.kinds: dict[int, str] = {}
        self.line_at = None
        at = 1
        for p, k in alts:
            self.kinds[at] = "" if k == "~" else k
            if p is self.opens:
                self.open_at = at
            if k == "column":
                self.line_at = at
            at += 1 + re.compile(p, re.M).groups
        self.rx = re.compile(rf"(?:[ \t\r]++(?![/#]))?(?:{'|'.join(f'({p})' for p, _ in alts)})", re.M)  # no blanks before what looks back or starts a line
        self.table = self.ops | self.kw | {b: b for b in "()[]{}"}
        self.end_rx = {o: re.compile(p, re.S) for o, p in self.ends.items()}

    def lex(self, text: str, state: str = "") -> tuple[str, str]:
        """Class letters of ``text`` entered in ``state``, and the state after it."""
        pos, head = 0, ""
        if self.templates and (state[:1] == "`" or "${" in text):
            return self._templates(text, state)
        if state:
            end = self._close(text, state)
            if end is None:
                return "", state
            pos, head = end, "" if state in COMMENTS else "s"
        ms = list(self.rx.finditer(text, pos))
        out = self.letters(ms)
        if ms and ms[-1].lastindex == self.open_at:
            return head + "".join(out), self.opener(ms[-1][self.open_at])
        return head + "".join(out), ""

    def letters(self, tokens: list[re.Match]) -> list[str]:
        get, kinds = self.table.get, self.kinds
        if self.line_at is None:
            return [get(m[k := m.lastindex]) or kinds[k] for m in tokens]
        at = self.line_at
        return [column(m[at]) if (k := m.lastindex) == at else get(m[k]) or kinds[k] for m in tokens]

    def map(self, text: str, states: tuple[str, ...]) -> dict[str, tuple[str, str]]:
        """State before ``text`` -> its letters, the state after it.

        Entered in another state than code, tokens are read one by one only up to the first that also starts a token of
        the text entered in code; from there on both are the same.
        """
        if self.templates and ("`" in text or "${" in text):
            return {s: self.lex(text, s) for s in states}
        ms = list(self.rx.finditer(text))
        out = self.letters(ms)
        state = self.opener(ms[-1][self.open_at]) if ms and ms[-1].lastindex == self.open_at else ""
        starts = [m.start(m.lastindex) for m in ms] if len(states) > 1 else []
        known = set(starts)
        maps = {}
        for s in states:
            if not s:
                maps[s] = ("".join(out), state)
                continue
            pos = self._close(text, s)
            if pos is None:
                maps[s] = ("", s)
                continue
            own, end = [], None
            for m in self.rx.finditer(text, pos):
                if (at := m.start(m.lastindex)) in known:
                    end = state
                    own += out[bisect_left(starts, at) :]
                    break
                own += self.letters([m])
                if m.lastindex == self.open_at:
                    end = self.opener(m[self.open_at])
            maps[s] = (("" if s in COMMENTS else "s") + "".join(own), end or "")
        return maps

    def _templates(self, text: str, state: str) -> tuple[str, str]:
        """As ``lex``, for texts whose templates hold expressions; a state lists the braces open in each, as ``{2``, after its backtick."""
        stack = [int(x) for x in re.findall(r"\{(\d+)", state)]
        inside, pos, out = state.endswith("`"), 0, []
        if state.endswith("/*"):
            end = self._close(text, "/*")
            if end is None:
                return "", state
            pos = end
        while pos < len(text):
            if inside:
                m = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)").match(text, pos)
                if m is None:
                    break
                pos, inside = m.end(), False
                out.append("s" if m[1] == "`" else "s+(")
                if m[1] != "`":
                    stack.append(0)
            for m in self.rx.finditer(text, pos):
                t, pos = m[m.lastindex], m.end()
                if m.lastindex == self.open_at:
                    if t[0] != "`":
                        return "".join(out), self._state(stack, False) + "/*"
                    pos, inside = m.start(m.lastindex) + 1, True
                    break
                if stack and t in "{}":
                    if t == "}" and not stack[-1]:
                        stack.pop()
                        out.append(")+")
                        inside = True
                        break
                    stack[-1] += 1 if t == "{" else -1
                out.append(self.table.get(t) or self.kinds[m.lastindex])
            else:
                pos = len(text)
        return "".join(out), self._state(stack, inside)

    @staticmethod
    def _state(stack: list[int], inside: bool) -> str:
        return "".join("`{%d" % n for n in stack) + ("`" if inside else "")

    def opener(self, token: str) -> str:
        if m := re.match(r"[a-zA-Z]{0,2}('''|\"\"\")", token):  # Python and Java
            return m[1]
        if m := re.match(r"=begin|%[wWiIqQ]?([\[({])", token):  # Ruby
            return "%" + m[1] if m[1] else m[0]
        m = re.match(r"/\*|`|'''|\"\"\"|b?(r#*)\"", token)
        return (m[1] or m[0].lstrip("b")) if m else token.lstrip("b")[:1]

    def _close(self, text: str, state: str) -> int | None:
        """Where the construct of ``state`` ends in ``text``."""
        if state[0] == "r":
            i = text.find('"' + "#" * state.count("#"))
            return None if i < 0 else i + state.count("#") + 1
        m = self.end_rx[state].match(text)
        return m.end() if m else None


_BIN = "&& || ?? == != === !== <= >= << >> >>> ** / % ^".split()
_ASSIGN = "= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split()
_BASE = {**dict.fromkeys(_BIN, "o"), **dict.fromkeys(_ASSIGN, "="), "+": "+", "-": "+", "!": "!", "~": "!", "++": "U", "--": "U", "*": "*", ".": ".", ",": ",", ";": ";", ":": ":", "?": "?", "<": "<", ">": "G", "&": "|", "|": "|"}

_JS_REGEX = r"(?:(?<=[=(,:;!&|?{}\[+\-*%~^<>\n])|(?<=return)|(?<=typeof)|(?<=case)|\A)[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?![\w$])"
_TEMPLATE = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{))*`"
_JS_KW = words(f="function", c="class", v="const let var", I="if while with switch", F="for", d="do", T="try", K="catch", Y="finally", r="return", h="throw", w="new", x="extends", e="else", k="case", D="default", b="break continue debugger", m="import", p="export", y="typeof void delete await yield", j="in instanceof", q="this null true false super", a="async", g="get set static accessor", t="from as of", )
_TS_KW = _JS_KW | words(u="interface type enum namespace module declare abstract public private protected readonly override implements", t="from as of is satisfies keyof infer asserts unique")


def _js(kw: dict[str, str]) -> Lexer:
    return Lexer(
        ident=r"#?(?!\d)[\w$]++",
        code=[(r"\A#![^\n]*", ""), (C_COMMENT, ""), (_JS_REGEX, "n"), (DQ + "|" + SQ + "|" + _TEMPLATE, "s"), (NUM % "n?", "n"), (r"\n\s*", "N")],
        kw=kw,
        ops={**_BASE, "=>": ">", "...": "E", "?.": ".", "@": "@"},
        opens=r"/\*(?s:.*)|`(?s:.*)",
        ends={"/*": r".*?\*/", "`": r"(?:[^`\\]|\\.)*?`"},
        templates=True,
    )


LEXERS: dict[str, Lexer] = {
    "javascript": _js(_JS_KW),
    "typescript": _js(_TS_KW),
    "tsx": _js(_TS_KW),
    "go": Lexer(
        ident=r"(?!\d)\w++",
        code=[(C_COMMENT, ""), (r"`[^`]*`|" + DQ + r"|'(?:[^'\\\n]|\\[^\n])+'", "s"), (NUM % "i?", "n"), (r"\n\s*", "N")],
        kw=words(K="package", M="import", f="func", v="var const", t="type", r="return", I="if switch select", F="for", R="range", k="case", D="default", g="go defer goto", T="struct interface", m="map", C="chan", e="else", b="break continue fallthrough"),
        ops={**_BASE, ":=": "=", "<-": "!", "...": "E", "&^": "o", "&^=": "=", "~": "!"} | {"?": "#", "!==": "#", "===": "#"},
        opens=r"/\*(?s:.*)|`(?s:.*)",
        ends={"/*": r".*?\*/", "`": r"[^`]*`"},
    ),
    "java": Lexer(
        ident=r"(?!\d)[\w$]++",
        code=[(C_COMMENT, ""), (r'"""(?s:(?:[^"\\]|\\.|"(?!""))*)"""|(?!""")' + DQ + r"|'(?:[^'\\\n]|\\[^\n])+'", "s"), (NUM % "[lLfFdD]?", "n")],
        kw=words(u="public private protected static final abstract synchronized native transient volatile strictfp sealed", c="class interface enum", K="package", m="import", I="if while switch", F="for", d="do", T="try", Y="finally", Z="catch", r="return", h="throw assert", w="new", x="extends implements throws permits", e="else", k="case", D="default", b="break continue", q="this super null true false", j="instanceof", z="int long short byte char boolean float double void"),
        ops={**_BASE, "->": ">", "::": ".", "@": "@", "...": "E"} | {"===": "#", "!==": "#"},
        opens=r'/\*(?s:.*)|"""(?s:.*)',
        ends={"/*": r".*?\*/", '"""': r'(?:[^"\\]|\\.|"(?!""))*"""'},
    ),
    "c": Lexer(
        ident=r"(?!\d)\w++",
        code=[(C_COMMENT, ""), (r"^[ \t]*#(?:[^\n\\/]|\\\r?(?s:.)|/(?!\*)|/\*(?s:.*?)\*/)*", ""), (r'(?:u8|[uUL])?' + DQ + r"|[uUL]?'(?:[^'\\\n]|\\[^\n])+'", "s"), (NUM % "(?:[uUlLfF]*)", "n")],
        kw=words(u="static const extern register inline volatile restrict auto typedef unsigned signed _Thread_local", c="struct union enum", I="if while switch", F="for", d="do", r="return", e="else", k="case", D="default", b="break continue", g="goto", y="sizeof", z="int long short char float double void bool _Bool"),
        ops={**_BASE, "->": ".", "...": "E"} | {"===": "#", "!==": "#", "**": "*", ">>>": "#"},
        opens=r"/\*(?s:.*)",
        ends={"/*": r".*?\*/"},
    ),
    "rust": Lexer(
        ident=r"(?:r#)?(?!\d)\w++",
        code=[(C_COMMENT, ""), (r'b?r"[^"]*"|b?r#"(?s:.*?)"#|b?r##"(?s:.*?)"##|b?"(?s:(?:[^"\\]|\\.)*)"|b?\'(?:[^\'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|[^\n]))\'', "s"), (r"'[^\W\d]\w*(?!')", "L"), (r"\d[\d_]*(?=\.\.)|" + NUM % "(?:[iuf](?:8|16|32|64|128|size))?", "n")],
        kw=words(f="fn", p="pub", U="use", l="let", M="mod", S="struct union enum", T="trait impl", C="const static", t="type", X="extern", m="match", I="if while", F="for", d="loop unsafe async move", e="else", r="return break continue", u="mut ref dyn", w="where", j="in as", q="self super crate Self true false", y="await"),
        ops={**_BASE, "->": ">", "=>": "a", "::": ".", "..": "o", "..=": "o", "...": "o", "@": "o", "#": "@", "$": "!"} | {"===": "#", "!==": "#", "++": "+", "--": "+", "**": "*", ">>>": "#"},
        opens=r'/\*(?s:.*)|b?r#*"(?s:.*)|b?"(?s:.*)',
        ends={"/*": r".*?\*/", '"': r'(?:[^"\\]|\\.)*"'},
    ),
    "ruby": Lexer(
        ident=r"[@$]{0,2}(?!\d)\w++[?!]?(?!\w)",
        code=[(r"^=begin\b(?s:.*?)^=end[^\n]*", ""), (r"#[^\n]*", ""), (r"<<[~-]?['\"]?(?P<tag>[A-Z_]\w*)['\"]?(?s:[^\n]*\n.*?)^[ \t]*(?P=tag)\b", "s"), (r'"(?s:(?:[^"\\]|\\.)*)"|\'(?s:(?:[^\'\\]|\\.)*)\'|`(?:[^`\\\n]|\\.)*`|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})|:"[^"\n]*"', "s"), (r":[^\W\d]\w*[?!=]?", "n"), (r"(?:(?<=[=(,|&!\[{~\n])|(?<=if)|(?<=when))[ \t]*/(?![ =])(?:[^/\\\n]|\\.)+/[imxo]*", "n"), (NUM % "[ri]?", "n"), (r"\n\s*|;", "N")],
        kw=words(f="def", c="class module", I="if unless while until", C="case", k="when in", d="do", T="begin", V="rescue ensure else elsif then", E="end", F="for", r="return break next redo retry yield", q="self nil true false super", j="and or", Y="not"),
        opens=r"(?:[\"']|^=begin\b|%[wWiIqQ]?[\[({])(?s:.*)",
        ends={'"': r'(?:[^"\\]|\\.)*"', "'": r"(?:[^'\\]|\\.)*'", "=begin": r".*?(?m:^)=end[^\n]*", "%[": r"[^\]]*\]", "%(": r"[^)]*\)", "%{": r"[^}]*\}"},
        ops={**_BASE, "=>": "o", "=~": "o", "!~": "o", "<=>": "o", "..": "o", "...": "o", "::": ".", "&.": ".", "->": "!", "?": "?", "||=": "=", "&&=": "="},
    ),
}


_DIGITS = r"\d(?:_?\d)*"
_EXPONENT = rf"[eE][+-]?{_DIGITS}"
_FIELD = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\}"  # of a formatted literal, which may hold the quote around it
LEXERS["python"] = Lexer(
    ident=r"(?!\d)\w++",
    code=[
        (r"\n(?:[ \t\f\r]*(?:#[^\n]*)?\n)*[ \t\f]*(?:#[^\n]*)?", "column"),
        (r"#[^\n]*|\\\r?\n", ""),
        (
            r"(?:[rR][bBfFtT]?|[bBfFuUtT][rR]?)?(?:'{3}(?:[^'\\]|\\(?s:.)|'{1,2}(?!'))*'{3}|\"{3}(?:[^\"\\]|\\(?s:.)|\"{1,2}(?!\"))*\"{3})"
            rf"|(?:[fF][rR]?|[rR][fF])(?:\"(?!\"\")(?:[^\"\\\n{{}}]|\\(?s:.)|\{{\{{|\}}\}}|{_FIELD})*\"|'(?!'')(?:[^'\\\n{{}}]|\\(?s:.)|\{{\{{|\}}\}}|{_FIELD})*')"
            r"|(?:[rR][bBfFtT]?|[bBfFuUtT][rR]?)?(?:'(?!'')(?:[^'\\\n]|\\(?s:.))*'|\"(?!\"\")(?:[^\"\\\n]|\\(?s:.))*\")",
            "s",
        ),
        (rf"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{_DIGITS})?\.{_DIGITS}(?:{_EXPONENT})?[jJ]?|{_DIGITS}(?:\.(?:{_EXPONENT})?[jJ]?|{_EXPONENT}[jJ]?|[jJ])|(?:0(?:_?0)*|[1-9](?:_?\d)*)(?!\.\d))(?!\w)", "n"),
    ],
    kw=words(q="None True False", d="def", c="class", I="if", e="else", l="elif", F="for", W="while", T="try", X="except", Y="finally", w="with", r="return", R="raise", D="del", p="pass break continue", g="global nonlocal", t="assert", S="async", u="await", y="yield", L="lambda", m="import", M="from", a="as", o="and or", j="in", J="is", h="match", k="case", x="type") | {"not": "!"},
    ops={**dict.fromkeys("// % << >> & | ^ < > <= >= == !=".split(), "o"), **dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "G"), "+": "-", "-": "-", "~": "~", "*": "*", "**": "H", "/": "/", "@": "@", "=": "=", ":=": "V", "->": ">", ":": ":", ",": ",", ";": ";", ".": ".", "...": "q"},
    opens=r"(?:[rR][bBfFtT]?|[bBfFuUtT][rR]?)?(?:'{3}|\"{3})(?s:.*)",
    ends={"\'\'\'": r"(?:[^'\\]|\\.|'{1,2}(?!'))*'{3}", '"""': r"(?:[^\"\\]|\\.|\"{1,2}(?!\"))*\"{3}"},
)


@lru_cache(10_000)
def column(token: str) -> str:
    """The letter of a line end, by the column in which the code behind it starts, tabs reaching to the next multiple of eight; behind it, if there are tabs, one for the column if each were one wide."""
    tail = token[token.rfind("\n") + 1 :].partition("#")[0].replace("\f", "")
    n = len(tail)
    if "\t" not in tail:
        return chr(LINE + min(MAX_COLUMN, n))
    return chr(LINE + min(MAX_COLUMN, len(tail.expandtabs(8)))) + chr(TABS + min(MAX_TABS, n))


def pieces(text: str, size: int) -> list[str]:
    """``text`` cut before line ends, but not between a backslash and its line end, into pieces of ``size`` characters at most, or of one line."""
    out, pos, cut = [], 0, 0
    for m in re.finditer(r"(?<!\\)(?<!\\\r)\n", text) if len(text) > size else ():
        if m.start() - pos > size and cut > pos:
            out.append(text[pos:cut])
            pos = cut
        cut = m.start()
    if len(text) - pos > size and pos < cut < len(text):
        out.append(text[pos:cut])
        pos = cut
    return [*out, text[pos:]]


def starts(language: str) -> tuple[str, ...]:
    """States a piece can be entered in that every map holds; templates nest without end, so deeper states are lexed when they come up."""
    return ("", *LEXERS[language].ends)


def lex(language: str, text: str, state: str = "") -> tuple[str, str]:
    return LEXERS[language].lex(text, state)
