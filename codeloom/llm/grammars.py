"""Local grammars: what is balanced in a stretch of letters is judged and reduced, from the innermost pair of brackets out.

The letters of a lexer are reduced group by group: the content of a pair of brackets is judged by itself and replaced by
one letter, ``P`` ( ), ``A`` [ ] or ``B`` { } (Python has more). A content is judged by what may not stand side by side in
it (``bad``), in Python by what its items may be. Brackets without a partner in the stretch stay, with the letters
around them; so the reduction of two neighbours is that of their reductions put together, in any order (``joined``), and
``#`` stands for any stretch that can't be part of a valid file. What is left of a whole file is judged by statements.
Contents repeat a lot, so judgements are kept.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codeloom.llm.lexing import LINE, TABS

GROUP = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
BRACKETS = re.compile(r"[^()\[\]{}]+")
MISMATCH = re.compile(r"[(\[{][)\]}]")
OPENERS = {"(": ")", "[": "]", "{": "}"}
WRONG, KEPT = "#", 2000  # longer contents are not kept in memory
PASSES = 64  # over all letters, before brackets of greater depth are walked one by one


class Wrong(Exception):
    pass


class Grammar:
    """``bad``: patterns no content may hold, further ones by bracket; ``top``: what each statement of a file must match, split by ``split``."""

    def __init__(self, bad: list[str], paren: list[str] = (), brace: list[str] = (), file: list[str] = (), top: str | None = None, split: str = r"(?<=[;B])|N", doubled: str = "") -> None:
        twice = [rf"([{doubled}])\1"] if doubled else []
        self.bad = {b: re.compile("|".join(f"(?:{p})" for p in [*twice, *bad, *more])) for b, more in (("P", paren), ("A", paren), ("B", brace), ("file", [*brace, *file]))}
        self.top, self.split = top and re.compile(top), re.compile(split)
        self.judge = lru_cache(100_000)(self._judge)

    def _judge(self, kind: str, content: str) -> str:
        s = self.normal(content.strip("N") if kind != "file" else content, kind)
        if self.bad[kind].search(s):
            raise Wrong(s)
        self.further(kind, s)
        return kind

    def further(self, kind: str, content: str) -> None:
        pass

    def normal(self, letters: str, kind: str) -> str:
        """A content with what needs no judgement taken out."""
        return letters

    def _inner(self, m: re.Match) -> str:
        k = m.lastindex
        return (self.judge if len(m[k]) < KEPT else self._judge)("PAB"[k - 1], m[k])

    def reduced(self, letters: str) -> str:
        """Letters with all that is balanced in them judged and replaced; '#' if it is wrong."""
        if WRONG in letters:
            return WRONG
        try:
            s = letters
            for _ in range(PASSES):
                if (t := GROUP.sub(self._inner, s)) == s:
                    break
                s = t
            else:
                s = self._nested(s)
        except Wrong:
            return WRONG
        return WRONG if MISMATCH.search(BRACKETS.sub("", s)) else s

    def _nested(self, letters: str) -> str:
        """As ``reduced``, in one walk with a stack, for brackets of great depth."""
        open_: list[tuple[str, list[str]]] = []
        here: list[str] = []
        at = 0
        for m in re.finditer(r"[()\[\]{}]", letters):
            here.append(letters[at : m.start()])
            at, b = m.end(), m[0]
            if b in OPENERS:
                open_.append((b, here))
                here = []
            elif not open_:
                here.append(b)
            elif OPENERS[open_[-1][0]] != b:
                raise Wrong(b)
            else:
                content, (o, here) = "".join(here), open_.pop()
                here.append((self.judge if len(content) < KEPT else self._judge)("PAB"["([{".index(o)], content))
        return "".join([x for o, before in open_ for x in (*before, o)] + here) + letters[at:]

    def joined(self, a: str, b: str) -> str:
        """The reduction of two neighbours from theirs; associative, with '' as its neutral element."""
        return WRONG if WRONG in (a, b) else self.reduced(a + b)

    def file(self, reduction: str) -> bool:
        """Whether the reduction of a whole file reads as code."""
        if WRONG in reduction or BRACKETS.sub("", reduction):
            return False
        try:
            self._judge("file", reduction)
        except Wrong:
            return False
        if self.top is None:
            return True
        s = self.normal(reduction, "file")
        return all(self.top.fullmatch(x) for x in self.split.split(s) if x and x != "N")


_AFTER_DOT = re.compile(r"\.N*(?![PAB])[a-zA-Z]")


class Script(Grammar):
    """JavaScript and TypeScript."""

    def normal(self, s: str, kind: str) -> str:
        s = _AFTER_DOT.sub(".i", s)  # a keyword after a dot is a name
        s = (_KEY_B if kind == "B" else _KEY).sub(r"\1i", s)  # and before a colon
        s = _SCRIPT_LINES.sub("", s)
        return self.types(s)

    def types(self, s: str) -> str:
        return s


_KEY = re.compile(r"(,N*|(?<=N)(?![kD]))(?![PAB])[a-zA-Z](?=\??:)")
_KEY_B = re.compile(r"(,N*|(?:^|(?<=N))(?![kD]))(?![PAB])[a-zA-Z](?=\??:)")
_SCRIPT_LINES = re.compile(r"(?<=[=o+*?:.,;!>EjvfcwhymtG<|@])N+|N+(?=[=o*?:.,;>oj|eKY])")
_ARGUMENTS = re.compile(r"(?<=[iq])<[iqs.,|Axtny]*G")
_MORE_ARGUMENTS = re.compile(r"(?<=[iqP])<[iqs.,|:?=xt;nyPABN>]*?G(?=[=PAB.,;:|GN>i!+]|$)")


class Typed(Script):
    def types(self, s: str) -> str:
        while "<" in s:
            t = _MORE_ARGUMENTS.sub("", _ARGUMENTS.sub("", s))
            if t == s:
                break
            s = t
        return re.sub(r"\?(?=[:,]|$)", "", s)


_SCRIPT_BAD = [
    r"#",
    r"[insqA][insqvfcIFdTrhwekDbmpy]",
    r"(?<![IFyKfi])P[insqvfcFdTrhwkDbmpy]",
    r"f(?!\*?i?P|\*|$)|f\*?i?P(?![B:;N]|$)|f$",
    r"c(?![iBxgtauq=,:P)])",
    r"v(?![iABtgajuqlcs])",
    r"I(?!P)|F(?!P|yP)|T(?!B)|K(?![PB])|Y(?!B)|w(?![iPqcfAwgtauyB.])",
    r"h(?![insqPAfcwyB!+gtau])|k(?![insqPAfwyB!+gtau])",
    r"m(?![siB*P.tgaulf])|p(?![vfcDB*iaut@gIs=])|x(?![iPcfqBgtau])",
    r"[o=|+,.!][mvpIFThrekDbKY]|n:[rvmpFIThN]",
    r"[=o.!+>?E][=o;:]|[=o!>E]\?|[=o.!]$|[.=][,.]|^[=o:.]",
]
GRAMMARS: dict[str, Grammar] = {
    "javascript": Script(
        [*_SCRIPT_BAD, r"P:i[B;N=]|v[iAB]:"],
        doubled="fcrmpTKYFISwkDxhe",
        paren=[r"^[^?:]*:"],
        file=[r"(?:^|[;NB])[insqPA]:(?![FIdB])"],
    ),
    "typescript": Typed(_SCRIPT_BAD, doubled="fcrmpTKYFISwkDxhev"),
}
GRAMMARS["tsx"] = GRAMMARS["typescript"]


class Go(Grammar):
    """Statements end at line ends; a file is a package clause and declarations."""

    def normal(self, s: str, kind: str) -> str:
        return _AFTER_DOT.sub(".i", re.sub(r"(?<=[=o+*:.,!|])N+|N+(?=\.)", "", s))

    def further(self, kind: str, content: str) -> None:
        if kind == "B":
            parts = [x for x in re.split(r"[N;]", content) if x]
            if not all(re.fullmatch(r"(?:i,)*i?[i*AmC.TBfP!]*s?", x) for x in parts):
                for x in parts:
                    if re.match(r"[^vt].*", x) and re.search(r"^[ins][ins]|[ns][ins]|[^AC*!.m]ii", x):
                        raise Wrong(x)


_GO_TYPE = r"[i*.AmCT!BPfE]"
GRAMMARS["go"] = Go(
    [
        r"#", r"[ns][insvfKMrIFg]", r"i[rIFgKMe]", r"iii", r"P[nsrIFgKMe]", r"[insPA]\?",
        r"f(?![iPB])", r"I(?:$|N)", r"K(?!i)", r"M(?![sPi.])", r"e(?![BI])", r"v(?![iP])",
        r"[=o!][=o;]|[=o.!+]$|^[=o]",
    ],
    doubled="KMfrIFvTmCekDg",
    paren=[r":$"],
    file=[r"^(?!N*Ki[N;])"],
    top=rf"Ki|M(?:[i.]?s|P)|f(?:P)?i(?:A)?P{_GO_TYPE}*|v(?:P|i(?:,i)*{_GO_TYPE}*(?:=.*)?)|t(?:P|i.+)",
    split=r"[N;]",
)


class Java(Grammar):
    def normal(self, s: str, kind: str) -> str:
        s = _AFTER_DOT.sub(".i", re.sub(r"@[iqzcu](?:\.[iqz])*", "@", s)).replace("z", "i")
        while "<" in s:
            t = re.sub(r"(?<=[iuG.])<(?:[i.,|?xAP]|@)*G", "", s)
            if t == s:
                break
            s = t
        if "@" in s:
            s = re.sub(r"@P?(?=,|$)", "i", s) if kind != "file" else s
            s = re.sub(r"@P?", "", s)
        return s


GRAMMARS["java"] = Java(
    [
        r"#", r"[nsq][insqcIFdTrhwebmKu]", r"i[nscIFdTrhwebmKuq]", r"iii(?!x)", r"A[ns]", r"c(?![iB.])",
        r"I(?!P)|F(?!P)|T(?![BP])|Z(?!P)|Y(?!B)|w(?![iPqA.])|h(?![insqPw!+])|x(?!i)",
        r"[=o.!+?][=o;]|[=o.!+]$|^[=o.]", r"[ins]P[ns]", r"P:",
    ],
    doubled="cKmIFTZYrhwxekD",
    top=r"Ki(?:\.i)*;|mu?i(?:\.[i*])*;|;|u*c[^;]*B|u*i?.?c.*B|u*[iA]*iP[^;]*[;B]|u*i[iA]*i(?:=.*)?;",
    split=r"(?<=[;B])",
)


class C(Grammar):
    def normal(self, s: str, kind: str) -> str:
        return _AFTER_DOT.sub(".i", s).replace("z", "i")


GRAMMARS["c"] = C(
    [
        r"#", r"@", r"n[insIFdrekDbcu]", r"s[nIFdrekDbcu]", r"i[nIFdrkDb]", r"iiiiii",
        r"(?<![cu])(?<!ci)(?<!cu)(?<=[^ciuPB=,(])iB|^iB", r"I(?!P)|F(?!P)|c(?![iB])|r(?![insPA;!+*|yU~<B])",
        r"[=o.!+][=o;:]|[=o.!+]$|^[=o.:]", r"P:|s:|[AB]:", r"b(?!;)|g(?!i;)", r"Bi?s;", r"[=o]>",
    ],
    doubled="IFdrekDbcgy",
    top=r";|(?:u|c|i|\*|s|P|A|B)*?iP(?:i?P?)*[B;]|[uci*]+(?:i|P)?[A,i*=|n+o.sBPc!:y\-?]*;|[uc]*[iu]*i?B(?:[i*A,])*;?|uis?B|[ui*c]*i?[*iA]+=.*;",
    split=r"(?<=;)|(?<=PB)(?!;)|(?<=^B)",
)


class Rust(Grammar):
    def normal(self, s: str, kind: str) -> str:
        s = re.sub(r"@!?A", "", _AFTER_DOT.sub(".i", s))
        while "<" in s:
            t = re.sub(r"(?<=[iPT.fqA])<[iLq.,|:+=u&nAPT;?j*]*G", "", s)
            if t == s:
                break
            s = t
        return s


GRAMMARS["rust"] = Rust(
    [
        r"#", r"[ns][insqfplUMSTCmFdrekL]", r"i[nsqfplUMSTCmFdreL]", r"ii", r"q[insqf]", r"f(?![iP])", r"fi(?!P|<)",
        r"U(?![iq.B*])", r"l(?![uiqPABn|s*])", r"[=o.!a][=o](?<!o;)|[=.!+]$", r"m(?![insqPAB*|+!UyL])",
        r"M(?!i)|S(?!i)|j(?![insqPA*|+!<u.B])",
    ],
    doubled="fUlMSTIFmrewja",
    top=r"(?:pP?)?(?:[dCX]s?)*fiP(?:>.+?)?(?:w.*)?[B;]|(?:pP?)?U[iq.B*j]+;|(?:pP?)?Mi[;B]|(?:pP?)?Si.*[;B]|d?(?:pP?)?T.*B|(?:pP?)?C.*;|(?:pP?)?ti.*;|X.*[;B]|i(?:\.i)*!i?[PAB];?|;",
    split=r"(?<=;)|(?<=[^=.,]B)(?!;|[=.,])",
)


class Ruby(Grammar):
    """Besides brackets, ``end`` closes what def, class, if and the like open; if, unless, while and until open only where a value or statement starts."""

    def normal(self, s: str, kind: str) -> str:
        return _AFTER_DOT.sub(".i", re.sub(r"(?<=[=o+*:.,!|])N+|N+(?=\.)", "", s))

    def further(self, kind: str, content: str) -> None:
        depth = 0
        for x in content.split("N"):
            x = x.lstrip("V")
            endless = re.match(r"fi(?:\.i)?P?=", x) is not None
            depth += len(re.findall(r"[fcTCF]", x)) - endless + len(re.findall(r"(?:^|[=o,!>V+])I", x)) - x.count("E")
            if not re.match(r"[IF]", x):
                depth += x.count("d")
            if depth < 0:
                raise Wrong(x)
        if depth:
            raise Wrong(content)


GRAMMARS["ruby"] = Ruby(
    [r"#", r"f(?![iqPo+*!A<a-zA-Z=])", r"c(?![i<q.o])", r"n[insP]", r"s[in]", r"P[ins]|Bi", r"[=+o.,]$", r"(?:^|N)[=.,?<G]", r"[=o.!+][=.](?!\.)"],
    doubled="fcTFIdVrY",
)


_LINES = re.compile("[\u0100-\ud7ff\ue000-\uf8ff]+")
# Parts of Python's expressions, over letters. Q: brackets that are one expression or list of them, K: arguments with keywords, D: parameters, O: imported names or items of with; A, U, Z: lists, comprehensions and slices in [ ]; B: { }.
_PRIMARY = r"u?(?:[inqQAUB]|s++)(?:\.i|[QKAZ])*+"
_TERM = rf"(?:[-~!]|L[^L:]*+:)*+{_PRIMARY}"
_SIMPLE = rf"{_TERM}(?:(?:[o/@H*-]|!?j|J!?){_TERM})*+"
_EXPR = rf"{_SIMPLE}(?:I{_SIMPLE}e{_SIMPLE})*"
_NAMED = rf"(?:iV)?{_EXPR}"
_STARRED = rf"(?:\*|iV)?{_EXPR}"
_LIST = rf"{_STARRED}(?:,{_STARRED})*,?"
_TARGET = rf"\*?(?:u?(?:[inqQAUB]|s+)(?:\.i|[QKAZ])*(?:\.i|[AZ])|[iQAU])"
_TARGETS = rf"{_TARGET}(?:,{_TARGET})*,?"
_FORS = rf"(?:S?F{_TARGETS}j{_SIMPLE}(?:I(?:iV)?{_SIMPLE})*)+"
_YIELD = rf"y(?:M{_EXPR}|{_LIST})?"
_ARGUMENT = rf"(?:i=|\*|H|iV)?{_EXPR}"
_PARAMETER = rf"(?:\*?i(?::\*?{_EXPR})?(?:={_EXPR})?|Hi(?::{_EXPR})?|\*|/)"
_SLICE = rf"(?:{_STARRED}|H?i={_EXPR}|(?:{_EXPR})?:(?:{_EXPR})?(?::(?:{_EXPR})?)?|\*?i|Hi)"
_ITEM = rf"(?:{_EXPR}:{_EXPR}|H{_EXPR})"
_AS = rf"{_EXPR}(?:a{_TARGET})?"
_DOTTED = r"i(?:\.i)*"
_VALUE = rf"(?:{_YIELD}|{_LIST})"
_PATTERN = r"[inqsQKABUO.,*\-oaH]+"
_CONTENT = {
    "P": [("Q", rf"|{_LIST}|{_NAMED}{_FORS}|{_YIELD}"), ("K", rf"{_ARGUMENT}(?:,{_ARGUMENT})*,?"), ("D", rf"{_PARAMETER}(?:,{_PARAMETER})*,?"), ("O", rf"{_AS}(?:,{_AS})*,?|{_PATTERN}(?:,i={_PATTERN})*,?|(?:i={_PATTERN})+")],
    "A": [("U", rf"|{_NAMED}{_FORS}"), ("A", _LIST), ("Z", rf"{_SLICE}(?:,{_SLICE})*,?"), ("O", _PATTERN)],
    "B": [("B", rf"|{_ITEM}(?:,{_ITEM})*,?|{_LIST}|(?:{_ITEM}|{_NAMED}){_FORS}|{_EXPR}:{_PATTERN}(?:,{_EXPR}:{_PATTERN})*(?:,Hi)?,?")],
}
_SMALL = rf"(?:{_LIST}|{_TARGETS}(?:={_TARGETS})*={_VALUE}|{_TARGET}G{_VALUE}|{_TARGET}:{_EXPR}(?:={_VALUE})?|{_YIELD}|r(?:{_LIST})?|R(?:{_EXPR}(?:M{_EXPR})?)?|D{_TARGETS}|p|gi(?:,i)*|t{_EXPR}(?:,{_EXPR})?|m{_DOTTED}(?:ai)?(?:,{_DOTTED}(?:ai)?)*|M(?:[.q]+(?:{_DOTTED})?|{_DOTTED})m(?:\*|i(?:ai)?(?:,i(?:ai)?)*|[QO]))"
_HEADER = rf"(?:[IlW]{_NAMED}|[eTY]|X(?:\*?{_EXPR}(?:ai)?)?|S?F{_TARGETS}j{_LIST}|S?w(?:{_AS}(?:,{_AS})*|O)|S?di[AZ]?[QKD](?:>{_EXPR})?|ci[AZ]?[QK]?)"


class Python(Grammar):
    """Items of brackets and statements by what each may be; blocks by the columns of their lines."""

    def __init__(self) -> None:
        self.judge = lru_cache(100_000)(self._judge)
        self.contents = {k: [(letter, re.compile(p)) for letter, p in v] for k, v in _CONTENT.items()}
        self.small, self.header = re.compile(_SMALL), re.compile(rf"({_HEADER}):(.*)", re.S)
        self.match, self.case = re.compile(rf"h{_LIST}:"), re.compile(rf"k{_PATTERN}(?:I{_NAMED})?:(.*)", re.S)
        self.statement = lru_cache(100_000)(self._statement)

    def _judge(self, kind: str, content: str) -> str:
        s = _LINES.sub("", content).translate(_NAMES)
        for letter, p in self.contents[kind]:
            if p.fullmatch(s):
                return letter
        raise Wrong(s)

    def _statement(self, line: str) -> tuple[str, bool]:
        """(what starts the statement, whether a block follows) of a line; further small ones may follow behind ';'."""
        if line[0] == "@":
            if self.small.fullmatch(line[1:].translate(_NAMES)):
                return "@", False
            raise Wrong(line)
        if line[0] == "h" and self.match.fullmatch(line[0] + line[1:].translate(_NAMES)):
            return "h", True
        if line[0] == "k" and (m := self.case.fullmatch(line[0] + line[1:].translate(_NAMES))):
            kind, rest = "k", m[1]
        elif line[0] == "x" and re.fullmatch(rf"xi[AZ]?={_EXPR}", line[0] + line[1:].translate(_NAMES)):
            return "", False
        elif m := self.header.fullmatch(line.translate(_NAMES)):
            kind, rest = m[1].lstrip("S")[0], m[2]
        else:
            kind, rest = "", line
        parts = rest.translate(_NAMES).split(";")
        if parts and not parts[-1]:
            parts.pop()
        if not all(self.small.fullmatch(x) for x in parts) or not parts and (rest or not kind):
            raise Wrong(line)
        return kind, bool(kind) and not parts

    def file(self, reduction: str) -> bool:
        if WRONG in reduction or BRACKETS.sub("", reduction):
            return False
        levels, narrow, before = [0], [0], [""]  # columns of the blocks open here, those with narrow tabs, and what stood last in each
        inside, opened = [""], ""
        try:
            for m in _LINE_OF.finditer(reduction):
                column, line = ord(m[1]) - LINE, m[3]
                other = ord(m[2]) - TABS if m[2] else column
                kind, opens = (self.statement if len(line) < KEPT else self._statement)(line)
                if opened:
                    if column <= levels[-1] or other <= narrow[-1]:
                        return False
                    levels.append(column)
                    narrow.append(other)
                    before.append("")
                    inside.append(opened)
                else:
                    while column < levels[-1]:
                        if before.pop() in _UNFINISHED:
                            return False
                        levels.pop()
                        narrow.pop()
                        inside.pop()
                    if column != levels[-1] or other != narrow[-1]:
                        return False
                last = before[-1]
                if last == "@" and kind not in ("@", "d", "c") or last == "T" and kind not in ("X", "Y") or kind in _AFTER and last not in _AFTER[kind] or (inside[-1] == "h") != (kind == "k"):
                    return False
                before[-1] = "E" if kind == "e" and last == "X" else "" if kind == "e" or kind == "Y" else kind
                opened = kind if opens else ""
        except Wrong:
            return False
        return not opened and not any(x in _UNFINISHED for x in before)


_NAMES = str.maketrans("hkx", "iii")  # match, case and type are names, but where a statement starts
_LINE_OF = re.compile("([\u0100-\ud7ff])([\ue000-\uf8ff])?([^\u0100-\ud7ff\ue000-\uf8ff]+)")
_UNFINISHED = ("@", "T")
_AFTER = {"l": ("I", "l"), "e": ("I", "l", "F", "W", "X"), "X": ("T", "X"), "Y": ("T", "X", "E")}
GRAMMARS["python"] = Python()
