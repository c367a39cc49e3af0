"""Secret scan by assignment-aware lexing.

Base spans come from three patterns. The method adds ``literal`` spans: source and configuration text is read as
assignments (``name = value``, ``name: value``, ``"name" => "value"``, attributes, elements, arguments of a call by the
function's name or after a quoted name, items of a list below a name and the like); each right side is lexed into string literals, bare values and names, over line ends inside brackets and strings, at continuations, beside joining
operators and where the value begins on the next line; constants are carried along, through names, concatenations and
``${name}`` inside strings, in the order of the text and within the function that sets them; and what reaches a name, each literal and all of them joined, is scored by how
sensitive that name's words are and how much it looks like key material. A joined value that passes gives all its literals.

Defined results: null and empty texts have no spans; a null doc_id is kept; repeated rows give repeated results; an
empty table gives no rows; texts are read whole. Offsets are code points, ends exclusive. A literal that a base span
covers isn't repeated.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import ChainMap, Counter
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "literal")


def either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


#: The base patterns; hex and access with their least lengths, which for these gives the same as dropping short matches.
ASSIGN = re.compile(f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LEAST = 12

NAME = re.compile(r"""(?:(?P<q>["'`])(?P<quoted>[A-Za-z_$][\w$. -]*)(?P=q)\]?|(?P<plain>[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*))[ \t]*\Z""")
OPERATOR = re.compile(r"(?::=|=>|<-|(?<![=!<>])=(?![=~])|:(?![:/=]))[ \t]*")
STRING = re.compile(r"""(?:[rbufRBUF]{1,2}(?=["']))?(?:\"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*)\"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*)'{3}|"((?:[^"\\]|\\[\s\S])*)"|'((?:[^'\\]|\\[\s\S])*)'|`((?:[^`\\]|\\[\s\S])*)`)""")
WORD = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*")
BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>#&]+")
SPACES = re.compile(r"\s*")
#: Operators that join; what joins without one; the same inside brackets, after a gap.
PLUS = re.compile(r"""[ \t]*(?:\\?\r?\n[ \t]+)?(?:\+(?![+=])|\|\||\.(?=\s*["']))""")
NEXT = re.compile(r"""[ \t]+(?=["'])|[ \t]*\\\r?\n[ \t]*(?=["'`])|\\\r?\n(?=\S)""")
PLUS_INSIDE = re.compile(r"""\+(?![+=])|\|\||\.(?=\s*["'])|\\\r?\n""")
#: The end of a line before its value, the head of a block value, and a name that has a value of its own.
LINE_END = re.compile(r"\r?\n[ \t]*(?=\S)")
BLOCK = re.compile(r"[|>][-+0-9]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
NESTED = re.compile(r"""(?:[A-Za-z_$][\w$. -]*?(?:=>|:=|<-|:(?=\s|\Z)|=(?!=*[ \t\r]*(?:\n|\Z)))|(["'`])[\w$. -]*\1[ \t]*(?:=>|:|=(?!=)))""")
ALONE = re.compile(r"[,;]?[ \t\r]*(?:\n|\Z)")
INDENT = re.compile(r"[ \t]*")
LINES = re.compile(r"[^\n]+")
INSIDE = re.compile(r"\$\{(\w+)\}|\{(\w+)\}|\$(\w+)")
#: Characters before an operator in which its name is looked for first; a name that may begin before them is looked for in twice as many.
NAME_REACH = 96
#: An element with text, the bracket of a call, a quoted name before a quoted value, and list items below a name.
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)(?=</\1\s*>)")
CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*)(?=\()")
KEYED = re.compile(r"""[(\[,{]\s*(["'`])([A-Za-z_$][\w$. -]*)\1\s*,\s*(?=["'`])""")
ITEMS = re.compile(r"(?:\r?\n[ \t]*- +[^\n]*)+")
ITEM = re.compile(r"""- +(?:(["'`])(.*?)\1|([^\s"'`#]+))[ \t\r]*(?:#[^\n]*)?$""", re.M)
#: A macro, an option of a command and a named attribute with its value beside it.
DEFINE = re.compile(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)[ \t]+(?=\S)", re.M)
OPTION = re.compile(r"(?<!\S)--([A-Za-z][\w-]*)[ \t]+(?=[^\s-])")
ATTRIBUTE = re.compile(r"""\b(?:key|name)[ \t]*=[ \t]*["']([^"'\n]*)["'][ \t]+value[ \t]*=[ \t]*(?=["'])""")
#: Values that their surroundings name: the password of a URL, the token of a header.
NAMED = re.compile(r"""(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s/:@'"]*:(?P<password>[^\s/@'"]+)@|(?<![A-Za-z])[Bb]earer[ \t]+(?P<bearer>[A-Za-z0-9._~+/=-]+)""")
#: A type between a name and its value, with the words that begin declarations of the form name, type.
TYPE = re.compile(r"[ \t]*[A-Za-z_*&\[][\w.$<>\[\], |?&*]*")
DECLARED = re.compile(r"(?:^|[^\w$])(?:const|var|let|val|static|final)[ \t]+\Z")
#: The head of a function, whose constants end with it.
FUNCTION = re.compile(r"^([ \t]*)(?:(?:export|default|async|public|private|protected|static|final|pub|local|override|suspend)[ \t]+)*(?:def|function|func|fn|fun|sub|void|proc)\b[^\n]*", re.M)

#: Words of sensitive names with their weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.7, "authorization": 0.8, "bearer": 0.9, "pass": 0.8, "signature": 0.6, "salt": 0.6,
    "dsn": 0.6, "pin": 0.5, "key": 0.5,
}
#: Words that make a following "key" sensitive.
KEY_BEFORE = {"api", "access", "private", "secret", "signing", "encryption", "master", "service", "account", "shared", "storage"}
#: What stands in for a secret.
PLACEHOLDERS = re.compile(r"(?i)change.?me|example|placeholder|your|dummy|sample|todo|xxx|\*\*\*")
#: Words that alone, or with digits behind them, stand in for a secret.
STANDS_ALONE = re.compile(r"(?i)none|null|true|false|undefined|password|secret|token|test")
CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def sensitivity(name: str) -> float:
    """Weight of a target name, from its words."""
    words = [w.lower() for w in CAMEL.findall(name)]
    best = 0.0
    for i, w in enumerate(words):
        weight = SENSITIVE.get(w, 0.0)
        if w == "key" and i:
            weight = 1.0 if words[i - 1] in KEY_BEFORE else 0.4
        best = max(best, weight)
    return best


Span = tuple[int, int, bool]
#: Characters kept of either end of a value: no placeholder and no head of one is longer.
EDGE = 16


class Looks:
    """What tells whether a value of any length looks like key material; of two values joined, it follows from theirs."""

    __slots__ = ("length", "counts", "bare", "odd", "head", "tail")

    def __init__(self, text: str, bare: bool):
        self.length, self.counts, self.bare = len(text), Counter(text), bare
        self.odd = bool(PLACEHOLDERS.search(text))
        self.head, self.tail = text[:EDGE], text[-EDGE:]

    def joined(self, other: Looks) -> Looks:
        both = Looks.__new__(Looks)
        both.bare, both.length = self.bare and other.bare, self.length + other.length
        # so long a value, from constants that double, keeps the frequencies that it has
        both.counts = self.counts + other.counts if both.length < 1 << 50 else self.counts
        both.odd = self.odd or other.odd or bool(PLACEHOLDERS.search(self.tail + other.head))
        both.head = self.head if self.length >= EDGE else (self.head + other.head)[:EDGE]
        both.tail = other.tail if other.length >= EDGE else (self.tail + other.tail)[-EDGE:]
        return both

    def stands_in(self) -> bool:
        """Whether the whole value is a placeholder: a known word with digits, <...>, $name, ${name}, {{...}} or %name%."""
        n, head, tail, counts = self.length, self.head, self.tail, self.counts
        of = lambda known: sum(k for c, k in counts.items() if known(c))
        name = lambda c: c.isalnum() or c == "_"
        if (m := STANDS_ALONE.match(head)) and of(str.isdecimal) == n - m.end():
            return True
        if head[:1] == "<" and tail[-1:] == ">" or (n >= 4 and head[:2] == "{{" and tail[-2:] == "}}"):
            return True
        if head[:1] == "%" == tail[-1:] and n > 2 and of(name) == n - 2:
            return True
        if head[:1] == "$":
            around = 1 + (head[1:2] == "{") + (tail[-1:] == "}")
            return n > around and of(lambda c: name(c) or c in ".:-") == n - around
        return False

    def strength(self) -> float:
        """Length, kinds of characters and entropy; 0 for placeholders and prose."""
        n = self.length
        if n < 8 or any(c.isspace() for c in self.counts):
            return 0.0
        if self.odd or self.stands_in():
            return 0.0
        kinds = {0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in self.counts}
        if len(kinds) < 2 and (self.bare or n < 16):
            return 0.0
        if self.bare and 2 not in kinds:
            return 0.0
        total = sum(self.counts.values())
        entropy = -sum(c / total * math.log2(c / total) for c in self.counts.values())
        return min(1.0, n / 12) * min(1.0, entropy / 3.0)


class Value:
    """What an expression may give: its literals, the constants in it, and what each value that it joins consists of.

    Constants are kept as such, not copied, so that a chain of assignments takes no more room than its text.
    """

    __slots__ = ("spans", "constants", "joined", "looks", "scored", "marked")

    def __init__(self):
        self.spans: list[Span] = []
        self.constants: list[Value] = []
        self.joined: list[list[Span | Value]] = [[]]
        self.looks: list[Looks | None] = []
        self.scored = self.marked = 0.0

    def add(self, spans: list[Span], parts: list[Span] | None = None) -> None:
        self.spans += spans
        self.joined[-1] += spans if parts is None else parts

    def add_constant(self, other: Value | None) -> None:
        if other:
            self.constants.append(other)
            if len(other.joined) == 1:
                self.joined[-1].append(other)

    def some(self) -> bool:
        return bool(self.spans or self.constants)

    def done(self, text: str) -> Value:
        self.joined = [x for x in self.joined if x]
        for parts in self.joined:
            looks = None
            for p in parts:
                one = p.looks[0] if isinstance(p, Value) else Looks(text[p[0] : p[1]], p[2])
                looks = looks.joined(one) if looks else one
            self.looks.append(looks)
        return self


class Scores:
    """The best score of each literal. A value is gone through again only for a higher weight or score."""

    def __init__(self, text: str, least: float):
        self.text, self.least, self.best = text, least, {}

    def literal(self, span: Span, score: float, name: str) -> None:
        if score >= self.least and score > self.best.get(span[:2], (0.0, ""))[0]:
            self.best[span[:2]] = score, name

    def mark(self, parts: list, score: float, name: str) -> None:
        """All literals that a joined value consists of."""
        left = [parts]
        while left:
            for p in left.pop():
                if not isinstance(p, Value):
                    self.literal(p, score, name)
                elif p.marked < score:
                    p.marked = score
                    left.append(p.joined[0])

    def reached(self, value: Value, weight: float, name: str) -> None:
        """A name with this weight is given the value."""
        left = [value]
        while left:
            v = left.pop()
            if v.scored >= weight:
                continue
            v.scored = weight
            left += v.constants
            for span in v.spans:
                self.literal(span, weight * Looks(self.text[span[0] : span[1]], span[2]).strength(), name)
            for parts, looks in zip(v.joined, v.looks, strict=True):
                if len(parts) > 1 and (score := round(weight * looks.strength(), 2)) >= self.least:
                    self.mark(parts, score, name)


class Lexer:
    """Name-literal pairs of one text, with constants carried along."""

    def __init__(self, text: str):
        self.text, self.constants = text, {}
        self.marks: dict[str, tuple[int, int]] = {}

    def next_mark(self, mark: str, at: int) -> int:
        """Where ``mark`` comes next, -1 if not at all; a search that has been made isn't made again."""
        begin, found = self.marks.get(mark, (at + 1, 0))
        if not (begin <= at and (found < 0 or at <= found)):
            begin, found = at, self.text.find(mark, at)
            self.marks[mark] = begin, found
        return found

    def gap(self, at: int) -> int:
        """The end of white space, line ends and closed comments, where an expression goes on."""
        text = self.text
        while True:
            at = SPACES.match(text, at).end()
            if text.startswith(("#", "//"), at):
                end = self.next_mark("\n", at)
                at = len(text) if end < 0 else end
            elif text.startswith("/*", at) and (end := self.next_mark("*/", at + 2)) >= 0:
                at = end + 2
            else:
                return at

    def lines(self, start: int, end: int) -> list[Span]:
        """The lines of a literal without blanks and backslashes around them; several lines are no quoted values."""
        text, found = self.text, []
        if text.find("\n", start, end) < 0:
            return [(start, end, False)] if end > start else []
        for m in LINES.finditer(text, start, end):
            a, b = m.span()
            while a < b and text[a].isspace():
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] == "\\"):
                b -= 1
            if b > a:
                found.append((a, b, True))
        return [(a, b, False) for a, b, _ in found] if len(found) == 1 else found

    def block(self, at: int, name_at: int) -> list[Span]:
        """The lines of a block value, which are indented deeper than the line of its name."""
        text = self.text
        indent = lambda i: INDENT.match(text, i).end() - i
        least, end = indent(text.rfind("\n", 0, name_at) + 1), at
        while end < len(text):
            stop = text.find("\n", end)
            stop = len(text) if stop < 0 else stop
            if text[end:stop].strip() and indent(end) <= least:
                break
            end = stop + 1
        return self.lines(at - 1, min(end, len(text)))

    def literal(self, value: Value, start: int, end: int) -> None:
        """Add a string literal, whose known names are replaced where it is joined."""
        text, parts, at = self.text, [], start
        lines = self.lines(start, end)
        value.add(lines, [])
        for inner in (*INSIDE.finditer(text, start, end), None):
            known = inner and self.constants.get(inner[inner.lastindex])
            if inner is None or known:
                stop = inner.start() if inner else end
                parts = [(max(a, at), min(b, stop), bare) for a, b, bare in lines if max(a, at) < min(b, stop)]
                value.add([], parts)
                if known:
                    value.add_constant(known)
                    at = inner.end()

    def value(self, at: int, name_at: int) -> Value:
        """The expression that begins at ``at``; literals are (start, end, bare)."""
        text, value, depth, plus = self.text, Value(), 0, False
        if m := BLOCK.match(text, at):
            value.add(self.block(m.end(), name_at))
            return value.done(text)
        below = LINE_END.match(text, at)
        at = below.end() if below else at
        while True:
            while text.startswith(("(", "["), at):
                depth, at = depth + 1, self.gap(at + 1)
            if (below or depth) and NESTED.match(text, at):
                break
            quoted = False
            if m := STRING.match(text, at):
                quoted, group = True, m.lastindex
                self.literal(value, *m.span(group))
            elif (m := WORD.match(text, at)) and m[0] in self.constants and not text.startswith("(", m.end()):
                value.add_constant(self.constants[m[0]])
            elif m := INSIDE.match(text, at):
                value.add_constant(self.constants.get(m[m.lastindex]))
            elif (m := BARE.match(text, at)) and not text.startswith(("(", "["), m.end()):
                stop = m.end()
                if text.startswith("\\", stop - 1) and text.startswith(("\n", "\r\n"), stop):
                    m = BARE.match(text, at, stop - 1) or m
                    stop = m.end()
                while stop > at and text[stop - 1] in ".!?:":
                    stop -= 1
                if below and not depth and not value.some() and not ALONE.match(text, m.end()):
                    break
                if stop > at:
                    # Beside an operator, a word is a name that isn't known.
                    unknown = (plus or PLUS.match(text, m.end())) and WORD.fullmatch(text, at, stop)
                    value.add([(at, stop, True)], [] if unknown else None)
            elif not (depth and text.startswith((")", "]"), at)):
                break
            at = m.end() if m else at
            goes_on = plus = False
            while depth and not goes_on:
                to = self.gap(at)
                if text.startswith((")", "]"), to):
                    depth, at = depth - 1, to + 1
                elif text.startswith(",", to):
                    at, goes_on = self.gap(to + 1), True
                    value.joined.append([])
                elif m := PLUS_INSIDE.match(text, to):
                    at, goes_on, plus = self.gap(m.end()), True, True
                elif text.startswith(('"', "'", "`"), to):
                    at, goes_on = to, True
                else:
                    return value.done(text)
            if goes_on:
                continue
            if m := PLUS.match(text, at):
                at, plus = self.gap(m.end()), True
            elif m := NEXT.match(text, at):
                at = m.end()
            elif not (quoted and text.startswith(('"', "'"), at)):
                break
        return value.done(text)

    def items(self, at: int) -> Value | None:
        """The items of a list below a name, each a value of its own."""
        value, found = Value(), ITEMS.match(self.text, at)
        for m in ITEM.finditer(self.text, *found.span()) if found else ():
            value.joined.append([])
            value.add([(*m.span(3), True)] if m[3] else [(*m.span(2), False)] if m[2] else [])
        return value.done(self.text) if value.some() else None

    def name_before(self, end: int, bound: int) -> re.Match | None:
        """The name that ends before an operator and begins at ``bound`` at the earliest, however long."""
        reach = NAME_REACH
        while True:
            low = max(bound, end - reach)
            m = NAME.search(self.text, low, end)
            if low == bound or (m and m.start() > low):
                return m
            tail = self.text[low:end].rstrip(" \t")
            if not m and tail and tail[-1] not in "\"'`]":
                return None
            reach *= 2

    def scopes(self) -> list[tuple[int, int]]:
        """Begin and end of each function: its head and the lines below that are indented deeper, or blank."""
        out = []
        for m in FUNCTION.finditer(self.text):
            at = m.end()
            while at < len(self.text):
                stop = self.text.find("\n", at + 1)
                stop = len(self.text) if stop < 0 else stop
                line = self.text[at + 1 : stop]
                if line.strip() and len(line) - len(line.lstrip(" \t")) <= len(m[1]):
                    break
                at = stop
            out.append((m.start(), at))
        return out

    def places(self) -> Iterator[tuple[int, int, str, re.Match]]:
        """Where a value may begin, in order: after operators and in elements, calls and arguments after a quoted name."""
        text = self.text
        found = [((m.start(), 0, "operator", m) for m in OPERATOR.finditer(text))]
        if "</" in text:
            found.append((m.start(2), 1, "element", m) for m in ELEMENT.finditer(text))
        if "(" in text or "," in text:
            found.append((m.end(), 2, "call", m) for m in CALL.finditer(text) if sensitivity(m[1]))
            found.append((m.end(), 3, "keyed", m) for m in KEYED.finditer(text) if sensitivity(m[2]))
        for sign, pattern in (("define", DEFINE), ("--", OPTION), ("value", ATTRIBUTE)):
            if sign in text:
                found.append((m.end(), 4, "keyed", m) for m in pattern.finditer(text) if sensitivity(m[1]))
        if "://" in text or "earer" in text:
            found.append((m.start(m.lastgroup), 5, "named", m) for m in NAMED.finditer(text))
        return merge(*found, key=lambda p: p[:2])

    def declared(self, name: re.Match, bound: int) -> str | None:
        """The name before ``name``, where that is the type in a declaration."""
        before = self.name_before(name.start(), bound) if name.start() > bound and self.text[name.start() - 1] in " \t*[]" else None
        return before["plain"] if before and before["plain"] and DECLARED.search(self.text, max(bound, before.start() - 10), before.start()) else None

    def pairs(self) -> Iterator[tuple[str, Value]]:
        text, bound = self.text, 0
        typed: tuple[int, str] = 0, ""  # where a type may begin behind a name and its colon
        scopes, inside = self.scopes()[::-1], []
        self.constants = ChainMap()
        for at, _, kind, m in self.places():
            while inside and inside[-1] <= at:
                inside.pop()
                self.constants = self.constants.parents
            while scopes and scopes[-1][0] <= at:
                if scopes[-1][1] > at:
                    inside.append(scopes[-1][1])
                    self.constants = self.constants.new_child()
                scopes.pop()
            if kind == "operator":
                low = max(bound, text.rfind("\n", 0, at) + 1)
                name, bound, equal = self.name_before(at, low), m.end(), m[0].strip() == "="
                with_type = equal and typed[0] and low == typed[0] and TYPE.fullmatch(text, typed[0], at)
                if not name and not with_type:
                    continue
                nearest = name and (name["quoted"] or name["plain"])
                if with_type and not (nearest and sensitivity(nearest)):
                    target = typed[1]
                else:
                    target = (equal and self.declared(name, low)) or nearest
                typed = (m.end(), name["plain"]) if m[0].strip() == ":" and name and name["plain"] else (0, "")
                name = name or m
                value = self.items(m.end()) or self.value(m.end(), name.start())
                if value.some():
                    self.constants[target] = value
            elif kind == "element":
                target, value = m[1], Value()
                value.add([(a, b, True) for a, b, _ in self.lines(*m.span(2))], [])
                value.done(text)
            elif kind == "named":
                target, value = m.lastgroup, Value()
                value.add([(*m.span(m.lastgroup), True)])
                value.done(text)
            else:
                target, value = m[m.lastindex], self.value(at, m.start())
            if value.some():
                yield target, value


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def scan_text(text: str, least: float = 0.5) -> list[dict]:
    """All spans of a text by start, then kind: kind, start, end, base, name (the sensitive target), score."""
    base = base_spans(text)
    found = [{"kind": k, "start": a, "end": b, "base": True, "name": None, "score": 1.0} for k, a, b in base]
    scores = Scores(text, least)
    if any(sign in text for sign in ("=", ":", "<", "(", ",", "--", "define", "earer")):
        for name, value in Lexer(text).pairs():
            if weight := sensitivity(name):
                scores.reached(value, weight, name)
    starts, reach = sorted((a, b) for _, a, b in base), []
    for _, b in starts:
        reach.append(max(b, reach[-1]) if reach else b)
    for (a, b), (score, name) in scores.best.items():
        before = bisect_right(starts, (a, len(text)))
        if not before or reach[before - 1] < b:
            found.append({"kind": "literal", "start": a, "end": b, "base": False, "name": name, "score": score})
    found.sort(key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))
    return found


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("name", pa.string()), ("score", pa.float64())]))
SPANS_SQL = "array<struct<kind:string,start:long,end:long,base:boolean,name:string,score:double>>"


def scan(df: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and the spans of every row; literals need a score of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [scan_text(t, least) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return common.map_arrow(common.texts(df), run, f"doc_id long, spans {SPANS_SQL}")


def redacted(text: str, mark: str, least: float) -> str:
    out, at = [], 0
    for s in scan_text(text, least):
        if s["end"] > at:
            if s["start"] >= at:
                out += (text[at : s["start"]], mark)
            at = s["end"]
    return "".join((*out, text[at:])) if out else text


def redact(df: DataFrame, mark: str = "[SECRET]", least: float = 0.5) -> DataFrame:
    """The same rows and columns with each stretch of secrets in ``text`` replaced by ``mark`` and, where there is one, ``n_chars`` counted again."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redacted(t, mark, least) for t in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    out = common.map_arrow(df, run, df.schema.simpleString()[len("struct<") : -1])
    return out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in names else out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
