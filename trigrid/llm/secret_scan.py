"""Secret scan by assignment-aware lexing.

Source and configuration text is lexed into (name, literal) pairs. Names stand before ``=``, ``:=``, ``=>``, ``:`` or
a comparison, with or without quotes and a type annotation (``const apiToken: string = "..."``), as keys of
subscripts (``d["pwd"] = "..."``), as XML elements (``<password>...</password>``) and attributes (also ``key="..."
value="..."``), and as setters or first arguments of calls (``setToken("...")``, ``put("token", "...")``). Literals are strings
in any quotes, with prefixes and escapes, triple-quoted ones and those side by side or joined by signs, and bare words of
configuration files. Items of a list and arguments of a call on the right side are literals of the name each by itself; keyword
arguments are pairs of their own, and so are pairs inside strings (connection strings). ``a, b = "...", "..."`` binds item by item.
Names also stand before ``<-``, after dashes (``--password=...``), between ``#define`` or ``set`` and a string, and before a block of
indented lines (``password: |``).

Names bound earlier in the text are constants: where a later right side names one, its literals stand in (so ``k = "...";
api_token = k`` reports the literal of k), also inside formatted strings (``f"{k}"``, ``"%s" % k``). Braces and indented blocks are scopes: what they bind ends with them.

A literal is scored by how sensitive the words of its target name are, by its length, character mix
and entropy; placeholders score down. Three base patterns (assign, access, hex) are always reported.

A name stands for its constant whatever the length. A value of more than ``LONGEST_SUM`` characters is kept as
what its score depends on (:class:`Profile`), and the literals of a sum as references to those of its
parts, so that sums of sums can't outgrow the text.

Offsets are code points, ends exclusive; a literal's span is what stands between its quotes, escapes as written. A null
or empty text has no spans; texts of any length are scanned whole; a span found twice is reported once, and spans with
one start are in the order of their kinds; repeated rows give repeated results; an empty table gives an
empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, keyed_texts

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_STRING = r"""(?<![\w"'`])(?:[rRbBuUfF]{1,2}(?=["']))?(?:\"\"\"((?:[^\\]|\\.)*?)\"\"\"|\'\'\'((?:[^\\]|\\.)*?)\'\'\'|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)"""
STRING = re.compile(_STRING, re.ASCII | re.DOTALL)
_OP = r"(?:[ \t]*:[ \t]*[A-Za-z_][\w.<>\[\], |?&*]*?(?=[ \t]*=[^=]))?[ \t]*(===?|!==?|:=|=>|\?=|\+=|<-|=(?![~])|:(?![:/]))[ \t]*"
HEAD = re.compile(r"(?<![\w.\-])-{0,2}([A-Za-z_][A-Za-z0-9_.\-]*)" + _OP, re.ASCII)
#: A string that names something: a key, or the last subscript of a target.
KEY_END = re.compile(r"(?:[ \t]*\])?" + _OP, re.ASCII)
EVENT = re.compile(
    r"(?P<attribute>(?<![\w.\-])(?:key|name|id)[ \t]*=[ \t]*[\"']([^\"'\n]*)[\"']\s+value[ \t]*=[ \t]*([\"'])([^\"'\n]*)\3)"
    r"|(?P<head>" + HEAD.pattern + r")|(?P<string>" + _STRING + r")|(?P<element><([A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>([^<>]*)</\15\s*>)"
    r"|(?P<call>(?<![\w.\-])([A-Za-z_][A-Za-z0-9_.\-]*)[ \t]*\((?=[ \t]*[\"']))|(?P<open>\{)|(?P<close>\})|(?P<line>\n[ \t]*)"
    r"|(?P<spaced>(?<![\w.\-#])(?:#[ \t]*define|set|setenv)[ \t]+(?P<spaced_name>[A-Za-z_][\w.\-]*)[ \t]+(?=[\"']))",
    re.ASCII | re.DOTALL,
)
#: Names before the last one of several targets, up to the start of their line.
TARGETS = re.compile(r"(?:^|\n|;|\b(?:let|var|const|local)\b)[ \t]*((?:[A-Za-z_][\w.]*[ \t]*,[ \t]*)+)$", re.ASCII)
#: Indented lines after a sign that keeps or folds them.
BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*\r?\n((?:[ \t]+[^\s][^\n]*(?:\n|$)|[ \t]*\r?\n)+)")
#: A name in braces inside a formatted string.
FORMATTED = re.compile(r"\{([A-Za-z_][\w.]*)(?:![rsa])?(?::[^{}]*)?\}", re.ASCII)
BARE = re.compile(r"[^\s\"',;{}()\[\]+`]+")
SETTER = re.compile(r"(?:^|[._\-])(?:set|with|put|add|use)(?=[A-Z_])|(?:^|[._\-])(?:set|put|add|define|insert|append)$")
JOINED = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+|\.\.|\|\||&|%(?=[ \t])|\.(?=\s))[ \t]*(?:\\?\r?\n[ \t]*)?")
BLANKS = re.compile(r"(?:[ \t]|\\\r?\n)*")
LEXED = re.compile(r"[=:<(]")
SPOKEN = re.compile(r"define|set")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weight of a word of the target name.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "mnemonic": 3, "secret": 3, "token": 3, "apikey": 3, "bearer": 2, "credential": 2, "credentials": 2,
    "pass": 2, "private": 1, "access": 1, "auth": 1, "key": 1, "api": 1, "signing": 1, "encryption": 1, "session": 1, "client": 1,
}
#: Names whose values may hold blanks; elsewhere blanks mean prose.
SPACED = {"passphrase", "mnemonic"}
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your[_-]|x{4,}|\*{3,}|^<.*>$|^\$\{|^\{\{|^(?:true|false|null|none|undefined)$", re.ASCII)
#: Of those, the ones that may stand anywhere, and the ones that open a value of any length.
INSIDE = re.compile(r"(?i)example|changeme|placeholder|your[_-]|x{4,}|\*{3,}", re.ASCII)
AT_START = re.compile(r"\$\{|\{\{")
MIN_SCORE = 5.0
LONGEST_SUM = 256


#: Characters kept of a long sum's ends: no placeholder that lies across two parts needs more.
ENDS = 16
#: Counts of a longer sum are halved so often: the shares they stand for stay exact to the last bit of a float.
LONGEST_COUNT, HALVINGS = 1 << 512, 256


class Profile(NamedTuple):
    """What the score of a value depends on, for those too long to be kept as text."""

    head: str
    tail: str
    placeholder: bool
    #: Occurrences of each character, in units of 2**halved.
    counts: dict[str, int]
    halved: int

    @staticmethod
    def of(value: str | Profile) -> Profile:
        if isinstance(value, Profile):
            return value
        return Profile(value[:ENDS], value[-ENDS:], bool(INSIDE.search(value)), Counter(value), 0)

    def joined(self, other: Profile) -> Profile:
        halved = max(self.halved, other.halved)
        counts = {c: max(1, n >> (halved - self.halved)) for c, n in self.counts.items()}
        for c, n in other.counts.items():
            counts[c] = counts.get(c, 0) + max(1, n >> (halved - other.halved))
        if sum(counts.values()) > LONGEST_COUNT:
            counts, halved = {c: max(1, n >> HALVINGS) for c, n in counts.items()}, halved + HALVINGS
        placeholder = self.placeholder or other.placeholder or bool(INSIDE.search(self.tail + other.head))
        head = (self.head + other.head)[:ENDS] if len(self.head) < ENDS else self.head
        tail = (self.tail + other.tail)[-ENDS:] if len(other.tail) < ENDS else other.tail
        return Profile(head, tail, placeholder, counts, halved)


def added(a: str | Profile, b: str | Profile) -> str | Profile:
    """The sum of two values: text while it is short, else its profile."""
    if a == "" or b == "":
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LONGEST_SUM:
        return a + b
    return Profile.of(a).joined(Profile.of(b))


def _kept(value: str) -> str | Profile:
    return value if len(value) <= LONGEST_SUM else Profile.of(value)


def _entropy(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def entropy(literal: str) -> float:
    """Bits per character of the literal's own distribution."""
    return _entropy(Counter(literal))


def score(name: str, literal: str | Profile) -> float:
    """How likely ``literal`` is a secret bound to ``name``."""
    words = [w.lower() for w in WORD.findall(name)]
    named = min(4, sum(SENSITIVE.get(w, 0) for w in words) + any(a + b in SENSITIVE for a, b in pairwise(words)))
    if not named:
        return 0.0
    if isinstance(literal, Profile):
        # Longer than LONGEST_SUM: of the anchored placeholders only those that look at the ends can match.
        size, chars = LONGEST_SUM + 1, "".join(literal.counts)
        placeholder = literal.placeholder or AT_START.match(literal.head) or (literal.head[0] == "<" and literal.tail[-1] == ">")
        bits = _entropy(literal.counts)
    else:
        size, chars, placeholder = len(literal), literal, PLACEHOLDER.search(literal)
        bits = None
    if size < 8 or placeholder or (" " in chars and not SPACED.intersection(words)):
        return 0.0
    classes = sum(bool(re.search(c, chars)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return named + (size >= 16) + min(2.0, max(0.0, (entropy(literal) if bits is None else bits) - 2.0)) + 0.5 * (classes - 1)


#: The places of a right side's literals in the text, and the numbers of the earlier bindings it names.
Parts = list[tuple[int, int] | int]


class _Lexer:
    """One pass over a text with a stack of unfinished right sides; each step moves forward."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.out: list[tuple[str, str | Profile, Parts]] = []
        self.known: dict[str, int] = {}
        #: Kind and indentation of each open scope, and what to restore when it ends.
        self.scopes: list[tuple[str, int, list[tuple[str, int | None]]]] = []
        self.indent = 0

    # Scopes

    def _enter(self, kind: str, indent: int = 0) -> None:
        self.scopes.append((kind, indent, []))

    def _leave(self) -> None:
        for name, before in reversed(self.scopes.pop()[2]):
            if before is None:
                del self.known[name]
            else:
                self.known[name] = before

    def _line(self, at: int, to: int, end: int) -> None:
        """A new line whose text starts at ``to``; ``at`` is where the last one ended."""
        if to >= end or self.text[to] in "\r\n":
            return
        new = to - self.text.rfind("\n", 0, to) - 1
        while self.scopes and self.scopes[-1][0] == "indent" and new <= self.scopes[-1][1]:
            self._leave()
        # Only blanks and empty lines lie between the colon that opens a block and its first line.
        while at and self.text[at - 1].isspace():
            at -= 1
        if new > self.indent and self.text[at - 1 : at] == ":":
            self._enter("indent", self.indent)
        self.indent = new

    # Bindings

    def bind(self, name: str, value: str | Profile, parts: Parts, constant: bool) -> None:
        if constant:
            if self.scopes:
                self.scopes[-1][2].append((name, self.known.get(name)))
            self.known[name] = len(self.out)
        self.out.append((name, value, parts))

    def _block(self, name: str, a: int, b: int) -> int:
        """Bind indented lines; those less indented than the first are no longer the block's."""
        text, lines, at = self.text, [], a
        first = None
        while at < b:
            stop = text.find("\n", at, b) + 1 or b
            line = text[at:stop]
            if line.strip():
                indent = len(line) - len(line.lstrip(" \t"))
                first = indent if first is None else first
                if indent < first:
                    break
                lines.append((at + indent, at + len(line.rstrip())))
            at = stop
        if lines:
            self.bind(name, _kept("".join(text[x:y] for x, y in lines)), [(lines[0][0], lines[-1][1])], False)
        return at

    def _literal(self, name: str, a: int, b: int) -> None:
        self.bind(name, _kept(self.text[a:b]), [(a, b)] if b > a else [], False)

    def scan(self, at: int, end: int, inner: bool = False) -> None:
        """Bind what stands in a range; ``inner`` is one inside a string, whose names are no constants."""
        text = self.text
        stack: list[_Side] = []
        while at < end:
            if stack:
                at = self._step(stack, at, end, inner)
                continue
            m = EVENT.search(text, at, end)
            if not m:
                return
            kind, at = m.lastgroup, m.end()
            if kind == "head":
                side = _Side(m[6], m[7] not in _COMPARED and not inner)
                block = BLOCK.match(text, at, end) if m[7] == ":" else None
                if block:
                    at = self._block(side.name, *block.span(1))
                    continue
                line = text.rfind("\n", 0, m.start()) + 1
                several = TARGETS.search(text, line, m.start()) if text[line : m.start()].rstrip(" \t").endswith(",") else None
                if several and m[7] in ("=", ":="):
                    side.targets = [n.strip() for n in several[1].split(",")[:-1]][1:] + [side.name]
                    side.name = several[1].split(",")[0].strip()
                stack.append(side)
            elif kind == "spaced":
                stack.append(_Side(m["spaced_name"], not inner))
            elif kind == "string":
                a, b = _inside(m, 8)
                key = KEY_END.match(text, at, end)
                if key:
                    stack.append(_Side(text[a:b], key[1] not in _COMPARED and not inner))
                    at = key.end()
                elif not inner and LEXED.search(text, a, b):
                    self.scan(a, b, True)
            elif kind == "element":
                a, b = m.span(16)
                while a < b and text[a].isspace():
                    a += 1
                while a < b and text[b - 1].isspace():
                    b -= 1
                self._literal(m[15], a, b)
                at = m.start() + 1 + len(m[15])
            elif kind == "attribute":
                self._literal(m[2], *m.span(4))
            elif kind == "call":
                first = STRING.match(text, BLANKS.match(text, at).end(), end)
                after = BLANKS.match(text, first.end()).end() if first else at
                if first and text[after : after + 1] == ",":
                    a, b = _inside(first, 0)
                    side = _Side(text[a:b], False)
                    side.groups.append(")")
                    stack.append(side)
                    at = after + 1
                elif SETTER.search(m[18]):
                    side = _Side(m[18], False)
                    side.groups.append(")")
                    stack.append(side)
            elif kind == "open":
                self._enter("brace")
            elif kind == "close":
                # A closing brace without an opening one ends nothing.
                inside = any(k == "brace" for k, _, _ in reversed(self.scopes))
                while inside:
                    inside = self.scopes[-1][0] != "brace"
                    self._leave()
            else:
                self._line(m.start(), at, end)
        while stack:
            self._finish(stack.pop())

    # Right sides

    def _finish(self, side: _Side) -> None:
        if side.has:
            self.bind(side.name, side.value, side.parts, side.constant)

    def _item(self, side: _Side) -> None:
        """The end of an item of a list or an argument of a call: a literal by itself."""
        self._finish(side)
        side.value, side.parts, side.has = "", [], False

    def _step(self, stack: list[_Side], at: int, end: int, inner: bool) -> int:
        text, side = self.text, stack[-1]
        at = BLANKS.match(text, at, end).end()
        if at >= end:
            return end
        c = text[at]
        if c == "\n" or c == "\r":
            nxt = at + 1 + (text[at : at + 2] == "\r\n")
            if side.groups and text[nxt : nxt + 1] not in ("\n", "\r"):
                return nxt
            if not side.groups and len(stack) == 1:
                joined = JOINED.match(text, at, end) if side.has else None
                if joined:
                    side.want = True
                    return joined.end()
            # A right side ends with its line, and all of them with an empty one.
            while stack:
                self._finish(stack.pop())
            return at
        if side.want or c in "\"'`" or STRING.match(text, at, end):
            return self._operand(stack, at, end, inner)
        joined = JOINED.match(text, at, end)
        if joined:
            side.want = True
            return joined.end()
        if c == "," and side.targets and not side.groups:
            self._item(side)
            side.name = side.targets.pop(0)
            side.want = True
            return at + 1
        if c == "," and side.groups:
            self._item(side)
            side.want = True
            return at + 1
        if side.groups and c == side.groups[-1]:
            self._item(side)
            side.groups.pop()
            side.want = False
            return at + 1
        if side.groups:
            if c in "{}":
                self._finish(stack.pop())
                return at
            bare = BARE.match(text, at, end)
            return bare.end() if bare else at + 1
        self._finish(stack.pop())
        if stack and c not in ",)]}":
            stack[-1].want = False
        return at

    def _operand(self, stack: list[_Side], at: int, end: int, inner: bool) -> int:
        text, side = self.text, stack[-1]
        c = text[at]
        m = STRING.match(text, at, end)
        if m:
            a, b = _inside(m, 0)
            key = KEY_END.match(text, m.end(), end) if side.groups else None
            if key:
                stack.append(_Side(text[a:b], False))
                return key.end()
            names = FORMATTED.findall(text, a, b) if text[m.start()] in "fF" or text[m.start() + 1] in "fF" else []
            constants = [self.known[n] for n in names if n in self.known] if not inner else []
            for k in constants:
                side.add(self.out[k][1], [k])
            if text[a:b] in ("%s", "%r", "{}"):
                side.add("", [])
            elif not constants or FORMATTED.sub("", text[a:b]):
                side.add(_kept(text[a:b]), [(a, b)] if b > a else [])
            if not inner and LEXED.search(text, a, b):
                self.scan(a, b, True)
            return m.end()
        if c in "([":
            side.groups.append(")" if c == "(" else "]")
            return at + 1
        if side.groups:
            if c == side.groups[-1] or c == ",":
                side.want = False
                return at
            head = HEAD.match(text, at, end)
            if head and head[2] not in _COMPARED:
                stack.append(_Side(head[1], not inner))
                side.want = False
                return head.end()
        bare = BARE.match(text, at, end)
        if not bare:
            side.want = False
            if c == "{" and not side.groups:
                self._finish(stack.pop())
                self._enter("brace")
                return at + 1
            if c in "\"'`+":
                return at + 1
            return at if not side.groups or c in "{}" else at + 1
        word = bare[0]
        if text[bare.end() : bare.end() + 1] == "(" and word[0].isalpha():
            side.groups.append(")")
            return bare.end() + 1
        constant = self.known.get(word[1:].strip("{}") if word[0] == "$" else word) if not inner else None
        if constant is not None:
            side.add(self.out[constant][1], [constant])
        elif not side.groups:
            side.add(_kept(word), [bare.span()])
        side.want = False
        return bare.end()


_COMPARED = ("==", "===", "!=", "!==")


def _inside(m: re.Match, before: int) -> tuple[int, int]:
    """The span between the quotes of a string; its five groups follow ``before`` others."""
    return next(m.span(k) for k in range(before + 1, before + 6) if m[k] is not None)


class _Side:
    """An unfinished right side: its target, and what it adds up to."""

    def __init__(self, name: str, constant: bool) -> None:
        self.name, self.constant = name, constant
        self.value: str | Profile = ""
        self.parts: Parts = []
        self.has, self.want = False, True
        self.groups: list[str] = []
        #: Of several targets, those whose items are still to come.
        self.targets: list[str] = []

    def add(self, value: str | Profile, parts: Parts) -> None:
        self.value = added(self.value, value)
        self.parts += parts
        self.has, self.want = True, False


def bindings(text: str) -> list[tuple[str, str | Profile, Parts]]:
    """(name, value, parts) of each pair, constants propagated in text order."""
    lexer = _Lexer(text)
    lexer.scan(0, len(text))
    return lexer.out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three base patterns, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of literals whose score reaches the limit."""
    if not LEXED.search(text) and not SPOKEN.search(text):
        return []
    bound = bindings(text)
    found: set[tuple[int, int]] = set()
    # Bindings name earlier ones only, so one walk backwards reaches all literals behind those that score.
    wanted = [score(name, value) >= MIN_SCORE for name, value, _ in bound]
    for i in range(len(bound) - 1, -1, -1):
        if wanted[i]:
            for part in bound[i][2]:
                if isinstance(part, int):
                    wanted[part] = True
                else:
                    found.add(part)
    return sorted((a, 3, b) for a, b in found)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            every = sorted({*base, *lexed_spans(text or "")})
            kinds = Counter(k for _, k, _ in base)
            rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        longs = [pa.array(c, pa.int64()) for c in cols[:3]]
        texts = [pa.array(c, pa.string()) for c in cols[3:]]
        return dict(zip(("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"), [batch.column("doc_id"), *longs, *texts], strict=True))

    return arrow_map(keyed_texts(docs), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
