"""Lexed spans against parsers of the languages themselves and against texts built with known spans."""

from __future__ import annotations

import ast
import collections
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from trigrid.llm import secret_scan

WEIGHTS = {"password": 3, "secret": 3, "token": 3, "api": 1, "key": 1, "client": 1, "apikey": 3, "private": 1, "pwd": 3}


def likely(name, literal):
    """The rule of the docstring in a few lines: names, length, mixture, entropy."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    named = min(4, sum(WEIGHTS.get(w, 0) for w in words) + any(a + b in WEIGHTS for a, b in zip(words, words[1:])))
    if not named or len(literal) < 8 or " " in literal:
        return False
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in collections.Counter(literal).values())
    classes = sum(bool(re.search(c, literal)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return named + (n >= 16) + min(2.0, max(0.0, bits - 2.0)) + 0.5 * (classes - 1) >= 5.0


NAMES = ["api_token", "clientSecret", "pwd", "note", "k1", "k2", "title", "PRIVATE_KEY", "count"]


def literal(rng):
    return "".join(rng.choice("abcXYZ0189+/!") for _ in range(rng.choice([1, 5, 9, 14, 20])))


def quoted(rng):
    body, q = literal(rng), rng.choice(['"', "'", '"""', "'''"])
    if rng.random() < 0.2:
        body += "\\" + rng.choice("n'\"") + "z"
    return rng.choice(["", "", "r", "b"]) .replace("b", "") + q + body + q


def python_text(rng):
    lines = []
    for _ in range(rng.randint(3, 9)):
        def side(depth=0):
            kind = rng.random()
            if kind < 0.45 or depth > 1:
                return quoted(rng)
            if kind < 0.6:
                return rng.choice(["k1", "k2", "note"])
            if kind < 0.75:
                return f"{side(2)} + {side(2)}"
            if kind < 0.83:
                return f"load({side(2)}, {rng.choice(NAMES)}={quoted(rng)})"
            if kind < 0.9:
                return f"[{quoted(rng)},\n    {quoted(rng)}]"
            return f"({quoted(rng)}\n    {quoted(rng)})"

        name = rng.choice(NAMES)
        form = rng.random()
        if form < 0.6:
            lines.append(f"{name} = {side()}")
        elif form < 0.7:
            lines.append(f"{name}: str = {quoted(rng)}")
        elif form < 0.8:
            lines.append(f"d[{name!r}] = {side()}")
        elif form < 0.9:
            lines.append(f"def f{len(lines)}():\n    {name} = {quoted(rng)}\n    {rng.choice(NAMES)} = {name}")
        else:
            lines.append(f"# {rng.choice(['plain words', 'more'])}")
    return "\n".join(lines) + "\n"


def python_spans(text):
    """Pairs by the language's own parser; literals by its coordinates."""
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    found, known = set(), {}

    def spans_of(node):
        """Contents of the string tokens of a constant; side by side they are one node."""
        a, b = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
        out, at = [], a
        while at < b:
            m = re.compile(r"[rb]?('''|\"\"\"|'|\")").match(text, at)
            if not m:
                at += 1
                continue
            end = m.end()
            while not text.startswith(m[1], end):
                end += 2 if text[end] == "\\" else 1
            out.append((m.end(), end))
            at = end + len(m[1])
        return out

    def value(node):
        """(spans, text) of a sum, or None for what is no sum of literals and names."""
        if isinstance(node, ast.Constant):
            spans = spans_of(node)
            return spans, "".join(text[a:b] for a, b in spans)
        if isinstance(node, ast.Name):
            return known.get(node.id) or ([(starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset)], node.id)
        if isinstance(node, ast.BinOp):
            (s1, t1), (s2, t2) = value(node.left), value(node.right)
            return s1 + s2, t1 + t2
        return None

    def report(name, got):
        if got and likely(name, got[1]):
            found.update(s for s in got[0] if s[1] > s[0])

    def bind(name, node, constant):
        if isinstance(node, ast.Call):
            items = [value(x) for x in node.args if not isinstance(x, ast.Name) or x.id in known]
            for keyword in node.keywords:
                bind(keyword.arg, keyword.value, True)
        elif isinstance(node, ast.List):
            items = [value(x) for x in node.elts]
        else:
            items = [value(node)]
        for got in items:
            report(name, got)
            if constant and got:
                known[name] = got

    def block(body):
        for node in body:
            if isinstance(node, ast.FunctionDef):
                before = dict(known)
                block(node.body)
                known.clear()
                known.update(before)
            elif isinstance(node, ast.AnnAssign):
                bind(node.target.id, node.value, True)
            elif isinstance(node, ast.Assign):
                target = node.targets[0]
                bind(target.id if isinstance(target, ast.Name) else target.slice.value, node.value, True)

    block(ast.parse(text).body)
    return sorted(found)


@pytest.mark.parametrize("seed", range(8))
def test_python_source(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = python_text(rng)
        assert [(a, b) for a, _, b in secret_scan.lexed_spans(text)] == python_spans(text), text


@pytest.mark.parametrize("seed", range(4))
def test_json(seed):
    rng = random.Random(seed)

    def make(depth):
        return {rng.choice(NAMES) + str(i): make(depth - 1) if depth and rng.random() < 0.3 else ([literal(rng) for _ in range(3)] if rng.random() < 0.2 else rng.choice([literal(rng), 5, None, True])) for i in range(5)}

    def walk(node, name=""):
        if isinstance(node, dict):
            for k, v in node.items():
                yield from walk(v, k)
        elif isinstance(node, list):
            for v in node:
                yield from walk(v, name)
        elif isinstance(node, str) and likely(name, node):
            yield node

    for indent in (None, 2):
        for _ in range(20):
            data = make(3)
            text = json.dumps(data, indent=indent)
            assert [text[a:b] for a, _, b in secret_scan.lexed_spans(text)] == list(walk(data)), text


@pytest.mark.parametrize("shape", ["{n} = {v}", "{n}={v}", "  {n}: {v}", "export {n}={v}", "<{n}>{v}</{n}>", '<add key="{n}" value="{v}"/>', '{n}="{v}";', "define('{n}', '{v}');", '$this->{n} = "{v}";', 'const {n}: string = "{v}";', "set_{n}('{v}')", "{n} := `{v}`", '"{n}" => "{v}",', 'if ({n} == "{v}") {{', 'conn = "host=db;{n}={v}"'])
def test_shapes_of_configuration(shape):
    rng = random.Random(shape)
    parts, want, at = [], [], 0
    for _ in range(80):
        name, value = rng.choice(NAMES), "".join(rng.choice("abcXYZ0189/") for _ in range(rng.choice([5, 9, 14, 20])))
        line = "# plain words, isn't it\n" if rng.random() < 0.2 else shape.format(n=name, v=value) + "\n"
        if line[0] != "#" and likely(("set_" if "set_" in shape else "") + name, value):
            k = at + line.rindex(value)
            want.append((k, k + len(value)))
        parts.append(line)
        at += len(line)
    text = "".join(parts)
    assert [(a, b) for a, _, b in secret_scan.lexed_spans(text)] == want, text


@pytest.mark.parametrize("text", ['password = "abc" + x(' * 5000, "a: " * 50_000, '"' * 99_999, "f(a=" * 50_000, "{" * 50_000 + "k='x'\n" + "}" * 50_001, "<a " * 50_000, "'''" * 30_001, '`"' * 50_000 + "=", "[" * 50_000 + "a=(" * 9])
def test_odd_texts_end(text):
    secret_scan.lexed_spans(text)


def test_base_columns_and_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    hidden = "\nAKIA" + "Q" * 14 + " token=abcdefgh1 " + "0" * 31 + " " + "f" * 40 + "\n"
    extra = spark.createDataFrame([(-1, "word " * 400_000 + hidden + "word " * 400_000), (-2, hidden), (-2, hidden), (None, None)], "doc_id long, text string")
    docs = docs.unionByName(extra).withColumns({"kind": F.lit(1), "base_sha256": F.lit("clash")})
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(s for s in r.spans.split(",") if not s.startswith("lexed"))) for r in secret_scan.secret_scan(docs).collect())
    want = collections.Counter()
    from hashlib import sha256

    for i, text in docs.select("doc_id", "text").collect():
        text, spans = text or "", []
        for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
            spans += [(m.start(), 0, "assign", m.end())] * (len(m[1]) >= 8)
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        written = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        n = collections.Counter(k for _, _, k, _ in spans)
        want[i, n["assign"], n["access"], n["hex"], sha256(written.encode()).hexdigest(), written] += 1
    assert got == want
