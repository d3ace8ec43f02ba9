"""Buckets of very many unlike members: no link is lost, and not all are compared with all."""

from __future__ import annotations

import random

import pytest

from trigrid.llm import neardup
from trigrid.llm.common import Workspace


def sets_of(text):
    w = text.split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))


def brute(sets, threshold=85):
    """Smallest linked id of each; pairs are looked for among sets that share a shingle few have."""
    n = len(sets)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if 100 * min(len(sets[i]), len(sets[j])) >= threshold * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def template_pages(n, rng):
    """Pages of one template: two thirds of the shingles are the same, some pages are near copies of others."""
    template = [f"t{i}" for i in range(130)]
    pages = []
    for i in range(n):
        if i > 20 and rng.random() < 0.1:
            words = pages[rng.randrange(i)].split()
            for _ in range(rng.choice([1, 2, 3, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        else:
            own = [f"w{rng.randint(0, 10**7)}" for _ in range(60)]
            words = template[:65] + own + template[65:]
        pages.append(" ".join(words))
    return pages


@pytest.mark.parametrize("block", [512, 16])
def test_template_pages(spark, monkeypatch, block):
    """With small blocks all groups are split, with large ones buckets are."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    pages = template_pages(1000, random.Random(7))
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, Workspace(spark)).collect()}
    want = brute([sets_of(p) for p in pages])
    assert [got[i] for i in range(len(pages))] == want
    assert len(set(want)) < len(want)


def test_twenty_thousand_unlike_members(spark):
    """One bucket of 20,000: rare shingles leave next to no pairs to compare."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(40)]
    pages = [" ".join([*template, *(f"w{rng.randint(0, 10**9)}" for _ in range(12))]) for _ in range(20_000)]
    pages[11_111] = pages[77] + " more"
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string").repartition(8)
    ws = Workspace(spark)
    keep, seen = ws.keep, {}

    def counted(frame, name, *rest):
        out = keep(frame, name, *rest)
        if name in ("under", "groups", "large"):
            seen[name] = out.count() if name != "groups" else sum(r.blocks**2 for r in out.collect())
        return out

    ws.keep = counted
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, ws).collect()}
    assert {i: c for i, c in got.items() if i != c} == {11_111: 77}
    # A set of 48 shingles has a prefix of 8, and these are its own.
    assert seen["large"] > 10_000 and seen["under"] < seen["large"] / 10 and seen["groups"] < 200
