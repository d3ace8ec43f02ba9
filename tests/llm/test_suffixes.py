"""Merged transforms against plain sorting, and byte dedup against every window."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from trigrid.llm import queries, suffixes
from trigrid.llm.common import Workspace

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_bytes int, lo string"


def brute(rows, window=100):
    """Results from a table of every window's first start; rows of one doc_id don't remove each other's bytes."""
    first = {}
    for k, (i, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0])):
        if i is not None:
            raw = (text or "").encode()
            for at in range(len(raw) - window + 1):
                first.setdefault(raw[at : at + window], (i, k, at))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=np.int8)
        own = set()
        for at in range(len(raw) - window + 1) if i is not None else ():
            part = raw[at : at + window]
            if first[part][0] < i or part in own:
                gone[at : at + window] = 1
            own.add(part)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(25))
def test_merge_orders_all_suffixes_and_finds_common_prefixes(seed):
    rng = random.Random(seed)
    letters = [b"a", b"ab", b"abcd", bytes(range(256))][seed % 4]
    stock = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(6)]
    strings = [b"".join(rng.choice(stock) for _ in range(rng.randint(0, 4))) for _ in range(20)]
    cuts = sorted(rng.sample(range(1, 20), 3))
    every = suffixes.Rows(strings)
    shards = [suffixes.Shard(every, a, b) for a, b in zip([0, *cuts], [*cuts, 20], strict=True)]
    rounds, base = 10, int(every.first[-1])
    rows, common, block = suffixes.merge(shards, rounds, every.narrow and seed % 2 == 0)
    assert sorted(rows.tolist()) == list(range(base))

    symbols = []
    for s in strings:
        padded = s + b"\0\0\0\0"
        for i in range(len(s) + 4):
            symbols.append((*(int.from_bytes(padded[j : j + 4], "big") for j in range(i, len(s), 4)), -1))
    ordered = [symbols[r] for r in rows.tolist()]
    heads = [s[:rounds] for s in ordered]
    assert heads == sorted(heads)
    for k in range(1, base):
        n = 0
        while n < min(len(heads[k]), len(heads[k - 1])) and heads[k][n] == heads[k - 1][n]:
            n += 1
        same = heads[k] == heads[k - 1]
        assert (block[k] == block[k - 1]) == same
        if not same:
            assert common[k] == n


def test_windows_that_repeat_in_strings():
    rng = random.Random(5)
    text = bytes(rng.randrange(97, 123) for _ in range(300))
    strings = [text[:150], text[20:170], b"x" * 120, text[200:299], text[100:200]]
    owner, offset, block = suffixes.repeated_windows(strings, 100)
    got = sorted((strings[o][i : i + 100], o, i) for o, i in zip(owner.tolist(), offset.tolist(), strict=True))
    every = [(s[i : i + 100], o, i) for o, s in enumerate(strings) for i in range(len(s) - 99)]
    seen = [w for w, _, _ in every]
    assert got == sorted(x for x in every if seen.count(x[0]) > 1)


def test_query_against_every_window(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = results(queries.op13_suffix_array_dedup(spark, SMALL))
    assert got == brute(docs) and sum(r[2] for r in got) > 10_000


@pytest.mark.parametrize("group", [2, 8, 1024])
def test_hot_groups_and_odd_rows(spark, group):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, header = text(260), text(90)
    rows = [(i, text(rng.randint(0, 60)) + header[: rng.randint(60, 90)] + shared + text(rng.randint(0, 80))) for i in range(60)]
    rows += [(100 + i, "z" * (95 + i) + shared[: 40 + 10 * i]) for i in range(12)]
    rows += [(200, None), (201, ""), (202, shared), (202, shared), (203, text(99)), (203, header + shared), (None, shared), (None, None), (204, (text(150) + " ") * 3 + "\0" * 230)]
    df = spark.createDataFrame([(i, t, -1, "clash") for i, t in rows], SCHEMA)
    got = suffixes.remove_repeated_bytes(df, Workspace(spark), group=group)
    assert results(got) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, a), (2, a[3000:7000] + "q" + a[:2000]), (3, a[8500:] + a[8500:])]
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 1500)
    raw = [t.encode() for _, t in rows]
    pieces = list(suffixes._sampled(raw, 100, 40, True))
    assert len(pieces) > 5
    covered = {(r, lo + k) for p in pieces for r, lo, n in zip(p["row"].tolist(), p["lo"].tolist(), p["n"].tolist(), strict=True) for k in range(n)}
    assert covered == {(r, k) for r, t in enumerate(raw) for k in range(len(t) - 99)}
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    assert results(suffixes.remove_repeated_bytes(df, Workspace(spark))) == brute(rows)
    assert suffixes.remove_repeated_bytes(df.limit(0), Workspace(spark)).count() == 0
    (row,) = suffixes.remove_repeated_bytes(df.where("doc_id <> 1").limit(1), Workspace(spark), texts=True).collect()
    assert bytes(row.kept).decode() == rows[1][1] and row.spans == []
