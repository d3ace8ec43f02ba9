"""Scans over the whole table and over large segments, against plain loops."""

from __future__ import annotations

import random

import pytest

from trigrid import primitives, scans
from trigrid.storage import Workspace


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, *range(-5, 9)])) for i in range(3000)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "i long, s string, v long").repartition(7)


@pytest.mark.parametrize("segment", [[], ["s"]])
def test_prefix_scan(spark, rows, df, segment):
    got = {r.i: r for r in scans.prefix_scan(df, "v", ["i"], Workspace(spark), "runs", segment).collect()}
    assert len(got) == len(rows)
    state = {}
    for i, s, v in sorted(rows):
        key = s if segment else 0
        seen = state.setdefault(key, [])
        r = got[i]
        assert r.exclusive == sum(seen) and (r.min_before, r.max_before) == ((min(seen), max(seen)) if seen else (None, None))
        if v is not None:
            seen.append(v)
        assert r.inclusive == sum(seen) and (r.min_upto, r.max_upto) == ((min(seen), max(seen)) if seen else (None, None))


def test_runs_are_several_and_positions_are_the_orders(spark, rows, df):
    ws = Workspace(spark)
    placed = scans.indexed(df, ["i"], ws, "runs")
    assert {r.i: r["index"] for r in placed.collect()} == {i: i for i, _, _ in rows}
    assert placed.columns == [*df.columns, "index"]
    assert spark.read.parquet(ws.path("runs")).select("__run").distinct().count() >= 1


@pytest.mark.parametrize("segment", [[], ["s"]])
def test_carried_value(spark, rows, df, segment):
    got = {r.i: r.last for r in scans.carried(df, "v", ["i"], Workspace(spark), "runs", "last", segment).collect()}
    state = {}
    for i, s, v in sorted(rows):
        key = s if segment else 0
        state[key] = v if v is not None else state.get(key)
        assert got[i] == state[key]


def test_neighbour(spark, rows, df):
    got = {r.i: r.before for r in scans.neighbour(df, ["s", "v"], ["i"], Workspace(spark), "runs", "before").collect()}
    before = None
    for i, s, v in sorted(rows):
        assert (tuple(got[i]) if got[i] is not None else None) == before
        before = (s, v)


def test_runs_of_the_whole_table(spark, rows, df):
    ordered = [(i, s, v or 0) for i, s, v in sorted(rows)]
    runs = []
    for i, s, v in ordered:
        if runs and runs[-1][1] is not None and runs[-1][1] == s:
            runs[-1][2] += 1
            runs[-1][3] += v
        else:
            runs.append([i, s, 1, v])
    full = df.fillna({"v": 0})
    got = sorted(tuple(r) for r in primitives.run_lengths(full, "s", ["i"], [], "v").select("run", "length", "total").collect())
    assert got == [(k + 1, n, t) for k, (_, _, n, t) in enumerate(runs)]
    long = sorted(tuple(r) for r in primitives.long_runs(df, "s", ["i"], []).collect())
    assert long == [(i, n) for i, _, n, _ in runs if n > 1]
    firsts = sorted(r.i for r in primitives.unique_consecutive(df, "s", ["i"], []).collect())
    assert firsts == [i for (i, s, _), before in zip(ordered, [(0, "none", 0), *ordered], strict=False) if s != before[1]]


def test_empty_table(spark, df):
    none = df.limit(0)
    assert scans.indexed(none, ["i"], Workspace(spark), "a").count() == 0
    assert scans.prefix_scan(none, "v", ["i"], Workspace(spark), "b").count() == 0


def test_bins_by_search(spark):
    borders = [-2.0, 0.0, 0.5, 3.0, 10.0]
    values = [None, -3.0, -2.0, -0.1, 0.0, 0.4, 0.5, 2.9, 3.0, 9.9, 10.0, 11.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = {}
    for v in values:
        at = [i for i in range(4) if v is not None and borders[i] <= v < borders[i + 1]]
        if at:
            want[at[0]] = want.get(at[0], 0) + 1
    assert {r.bin: r.n for r in primitives.histogram_range(df, "v", borders).collect()} == want
    many = [float(k) for k in range(300)]
    assert {r.bin: r.n for r in primitives.histogram_range(df, "v", many).collect()} == {0: 3, 2: 1, 3: 1, 9: 1, 10: 1, 11: 1}
