"""Counting in jobs of two and three colours: each triangle once, few copies of an edge, and hubs bounded."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from trigrid import closing, graph, partition, triangles


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a > b}


def brute(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    return [(a, b, c) for a, b in edges for c in out[b] if c in out[a]]


def dealt(edges, label, k, kind):
    """Blocks as they come to each job."""
    lists = collections.defaultdict(list)
    for a, b in sorted(edges):
        lists[a].append(b)
    columns = {"src": pa.array(list(lists), kind), "dst": pa.array(list(lists.values()), pa.list_(kind))}
    columns |= {"label": pa.array([[label(a, b) for b in own] for a, own in lists.items()], pa.list_(pa.int32()))} if label else {}
    whole = pa.RecordBatch.from_pydict(columns)
    rows = [(job, {x: out.column(x)[0].as_py() for x in out.schema.names if x != "jobs"}) for at in range(0, len(lists), 7) for out in closing._blocks([whole.slice(at, 7)], k) for job in out.column("jobs")[0].as_py()]
    for job, row in sorted(rows, key=lambda x: x[0]):
        yield pa.RecordBatch.from_pydict({"job": pa.array([job], pa.int32())} | {x: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for x, v in row.items()})


@pytest.mark.parametrize("k", [2, 3, 5])
@pytest.mark.parametrize("probe", ["sorted", "hash", "bits"])
@pytest.mark.parametrize("size", ["i4", "i8"])
def test_each_triangle_in_one_job(k, probe, size, monkeypatch):
    monkeypatch.setattr(closing, "PROBES", 50)
    monkeypatch.setattr(closing, "TABLE", 1)
    step = 1 if size == "i4" else 1 << 33
    edges = {(a * step, b * step) for a, b in random_edges(k, 60, 900)}
    label = None if probe == "bits" else lambda a, b: (a + 3 * b) // step % 1000
    kind = pa.int32() if size == "i4" else pa.int64()
    got = collections.Counter()
    for found in closing._closed(dealt(edges, label, k, kind), probe, k, (size, "i4")):
        got.update(zip(*(x.tolist() for x in found if x is not None), strict=True))
    want = brute(edges) if label is None else [(a, b, c, label(a, b), label(a, c), label(b, c)) for a, b, c in brute(edges)]
    assert got == collections.Counter(want) and len(want) > 200


@pytest.mark.parametrize("k", [2, 4, 9])
def test_an_edge_moves_once_for_each_other_colour(k):
    edges = random_edges(1, 80, 1500)
    moved = sum(len(b.column("dst")[0].as_py()) // 8 for b in dealt(edges, None, k, pa.int64()))
    assert moved == len(edges) * (k - 1)


def test_copies_grow_slower_than_the_edges():
    """Before, lists went to p + q jobs, where p grows as the edges."""
    for cores in (1, 2, 7, 8, 12, 100):
        for edges in (0, 10**6, 10**8, 432 * 10**6, 10**10):
            k = closing.colours(edges, cores)
            jobs = len(closing._jobs(k)) if k < 60 else k * (k * k - 1) // 6
            assert jobs == k * (k * k - 1) // 6 >= cores and 6 * edges <= closing.HELD * k * k
            assert -(-jobs // cores) * cores <= (1 + closing.IDLE) * jobs
    assert closing.colours(432 * 10**6, 12) - 1 == 8 < sum(closing.shape(432 * 10**6, 12)) / 1.9
    assert closing.colours(4320 * 10**6, 12) - 1 < sum(closing.shape(4320 * 10**6, 12)) / 4


def test_degrees_are_taken_for_hubs_only(spark, monkeypatch):
    degrees, seen = graph.degrees, []
    monkeypatch.setattr(graph, "degrees", lambda e: (seen.append(1), degrees(e))[1])
    flat = {(a, a - d) for a in range(9, 400) for d in (1, 2, 3, 5, 8)}
    assert triangles.count(frame(spark, flat), "hash", simple=True).first()[0] == len(brute(flat))
    assert not seen
    hubs = {(1000 + h, v) for h in range(4) for v in range(600)} | {(1000 + h, 1000 + g) for h in range(4) for g in range(h)} | {(v, v - 1) for v in range(1, 600)}
    assert triangles.count(frame(spark, hubs), "hash", simple=True).first()[0] == len(brute(hubs))
    assert seen


def test_triads_of_directed_edges_are_closed_in_jobs(spark, monkeypatch):
    deals = []
    deal = closing.deal
    monkeypatch.setattr(closing, "deal", lambda *a: (deals.append(1), deal(*a))[1])
    rng = random.Random(6)
    rows = [(rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(500)] + [(7, v) for v in range(-20, 20)] + [(v, 7) for v in range(-20, 9)]
    d = {(a, b) for a, b in rows if a != b}
    want = sum((u, w) in d for v in range(-20, 20) for u, w in itertools.permutations(range(-20, 20), 2) if (v, u) in d and (v, w) in d)
    assert triangles.transitive_triads(spark.createDataFrame(rows + rows[:50], "src long, dst long")).first()[0] == want > 1000
    assert deals
    assert triangles.transitive_triads(spark.createDataFrame([], "src long, dst long")).first()[0] == 0


def test_jobs_are_summed_without_names(spark, monkeypatch):
    """The total over jobs needs no struct of a shard's parts, and no label where ids tell the shard."""
    monkeypatch.setattr(triangles, "_named", lambda *a: pytest.fail("named"))
    edges = random_edges(3, 90, 1600)
    e = frame(spark, edges)
    want = len(brute(edges))
    assert triangles.over_jobs(e, partition.quadtree(e, 40, 64), 64).first()[0] == want
    monkeypatch.setattr(partition, "with_leaf", lambda *a, **k: pytest.fail("labelled"))
    assert triangles.over_jobs(e, partition.quadtree(e, 10_000, 16), 16).first()[0] == want
    none = spark.createDataFrame([], "src long, dst long")
    monkeypatch.undo()
    assert triangles.over_jobs(none, partition.quadtree(none, 40, 16), 16).first()[0] == 0


def test_grids_of_one_slice_are_not_sorted(spark, monkeypatch):
    edges = random_edges(5, 60, 700)
    grids = collections.Counter((a // 16, b // 16) for a, b in edges)
    monkeypatch.setattr(triangles, "_named", lambda *a: pytest.fail("named"), raising=False)
    sliced, with_slice = [], partition.with_slice
    monkeypatch.setattr(partition, "with_slice", lambda e, *a: (sliced.append(e.count()), with_slice(e, *a))[1])
    for size in (sorted(grids.values())[-2], max(grids.values())):
        place = {}
        for own in (sorted(x for x in edges if (x[0] // 16, x[1] // 16) == g) for g in grids):
            place |= {x: (x[0] // 16, x[1] // 16, i // size) for i, x in enumerate(own)}
        got = {(tuple(r.g0), tuple(r.g1), tuple(r.g2)): r.triangles for r in triangles.per_slice_triple(frame(spark, edges), size, 16, simple=True).collect()}
        assert got == collections.Counter((place[b, c], place[a, c], place[a, b]) for a, b, c in brute(edges))
    assert sliced == [max(grids.values())]


def test_bytes_come_back():
    for kind in ("i4", "i8"):
        x = np.array([0, 1, -5, 1 << 30, 255, 256], kind)
        assert closing._unpacked(closing._packed(x), kind).tolist() == x.tolist()
