"""What grows with the data: tasks, passes of the quadtree, and what counting moves."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from trigrid import closing, formats, graph, partition, scans, triangles
from trigrid.storage import Workspace


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def test_tasks_of_co_occurrence_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 50, raising=False)
    rows = spark.range(2000).selectExpr("id div 4 AS g", "id * 7919 % 400 AS v")
    e = graph.co_occurrence(rows, "g", "v")
    assert e.rdd.getNumPartitions() == 80
    own = {}
    for r in rows.collect():
        own.setdefault(r.g, set()).add(r.v)
    assert sorted(map(tuple, e.collect())) == sorted({(a, b) for vs in own.values() for a in vs for b in vs if a > b})


def test_grids_that_fit_are_not_counted_in_cells(spark, monkeypatch):
    """Edges spread thin over a large matrix: as many grids as edges, each far below the limit."""
    rng = random.Random(5)
    edges = {tuple(sorted((rng.randrange(6000), rng.randrange(6000)), reverse=True)) for _ in range(3000)}
    seen = []
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name, *a: (seen.append(name), keep(self, df, name, *a))[1])
    shards = partition.quadtree(frame(spark, edges), 60, 256)
    assert [n for n in seen if n.startswith("cells-")] == ["cells-0"]
    assert shards.agg(F.sum("edges")).first()[0] == len(edges)


def test_grids_that_fit_are_counted_once(spark, monkeypatch):
    """The sizes of grids that settle the first depth are the first cells where grids fit: edges are read once."""
    rng = random.Random(6)
    edges = {tuple(sorted((rng.randrange(6000), rng.randrange(6000)), reverse=True)) for _ in range(3000)}
    read, keep = spark.sparkContext.accumulator(0), Workspace.keep

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    def kept(self, df, name, *a):
        out = keep(self, df, name, *a)
        return out.mapInPandas(counted, out.schema) if name == "edges" else out

    monkeypatch.setattr(Workspace, "keep", kept)
    shards = partition.quadtree(frame(spark, edges), 60, 256).collect()
    assert read.value == len(edges)
    want = {}
    for a, b in edges:
        want[a // 256, b // 256] = want.get((a // 256, b // 256), 0) + 1
    assert {(r.gr, r.gc, r.depth, r.sr, r.sc): r.edges for r in shards} == {(*g, 0, 0, 0): n for g, n in want.items()}


@pytest.mark.parametrize("strategy", ["oriented", "hash", "bitmap", "grid"])
def test_counts_move_lists_not_wedges(spark, strategy, monkeypatch):
    """A wheel of hubs has far more wedges than edges; rows dealt to jobs are lists, a few for each vertex."""
    edges = [(100 + v, h) for v in range(200) for h in range(40)] + [(a, b) for a in range(40) for b in range(a)]
    rows = []
    deal = closing.deal
    monkeypatch.setattr(closing, "deal", lambda *a, **k: (out := deal(*a, **k), rows.append(out.count()))[0])
    assert triangles.count(frame(spark, edges), strategy, width=16).first()[0] == 200 * 780 + 9880
    p, q = closing.shape(len(edges), spark.sparkContext.defaultParallelism)
    assert rows[0] <= 240 * (p + q)


@pytest.mark.parametrize("probe", ["sorted", "hash", "bits"])
def test_ways_to_look_up_agree(spark, probe, monkeypatch):
    monkeypatch.setattr(closing, "PROBES", 50)
    rng = random.Random(9)
    edges = sorted({tuple(sorted((rng.randrange(3000) ** 2 * 5, rng.randrange(3000) ** 2 * 5), reverse=True)) for _ in range(40_000)} | {(a * 5, b * 5) for a in range(60) for b in range(a)})
    edges = [(a, b) for a, b in edges if a != b]
    have, out = set(edges), {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    want = sum((b, c) in have for own in out.values() for b in own for c in own if c < b)
    rows = [(a, np.array(sorted(x))) for a, x in out.items()]
    whole = (np.array([a for a, _ in rows]), np.array([len(x) for _, x in rows]), np.concatenate([x for _, x in rows]), None)
    held = closing._Held([whole], probe)
    assert held.probe == probe and want > 30_000
    assert sum(len(f[0]) for f in closing._paired(held, whole, False)) == want


def test_job_triples_are_not_written(spark, monkeypatch):
    """As many triples as the cube of the side stream out of the tasks; what is written or dealt is cells."""
    seen = []
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name, *a: (seen.append(name), keep(self, df, name, *a))[1])
    cells = [(a, b) for a in range(30) for b in range(a + 1) if (a * b) % 5 != 1]
    shards = spark.createDataFrame([(a >> 2, b >> 2, 2, a & 3, b & 3) for a, b in cells], "gr long, gc long, depth int, sr long, sc long")
    have = set(cells)
    want = {(a, b, c) for a, b in cells for c in range(b + 1) if (a, c) in have and (b, c) in have}
    at = lambda g, s: g * 4 + s
    got = [(at(r.g1.gr, r.g1.sr), at(r.g0.gr, r.g0.sr), at(r.g0.gc, r.g0.sc)) for r in partition.shard_jobs(shards).collect()]
    assert len(got) == len(want) and set(got) == want
    assert "triples" not in seen and "pairs" not in seen


def test_many_slices_are_encoded_at_once():
    rng = random.Random(2)
    slices = [sorted({(rng.randrange(5), rng.randrange(9)) for _ in range(rng.randrange(1, 12))}) for _ in range(40)]
    r, c = (np.array([e[i] for s in slices for e in s]) for i in (0, 1))
    start = np.cumsum([0, *map(len, slices)])[:-1]
    made = formats._compressed_slices(r, c, start)
    for k, own in enumerate(slices):
        want = formats._compressed(*(np.array([e[i] for e in own]) for i in (0, 1)))
        for x, (numbers, counts) in made.items():
            at = int(counts[:k].sum())
            assert numbers[at : at + counts[k]].tolist() == want[x].tolist()
    assert [len(b) // 4 for b in formats._contents(*made["row"]).to_pylist()] == made["row"][1].tolist()


def test_metadata_goes_in_documents_of_bounded_length(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(formats, "DOCUMENT_GRIDS", 10, raising=False)
    edges = [(a, b) for a in range(25) for b in range(a)]
    formats.write_metadata(formats.metadata(frame(spark, edges), "sample", 2), str(tmp_path / "meta"))
    rows = formats.read_metadata(spark, str(tmp_path / "meta")).collect()
    assert len(rows) > 3 and max(len(r.grid) for r in rows) < 40
    assert {(r.dataname, r.info["count"]["row"], r.info.max_vid) for r in rows} == {("sample", 13, 24)}
    assert sorted(g.name for r in rows for g in r.grid) == sorted({f"{a // 2}-{b // 2}" for a, b in edges})


def test_jobs_fill_the_cores_with_few_copies_of_a_list():
    for cores in (1, 2, 7, 8, 12, 100):
        for edges in (0, 10**6, 10**8, 432 * 10**6):
            p, q = closing.shape(edges, cores)
            assert p * closing.HELD >= edges and p * q >= cores
            assert -(-p * q // cores) * cores <= (1 + closing.IDLE) * p * q
    assert sum(closing.shape(72 * 10**6, 12)) == 7


def test_normalised_edges_are_not_grouped_again(spark, monkeypatch):
    """The queries' edges are normalised when they are made: counting writes them as they come."""
    monkeypatch.setattr(graph, "normalize", lambda *a: pytest.fail("normalised again"))
    e = frame(spark, [(a, b) for a in range(12) for b in range(a)])
    assert triangles.count(e, "oriented", simple=True).first()[0] == 220
    assert triangles.per_grid_triple(e, 4, simple=True).agg(F.sum("triangles")).first()[0] == 220
    assert triangles.per_slice_triple(e, 5, 4, simple=True).agg(F.sum("triangles")).first()[0] == 220
    shards = partition.quadtree(e, 10, 16)
    assert triangles.per_job(e, shards, 16, simple=True).agg(F.sum("triangles")).first()[0] == 220


def test_labels_dealt_are_ints(spark, monkeypatch):
    kinds = []
    deal = closing.deal
    monkeypatch.setattr(closing, "deal", lambda lists, *a, **k: (kinds.append(lists.schema["label"].dataType.elementType.simpleString()), deal(lists, *a, **k))[1])
    e = frame(spark, [(a, b) for a in range(12) for b in range(a)])
    assert triangles.per_job(e, partition.quadtree(e, 10, 16), 16).agg(F.sum("triangles")).first()[0] == 220
    assert triangles.per_slice_triple(e, 5, 4).agg(F.sum("triangles")).first()[0] == 220
    assert kinds == ["int", "int"]


def partitions(spark, df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_tasks_of_gaps_lists_and_chunks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 50)
    e = frame(spark, [(a, b) for a in range(60) for b in range(a)])
    assert partitions(spark, graph.adjacent_gaps(e, 40)) > 8
    assert partitions(spark, partition.adjacency(e, 8, 40)) > 8
    assert partitions(spark, partition.csr_chunks(e, 5, 8, 40)) > 8
    seen = []
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name, *a: (seen.append(partitions(spark, df)), keep(self, df, name, *a))[1])
    partition.csr_rows(e, 8, 40)
    assert seen[0] > 8


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_rows_of_a_grid_are_ordered_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    monkeypatch.setattr(partition, "ROW_CHUNK", chunk, raising=False)
    edges = sorted({(a, b) for a in range(100) for b in range(a) if (a * 7 + b) % 5 == 0})
    want, at = [], {}
    for a, g in sorted({(a, b // 32) for a, b in edges}):
        n, start = sum(x == a and y // 32 == g for x, y in edges), at.get((a // 32, g), 0)
        want.append((a // 32, g, a % 32, start, start + n))
        at[a // 32, g] = start + n
    rows = partition.csr_rows(frame(spark, edges), 32)
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert chunk > 4 or partitions(spark, rows) > 8


def test_runs_of_a_scan_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 50)
    ws = Workspace(spark)
    rows = ws.keep(spark.range(1000).selectExpr("id * 7919 % 1000 AS x"), "rows")
    found = scans.indexed(rows, ["x"], ws, "runs").collect()
    assert all(r["x"] == r["index"] for r in found) and len(found) == 1000
    assert spark.read.parquet(ws.path("runs")).select("__run").distinct().count() > 8


def test_items_of_a_group_are_paired_without_a_join(spark):
    """A task sorts its rows once: no join of the table with itself, and one pass over the table's rows."""
    rows = [(1, 5), (1, 3), (1, 5), (1, 9), (2, 5), (2, 3), (3, 7), (4, None), (None, 1), (None, 2), (5, -4), (5, 2), *((6, v % 70) for v in range(300))]
    e = graph.co_occurrence(spark.createDataFrame(rows, "g long, v long"), "g", "v")
    want = {(5, 3), (9, 3), (9, 5), (2, -4)} | {(a, b) for a in range(70) for b in range(a)}
    got = list(map(tuple, e.collect()))
    assert len(got) == len(want) and set(got) == want
    plan = e._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(g") == 1
