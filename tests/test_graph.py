"""Closed-form graphs, invariances, partition rules, and all queries against their SQL twins."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trigrid import graph, partition, primitives, queries, triangles

SMALL = "/root/testdata/sf0.001"
STRATEGIES = ("hash", "oriented", "intersect", "bitmap", "edge_iterator", "grid", "sharded")


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def count(e, strategy="hash", **options):
    return triangles.count(e, strategy, **options).first()["triangles"]


def complete(n):
    return itertools.combinations(range(n), 2)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_closed_forms(spark, strategy):
    wheel = [(0, i) for i in range(1, 8)] + [(i, i % 7 + 1) for i in range(1, 8)]
    two_k4 = {tuple(sorted(p)) for g in ((0, 1, 2, 3), (2, 3, 4, 5)) for p in itertools.combinations(g, 2)}
    cases = [(list(complete(9)), math.comb(9, 3)), ([(i, i + 1) for i in range(9)], 0), (wheel, 7), (list(two_k4), 8), ([], 0), ([(4, 4)], 0), ([(a, b) for a in range(4) for b in range(4, 9)], 0)]
    for edges, want in cases:
        assert count(graph.normalize(frame(spark, edges)), strategy, width=4, depth=1) == want


def test_count_is_invariant(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(500)]
    e = frame(spark, edges)
    want = count(graph.normalize(e))
    flipped = frame(spark, [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges + edges[:100] + [(7, 7)] * 5])
    assert count(graph.normalize(flipped)) == want
    for kind in graph.RELABELINGS:
        assert count(graph.relabelled(e, kind)) == want
    once = graph.normalize(e)
    assert sorted(graph.normalize(once).collect()) == sorted(once.collect())
    for width in (7, 16, 1 << 24):
        assert triangles.per_grid_triple(once, width).agg(F.sum("triangles")).first()[0] == want


def test_shards_whose_edges_all_lie_in_an_upper_half(spark):
    low, mid, high = range(0, 40), range(600, 680), range(1200, 1260)
    edges = [(a, b) for b, a in itertools.combinations(mid, 2)] + [(a, b) for a in high for b in mid] + [(a, b) for a in high for b in low]
    e = frame(spark, edges)
    assert count(e) == 271_760
    for limit in (2000, 4000):
        shards = partition.quadtree(e, limit, 2048)
        assert shards.agg(F.sum("edges")).first()[0] == len(edges)
        assert triangles.per_job(e, shards, 2048).agg(F.sum("triangles")).first()[0] == 271_760
        jobs = partition.shard_jobs(partition.catalogue(shards, 2048))
        counted = triangles.per_job(e, shards, 2048)
        assert counted.join(jobs, ["g0", "g1", "g2"], "left_anti").count() == 0


def test_degree_ties_across_grids_and_last_row(spark):
    tie = frame(spark, [(3, 13), (13, 23), (23, 3)])
    assert graph.orient_by_degree(tie).count() == 3 and count(tie, "oriented") == 1
    last = graph.normalize(frame(spark, [(20, 21), (21, 22), (20, 22)]))
    rows = triangles.per_grid_triple(last, 10).collect()
    assert [tuple(r) for r in rows] == [(2, 2, 2, 1)]


def test_degrees_and_relabelling(spark):
    e = frame(spark, [(0, 1), (0, 1), (2, 2), (1, 3)])
    assert {r.vid: r.degree for r in graph.complete_degrees(e, 5).collect()} == {0: 2, 1: 3, 2: 0, 3: 1, 4: 0, 5: 0}
    asc = {r.vid: r.new_vid for r in graph.relabel_table(graph.complete_degrees(e, 5), "asc").collect()}
    desc = {r.vid: r.new_vid for r in graph.relabel_table(graph.complete_degrees(e, 5), "desc").collect()}
    assert asc == {3: 0, 0: 1, 1: 2, 2: 3, 4: 4, 5: 5} and desc == {1: 0, 0: 1, 3: 2, 5: 3, 4: 4, 2: 5}
    with pytest.raises(ValueError):
        graph.relabel_table(graph.complete_degrees(e), "other")


def test_csr_arrays(spark):
    e = graph.normalize(graph.from_adjacency(spark.createDataFrame([(2, [0, 1]), (1, [0])], "src long, dst array<long>")))
    r = partition.csr_arrays(e, 16).first()
    assert (r.row, r.ptr, r.col) == ([1, 2], [0, 1, 3], [0, 0, 1])
    assert count(e) == 1


def test_shard_names_round_trip(spark):
    shards = spark.createDataFrame([(1, 0, 0, 0, 0, 5), (3, 2, 2, 1, 3, 7)], "gr long, gc long, depth int, sr long, sc long, edges long")
    named = partition.shard_name(shards)
    assert sorted(r.stem for r in named.collect()) == ["1-0", "3-2,2,1-3"]
    back = partition.parse_shard_name(named.select("stem"))
    assert sorted(tuple(r)[1:] for r in back.collect()) == [(1, 0, 0, 0, 0), (3, 2, 2, 1, 3)]


def test_primitives(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, "b")], "k long, i long, v string")
    assert [r.v for r in primitives.unique_consecutive(df, "v", ["i"], ["k"]).orderBy("i").collect()] == ["a", None, "b"]
    yes, no = primitives.partition_flagged(df, "v = 'a'")
    assert (yes.count(), no.count()) == (2, 2) and primitives.select_flagged(df, "i > 1").count() == 2


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).first()["triangles"] == 125_968
    assert set(entry.oracle_sql()) <= set(entry.queries())
