"""From adjacency records to shard files and back; file listings; slices as shards."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from trigrid import formats, graph, partition, triangles


def edges(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(900)] + [(0, 89), (0, 89), (5, 5)]
    return spark.createDataFrame(pairs, "src long, dst long")


def test_adj6_to_shard_files_and_back(spark, tmp_path):
    raw = formats.read_adj6(formats.write_adj6(edges(spark)))
    for relabel in (None, *graph.RELABELINGS):
        want = graph.relabelled(edges(spark), relabel) if relabel else graph.normalize(edges(spark))
        written = formats.convert(raw, 40, 64, relabel)
        assert sorted(formats.read_csr(written, 64).collect()) == sorted(want.collect())
    (tmp_path / "inner").mkdir()
    formats.write_files(written, str(tmp_path / "inner"))
    listed = formats.listing(spark, str(tmp_path), "*-*")
    cat = formats.file_catalogue(listed, 64)
    assert cat.agg(F.sum("edges")).first()[0] == want.count()
    shards = partition.quadtree(want, 40, 64)
    assert sorted(cat.select(*shards.columns).collect()) == sorted(shards.collect())
    assert formats.listing(spark, str(tmp_path / "inner"), "*.row", over=8).where("length <= 8").count() == 0


def test_convert_nothing(spark):
    written = formats.convert(spark.createDataFrame([], "src long, dst long"), 10, 16)
    assert written.count() == 0 and formats.read_csr(written, 16).count() == 0


def test_file_catalogue_leaves_out_incomplete_shards(spark):
    listed = spark.createDataFrame([("0-0.row", 8), ("0-0.col", 20), ("1-0.row", 4), ("x.col", 4)], "name string, length long")
    assert [(r.gr, r.gc, r.n_rows, r.edges) for r in formats.file_catalogue(listed, 16).collect()] == [(0, 0, 2, 5)]


def test_slices_count_every_triangle_once(spark):
    e = graph.normalize(edges(spark))
    counted = triangles.per_slice_triple(e, 7, 16)
    assert counted.agg(F.sum("triangles")).first()[0] == triangles.count(e).first()[0]
    jobs = partition.slice_jobs(partition.linear_slices(e, 7, 16))
    assert counted.join(jobs, ["g0", "g1", "g2"], "left_anti").count() == 0


def test_slice_names(spark):
    named = partition.slice_name(spark.createDataFrame([(2, 1, 7)], "gr long, gc long, slice long")).select("stem")
    odd = named.union(spark.createDataFrame([("2-1",)], "stem string"))
    assert [tuple(r) for r in partition.parse_slice_name(odd).collect()] == [("2-1,7", 2, 1, 7)]
