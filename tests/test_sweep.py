"""Sweeps with resume, and the job table against counts made without it."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trigrid import graph, jobs, partition, sweep, triangles


def random_edges(spark, n, m, seed=5):
    rng = random.Random(seed)
    return graph.normalize(spark.createDataFrame([(rng.randrange(n), rng.randrange(n)) for _ in range(m)], "src long, dst long"))


def test_sweep_resumes(spark, tmp_path):
    log = str(tmp_path / "log")
    edges = {"k6": list(itertools.combinations(range(6), 2)), "path": [(0, 1), (1, 2)]}
    loaded = []

    def load(spark, dataset):
        loaded.append(dataset)
        if len(loaded) == 3:
            raise RuntimeError("broken off")
        return graph.normalize(spark.createDataFrame(edges[dataset], "src long, dst long"))

    wanted = sweep.settings(spark, edges, ("oriented", "sharded"), widths=(4,), depths=(1,), partitions=(2,))
    assert wanted.count() == 4 and sweep.read_log(spark, log).count() == 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError):
        sweep.run(spark, wanted, log, load)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(r.dataset for r in sweep.pending(wanted, sweep.read_log(spark, log)).collect()) == ["path", "path"]
    done = sweep.run(spark, wanted.union(wanted), log, load)
    assert loaded == ["k6", "k6", "path", "path", "path"]
    assert {(r.dataset, r.strategy, r.triangles) for r in done.collect()} == {("k6", "oriented", 20), ("k6", "sharded", 20), ("path", "oriented", 0), ("path", "sharded", 0)}
    assert done.count() == 4 and sweep.disagreements(done).count() == 0
    sweep.run(spark, wanted, log, load)
    assert len(loaded) == 5
    best = {r.dataset: r for r in sweep.fastest(done).collect()}
    assert best["k6"].triangles == 20 and best["k6"].seconds == done.where("dataset = 'k6'").agg(F.min("seconds")).first()[0]
    wrong = done.union(done.limit(1).withColumn("triangles", F.col("triangles") + 1))
    assert sweep.disagreements(wrong).count() == 1


def test_finished_jobs_cover_all_triangles(spark):
    e = random_edges(spark, 60, 700)
    shards = partition.catalogue(partition.quadtree(e, 40, 16), 16)
    table = jobs.finish(e, shards, 16)
    assert table.agg(F.sum("triangles")).first()[0] == triangles.count(e).first()[0]
    assert jobs.waiting(table).count() == 0 and table.count() == partition.shard_jobs(shards).count()


def test_results_enter_the_job_table_as_they_come(spark):
    e = random_edges(spark, 30, 200)
    shards = partition.catalogue(partition.quadtree(e, 40, 16), 16)
    table, counts = jobs.job_table(shards), triangles.per_job(e, shards, 16)
    one = counts.orderBy(F.desc("triangles"), "g0", "g1", "g2").limit(1)
    some = jobs.record_results(table, one)
    assert some.where("state = 'FINISH'").count() == 1 and jobs.waiting(some).count() == table.count() - 1
    again = jobs.record_results(some, one.withColumn("triangles", F.lit(7).cast("long")))
    assert [r.triangles for r in again.where("state = 'FINISH'").collect()] == [7]


def test_views_answer_in_sql(spark):
    e = random_edges(spark, 30, 200)
    jobs.create_views(e, 40, 16, prefix="t_")
    want = triangles.count(e).first()[0]
    assert spark.sql("SELECT sum(triangles) FROM t_results").first()[0] == want
    assert spark.sql("SELECT sum(edges) FROM t_shards").first()[0] == spark.sql("SELECT sum(edges) FROM t_grids").first()[0] == spark.sql("SELECT count(*) FROM t_edges").first()[0]
    assert spark.sql("SELECT count(*) FROM t_results r LEFT ANTI JOIN t_jobs j USING (g0, g1, g2)").first()[0] == 0


def test_no_edges_no_jobs(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert jobs.finish(e, partition.catalogue(partition.quadtree(e, 40, 16), 16), 16).count() == 0
