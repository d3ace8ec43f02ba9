"""The table of counting jobs: one row per shard triple, filled with results as they come in.

Jobs carry the shards of their three edges as structs g0, g1 and g2 (gr, gc, depth, sr, sc).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partition, triangles
from .storage import Workspace

WAITING, FINISHED = "WAIT", "FINISH"
_TRIPLE = ["g0", "g1", "g2"]


def job_table(shards: DataFrame) -> DataFrame:
    """Jobs of a shard catalogue, none of them done."""
    return partition.shard_jobs(shards).withColumns({"state": F.lit(WAITING), "triangles": F.lit(None).cast("long")})


def record_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``jobs`` with the counts of ``results`` (g0, g1, g2, triangles) entered; a later result of a job
    replaces an earlier one, and jobs without a result stay as they are."""
    new = results.select(*_TRIPLE, F.col("triangles").alias("found"))
    done = F.col("found").isNotNull()
    return jobs.join(new, _TRIPLE, "left").select(
        *_TRIPLE, F.when(done, F.lit(FINISHED)).otherwise(F.col("state")).alias("state"), F.when(done, F.col("found")).otherwise(F.col("triangles")).alias("triangles")
    )


def waiting(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state") == WAITING)


def finish(e: DataFrame, shards: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """The finished job table of normalised edges: every triple of the catalogue with its count, zero
    where no triangle lies in it."""
    ws = Workspace(e.sparkSession)
    shards = ws.keep(shards.select("gr", "gc", "depth", "sr", "sc"), "catalogue")
    depth = partition.one_depth(shards)
    if depth is not None and width >> depth << depth == width:
        # Jobs stream out of the tasks that make them, which hold the counts: a job table is far longer than its counts.
        counts = triangles.per_shard_triple(e, depth, width).select(F.col("v_shard").alias("a"), F.col("u_shard").alias("b"), F.col("w_shard").alias("c"), F.col("triangles").alias("n"))
        return partition.shard_jobs(shards, counts, depth).select(*_TRIPLE, F.lit(FINISHED).alias("state"), F.col("n").alias("triangles"))
    jobs = job_table(shards)
    counts = triangles.per_job(e, shards, width)
    return record_results(jobs, jobs.select(*_TRIPLE).join(counts, _TRIPLE, "left").fillna({"triangles": 0}))


def create_views(e: DataFrame, limit: int, width: int = partition.WIDTH, prefix: str = "") -> None:
    """Temporary views ``edges``, ``grids``, ``shards``, ``jobs`` and ``results`` for queries in SQL."""
    shards = partition.catalogue(partition.quadtree(e, limit, width), width)
    views = {
        "edges": partition.with_grid(e, width),
        "grids": partition.with_grid(e, width).groupBy("gr", "gc").agg(F.count("*").alias("edges")),
        "shards": shards,
        "jobs": job_table(shards),
        "results": triangles.per_job(e, shards, width),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
