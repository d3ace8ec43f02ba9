"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _star(edges: DataFrame, large: bool, ws: Workspace, name: str) -> DataFrame:
    """One contraction step on edges (u, v), written. Large: every node links its larger neighbours to the
    smallest of itself and its neighbours. Small: it links its smaller neighbours and itself to it.
    The smallest are written before they join back: a join with a plain scan on both sides is one whose hot
    nodes (the middle of a large group) adaptive execution splits; one with an aggregate is not."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = ws.keep(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low")
    joined = near.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    out = ws.keep(out.where("u <> v").distinct(), name)
    ws.drop(f"{name}-low")
    return out


def components(edges: DataFrame, ws: Workspace, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v longs, any direction, repeats allowed);
    component is the smallest node reachable. Each round is a pair of aggregations and joins on the
    node, written to the shared folder; rounds grow with the logarithm of the diameter."""
    now = ws.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen = None
    for k in range(1, max_rounds + 1):
        now = _star(_star(now, True, ws, f"{name}-{k}-large"), False, ws, f"{name}-{k}")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        ws.drop(f"{name}-{k - 1}", f"{name}-{k}-large")
        if seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
