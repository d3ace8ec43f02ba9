"""Recall of the pivot lists by number of pivots, and components and counts against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigrid.llm import embedding
from trigrid.llm.common import Workspace


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("n_pivots", "least"), [(64, 0.995), (256, 0.99), (1024, 0.97), (4096, 0.94)])
@pytest.mark.parametrize("size", [16, 64, 768])
def test_recall_at_the_threshold(n_pivots, least, size):
    """Random pairs at a cosine of exactly 0.9 among random pivots."""
    rng = np.random.default_rng(n_pivots + size)
    pivots = unit(rng.normal(size=(n_pivots, size)))
    a = unit(rng.normal(size=(1200, size)))
    e = rng.normal(size=a.shape)
    e = unit(e - (e * a).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * e
    x, y = (embedding.list_keys(embedding.nearest(v, pivots), size) for v in (a, b))
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() >= least


def components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(linked[i, :i]).tolist():
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while root[i] != i:
            i = root[i]
        out.append(i)
    return out


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_tight_groups_exactly(spark, kind):
    """One group of a third of all rows (more than a block), smaller ones, chains, copies, other lengths."""
    rng = np.random.default_rng(5)
    rows = [rng.normal(size=24) for _ in range(900)]
    hot = rng.normal(size=24)
    rows += [hot + rng.normal(size=24) * 0.04 for _ in range(700)]
    for _ in range(60):
        at = rng.normal(size=24)
        for _ in range(6):
            rows.append(at)
            at = at + rng.normal(size=24) * 0.1
    rows += rows[100:140]
    rng.shuffle(rows)
    m = np.array(rows, dtype=np.float32 if kind == "array<float>" else np.float64).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"vec_id long, embedding {kind}").withColumns({"near": F.lit(1), "key": F.lit("clash")})
    got = {r.vec_id: r for r in embedding.near_vectors(df, Workspace(spark)).collect()}
    u = unit(m)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    links = np.array([got[i].n_links for i in range(len(m))])
    assert (links <= linked.sum(1)).all() and links.sum() >= 0.995 * linked.sum()
    assert [got[i].component_id for i in range(len(m))] == components(len(m), linked)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(m)))
