"""Few, alike and many pivots: results and recall against brute force, and memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trigrid.llm import embedding
from trigrid.llm.common import Workspace


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(m):
    u = unit(m)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    return linked


def links(spark, m):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding.near_vectors(df, Workspace(spark)).collect()}
    return np.array([got[i].n_links for i in range(len(m))]), [got[i].component_id for i in range(len(m))]


def shared_mean(rng, n, size, weight):
    return unit(rng.normal(size=(n, size))) + weight * unit(rng.normal(size=(1, size)))


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("one", [[1.0, 2.0]]), ("two alike", [[1.0, 2.0], [1.0, 2.1]]), ("two apart", [[1.0, 0.0], [0.0, 1.0]]),
        ("one dimension", [[1.0], [2.0], [-3.0], [-1.0], [5.0]]), ("same direction", [[float(k), 2.0 * k] for k in range(1, 9)]),
    ],
)
def test_few_vectors(spark, name, rows):
    m = np.array(rows)
    n, component = links(spark, m)
    want = brute(m)
    assert n.tolist() == want.sum(1).tolist()
    assert component == [min([i, *np.flatnonzero(want[i]).tolist()]) for i in range(len(m))]


@pytest.mark.parametrize("weight", [0.5, 1.0, 1.5, 4.0])
def test_vectors_with_a_common_mean(spark, weight):
    rng = np.random.default_rng(3)
    m = np.concatenate([c + 0.25 * unit(rng.normal(size=(4, 32))) for c in shared_mean(rng, 75, 32, weight)])
    n, _ = links(spark, m)
    want = brute(m).sum(1)
    assert (n <= want).all() and n.sum() >= 0.9 * want.sum() > 0


@pytest.mark.parametrize("weight", [0.0, 0.7, 1.2])
def test_recall_of_fitted_lists_on_clusters(weight):
    rng = np.random.default_rng(7)
    centres = shared_mean(rng, 500, 64, weight)
    m = unit(np.concatenate([c + 0.3 * unit(rng.normal(size=(4, 64))) for c in centres]))
    index = embedding.fit(list(m[rng.permutation(len(m))][:512]), 256)
    keys = embedding.list_keys(embedding.nearest(m, unit(np.array(index.pivots)), index.nearest), 64, index.rank_sum)
    i, j = np.nonzero(np.triu(m @ m.T >= 0.9, 1))
    met = [bool(np.intersect1d(keys[a], keys[b]).size) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(met) > 300 and np.mean(met) >= 0.9


def test_memory_with_many_pivots():
    rng = np.random.default_rng(1)
    pivots = list(rng.normal(size=(4096, 64)))
    vec = rng.normal(size=(10_000, 64))
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(10_000)), "vec": pa.array(list(vec), pa.list_(pa.float64()))})
    tracemalloc.start()
    described = sum(b.num_rows for b in embedding._describe([batch], embedding.PivotIndex(pivots)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert described == 10_000 and peak < 200e6
