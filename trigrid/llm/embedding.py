"""Near-duplicate vectors by a pivot-permutation index.

Pivots are rows of the table itself, taken from a bounded sample so that no two are alike (:func:`spread_out`). A vector is described by its twelve nearest pivots
(more where vectors are alike on the whole, see :func:`fit`) in order, the prefix of its pivot permutation. Inverted lists hold the vectors under every two of those
whose ranks sum to at most ``RANK_SUM``: two vectors meet when they share two pivots that are near to both
of them, the nearer the one, the farther may be the other. The number of pivots follows the square root of
the number of vectors between bounds, so lists stay short as the table grows. Equal arrays collapse into one class first.

1. Lists carry ids, pivots and vectors rounded to a byte a component. Long lists are dealt out as pairs of bounded
   blocks, and a task finds the members that have a likely partner: the rounded cosine is below the
   threshold by no more than rounding can take off, so no pair found is lost.
2. Only those members get their whole vectors, and the cosine is computed exactly, in double precision. A pair that
   meets in several lists counts in one: that of its lowest common key. Tasks return link counts and spanning
   links, not pairs.

Recall against brute force, random pairs at a cosine of exactly 0.9 (the hardest; more above it), least of 16, 64 and 768
dimensions: 1.0 with 64 pivots, 0.999 with 256, 0.989 with 1024, 0.961 with 4096 (``tests/llm/test_vector_recall.py`` measures
it). Links reported are exact: none lies below the threshold.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; a null vec_id links with nothing and is kept; rows that share a
vec_id are one node for components, and each counts as a vector; fully repeated rows and equal vectors are linked with
each other; vectors of any length are compared whole; ties among pivots go to the earlier one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lower_keys, runs
from .components import components

THRESHOLD = 0.9
NEAREST, RANK_SUM = 12, 11
#: Near pivots and rank sums that are tried in turn, and the share of pairs at the threshold that must meet (on ``PROBES`` of the sample).
WIDENING = [(NEAREST, RANK_SUM), (16, 20), (24, 40)]
LEAST_RECALL, PROBES = 0.95, 512
MIN_PIVOTS, MAX_PIVOTS = 64, 4096
#: Rows sampled for a pivot, and the cosines from which two are too alike to be both: the first that leaves enough.
CANDIDATES, ALIKE = 2, (0.8, 0.9, 0.95, 0.98, 0.99, 0.999)
BLOCK = 512
#: Vectors described at a time: against all pivots, so this bounds memory.
DESCRIBED = 256


def pivot_count(n: int) -> int:
    """About the square root of the number of vectors, a power of two between bounds."""
    k = MIN_PIVOTS
    while k < MAX_PIVOTS and k * k < n:
        k *= 2
    return k


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
        return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _apart(sample: list[np.ndarray], n: int, alike: float) -> list[np.ndarray]:
    """Up to ``n`` of the sample, in its order, no two with a cosine of ``alike`` or more."""
    chosen: list[np.ndarray] = []
    kept: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for v in sample:
        d = len(v)
        unit = _unit(v[None, :])[0]
        rows = kept.setdefault(d, np.empty((n, d)))
        k = count.get(d, 0)
        if not k or (rows[:k] @ unit).max() < alike:
            rows[k], count[d] = unit, k + 1
            chosen.append(v)
            if len(chosen) == n:
                break
    return chosen


def spread_out(sample: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Up to ``n`` of the sample as pivots, no two very alike. A large group of alike
    vectors has as many rows in a sample as its share; were they all pivots, they alone would be the nearest
    of its members, in an order that says nothing. Where the whole sample is alike (vectors with a common mean) the bound gives way
    step by step; two rows are pivots whatever they are."""
    chosen: list[np.ndarray] = []
    for alike in ALIKE:
        chosen = max(chosen, _apart(sample, n, alike), key=len)
        if len(chosen) >= min(n, len(sample), MIN_PIVOTS):
            break
    return chosen if len(chosen) > 1 else sample[:2]


@dataclasses.dataclass
class PivotIndex:
    """Pivots, and how many of a vector's nearest ones make list keys, by pairs whose ranks sum to ``rank_sum`` at most."""

    pivots: list[np.ndarray]
    nearest: int = NEAREST
    rank_sum: int = RANK_SUM


def _probes(units: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold, the hardest to find: each vector and one moved from it towards another of the sample (as far as that goes),
    and each and one moved in a random direction."""
    rng = np.random.default_rng(len(units))
    other, noise = units[rng.permutation(len(units))], rng.normal(size=units.shape)
    alike = np.maximum(threshold, (other * units).sum(axis=1, keepdims=True))
    for aim, cosine in ((other, alike), (noise, np.full_like(alike, threshold))):
        side = np.nan_to_num(_unit(aim - (aim * units).sum(axis=1, keepdims=True) * units))
        yield units, np.nan_to_num(_unit(cosine * units + np.sqrt(np.maximum(0, 1 - cosine * cosine)) * side))


def fit(sample: list[np.ndarray], n: int, threshold: float = THRESHOLD) -> PivotIndex:
    """The index with the shortest lists that meets ``LEAST_RECALL`` on pairs made from the sample: ``n`` pivots and few near ones at first,
    then more near ones, then fewer pivots, down to two, which put all vectors in one list."""
    sizes = [len(v) for v in sample]
    d = max(set(sizes), key=sizes.count) if sizes else 0
    units = np.nan_to_num(_unit(np.array([v for v in sample if len(v) == d][:PROBES]))) if d else np.zeros((0, 0))
    while True:
        pivots = spread_out(sample, n)
        if len(pivots) <= 2 or not len(units):
            return PivotIndex(pivots)
        fitted = np.nan_to_num(_unit(np.array([np.resize(p, d) for p in pivots])))
        for near, rank_sum in WIDENING:
            recall = []
            for x, y in _probes(units, threshold):
                a, b = (list_keys(nearest(v, fitted, near), d, rank_sum) for v in (x, y))
                recall.append(np.mean([bool(np.intersect1d(i, j).size) for i, j in zip(a, b, strict=True)]))
            if min(recall) >= LEAST_RECALL:
                return PivotIndex(pivots, near, rank_sum)
        n = max(2, min(n, len(pivots)) // 4)


def nearest(rows: np.ndarray, pivots: np.ndarray, n: int = NEAREST) -> np.ndarray:
    """The ids of each unit vector's nearest pivots, the nearest first."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int16)


def list_keys(near: np.ndarray, size: int, rank_sum: int = RANK_SUM) -> np.ndarray:
    """The keys of the lists that hold vectors of ``size`` components with these nearest pivots."""
    near = near.astype(np.int64)
    two = [(i, j) for i, j in itertools.combinations(range(near.shape[1]), 2) if i + j <= rank_sum]
    if not two:
        return np.zeros((len(near), 0), dtype=np.int64)
    i, j = (np.array(x) for x in zip(*two, strict=True))
    low, high = np.minimum(near[:, i], near[:, j]), np.maximum(near[:, i], near[:, j])
    return size * MAX_PIVOTS**2 + low * MAX_PIVOTS + high


def _describe(batches: Iterable[pa.RecordBatch], index: PivotIndex) -> Iterator[pa.RecordBatch]:
    """Nearest pivots, list keys, and the unit vector in steps of ``step``, a byte each, of every vector."""
    fitted: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column("vec")
        sizes = np.asarray(column.value_lengths())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(sizes)
        for d in np.unique(sizes).tolist():
            if d not in fitted:
                fitted[d] = np.nan_to_num(_unit(np.array([np.resize(p, d) for p in index.pivots])))
            every = np.flatnonzero(sizes == d)
            for at in np.split(every, range(DESCRIBED, len(every), DESCRIBED)):
                rows = _unit(flat[(ends[at] - d)[:, None] + np.arange(d)])
                near = nearest(rows, fitted[d], index.nearest)
                step = np.abs(rows).max(axis=1) / 127
                rounded = np.rint(rows / step[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column("node").take(pa.array(at)), "near": pa.array([r.tobytes() for r in near], pa.binary()), "step": pa.array(step),
                    "rounded": pa.array([r.tobytes() for r in rounded], pa.binary()), "keys": pa.array(list(list_keys(near, d, index.rank_sum)), pa.list_(pa.int64())),
                })


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, np.ndarray, np.ndarray]]:
    """Each block pair of batches sorted by (key, bi, bj): its table, key, size of vectors, and its rows of both blocks."""
    for table in runs(batches, ["key", "bi", "bj"]):
        key, bi, bj, block = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "block"))
        new = (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        for a, b in itertools.pairwise(np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)])).tolist()):
            left = np.flatnonzero(block[a:b] == bi[a])
            right = left if bi[a] == bj[a] else np.flatnonzero(block[a:b] == bj[a])
            if len(left) and len(right):
                yield table.slice(a, b - a).combine_chunks(), int(key[a]), int(key[a] // MAX_PIVOTS**2), left, right


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1)


def _owned(linked: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, size: int, key: int, rank_sum: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of linked pairs (left by right) those without a common key below this one, by row."""
    if left is right:
        linked = np.triu(linked, 1)
    rows = np.flatnonzero(linked.any(axis=1))
    if not len(rows):
        return
    keys = list_keys(near, size, rank_sum)
    bits = lower_keys(np.repeat(np.arange(len(keys)), keys.shape[1]), keys.ravel(), len(keys), key)
    for x in rows.tolist():
        i, js = int(left[x]), right[linked[x]]
        js = js[~(bits[js] & bits[i]).any(axis=1)]
        if len(js):
            yield i, js


def _flag(batches: Iterable[pa.RecordBatch], threshold: float, rank_sum: int) -> Iterator[pa.RecordBatch]:
    """Members of block pairs with a likely partner that no other list has."""
    for table, key, d, left, right in _blocks(batches):
        step, near = table.column("step").to_numpy(), _matrix(table.column("near"), np.int16)
        rounded = _matrix(table.column("rounded"), np.int8).astype(np.float32)
        a, b = step[left][:, None], step[right][None, :]
        # Half a step a component, against unit vectors, and of the products; and what single precision may take.
        slack = np.sqrt(d) / 2 * (a + b) + d / 4 * a * b + 1e-5
        likely = (rounded[left] @ rounded[right].T).astype(np.float64) * a * b >= threshold - slack
        wanted = np.zeros(table.num_rows, dtype=bool)
        for i, js in _owned(likely, left, right, near, d, key, rank_sum):
            wanted[i] = True
            wanted[js] = True
        yield from table.select(["key", "node", "block", "bi", "bj"]).filter(pa.array(wanted)).to_batches()


def _compare(batches: Iterable[pa.RecordBatch], threshold: float, rank_sum: int) -> Iterator[pa.RecordBatch]:
    """For each block pair: (node, null, links) counts and (node, node, null) spanning links."""
    for table, key, d, left, right in _blocks(batches):
        node, size = (table.column(c).to_numpy() for c in ("node", "n"))
        rows = _unit(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
        near = _matrix(table.column("near"), np.int16)
        u, v, counts = [], [], np.zeros(len(node), dtype=np.int64)
        comp = np.arange(len(node))
        for i, js in _owned(rows[left] @ rows[right].T >= threshold, left, right, near, d, key, rank_sum):
            counts[i] += size[js].sum()
            counts[js] += size[i]
            for j in js[comp[js] != comp[i]].tolist():
                if comp[j] != comp[i]:
                    u.append(int(node[i]))
                    v.append(int(node[j]))
                    comp[comp == comp[j]] = comp[i]
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "u": pa.array(np.concatenate((node[at], np.array(u, dtype=np.int64)))),
            "v": pa.array([None] * len(at) + v, pa.int64()),
            "links": pa.array(counts[at].tolist() + [None] * len(u), pa.int64()),
        })


def near_vectors(vectors: DataFrame, ws: Workspace, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    finite = "exists(vec, x -> x <> 0) AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    usable = F.expr(f"coalesce(vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND {finite}, false)")
    hashed = rows.select("vec_id", "vec", usable.alias("usable"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    # Aggregates are written before they join back to what they sum up: adaptive execution splits the hot keys
    # (a third of all rows may be copies, or in one list) of a join of two scans, not those of a join with an aggregate.
    classes = ws.keep(hashed.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    member = ws.keep(hashed.select("vec_id", "usable", "h1", "h2").join(classes, ["h1", "h2"], "left").select("vec_id", F.when(F.col("usable"), F.col("node")).alias("node"), F.when(F.col("usable"), F.col("n")).alias("n")), "member")
    reps = hashed.where("usable").join(classes.withColumn("vec_id", F.col("node")), ["h1", "h2", "vec_id"]).dropDuplicates(["node", "h1", "h2"])
    reps = ws.keep(reps.select("node", "vec", "n"), "reps")

    total = reps.count()
    # A bounded sample, of at most CANDIDATES * MAX_PIVOTS vectors.
    n = pivot_count(total)
    sample = reps.orderBy(F.xxhash64("node"), "node").select("vec").limit(CANDIDATES * n).toArrow()
    index = fit([np.asarray(v.values, dtype=np.float64) for v in sample.column("vec")], n, threshold)
    fitted, rank_sum = spark.sparkContext.broadcast(index), index.rank_sum
    if not total:
        found, links = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "node long, more long")
    else:
        described = reps.select("node", "vec").mapInArrow(lambda it: _describe(it, fitted.value), "node long, near binary, step double, rounded binary, keys array<long>")
        described = ws.keep(described, "described")
        cells = described.select("node", F.explode("keys").alias("key"))
        lists = cells.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        lists = ws.keep(lists.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "lists")
        cells = cells.join(lists, "key")
        cells = cells.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("key", "node", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
        order = ["key", "bi", "bj"]
        dealt = cells.join(described.select("node", "near", "step", "rounded"), "node").repartition(parts, *order).sortWithinPartitions(*order)
        flagged = dealt.mapInArrow(lambda it: _flag(it, threshold, rank_sum), "key long, node long, block int, bi int, bj int")
        flagged = ws.keep(flagged, "flagged")
        facts = reps.join(described.select("node", "near"), "node")
        # Vectors stored as floats travel as floats: nothing is lost, and half is moved.
        single = dict(vectors.dtypes)[vec_col] == "array<float>"
        vec = F.col("vec").cast("array<float>") if single else F.col("vec")
        dealt = flagged.join(facts, "node").select("key", "node", "block", "bi", "bj", "n", "near", vec.alias("vec"))
        dealt = dealt.repartition(parts, *order).sortWithinPartitions(*order)
        out = ws.keep(dealt.mapInArrow(lambda it: _compare(it, threshold, rank_sum), "u long, v long, links long"), "links")
        links = out.where("links IS NOT NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("more"))
        found = ws.keep(components(out.where("v IS NOT NULL").select("u", "v"), ws, "vectors"), "found")
        ws.drop("classes", "reps", "described", "lists", "flagged")
    result = member.join(found, "node", "left").join(links, "node", "left").select(
        "vec_id",
        F.when(F.col("node").isNotNull(), F.col("n") - 1 + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "node", "vec_id").alias("component_id"),
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
