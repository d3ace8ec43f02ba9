"""Triangles counted inside jobs: each edge is sent to the jobs it can matter to, in one shuffle, and never meets a wedge.

Roles: a triangle is (v, u, w) with edges v->u (role 2), v->w (role 1), u->w (role 0). A job owns a box of v, u and w; an edge goes to a job in a
role when both its ends lie in the job's box for that role, so each triangle is found in exactly one job. Two ways to cut
the boxes:

``by_boxes``    the surviving triples of quadtree shards over all ids, of ``JOB_EDGES`` edges at most each: a hot block of the matrix is
                halved until its jobs fit a task, an empty one is in no job
``by_shares``   vertices dealt by hash into ``k`` shares, a job for each triple of shares; every edge goes to ``k`` jobs in each
                role, and ``k`` follows from the number of edges so that a job holds about ``JOB_EDGES``

Within a task jobs come together and their edges are closed at once: for every edge v->u the shorter of the neighbour lists of
v and u probes the longer one, sorted, by binary search; lists of hubs stand once in a job, not once for each edge. Edges may carry
a label (their grid, shard or slice); triangles are then counted for each triple of labels, however the boxes are cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partition
from .storage import Workspace

#: Edges of a job that a task is meant to hold.
JOB_EDGES = 1 << 18
#: Neighbours that probe at a time.
PROBES = 1 << 20
RESULT = "l0 long, l1 long, l2 long, triangles long"


class _Lists:
    """Sorted neighbour lists of one role: list i is ``to[first[i]:first[i + 1]]`` and belongs to ``owner[i]``."""

    def __init__(self, owner: np.ndarray, to: np.ndarray, label: np.ndarray) -> None:
        opens = np.ones(len(owner), dtype=bool)
        opens[1:] = owner[1:] != owner[:-1]
        start = np.flatnonzero(opens)
        self.owner, self.first, self.to, self.label = owner[start], np.append(start, len(owner)), to, label
        self.entry = (np.cumsum(opens) - 1) << 32 | to

    def of(self, owner: np.ndarray) -> np.ndarray:
        """The list of each owner, -1 for none."""
        if not len(self.owner):
            return np.full(len(owner), -1)
        at = np.minimum(np.searchsorted(self.owner, owner), len(self.owner) - 1)
        return np.where(self.owner[at] == owner, at, -1)

    def size(self, i: np.ndarray) -> np.ndarray:
        return self.first[i + 1] - self.first[i]

    def probe(self, i: np.ndarray, other: _Lists, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What of list i stands in list j of ``other``: pair of lists, and labels of the entry here and there."""
        sizes = self.size(i)
        ends = np.cumsum(sizes)
        a = 0
        while a < len(i):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + PROBES, side="right")))
            pair = np.repeat(np.arange(a, b), sizes[a:b])
            here = self.first[i[pair]] + np.arange(len(pair)) - np.repeat(ends[a:b] - sizes[a:b] - done, sizes[a:b])
            want = j[pair] << 32 | self.to[here]
            there = np.minimum(np.searchsorted(other.entry, want), len(other.entry) - 1)
            hit = other.entry[there] == want
            yield pair[hit], self.label[here[hit]], other.label[there[hit]]
            a = b


def close(job: np.ndarray, role: np.ndarray, src: np.ndarray, dst: np.ndarray, label: np.ndarray) -> dict[tuple[int, int, int], int]:
    """Triangles by the labels of their edges (roles 0, 1, 2), from rows sorted by job (numbered from 0), role, src and dst."""
    ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
    a, b = at[: len(src)].astype(np.int64), at[len(src) :].astype(np.int64)
    labels, label = np.unique(label, return_inverse=True)
    own = job << 32
    zero, one = (_Lists((own | a)[role == r], b[role == r], label[role == r]) for r in (0, 1))
    middle = role == 2
    i, j = one.of((own | a)[middle]), zero.of((own | b)[middle])
    ok = (i >= 0) & (j >= 0)
    i, j, mine = i[ok], j[ok], label[middle][ok]
    k, total = len(labels), {}
    short = one.size(i) <= zero.size(j) if len(i) else np.zeros(0, dtype=bool)
    for one_first, part in ((True, short), (False, ~short)):
        x, y, two = i[part], j[part], mine[part]
        for pair, here, there in one.probe(x, zero, y) if one_first else zero.probe(y, one, x):
            first, second = (there, here) if one_first else (here, there)
            triples, n = np.unique((first * k + second) * k + two[pair], return_counts=True)
            for t, m in zip(triples.tolist(), n.tolist(), strict=True):
                key = (int(labels[t // (k * k)]), int(labels[t // k % k]), int(labels[t % k]))
                total[key] = total.get(key, 0) + m
    return total


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of whole jobs from batches sorted by job; a job that goes on in the next batch waits for it."""

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, role, src, dst, label = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("job", "role", "src", "dst", "label"))
        number = np.cumsum(np.concatenate(([0], job[1:] != job[:-1])))
        found = close(number, role, src, dst, label)
        columns = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_pydict({f"l{r}": pa.array(columns[r], pa.int64()) for r in range(3)} | {"triangles": pa.array(list(found.values()), pa.int64())})

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        jobs = batch.column("job").to_numpy()
        cut = int(np.searchsorted(jobs, jobs[-1]))
        if held and not cut and held[-1].column("job")[held[-1].num_rows - 1].as_py() != jobs[0]:
            cut = -1
        # Small jobs gather until they are worth a pass.
        if cut and size + max(cut, 0) >= JOB_EDGES:
            yield from done([*held, batch.slice(0, cut)] if cut > 0 else held)
            held, size, batch = [], 0, batch.slice(max(cut, 0))
        held.append(batch)
        size += batch.num_rows
    if held:
        yield from done(held)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count_jobs(dealt: DataFrame) -> DataFrame:
    """(l0, l1, l2, triangles), several rows for labels that several tasks meet, from edges dealt to jobs: job, role (int), src, dst,
    label, each edge once a job and role."""
    # A set number of tasks: closing takes time, not bytes.
    rows = dealt.select("job", "role", "src", "dst", "label").repartition(_tasks(dealt), "job").sortWithinPartitions("job", "role", "src", "dst")
    return rows.mapInArrow(_counted, RESULT)


def by_boxes(e: DataFrame, ws: Workspace, job_edges: int = JOB_EDGES) -> DataFrame:
    """Triangles by the labels of their edges: l0, l1, l2, triangles. ``e`` (src > dst, each once, label) is written."""
    top = e.agg(F.max("src")).first()[0]
    levels = max(1, (top or 1).bit_length())
    key = ["gr", "gc", "depth", "sr", "sc"]
    shards = partition.split(e.select("src", "dst"), job_edges, levels, 1 << levels)
    shards = ws.keep(shards.select(*key, F.monotonically_increasing_id().alias("id")), "job-shards")
    jobs = partition.overlapping(shards.select(*key, F.struct("id", "depth", "sr", "sc").alias("s"))).withColumn("job", F.monotonically_increasing_id())

    def span(g: str, part: str) -> tuple[str, str]:
        side = f"shiftleft(1L, {levels} - {g}.depth)"
        return f"{g}.{part} * {side}", f"({g}.{part} + 1) * {side}"

    def shared(p: tuple[str, str], q: tuple[str, str]) -> tuple[str, str]:
        return f"greatest({p[0]}, {q[0]})", f"least({p[1]}, {q[1]})"

    v, w, u = shared(span("g1", "sr"), span("g2", "sr")), shared(span("g1", "sc"), span("g0", "sc")), shared(span("g0", "sr"), span("g2", "sc"))
    roles = [f"struct({r} AS role, g{r}.id AS id, {s[0]} AS s0, {s[1]} AS s1, {d[0]} AS d0, {d[1]} AS d1)" for r, s, d in ((0, u, w), (1, v, w), (2, v, u))]
    boxes = ws.keep(jobs.selectExpr("job", f"explode(array({', '.join(roles)})) AS x").select("job", "x.*"), "job-boxes")
    placed = ws.keep(partition.with_leaf(e, shards, 1 << levels, levels, ("id",)).select("src", "dst", "label", "id").repartition(_tasks(e), "src"), "job-edges")
    dealt = placed.join(boxes, "id").where("src >= s0 AND src < s1 AND dst >= d0 AND dst < d1")
    counts = count_jobs(dealt).groupBy("l0", "l1", "l2").agg(F.sum("triangles").alias("triangles"))
    out = ws.keep(counts, "job-results")
    ws.drop("job-shards", "job-boxes", "job-edges")
    return out


def shares_for(edges: int, job_edges: int = JOB_EDGES) -> int:
    """Shares of the vertices: a job holds three pairs of shares of the edges."""
    return max(1, math.ceil(math.sqrt(3 * edges / job_edges)))


def by_shares(o: DataFrame, k: int) -> DataFrame:
    """(triangles), in parts, over edges ``o`` that point one way along an order without cycles: each a -> b, a -> c, b -> c once."""
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(k))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("x")
    rows = o.select("src", "dst", share("src").alias("s"), share("dst").alias("d"), other)
    job = lambda a, b, c: (F.col(a) * k + F.col(b)) * k + F.col(c)
    roles = [F.struct(job(*names).alias("job"), F.lit(r).alias("role")) for r, names in ((0, "xsd"), (1, "sxd"), (2, "sdx"))]
    dealt = rows.select("src", "dst", F.explode(F.array(*roles)).alias("j"))
    return count_jobs(dealt.select("j.job", "j.role", "src", "dst", F.lit(0).cast("long").alias("label")))
