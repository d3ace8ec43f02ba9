"""Triangles closed over neighbour lists inside jobs: few bytes move, and no wedge is ever a row.

Edges are lists: ``src`` with its sorted ``dst``, all smaller than ``src`` (or equal, with loops). A triangle is (a, b, c), a > b > c: b and c stand in
a's list, c in b's.

Counting: vertices are dealt by hash into ``k`` colours (:func:`colours`). There is a job for any three colours, for the triangles that have all three, and
one for any two, for those that have both; those of one colour go with one of its pairs. An edge of two colours lies in ``k - 1`` jobs, and so many times it
moves, once whatever its part in a triangle. A job holds at most ``6 / k**2`` of the edges; ``k`` follows from their number, so that a
task never holds much more than ``HELD``, and what moves grows with the edges to the power of 1.5. Every wedge is looked up once, in one job.
Lists travel in blocks, a few bytes an edge.

Listing the triples of a matrix (:func:`triples`): b is dealt into ``p`` buckets and a into ``q``; job (p, q) holds the lists of its b's while the lists of its
a's stream by. A list goes to ``q`` jobs to be held, and to the buckets that hold one of its entries to stream by.

Within a task the entries of many lists are paired and looked up at once. Ways to look up: ``sorted`` (bisection in b's list), ``hash`` (a table of
hashed bits, then bisection of what passes), ``bits`` (words of 64 neighbours); where most pairs are edges, as with cells of a matrix, a full table.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges whose lists a task holds.
HELD = 1 << 25
#: Pairs looked up at a time.
PROBES = 1 << 20
#: Entries of lists that a task cuts into blocks at a time.
BLOCK = 1 << 21
#: Entries of a full table of a job's lists.
TABLE = 1 << 24
#: Results that a job gets.
RESULTS = 1 << 21
#: Lists with as many entries are matched by marks, one at a time; marks are no more than ``MARKS``.
LONG, MARKS = 64, 1 << 26
#: Time that cores may stand idle in the last wave of jobs, as a share of the work.
IDLE = 0.25
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
Found = tuple[np.ndarray, np.ndarray, np.ndarray, "np.ndarray | None", "np.ndarray | None", "np.ndarray | None"]


class _Held:
    """The lists of a job's b's."""

    def __init__(self, parts: list[tuple], probe: str, table: bool = True) -> None:
        owner, size = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        self.to = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        self.label = np.concatenate([p[3] for p in parts]) if parts and parts[0][3] is not None else None
        parts.clear()
        order = np.argsort(owner, kind="stable")
        self.owner = owner[order]
        ends = np.cumsum(size)
        self.first, self.last = (ends - size)[order], ends[order]
        self.probe = probe
        most = min(TABLE, max(1 << 20, 8 * len(self.to)))
        # Lists are sets: there are as many targets as the longest has, at least.
        self.targets = np.unique(self.to) if table and len(self.owner) * int((self.last - self.first).max(initial=0)) <= most else None
        if self.targets is not None and len(self.owner) * len(self.targets) <= most:
            self.probe = "table"
            at = np.zeros(len(self.owner) * len(self.targets), np.int32)
            at[self._each() * len(self.targets) + np.searchsorted(self.targets, self.to)] = np.arange(1, len(self.to) + 1)
            self.at = at
        else:
            self.targets = None
            if self.probe == "hash":
                self.power = max(16, (8 * len(self.to)).bit_length() - 1)
                seen, each = np.zeros(1 << self.power, bool), self._each()
                for at in range(0, len(each), PROBES):
                    seen[self._hash(each[at : at + PROBES], self.to[at : at + PROBES])] = True
                self.seen = np.packbits(seen, bitorder="little")
            elif self.probe == "bits":
                self._words()

    def _each(self) -> np.ndarray:
        """The list of each entry."""
        by = np.argsort(self.first, kind="stable")
        return np.repeat(by, (self.last - self.first)[by])

    def _hash(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((self.owner[i].astype(np.uint64) * _MIX[0] ^ c.astype(np.uint64)) * _MIX[1] >> np.uint64(64 - self.power)).astype(np.int64)

    def _words(self) -> None:
        each, word = self._each(), self.to >> 6
        opens = np.ones(len(each), bool)
        opens[1:] = (each[1:] != each[:-1]) | (word[1:] != word[:-1])
        start = np.flatnonzero(opens)
        self.word = word[start]
        self.bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (self.to & 63).astype(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
        self.first_word, self.last_word = (np.searchsorted(start, x) for x in (self.first, self.last))

    def of(self, b: np.ndarray) -> np.ndarray:
        """The list of each b, -1 for none here."""
        if not len(self.owner):
            return np.full(len(b), -1)
        at = np.minimum(np.searchsorted(self.owner, b), len(self.owner) - 1)
        return np.where(self.owner[at] == b, at, -1)

    def columns(self, c: np.ndarray) -> np.ndarray | None:
        """The place of each c among the targets of the table, -1 for none."""
        if self.targets is None:
            return None
        if not len(self.targets):
            return np.full(len(c), -1)
        at = np.minimum(np.searchsorted(self.targets, c), len(self.targets) - 1)
        return np.where(self.targets[at] == c, at, -1)

    def find(self, i: np.ndarray, c: np.ndarray, column: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Which of the pairs (list i, c) are edges, and the place of their entries (None with ``bits``)."""
        if self.probe == "table":
            there = np.where(column >= 0, self.at[i * len(self.targets) + np.maximum(column, 0)], 0)
            hit = np.flatnonzero(there)
            return hit, there[hit] - 1
        if self.probe == "bits" and self.label is None:
            at = _bisect(self.word, self.first_word[i], self.last_word[i], c >> 6)
            ok = np.flatnonzero(at >= 0)
            bit = self.bits[at[ok]] >> (c[ok] & 63).astype(np.uint64) & np.uint64(1)
            return ok[bit == 1], None
        ok = np.arange(len(i))
        if self.probe == "hash":
            h = self._hash(i, c)
            ok = np.flatnonzero(self.seen[h >> 3] >> (h & 7).astype(np.uint8) & 1)
        at = _bisect(self.to, self.first[i[ok]], self.last[i[ok]], c[ok])
        hit = at >= 0
        return ok[hit], at[hit]


def _lower(values: np.ndarray, low: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Where each wanted value would stand in its own sorted stretch of ``values``."""
    high, most = end, len(values) - 1
    for _ in range(int((end - low).max(initial=0)).bit_length()):
        mid = low + high >> 1
        less = (values[np.minimum(mid, most)] < want) & (mid < high)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    return low


def _bisect(values: np.ndarray, low: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of each wanted value in its own sorted stretch of ``values``, -1 for none."""
    if not len(want):
        return np.zeros(0, np.int64)
    low = _lower(values, low, end, want)
    return np.where((low < end) & (values[np.minimum(low, len(values) - 1)] == want), low, -1)


def _rows(batch: pa.RecordBatch) -> tuple:
    """src, sizes, entries and labels of a batch of lists."""
    dst = batch.column("dst")
    size = np.diff(dst.offsets.to_numpy()).astype(np.int64)
    label = batch.column("label").flatten().to_numpy() if "label" in batch.schema.names else None
    return batch.column("src").to_numpy(), size, dst.flatten().to_numpy(), label


def _paired(held: _Held, rows: tuple, loops: bool, others: _Held | None = None, column: np.ndarray | None = None) -> Iterator[Found]:
    """Triangles whose b's are the entries of ``rows`` and whose c's are entries before b in the same list, or in the list that ``others`` has for
    the same a; ``column`` are the places of the others' entries in the table of ``held``."""
    src, size, to, label = rows
    row = np.repeat(np.arange(len(src)), size)
    own = held.of(to)
    if others is None:
        second, seconds, column = to, label, held.columns(to)
        first = np.repeat(np.cumsum(size) - size, size)
        before = np.arange(len(to)) - first + loops
        pick = np.flatnonzero((own >= 0) & (before > 0))
        first, before = first[pick], before[pick]
    else:
        second, seconds = others.to, others.label
        at = others.of(src)[row]
        pick = np.flatnonzero((own >= 0) & (at >= 0))
        first = others.first[at[pick]]
        before = _lower(second, first, others.last[at[pick]], to[pick]) - first
        some = before > 0
        pick, first, before = pick[some], first[some], before[some]
    ends = np.cumsum(before)
    x = 0
    while x < len(pick):
        done = ends[x - 1] if x else 0
        y = max(x + 1, int(np.searchsorted(ends, done + PROBES, side="right")))
        b = np.repeat(pick[x:y], before[x:y])
        c = np.arange(len(b)) + np.repeat(first[x:y] - (ends[x:y] - before[x:y] - done), before[x:y])
        hit, there = held.find(own[b], second[c], None if column is None else column[c])
        b, c = b[hit], c[hit]
        yield src[row[b]], to[b], second[c], *((None,) * 3 if label is None else (label[b], seconds[c], held.label[there]))
        x = y


class _Job:
    """What a task holds of the job at hand."""

    def __init__(self) -> None:
        self.parts, self.lists = [], None


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes: the upper ones, mostly alike, take next to nothing in a shuffle."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _colour(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x.astype(np.uint64) * _MIX[0] ^ _MIX[1]) * _MIX[1] >> np.uint64(33)).astype(np.int64) % k


def _blocks(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists cut by the colours of their owners and entries (pair: k times the owner's and the entries'), many to a row, with the jobs they go to."""
    jobs = _jobs(k)
    going = [[n for n, own in enumerate(jobs) if {*divmod(pair, k)} <= {*own} and (len(own) == 2 or pair % (k + 1))] for pair in range(k * k)]

    def cut(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        src, size, to, label = (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
        row = np.repeat(np.arange(len(src)), size)
        pair = _colour(src, k)[row] * k + _colour(to, k)
        order = np.argsort(pair.astype(np.int32), kind="stable")
        cuts = _starts(pair[order])
        for at, end in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            own = order[at:end]
            starts = _starts(row[own])
            columns = {"pair": pa.array([pair[own[0]]], pa.int32()), "jobs": pa.array([going[pair[own[0]]]], pa.list_(pa.int32()))}
            columns |= {"src": src[row[own[starts[:-1]]]], "size": np.diff(starts).astype(np.int32), "dst": to[own]} | ({} if label is None else {"label": label[own]})
            yield pa.RecordBatch.from_pydict({x: v if isinstance(v, pa.Array) else pa.array([_packed(v)], pa.large_binary()).cast(pa.binary()) for x, v in columns.items()})

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            held.append(_rows(batch.slice(at, 100)))
            n += len(held[-1][2])
            if n >= BLOCK:
                yield from cut(held)
                held, n = [], 0
    if n:
        yield from cut(held)


def _closed(batches: Iterable[pa.RecordBatch], probe: str, k: int, kinds: tuple[str, str]) -> Iterator[Found]:
    """The triangles of the jobs of a partition (one each, as they are dealt)."""
    found = defaultdict(lambda: defaultdict(list))
    for batch in batches:
        jobs, pairs = (batch.column(x).to_pylist() for x in ("job", "pair"))
        for at, (job, pair) in enumerate(zip(jobs, pairs, strict=True)):
            data = {x: batch.column(x)[at].as_buffer() for x in ("src", "size", "dst", "label") if x in batch.schema.names}
            part = [_unpacked(data[x], kind) if x in data else None for x, kind in (("src", kinds[0]), ("size", "i4"), ("dst", kinds[0]), ("label", kinds[1]))]
            found[job][divmod(pair, k)].append(part)
    for job in sorted(found):
        parts, own = found.pop(job), _jobs(k)[job]
        rows = {x: [np.concatenate([p[i] for p in parts[x]]) for i in (0, 1)] for x in parts}
        lists = {x: _Held(parts.pop(x), probe) for x in [*parts]}
        for b, c in itertools.product(own, own):
            held = lists.get((b, c))
            for a in own if held else ():
                # Triangles of one colour go with one of its pairs; jobs of three colours have no edges within one.
                if len({a, b, c}) < len(own) and not (len(own) == 2 and a == b == c and (a + 1) % k in own) or (a, b) not in lists or (a, c) not in lists:
                    continue
                firsts, others = lists[a, b], None if b == c else lists[a, c]
                column = None if others is None else held.columns(others.to)
                src, size = rows[a, b]
                ends = np.cumsum(size, dtype=np.int64)
                x = 0
                while x < len(src):
                    done = int(ends[x - 1]) if x else 0
                    y = max(x + 1, int(np.searchsorted(ends, done + PROBES, side="right")))
                    to = slice(done, int(ends[y - 1]))
                    yield from _paired(held, (src[x:y], size[x:y], firsts.to[to], None if firsts.label is None else firsts.label[to]), False, others, column)
                    x = y


def _batch(names: Iterable[str], columns: Iterable[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in zip(names, columns, strict=True)})


def neighbours(e: DataFrame, tasks: int) -> DataFrame:
    """Lists (src, dst array) of edges src >= dst, each once, with their labels where ``e`` has a column ``label``."""
    e = e.repartition(tasks, "src")
    if "label" not in e.columns:
        return e.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dst"))
    out = e.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "label"))).alias("x"))
    return out.select("src", F.col("x.dst").alias("dst"), F.col("x.label").alias("label"))


def shape(edges: int, cores: int) -> tuple[int, int]:
    """Buckets of b and of a: a job for each core at least, in waves that fill the cores, with as few copies of a list (``p + q``) as that takes."""
    least = max(math.ceil(edges / HELD), math.ceil(math.sqrt(cores)))
    fits = ((p, q) for p in range(least, 2 * least + 1) for q in range(math.ceil(cores / p), math.ceil(5 * cores / p) + 1))
    return min((x for x in fits if math.ceil(math.prod(x) / cores) * cores <= (1 + IDLE) * math.prod(x)), key=sum)


def _jobs(k: int) -> list[tuple[int, ...]]:
    """The colours of each job."""
    return [*itertools.combinations(range(k), 2), *itertools.combinations(range(k), 3)]


def colours(edges: int, cores: int) -> int:
    """As few colours as jobs that hold no more than ``HELD`` take, in waves that fill the cores."""
    k = max(2, math.ceil(math.sqrt(6 * edges / HELD)))
    while (jobs := math.comb(k + 1, 3)) < cores or math.ceil(jobs / cores) * cores > (1 + IDLE) * jobs:
        k += 1
    return k


def deal(lists: DataFrame, edges: int) -> DataFrame:
    """Lists of src > dst dealt to the jobs that count them, a job to a partition, in blocks: job, pair, src, size, dst, label."""
    k = colours(edges, lists.sparkSession.sparkContext.defaultParallelism)
    rest = [x for x in ("src", "size", "dst", "label") if x == "size" or x in lists.columns]
    cut = lists.mapInArrow(lambda batches: _blocks(batches, k), "pair int, jobs array<int>, " + ", ".join(f"{x} binary" for x in rest))
    return cut.select(F.explode("jobs").alias("job"), "pair", *rest).repartitionById(math.comb(k + 1, 3), F.col("job"))


def _kinds(lists: DataFrame) -> tuple[str, str]:
    """Numpy's names for the types of ids and labels."""
    names = {"int": "i4", "bigint": "i8"}
    return names[lists.schema["src"].dataType.simpleString()], names[lists.schema["label"].dataType.elementType.simpleString()] if "label" in lists.columns else "i4"


def deal_cells(lists: DataFrame, cells: int, results: DataFrame | None = None) -> DataFrame:
    """Lists with loops dealt to the jobs of :func:`triples` and sorted for a task: job, role, src, dst, label; first the lists held, then those that
    stream by. ``lists`` is read twice: pass a written table. ``results`` (a, b, c, n, once a triple, written) come each before its a's list."""
    p, q = shape(cells, lists.sparkSession.sparkContext.defaultParallelism)
    q = q if results is None else max(q, math.ceil(results.count() / (p * RESULTS)))
    bucket = lambda c, n: F.pmod(F.xxhash64(c.cast("long")), F.lit(n)).cast("int")
    rest = [F.col(c) for c in ("src", "dst", "label") if c in lists.columns]
    each = lambda x, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(x)
    held = lists.select((bucket(F.col("src"), p) * q).alias("j"), each("k", q), *rest).select((F.col("j") + F.col("k")).alias("job"), F.lit(0).alias("role"), *rest)
    hits = F.array_distinct(F.transform("dst", lambda b: bucket(b, p)))
    streams = lists.select(bucket(F.col("src"), q).alias("j"), F.explode(hits).alias("k"), *rest)
    rows = held.unionByName(streams.select((F.col("k") * q + F.col("j")).alias("job"), F.lit(2).alias("role"), *rest))
    if results is not None:
        kind = lists.schema["dst"].dataType
        job = bucket(F.col("b"), p) * q + bucket(F.col("a"), q)
        found = [F.col("a").cast(lists.schema["src"].dataType).alias("src"), F.array("b", "c", "n").cast(kind).alias("dst")]
        found += [F.array().cast(lists.schema["label"].dataType).alias("label")] if "label" in lists.columns else []
        rows = rows.unionByName(results.select(job.alias("job"), F.lit(1).alias("role"), *found))
    return rows.repartitionById(p * q, F.col("job")).sortWithinPartitions("job", F.col("role") > 0, "src", "role")


def _found(lists: DataFrame, edges: int, probe: str) -> tuple[DataFrame, Callable[[Iterable[pa.RecordBatch]], Iterator[Found]]]:
    """Lists as dealt, and the triangles that a task finds in them."""
    k, kinds = colours(edges, lists.sparkSession.sparkContext.defaultParallelism), _kinds(lists)
    return deal(lists, edges), lambda batches: _closed(batches, probe, k, kinds)


def total(lists: DataFrame, edges: int, probe: str = "hash") -> DataFrame:
    """(triangles), a row for each task. ``lists`` (src > dst, written), of so many ``edges``."""
    dealt, closed = _found(lists, edges, probe)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(found[0]) for found in closed(batches))
        yield _batch(["triangles"], [np.array([n], np.int64)])

    return dealt.mapInArrow(run, "triangles long")


def _summed(labels: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(labels[::-1])
    labels = [x[order] for x in labels]
    opens = np.ones(len(order), bool)
    opens[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in labels])
    at = np.flatnonzero(opens)
    return [*(x[at] for x in labels), np.add.reduceat(n[order], at)]


#: Strips of the vertices, lowest first, and labels of the edges across from them.
STRIPS, LABELS = ["w", "u", "v"], ["l2", "l1", "l0"]


def label_names(lists: DataFrame, width: int | None) -> list[str]:
    """What :func:`by_label` counts by."""
    return [*(STRIPS if width is not None else []), *(LABELS if "label" in lists.columns else [])]


def by_label(lists: DataFrame, edges: int, bits: int | None, width: int | None = None, probe: str = "hash") -> DataFrame:
    """Triangles by the labels of their edges, several rows for those that several tasks meet. Roles go by the ids v > u > w, the lowest ``bits`` of what the
    lists hold: l2 is the label of (v, u), l1 of (v, w), l0 of (u, w). With ``width`` they are counted by strips of ids (v, u, w: id by width) too,
    which tell the grids of the three edges."""
    names = [*label_names(lists, width), "triangles"]
    labelled = "label" in lists.columns
    dealt, closed = _found(lists, edges, probe)

    def labels(found: Found) -> list[np.ndarray]:
        abc = np.stack([x.astype(np.int64) if bits is None else x.astype(np.int64) & (1 << bits) - 1 for x in found[:3]])
        order = np.argsort(abc, axis=0)
        strips = [] if width is None else [*np.take_along_axis(abc, order, axis=0) // width]
        # The edge across from a vertex: (b, c), (a, c), (a, b).
        across = [*np.take_along_axis(np.stack([found[5], found[4], found[3]]), order, axis=0)] if labelled else []
        return [*strips, *(x.astype(np.int64) for x in across)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in closed(batches):
            if len(found[0]):
                held.append([*labels(found), np.ones(len(found[0]), np.int64)])
                size += len(found[0])
            if size >= PROBES:
                one = [np.concatenate(x) for x in zip(*held, strict=True)]
                one = _summed(one[:-1], one[-1])
                held, size = [one], len(one[0])
                if size >= PROBES // 2:
                    yield _batch(names, one)
                    held, size = [], 0
        if held:
            one = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield _batch(names, _summed(one[:-1], one[-1]))

    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    opens = np.ones(len(keys[0]), bool)
    opens[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return np.append(np.flatnonzero(opens), len(opens))


def _marked(held: _Held, a: int, to: np.ndarray, label: np.ndarray | None, place: np.ndarray | None) -> Iterator[tuple]:
    """The triples of one list, for pieces of its b's: a and b of each pair, where the c's of each start and end, the c's, and the labels ab, ac, bc of
    each c. ``place`` is -1 wherever it isn't lent to this list; without one c's are looked up in the list itself."""
    own = held.of(to)
    at = np.flatnonzero(own >= 0)
    own = own[at]
    first, last = held.first[own], held.last[own]
    ends = np.cumsum(last - first)
    if place is not None:
        place[to] = np.arange(len(to), dtype=place.dtype)
    x = 0
    while x < len(at):
        done = ends[x - 1] if x else 0
        y = max(x + 1, int(np.searchsorted(ends, done + PROBES, side="right")))
        bounds = np.concatenate([[0], ends[x:y] - done])
        if (first[x + 1 : y] == last[x : y - 1]).all():
            entry, c = None, held.to[first[x] : last[y - 1]]
        else:
            entry = np.arange(bounds[-1]) + np.repeat(first[x:y] - bounds[:-1], np.diff(bounds))
            c = held.to[entry]
        if place is not None:
            there = place[c]
        else:
            there = np.minimum(np.searchsorted(to, c), len(to) - 1)
            there = np.where(to[there] == c, there, -1)
        hit = np.flatnonzero(there >= 0)
        cuts = np.searchsorted(hit, bounds)
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        labels = None
        if label is not None:
            entry = hit + first[x] if entry is None else entry[hit]
            labels = np.repeat(label[at[x:y]], np.diff(cuts)), label[there[hit]], held.label[entry]
        b = to[at[x:y][some]]
        yield np.full(len(b), a, b.dtype), b, np.append(cuts[some], len(hit)), c[hit], labels
        x = y
    if place is not None:
        place[to] = -1


def _expanded(labels: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """For windows of the product of the ranges of each triple's labels (ab, ac, bc): the triples, and their places in the three ranges."""
    ab, ac, bc = (x.astype(np.int64) for x in labels)
    ends = np.cumsum(ab * ac * bc)
    for start in range(0, int(ends[-1]) if len(ends) else 0, PROBES):
        k = np.arange(start, min(start + PROBES, int(ends[-1])))
        at = np.searchsorted(ends, k, side="right")
        k = k - np.where(at > 0, ends[at - 1], 0)
        yield at, k % bc[at], k // bc[at] % ac[at], k // (bc[at] * ac[at])


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _counted_at(b: np.ndarray, bounds: np.ndarray, c: np.ndarray, known: np.ndarray) -> np.ndarray | None:
    """The results (b, c, n) of one a at its triples."""
    width = int(max(c.max(), known[1].max())) + 1
    # Keys (place of b, c) rise through the rows.
    keys = np.repeat(np.arange(len(b)), np.diff(bounds)) * width + c
    here = np.minimum(np.searchsorted(b, known[0]), len(b) - 1)
    want = here * width + known[1]
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    ok = (b[here] == known[0]) & (keys[at] == want)
    n = np.zeros(len(c), np.int64)
    n[at[ok]] = known[2][ok]
    return n if ok.any() else None


def _triple_rows(batches: Iterable[pa.RecordBatch], extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, list of c, lists of ``extra``, of rows in the order of :func:`deal_cells`."""
    results = extra == ["n"]

    def rows(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, c: np.ndarray, more: list[np.ndarray | None]) -> pa.RecordBatch:
        lists = [pa.nulls(len(b), pa.list_(pa.int64())) if x is None else _lists(x, bounds) for x in more]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), _lists(c, bounds), *lists], ["a", "b", "c", *extra])

    def made(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, c: np.ndarray, labels: tuple | None, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if not len(c):
            return
        if labels is None or max(x.max() for x in labels) == 1:
            yield rows(a, b, bounds, c, [None if known is None else _counted_at(b, bounds, c, known)] if results else [None] * len(extra))
            return
        pair = np.repeat(np.arange(len(b)), np.diff(bounds))
        for at, *k in _expanded(labels):
            cuts = _starts(pair[at])
            own = pair[at[cuts[:-1]]]
            yield rows(a[own], b[own], cuts, c[at], k)

    place, number, job, owner, found = np.zeros(0, np.int32), None, _Job(), None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        jobs, roles, src = (batch.column(x).to_numpy() for x in ("job", "role", "src"))
        cuts = _starts(jobs, roles, np.where(roles == 1, src, 0)).tolist()
        for at, end in zip(cuts, cuts[1:], strict=False):
            if jobs[at] != number:
                number, job, owner, found = jobs[at], _Job(), None, []
            whole = _rows(batch.slice(at, end - at))
            if roles[at] == 0:
                job.parts.append(whole)
                continue
            if roles[at] == 1:
                found = found if owner == src[at] else []
                owner = src[at]
                found.append(whole[2].reshape(-1, 3))
                continue
            if job.lists is None:
                job.lists = _Held(job.parts, "sorted", False)
            owners, size, to, label = whole
            if not results and len(owners) > 1 and size.max() < LONG:
                for a, b, c, *labels in _paired(job.lists, whole, True):
                    opens = _starts(a, b)
                    yield from made(a[opens[:-1]], b[opens[:-1]], opens, c, None if label is None else tuple(labels), None)
                continue
            most = int(max(to.max(initial=-1), job.lists.to.max(initial=-1))) + 1
            if most > len(place) and most <= MARKS:
                place = np.full(most, -1, np.int32)
            bounds = np.concatenate([[0], np.cumsum(size)])
            for k, a in enumerate(owners.tolist()):
                own = slice(bounds[k], bounds[k + 1])
                known = np.concatenate(found).T if found and owner == a else None
                for part in _marked(job.lists, a, to[own], None if label is None else label[own], place if most <= MARKS else None):
                    yield from made(*part, known)


def triples(dealt: DataFrame, results: bool = False) -> DataFrame:
    """Every triple a >= b >= c of lists with loops as a row, streamed from the tasks that find it: a, b, c, with ``n`` of the results dealt (0 for none), or
    with k0, k1, k2 from the ranges of the labels bc, ac, ab where lists have them.

    A task hands on a row for each pair (a, b), with its c's as a list, which is only taken apart where rows are used. It holds the lists
    of its b's, and the results of one a at a time."""
    kind = dealt.schema["dst"].dataType.elementType.simpleString()
    extra = ["n"] if results else ["k0", "k1", "k2"] if "label" in dealt.columns else []
    found = dealt.mapInArrow(lambda batches: _triple_rows(batches, extra), f"a {kind}, b {kind}, c array<{kind}>" + "".join(f", {x} array<bigint>" for x in extra))
    each = found.select("a", "b", *[F.col(x).alias(f"{x}s") for x in extra], F.posexplode("c").alias("at", "c"))
    return each.select("a", "b", "c", *[F.when(F.col(f"{x}s").isNull(), F.lit(0).cast("long")).otherwise(F.get(f"{x}s", "at")).alias(x) for x in extra])
