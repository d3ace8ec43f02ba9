"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Sorting all suffixes of a corpus is not needed to know which 100-byte strings repeat: only places that could repeat are sorted,
and each shard is sorted once. In order:

1. *Candidates.* Each window (100 bytes) is governed by the smallest 40-byte hash inside it, its anchor; consecutive windows
   of a document with one anchor form a path, and equal windows have equal anchors at equal places. Anchors that
   occur once hold no repeat and go. Equal paths enter the rest once, as their first copy; the others are repeats of it.
2. *Strings.* First copies at anchors with several different paths are cut out of their texts. A string goes on, by halves of
   the places that the anchor can take in a window, where another one shares all bytes that windows of its half share.
   Groups of such strings larger than ``GROUP`` are halved again, equal strings becoming one each time, until they fit or all
   windows of a group are one and the same: no task ever holds more of a hot group.
3. *Merge.* Within a task whole groups come together as shards. Each shard's suffixes are sorted once and held
   as its transform. The transforms are merged by refining their interleave: round h orders all suffixes by their first h
   symbols from the order by h - 1, by one stable distribution of the symbols before them. A border
   that first shows in round h is a common prefix of h - 1 symbols. Symbols are four bytes, so 25 rounds order by the 100
   bytes that matter; what still shares a block then is a repeated interval, whose windows all go but the first.

Decisions at 2 and 3 compare bytes; those at 1 take paths with equal 128-bit hashes for equal.

Defined results: documents are ordered by doc_id, windows of one document by their start. A null doc_id neither removes nor loses
bytes; a null or empty text has no bytes; rows that share a doc_id don't remove each other's bytes and keep a result
row each (fully repeated rows: the same one); texts of any length are read whole, in pieces of bounded size; an empty table gives an
empty result; columns besides id and text, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, keyed_texts, runs
from .debruijn import _TEXT_KEY
from .textkernel import SLICE_BYTES, byte_codes, mix64, prefix_sums

WINDOW = 100
ANCHOR = 40
#: Strings of a group that are merged in one task; larger groups are halved first.
GROUP = 1024
#: Bytes of a shard, whose suffixes are sorted on their own, and of what is merged at once (its arrays stay in a core's cache).
SHARD_BYTES = 1 << 15
MERGE_BYTES = 1 << 17
#: Bits of a packed value that hold a place within a piece.
_PLACE = 21


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value in each full window."""
    done, best = 1, values
    while 2 * done <= width:
        best = np.minimum(best[done:], best[:-done])
        done *= 2
    if width > done:
        step = width - done
        best = np.minimum(best[step:], best[:-step])
    return best


def _pieces(raw: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts laid end to end in pieces of bounded size: bytes, and for each stretch of a text its row and where it
    starts in text and piece. Stretches of one text overlap by a window less one byte, so each window lies in one."""
    parts, rows, size = [], [], 0

    def piece():
        starts = np.cumsum([0, *[len(p) for p in parts]])
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(rows, dtype=np.int64).reshape(-1, 2), starts

    for row, text in enumerate(raw):
        for at in range(0, max(1, len(text) - window + 1), SLICE_BYTES):
            part = text[at : at + SLICE_BYTES + window - 1]
            if len(part) < window:
                continue
            if size and size + len(part) > SLICE_BYTES:
                yield piece()
                parts, rows, size = [], [], 0
            parts.append(part)
            rows.append((row, at))
            size += len(part)
    if parts:
        yield piece()


def _sampled(raw: list[bytes], window: int, anchor: int, full: bool) -> Iterator[dict[str, np.ndarray]]:
    """The paths of each piece: row, first window's start, number of windows, place of the anchor from that start, anchor; with ``full``
    also two hashes of the bytes that the path's windows cover."""
    for buffer, rows, starts in _pieces(raw, window):
        total, down = prefix_sums(byte_codes(0)[buffer], 0)
        grams = mix64((total[anchor:] - total[:-anchor]) * down[: len(total) - anchor])
        low = np.uint64((1 << _PLACE) - 1)
        packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        chosen = (_sliding_min(packed, window - anchor + 1) & low).astype(np.int64)
        # Windows lie within their stretch.
        inside = np.zeros(len(chosen), dtype=bool)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            inside[a : b - window + 1] = True
        new = inside.copy()
        new[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        # A path ends before the next one or before windows that cross a border.
        ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | new[1:], [True])))
        part = np.searchsorted(starts, first, side="right") - 1
        out = {
            "row": rows[part, 0], "lo": first - starts[part] + rows[part, 1], "n": ends - first + 1, "at": chosen[first] - first,
            "anchor": grams[chosen[first]].view(np.int64),
        }
        if full:
            size = (ends - first).astype(np.uint64)
            for name, (sums, powers) in (("p1", (total, down)), ("p2", prefix_sums(byte_codes(1)[buffer], 1))):
                out[name] = mix64((sums[ends + window] - sums[first]) * powers[first] + size).view(np.int64)
        yield out


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _anchors(batch: pa.RecordBatch, window: int, anchor: int) -> dict:
    """Each anchor of a slice once, and whether it occurs there more than once."""
    seen = [p["anchor"] for p in _sampled(_raw(batch), window, anchor, False)]
    found, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, dtype=np.int64), return_counts=True)
    return {"anchor": pa.array(found), "times": pa.array(np.minimum(n, 2).astype(np.int32))}


def _paths(batch: pa.RecordBatch, window: int, anchor: int) -> dict:
    """The paths of a slice; ``again`` marks those that stand earlier in their own document."""
    raw = _raw(batch)
    pieces = list(_sampled(raw, window, anchor, True))
    names = ("row", "lo", "n", "at", "anchor", "p1", "p2")
    column = {k: np.concatenate([p[k] for p in pieces]) if pieces else np.zeros(0, dtype=np.int64) for k in names}
    order = np.lexsort([column[k] for k in ("lo", "p2", "p1", "anchor", "row")])
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in ("row", "anchor", "p1", "p2"):
        same &= column[k][order[1:]] == column[k][order[:-1]]
    again = np.zeros(len(order), dtype=bool)
    again[order[1:][same]] = True
    key = np.array([zlib.crc32(t) for t in raw], dtype=np.int64)
    small = {k: pa.array(column[k].astype(np.int32)) for k in ("lo", "n", "at")}
    return {
        "doc_id": batch.column("doc_id").take(pa.array(column["row"])), "row_key": pa.array(key[column["row"]]), "anchor": pa.array(column["anchor"]),
        "p1": pa.array(column["p1"]), "p2": pa.array(column["p2"]), **small, "again": pa.array(again),
    }


def _cut(batch: pa.RecordBatch, window: int) -> dict:
    """The bytes that each wanted path's windows cover."""
    wanted = batch.column("wanted")
    of, flat = wanted.value_parent_indices(), wanted.flatten()
    raw = _raw(batch)
    ranges = zip(of.to_pylist(), flat.field("lo").to_pylist(), flat.field("n").to_pylist(), strict=True)
    text = [raw[i][lo : lo + n - 1 + window] for i, lo, n in ranges]
    return {name: batch.column(name).take(of) for name in ("doc_id", "row_key")} | {"lo": flat.field("lo"), "at": flat.field("at"), "bytes": pa.array(text, pa.binary())}


def halves(strings: DataFrame, window: int) -> DataFrame:
    """Strings (doc_id, row_key, lo, at, bytes, x, y: places of the anchor that windows of their group can have) by the halves of their
    group's places. ``key`` is a hash of all bytes that windows of the half share; equal windows get equal keys."""
    cut = """explode(filter(transform(array(struct(x, (x + y) div 2 AS y), struct((x + y) div 2 + 1 AS x, y)), h -> struct(h.x, h.y,
        least(at, h.y) AS hi, greatest(at - length(bytes) + {w}, h.x) AS lo)), h -> h.x <= h.y AND h.lo <= h.hi)) AS h""".format(w=window)
    rows = strings.selectExpr("doc_id", "row_key", "lo", "at", "bytes", cut)
    rows = rows.selectExpr(
        "doc_id", "row_key", "cast(lo + at - h.hi AS int) AS lo", "cast(h.hi AS int) AS at", f"substring(bytes, at - cast(h.hi AS int) + 1, cast(h.hi - h.lo AS int) + {window}) AS bytes",
        "cast(h.x AS int) AS x", "cast(h.y AS int) AS y",
    )
    return rows.withColumn("key", F.expr(f"xxhash64(x, y, substring(bytes, at - x + 1, {window} - y + x))"))


def _first_copies(strings: DataFrame, ws: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """Equal strings of a group as one: (later copies, first ones of each document and of all). ``strings`` is written."""
    group = ["key", "x", "y", "at", "bytes"]
    own = ws.keep(strings.groupBy(*group, "doc_id", "row_key").agg(F.min("lo").alias("own")), f"{name}-own")
    low = ws.keep(own.groupBy(*group).agg(F.min("doc_id").alias("source")), f"{name}-low")
    later = strings.join(own, [*group, "doc_id", "row_key"]).where("lo > own").select(*strings.columns)
    judged = own.withColumnRenamed("own", "lo").join(low, group)
    later = later.unionByName(judged.where("doc_id > source").select(*strings.columns))
    return later, judged.where("doc_id = source").select(*strings.columns)


#: Bytes of a symbol. Every string has as many ends, so that each of its suffixes is some whole symbols and an end.
SYMBOL = 4


class Rows:
    """All suffixes of some strings, a row each: string i of length n has rows ``first[i]`` to ``first[i + 1]``, for its suffixes 0 to n - 1 and
    ``SYMBOL`` ends. ``symbol`` numbers the bytes that a row starts with (past a string's end: zeros) by rank from 1; ends have 0."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        size = self.lengths + SYMBOL
        self.first = np.concatenate(([0], np.cumsum(size)))
        n = int(self.first[-1])
        text = np.frombuffer(b"".join(s + bytes(SYMBOL) for s in strings) + bytes(SYMBOL), dtype=np.uint8).astype(np.uint32)
        value = text[:n].copy()
        for k in range(1, SYMBOL):
            value = value << np.uint32(8) | text[k : n + k]
        self.place = np.arange(n) - np.repeat(self.first[:-1], size)
        self.left = np.repeat(size, size) - self.place
        inner = self.left > SYMBOL
        self.symbol = np.zeros(n, dtype=np.int64)
        found, rank = np.unique(value[inner], return_inverse=True)
        self.symbol[inner] = rank + 1
        #: Numbers up to 65,536 are dealt out by counting.
        self.narrow = len(found) <= 1 << 16


class Shard:
    """The transform of some consecutive strings: their suffixes sorted once, and the symbol before each (-1: there is none)."""

    def __init__(self, rows: Rows, a: int, b: int) -> None:
        lo, hi = int(rows.first[a]), int(rows.first[b])
        symbol, left = rows.symbol[lo:hi], rows.left[lo:hi]
        order = self._sort(symbol, left)
        self.rows = order + lo
        inner = rows.place[self.rows] >= SYMBOL
        self.before = np.full(hi - lo, -1, dtype=np.int32)
        self.before[inner] = symbol[order[inner] - SYMBOL] - 1
        self.ends = SYMBOL * (b - a)

    @staticmethod
    def _sort(symbol: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Prefix doubling; ties are equal suffixes and keep the order of rows."""
        n = len(symbol)
        rows = np.arange(n)

        def shifted(values: np.ndarray, by: int) -> np.ndarray:
            ok = left > by
            out = np.zeros(n, dtype=np.int64)
            out[ok] = values[rows[ok] + by]
            return out

        key, depth = symbol << 32 | shifted(symbol, SYMBOL), 2 * SYMBOL
        while True:
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([1], key[order[1:]] != key[order[:-1]]))
            if depth >= left.max() or new.all():
                return order
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            key = rank << 32 | shifted(rank, depth)
            depth *= 2


def merge(shards: list[Shard], rounds: int, narrow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all shards in one order by their first ``rounds`` symbols, the number of symbols each shares with the one before
    (``rounds``: at least so many), and the block of rows that share all ``rounds``."""
    before = np.concatenate([s.before for s in shards])
    rows = np.concatenate([s.rows for s in shards])
    kind = np.uint8 if len(shards) <= 256 else np.uint16
    # Each shard's suffixes in turn, all in one block: the interleave by no symbols.
    source = np.repeat(np.arange(len(shards), dtype=kind), [len(s.rows) for s in shards])
    ended = np.repeat(np.arange(len(shards), dtype=kind), [s.ends for s in shards])
    n, ends = len(rows), len(ended)
    common = np.full(n, rounds, dtype=np.int32)
    common[0] = 0
    border = np.zeros(n, dtype=bool)
    border[0] = True
    symbol = np.empty(n, dtype=np.int32)
    for h in range(1, rounds + 1):
        block = np.cumsum(border, dtype=np.int32)
        symbol[np.argsort(source, kind="stable")] = before
        inner = np.flatnonzero(symbol >= 0)
        dealt = symbol[inner]
        order = np.argsort(dealt.astype(np.uint16) if narrow else dealt, kind="stable")
        inner, dealt = inner[order], dealt[order]
        block = block[inner]
        now = np.zeros(n, dtype=bool)
        now[0] = now[min(ends, n - 1)] = True
        np.logical_or(dealt[1:] != dealt[:-1], block[1:] != block[:-1], out=now[ends + 1 :])
        source = np.concatenate((ended, source[inner]))
        fresh = np.flatnonzero(now != border)
        if not len(fresh):
            break
        common[fresh] = h - 1
        border = now
    at = np.empty(n, dtype=np.int64)
    at[np.argsort(source, kind="stable")] = rows
    return at, common, np.cumsum(border)


def repeated_windows(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that share a repeated interval with another: string, offset and interval."""
    every = Rows(strings)
    # Shards end where their bytes first exceed a multiple of SHARD_BYTES.
    share = (every.first[1:] - 1) // SHARD_BYTES
    cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(strings)]
    rows, _, block = merge([Shard(every, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], window // SYMBOL, every.narrow)
    owner = np.searchsorted(every.first, rows, side="right") - 1
    offset = rows - every.first[owner]
    full = offset + window <= every.lengths[owner]
    owner, offset, block = owner[full], offset[full], block[full]
    times = np.bincount(block)
    twice = times[block] > 1 if len(block) else np.zeros(0, dtype=bool)
    return owner[twice], offset[twice], block[twice]


def _merged(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that go, from strings sorted by group."""
    for table in runs(batches, ["key"]):
        key = table.column("key").to_numpy()
        sizes = np.cumsum(pa.compute.binary_length(table.column("bytes")).to_numpy().astype(np.int64))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        # Whole groups up to the size that is merged at once.
        cut, done = [0], 0
        for a in starts[1:].tolist():
            if sizes[a - 1] - done > MERGE_BYTES:
                cut.append(a)
                done = sizes[a - 1]
        for a, b in zip(cut, [*cut[1:], table.num_rows], strict=True):
            part = table.slice(a, b - a)
            owner, offset, block = repeated_windows(part.column("bytes").to_pylist(), window)
            doc, row_key, lo = (part.column(c).to_numpy().astype(np.int64)[owner] for c in ("doc_id", "row_key", "lo"))
            at = lo + offset
            order = np.lexsort((at, row_key, doc, block))
            doc, row_key, at, block = doc[order], row_key[order], at[order], block[order]
            opens = np.ones(len(block), dtype=bool)
            opens[1:] = block[1:] != block[:-1]
            lowest = doc[opens][np.cumsum(opens) - 1]
            opens[1:] |= (doc[1:] != doc[:-1]) | (row_key[1:] != row_key[:-1])
            goes = (doc > lowest) | (at > at[opens][np.cumsum(opens) - 1])
            doc, row_key, at = doc[goes], row_key[goes], at[goes]
            order = np.lexsort((at, row_key, doc))
            doc, row_key, at = doc[order], row_key[order], at[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (row_key[1:] != row_key[:-1]) | (at[1:] > at[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.concatenate((head[1:], [len(at)]))[: len(head)] - 1
            spans = {"doc_id": pa.array(doc[head]), "row_key": pa.array(row_key[head])}
            yield pa.RecordBatch.from_pydict(spans | {"lo": pa.array(at[head].astype(np.int32)), "hi": pa.array((at[tail] + window).astype(np.int32))})


def _kept(batch: pa.RecordBatch, texts: bool) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
    for raw, ranges in zip(_raw(batch), batch.column("ranges").to_pylist(), strict=True):
        merged: list[list[int]] = []
        for a, b in sorted((r["lo"], r["hi"]) for r in ranges or ()):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        edges = [0, *[x for span in merged for x in span], len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
        for name, value in zip(out, (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in merged]), strict=True):
            out[name].append(value)
    columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())}
    if texts:
        columns |= {"kept": pa.array(out["kept"], pa.binary()), "spans": pa.array(out["spans"], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))}
    return columns


def remove_repeated_bytes(docs: DataFrame, ws: Workspace, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP, texts: bool = False) -> DataFrame:
    """One row per document: counts and digest of the bytes left; with ``texts`` those bytes and the removed ranges too.
    ``window`` is a multiple of four (a symbol's bytes)."""
    if window % SYMBOL or not 8 <= anchor < window:
        raise ValueError("the window must be a multiple of four and longer than the anchor")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = keyed_texts(docs)
    known = docs.where("doc_id IS NOT NULL")
    span = ["doc_id", "row_key", "lo", "cast(lo + length(bytes) AS int) AS hi"]
    times = arrow_map(known, lambda b: _anchors(b, window, anchor), "anchor long, times int")
    times = ws.keep(times.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor"), "anchors")
    schema = "doc_id long, row_key long, anchor long, p1 long, p2 long, lo int, n int, at int, again boolean"
    paths = arrow_map(known, lambda b: _paths(b, window, anchor), schema)
    paths = ws.keep(paths.join(times, "anchor", "left_semi"), "paths")
    spans = [paths.where("again").selectExpr("doc_id", "row_key", "lo", f"lo + n - 1 + {window} AS hi")]
    # Copies are told from the first one by a join of two written tables, whose hot keys adaptive execution splits.
    equal = ["anchor", "p1", "p2"]
    paths = paths.where("NOT again")
    firsts = ws.keep(paths.groupBy(*equal).agg(F.min("doc_id").alias("source")), "firsts")
    branching = ws.keep(firsts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "branching")
    firsts = ws.keep(firsts.join(branching.withColumn("branches", F.lit(True)), "anchor", "left"), "firsts-marked")
    judged = ws.keep(paths.join(firsts, equal).where("doc_id > source OR branches").select("doc_id", "row_key", "lo", "n", "at", "source"), "judged")
    ws.drop("anchors", "firsts", "branching", "firsts-marked")
    spans.append(judged.where("doc_id > source").selectExpr("doc_id", "row_key", "lo", f"lo + n - 1 + {window} AS hi"))
    # A document's own paths come together, which its own length bounds.
    wanted = judged.where("doc_id = source").groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("lo", "n", "at")).alias("wanted"))
    cut = known.withColumn("row_key", F.expr(_TEXT_KEY)).join(wanted, ["doc_id", "row_key"])
    strings = arrow_map(cut, lambda b: _cut(b, window), "doc_id long, row_key long, lo int, at int, bytes binary")
    hot = ws.keep(strings, "strings").withColumns({"x": F.lit(0), "y": F.lit(window - anchor)})
    small, k = [], 0
    while k == 0 or not hot.isEmpty():
        parts = halves(hot, window)
        counted = ws.keep(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"groups-{k}")
        parts = ws.keep(parts.join(counted, "key"), f"parts-{k}")
        small.append(parts.where(f"n <= {group}").drop("n"))
        copies, hot = _first_copies(parts.where(f"n > {group}").drop("n"), ws, f"large-{k}")
        spans.append(copies.selectExpr(*span))
        # Where the anchor has one place left equal strings are equal windows: nothing is left to compare.
        hot = ws.keep(hot.where("x < y"), f"hot-{k}")
        k += 1
    strings = small[0]
    for more in small[1:]:
        strings = strings.unionByName(more)
    strings = strings.select("key", "doc_id", "row_key", "lo", "bytes").repartition(tasks, "key").sortWithinPartitions("key")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  (bound as pa.compute on the executors too)

        yield from _merged(batches, window)
        pa.default_memory_pool().release_unused()

    spans.append(strings.mapInArrow(work, "doc_id long, row_key long, lo int, hi int"))
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    by_row = found.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    by_row = ws.keep(by_row, "ranges")
    ws.drop("paths", "judged", "strings", *[name.format(i) for name in ("groups-{}", "parts-{}", "hot-{}", "large-{}-own", "large-{}-low") for i in range(k)])
    keyed = known.withColumn("row_key", F.expr(_TEXT_KEY))
    joined = keyed.join(by_row, ["doc_id", "row_key"], "left").select("doc_id", "text", "ranges")
    # Rows without an id take no part in the join: they would all meet in one task.
    joined = joined.unionByName(docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("ranges")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return arrow_map(joined, lambda b: _kept(b, texts), schema + ", kept binary, spans array<struct<lo:int,hi:int>>" * texts)
