"""MinHash near-duplicate classes: one-permutation hashing, banded buckets, star-shaped candidates.

1. Every text becomes its set of distinct 5-word shingles, and equal sets collapse into one class
   before anything is paired, so copies never meet each other.
2. A class's set gives 128 minima by one permutation, empty bins filled by optimal densification;
   bands of as many bins as the threshold allows give bucket keys. At 0.85 and at 0.80 these are 32 bands
   of four: a pair at the threshold shares no bucket with a chance of (1 - 0.85**4)**32, about 6e-11, or
   (1 - 0.80**4)**32, about 5e-8.
3. Within a bucket only a star is proposed: each member with the bucket's hub, the member that shares
   most buckets. Pairs whose signatures agree in too few bins (five standard deviations below the
   threshold) are left out; the others are confirmed on the full sets, and the links contracted
   into components.
4. What a star can miss are links between members of one bucket that are still in different
   components. Those are looked for exactly: members of such a bucket are compared by signature inside a task,
   those with a likely partner get their full sets, and the task confirms on them. Tasks return only links,
   never candidate pairs.
5. A bucket of more than a block (pages that share a template, say) isn't compared all with all. Its members are put
   under the rarest shingles of their sets instead: linked sets have one of the first n - ceil(t * n) + 1 in common,
   in one order for all, rare ones first. That loses no link, and what very many share comes last. Groups under one
   shingle that are longer than a block are dealt out as pairs of bounded blocks.

Defined results: A-Z is lower-cased, nothing else; fewer than five words are one shingle; a null, empty or
wordless text has an empty set and is linked with nothing; a null doc_id is linked with nothing and kept;
rows that share a doc_id are one node, and fully repeated rows get equal results; of hubs that share equally many buckets the
smallest id is one; texts of any length are read whole; an empty table gives an empty result; other
columns are ignored by :func:`near_duplicates` and passed on untouched by :func:`keep_representatives`.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import Workspace, arrow_map, keyed_texts, lower_keys, runs
from .components import components
from .textkernel import Words

#: Links have 100 * intersection >= threshold * union; this one unless another is given.
THRESHOLD = 85
#: Members of a bucket block; a task holds two blocks.
BLOCK = 512


@dataclass(frozen=True)
class Limits:
    """What follows from the threshold, a similarity in hundredths."""

    threshold: int = THRESHOLD

    @property
    def least_agreement(self) -> float:
        """Least share of equal bins for a pair to be confirmed: five standard deviations of the bins below
        the threshold, rounded down to hundredths."""
        t = self.threshold / 100
        return max(0, math.floor(100 * (t - 5 * math.sqrt(t * (1 - t) / minhash.BINS)))) / 100

    @property
    def rows(self) -> int:
        return minhash.rows_for(self.threshold / 100)

    @property
    def bands(self) -> int:
        return minhash.BINS // self.rows


def _features(batch: pa.RecordBatch, rows: int = minhash.ROWS) -> dict:
    n, k1, k2, sig, keys = [], [], [], [], []
    for members in minhash.shingle_sets(Words(batch.column("text").to_pylist(), lower=True)):
        n.append(len(members))
        digest = np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), dtype=np.int64)
        k1.append(int(digest[0]))
        k2.append(int(digest[1]))
        if len(members):
            s = minhash.signature(members)
            sig.append((s & np.uint64(255)).astype(np.uint8).tobytes())
            keys.append(minhash.bands(s, rows).view(np.int64))
        else:
            sig.append(b"")
            keys.append(np.zeros(0, dtype=np.int64))
    return {
        "doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()),
        "sig": pa.array(sig, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64())),
    }


def _sets(batch: pa.RecordBatch) -> dict:
    sets = minhash.shingle_sets(Words(batch.column("text").to_pylist(), lower=True))
    return {"node": batch.column("doc_id"), "members": pa.array([s.tobytes() for s in sets], pa.binary())}


def _linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def _confirm_stars(batches: Iterable[pa.RecordBatch], threshold: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node, members) sorted by hub and block, the hub's own row first in each block."""
    hub_id, hub_set = None, None
    for batch in batches:
        u, v = [], []
        for hub, node, raw in zip(*(batch.column(c).to_pylist() for c in ("hub", "node", "members")), strict=True):
            if hub == node:
                hub_id, hub_set = hub, _as_set(raw)
            elif hub == hub_id and _linked(hub_set, _as_set(raw), threshold):
                u.append(hub)
                v.append(node)
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in table.column_names if not pa.types.is_binary(table.schema.field(c).type) and not pa.types.is_list(table.schema.field(c).type)}


def _groups(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """Rows with equal (key, bi, bj), and where they start."""
    c = _columns(table.select(["key", "bi", "bj"]))
    new = (c["key"][1:] != c["key"][:-1]) | (c["bi"][1:] != c["bi"][:-1]) | (c["bj"][1:] != c["bj"][:-1])
    edge = np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))
    for a, b in itertools.pairwise(edge.tolist()):
        yield a, table.slice(a, b - a).combine_chunks()


def _likely(group: pa.Table, limits: Limits) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block pair, its likely partners: of another component, close in size, alike
    in signature, and with no lower list in common."""
    c = _columns(group)
    comp, size, block = c["component"], c["n_shingles"], c["block"]
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, minhash.BINS)
    left, right = np.flatnonzero(block == c["bi"][0]), np.flatnonzero(block == c["bj"][0])
    bits = None
    for i in left.tolist():
        js = right[right > i] if c["bi"][0] == c["bj"][0] else right
        js = js[(comp[js] != comp[i]) & (100 * np.minimum(size[js], size[i]) >= limits.threshold * np.maximum(size[js], size[i]))]
        if len(js):
            js = js[(sig[js] == sig[i]).mean(axis=1) >= limits.least_agreement]
        if len(js):
            if bits is None:
                lists = group.column("lists").combine_chunks()
                rows = np.repeat(np.arange(group.num_rows), np.asarray(lists.value_lengths()))
                bits = lower_keys(rows, lists.flatten().to_numpy(), group.num_rows, int(c["key"][0]))
            js = js[~(bits[js] & bits[i]).any(axis=1)]
        if len(js):
            yield i, js


def _flag(batches: Iterable[pa.RecordBatch], limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Members of block pairs that have a likely partner there."""
    for table in runs(batches, ["key", "bi", "bj"]):
        wanted = np.zeros(table.num_rows, dtype=bool)
        for a, group in _groups(table):
            for i, js in _likely(group, limits):
                wanted[a + i] = True
                wanted[a + js] = True
        yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()


def _confirm_blocks(batches: Iterable[pa.RecordBatch], limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Links between likely partners of block pairs, confirmed on the full sets; links within what the
    same block pair has joined already are left out."""
    for table in runs(batches, ["key", "bi", "bj"]):
        u, v = [], []
        for _, group in _groups(table):
            comp, node = group.column("component").to_numpy().copy(), group.column("node").to_numpy()
            sets = [_as_set(raw) for raw in group.column("members").to_pylist()]
            for i, js in _likely(group, limits):
                for j in js.tolist():
                    if comp[i] != comp[j] and _linked(sets[i], sets[j], limits.threshold):
                        u.append(int(node[i]))
                        v.append(int(node[j]))
                        comp[comp == comp[j]] = comp[i]
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each set."""
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("members").to_pylist(), strict=True):
            members = np.frombuffer(raw, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(len(members), node)), "shingle": pa.array(members)})


def _rarest(nodes: DataFrame, sets: DataFrame, limits: Limits, ws: Workspace) -> DataFrame:
    """(node, lists): of each set the rarest shingles, as many as must hold one of any linked set's. Shingles of one
    set alone count among them but are no lists."""
    shingles = ws.keep(nodes.join(sets, "node").select("node", "members").mapInArrow(_shingles, "node long, shingle long"), "shingles")
    times = ws.keep(shingles.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"), "times")
    ranked = shingles.join(times, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    size = shingles.groupBy("node").agg(F.count("*").alias("n"))
    first = F.expr(f"n - (n * {limits.threshold} + 99) div 100 + 1 - (n - size(shared))").cast("int")
    lists = F.transform(F.slice("shared", F.lit(1), F.greatest(F.lit(0), first)), lambda s: s["shingle"])
    return ranked.join(size, "node").select("node", lists.alias("lists")).where("size(lists) > 0")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(docs: DataFrame, ws: Workspace, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    limits = Limits(threshold)
    rows = limits.rows
    docs = keyed_texts(docs)
    n = _partitions(docs)
    features = ws.keep(arrow_map(docs, lambda batch: _features(batch, rows), "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"), "features")
    linkable = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Aggregates are written before they join back to what they sum up: adaptive execution splits the hot
    # keys (a third of all rows may be copies) of a join of two scans, not those of a join with an aggregate.
    classes = ws.keep(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "classes")
    member = ws.keep(linkable.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "n_shingles", "node"), "member")
    # Rows that link with nothing take no part in joins: they would all meet under one key.
    loose = ws.keep(features.where("NOT coalesce(n_shingles > 0 AND doc_id IS NOT NULL, false)").select("doc_id", "n_shingles"), "loose")
    reps = linkable.join(classes.withColumn("doc_id", F.col("node")), ["k1", "k2", "doc_id"]).select("node", "n_shingles", "sig", "bands")

    # Buckets of two members or more, and each member's number of bucket neighbours.
    cells = reps.select("node", F.explode("bands").alias("key"))
    sizes = cells.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    sizes = ws.keep(sizes.select("key", "n"), "sizes")
    cells = ws.keep(cells.join(sizes, "key"), "cells")
    nodes = ws.keep(cells.groupBy("node").agg(F.sum("n").alias("degree")), "nodes")
    reps = ws.keep(reps.join(nodes, "node"), "reps")
    hubs = cells.join(nodes, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("low"))).alias("best"))
    hubs = ws.keep(hubs.select("key", (-F.col("best.low")).alias("hub")), "hubs")
    stars = cells.join(hubs, "key").where("node <> hub").select("hub", "node").distinct()

    small = reps.select("node", "n_shingles", "sig")
    alike = F.expr(f"aggregate(sequence(1, {minhash.BINS}), 0, (s, i) -> s + if(substring(sig, i, 1) = substring(hub_sig, i, 1), 1, 0))")
    stars = (
        stars.join(small, "node")
        .join(small.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sig").alias("hub_sig")), "hub")
        .where(f"100 * least(n_shingles, hub_n) >= {threshold} * greatest(n_shingles, hub_n)")
        .where(alike >= int(limits.least_agreement * minhash.BINS))
        .select("hub", "node")
    )
    stars = ws.keep(stars, "stars")

    # Full sets of the documents that share a bucket with another.
    sets = ws.keep(arrow_map(docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"]), _sets, "node long, members binary"), "sets", "lz4")
    # A star is dealt in blocks, each with a copy of the hub's set, so no task gets the whole of a large one.
    blocks = ws.keep(stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "star-blocks")
    pairs = stars.join(blocks, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    own = blocks.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = pairs.union(own).join(sets, "node").repartition(n, "hub", "block").sortWithinPartitions("hub", "block", F.col("node") != F.col("hub"))
    links = ws.keep(dealt.select("hub", "node", "members").mapInArrow(lambda batches: _confirm_stars(batches, threshold), "u long, v long"), "links")
    found = ws.keep(components(links, ws, "star"), "star")

    # The rest, exactly: buckets that still hold several components; those longer than a block by rare shingles.
    label = F.coalesce("component", "node").alias("component")
    cells = cells.join(found, "node", "left").select("key", "node", label)
    span = (F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"))
    mixed = ws.keep(cells.groupBy("key").agg(*span).where("a <> b").select("key", "n"), "mixed")
    large = ws.keep(cells.join(mixed.where(f"n > {BLOCK}"), "key").select("node", "component").distinct(), "large")
    order = ["key", "bi", "bj"]
    names = ["key", "node", "component", "block", "bi", "bj", "n_shingles", "sig", "lists"]
    zero = F.lit(0)
    short = cells.join(mixed.where(f"n <= {BLOCK}"), "key").select("key", "node", "component", zero.alias("block"), zero.alias("bi"), zero.alias("bj"))
    rest = short.join(reps.select("node", "n_shingles", "sig", F.col("bands").alias("lists")), "node").select(*names)
    if not large.isEmpty():
        rarest = ws.keep(_rarest(large.select("node"), sets, limits, ws), "rarest")
        under = ws.keep(rarest.join(large, "node").select("node", "component", F.explode("lists").alias("key")), "under")
        groups = under.groupBy("key").agg(*span).where("a <> b")
        groups = ws.keep(groups.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "groups")
        under = under.join(groups, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        under = under.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        under = under.select("key", "node", "component", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
        rest = rest.unionByName(under.join(reps.select("node", "n_shingles", "sig"), "node").join(rarest, "node").select(*names))
    columns = "key long, node long, component long, block int, bi int, bj int, n_shingles long, sig binary, lists array<long>"
    flagged = ws.keep(rest.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _flag(batches, limits), columns), "flagged")
    dealt = flagged.join(sets, "node").repartition(n, *order).sortWithinPartitions(*order)
    more = ws.keep(dealt.select(*names, "members").mapInArrow(lambda batches: _confirm_blocks(batches, limits), "u long, v long"), "more")
    if not more.isEmpty():
        found = ws.keep(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), ws, "all"), "all")
    ws.drop("features", "classes", "sizes", "hubs", "star-blocks", "mixed", "cells", "nodes", "reps", "stars", "sets", "links", "flagged", "more")
    ws.drop("large", "shingles", "times", "rarest", "under", "groups")

    out = member.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = out.unionByName(loose.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, ws: Workspace, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their group (and those linked with nothing), all columns as
    they are. Of rows that share a doc_id and are kept, all stay."""
    verdict = near_duplicates(docs, ws, threshold)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    gone = verdict.where("NOT kept").select("doc_id").distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row).join(gone, "doc_id", "left_anti").select("row.*")
