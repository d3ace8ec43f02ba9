"""Exact triangle counting over normalised edges, with interchangeable strategies.

A triangle is (v, u, w) with edges v->u, v->w, u->w. Roles: G2 holds v->u, G1 holds v->w, G0 closes
with u->w. All strategies return the same count. A vertex has at most the square root of twice the edges as neighbours below it: by the order of
the ids where that gives such lists, else by degrees, whatever the hubs. Tables that a strategy writes to the shared folder are dropped once the count is there.

Wedges are never rows of a shuffle: neighbour lists meet in jobs (:mod:`trigrid.closing`), where they are closed at once.

``oriented``            wedges of the lists, closed by bisection in the sorted lists of their middle vertices
``hash``                the same wedges, probing a table of hashed closing edges first
``intersect``           lists of both ends of an edge, intersected
``bitmap``              neighbours as words of 64 bits, probed word by word
``edge_iterator``       every edge with its far list, probed by hash
``grid``, ``sharded``   triangles counted by grid triples, or by shard triples at a depth
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import closing, graph, partition, scans
from .storage import Workspace


def _roles(e: DataFrame, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    def named(role: int, src: str, dst: str) -> DataFrame:
        return e.select(F.col("src").alias(src), F.col("dst").alias(dst), *[F.col(c).alias(f"{c}{role}") for c in extra or []])

    return named(0, "u", "w"), named(1, "v", "w"), named(2, "v", "u")


def wedges(e: DataFrame) -> DataFrame:
    """Pairs of edges with one source: v, u, w. With edges pointed to smaller ids the closing edge has
    u > w, so each wedge is made once."""
    _, g1, g2 = _roles(e)
    return g2.join(g1, "v").where("u > w")


def wedge_count(e: DataFrame) -> DataFrame:
    """Number of wedges, from out-degrees alone."""
    return e.groupBy("src").agg(F.count("*").alias("d")).agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).cast("long").alias("wedges"))


def pointed(e: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Simple edges from the lower to the higher degree, written as ``pointed``; ``e`` is read once."""
    ws = ws or Workspace(e.sparkSession)
    kept = ws.keep(graph.normalize(e), "edges")
    # A set number of tasks: edges are few bytes, but the wedges made of them are many rows.
    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = ws.keep(graph.orient_by_degree(kept, simple=True).repartition(tasks, "src"), "pointed")
    ws.drop("edges")
    return out


def list_triangles(e: DataFrame) -> DataFrame:
    """v, u, w of every triangle of any edge list, v > u > w."""
    t = oriented_triangles(e)
    high, low = F.greatest("a", "b", "c"), F.least("a", "b", "c")
    return t.select(high.alias("v"), (F.col("a") + F.col("b") + F.col("c") - high - low).alias("u"), low.alias("w"))


def oriented_triangles(e: DataFrame) -> DataFrame:
    """Triangles (as a, b, c with a the vertex of lowest degree) of any edge list."""
    return _closed(pointed(e))


def _closed(o: DataFrame, hint: str | None = None) -> DataFrame:
    ab = o.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ac = o.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    pairs = ab.join(ac, "a").where("b < c")
    # The third edge may point either way; by its smaller end it has one form.
    closing = o.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c"))
    return pairs.join(closing.hint(hint) if hint else closing, ["b", "c"]).select("a", "b", "c")


def _intersect(e: DataFrame) -> DataFrame:
    adj = e.groupBy("src").agg(F.collect_list("dst").alias("nbrs"))
    left = adj.select("src", F.col("nbrs").alias("a"))
    right = adj.select(F.col("src").alias("dst"), F.col("nbrs").alias("b"))
    return e.join(left, "src").join(right, "dst").select(F.size(F.array_intersect("a", "b")).cast("long").alias("n"))


def bit_arrays(e: DataFrame) -> DataFrame:
    """Neighbour sets as two-level bit arrays, a row for each source and block of 4096 targets: ``summary`` has a bit for each of the
    block's 64 words that isn't zero, ``words`` (64 bits each) only those, in order. The word of bit k stands at the number of
    summary bits below k."""
    word = F.expr("bit_or(shiftleft(1L, cast(dst % 64 AS int)))")
    words = e.groupBy("src", F.expr("dst div 64").alias("word")).agg(word.alias("bits"))
    cell = F.struct(F.expr("cast(word % 64 AS int)").alias("k"), "bits")
    rows = words.groupBy("src", F.expr("word div 64").alias("block")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("src", "block", F.expr("aggregate(cells, 0L, (s, c) -> s | shiftleft(1L, c.k))").alias("summary"), F.transform("cells", lambda c: c["k"]).alias("ks"), F.transform("cells", lambda c: c["bits"]).alias("words"))


def _common_bits(e: DataFrame) -> DataFrame:
    """Common neighbours of both ends of each edge, a row (n) for each block in which their summaries meet."""
    blocks = bit_arrays(e)
    mine = blocks.select("src", "block", F.col("summary").alias("sa"), F.col("words").alias("wa"), F.col("ks").alias("ka"))
    theirs = blocks.select(F.col("src").alias("dst"), "block", F.col("summary").alias("sb"), F.col("words").alias("wb"))
    met = e.join(mine, "src").join(theirs, ["dst", "block"]).where("(sa & sb) <> 0")
    below = "bit_count(sb & ~shiftleft(-1L, k))"
    both = f"zip_with(ka, wa, (k, a) -> CASE WHEN shiftright(sb, k) & 1 = 1 THEN bit_count(a & get(wb, {below})) ELSE 0 END)"
    return met.select(F.expr(f"aggregate({both}, 0L, (n, x) -> n + x)").alias("n"))


#: How the jobs of a strategy look up closing edges.
PROBE = {"hash": "hash", "oriented": "sorted", "intersect": "sorted", "bitmap": "bits", "edge_iterator": "hash"}


def _lists(e: DataFrame, ws: Workspace) -> tuple[DataFrame, int, int | None]:
    """Neighbour lists of simple edges (src > dst, with labels or not; read several times), written as ``lists``, the number of edges, and in how many low
    bits of what the lists hold the ids stand (None: all).

    Lists should have at most as many entries as the square root of twice the edges. Where the order of the ids gives such lists, edges are taken as
    they are. Else edges point from the higher to the lower rank: a rank is the degree, counted down, before the id, in one number, and
    a vertex of low degree ranks high. Where degree and id don't fit a long, or ids are negative, ids are the ranks."""
    size = e.agg(F.count("*").alias("m"), F.max("src").alias("top"), F.min("dst").alias("low")).first()
    longest = e.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    label = [F.col("label")] if "label" in e.columns else []
    low, top, bits = size["low"] or 0, size["top"] or 0, None
    if longest**2 > 2 * size["m"] and low >= 0:
        deg = ws.keep(graph.degrees(e), "degrees")
        most = deg.agg(F.max("degree")).first()[0] or 0
        bits = max(1, top.bit_length())
        need = bits + most.bit_length()
        bits = bits if need < 63 else None
    if bits is not None:
        kind = "int" if need < 32 else "long"
        rank = deg.select("vid", ((F.lit(most) - F.col("degree")) * (1 << bits) + F.col("vid")).cast(kind).alias("rank"))
        pairs = e.join(rank.select(F.col("vid").alias("src"), F.col("rank").alias("s")), "src").join(rank.select(F.col("vid").alias("dst"), F.col("rank").alias("d")), "dst")
        pairs = pairs.select(F.greatest("s", "d").alias("src"), F.least("s", "d").alias("dst"), *label)
    else:
        kind = "int" if -(1 << 31) <= low and top < 1 << 31 else "long"
        pairs = e.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), *label)
    lists = ws.keep(closing.neighbours(pairs, graph.tasks_for(e.sparkSession, size["m"])), "lists")
    ws.drop("degrees")
    return lists, size["m"], bits


def _simple(e: DataFrame, simple: bool) -> DataFrame:
    """Normalised edges; those that are so already (``simple``) are not dealt and grouped once more."""
    return e.select("src", "dst") if simple else graph.normalize(e)


def count(e: DataFrame, strategy: str = "oriented", width: int = partition.WIDTH, depth: int = 2, simple: bool = False) -> DataFrame:
    """One row, ``triangles``, of any edge list. ``simple``, here and below: ``e`` is normalised already."""
    ws = Workspace(e.sparkSession)
    if strategy in PROBE:
        lists, m, _ = _lists(ws.keep(_simple(e, simple), "edges"), ws)
        out = closing.total(lists, m, PROBE[strategy])
    elif strategy in ("grid", "sharded"):
        lists, m, bits = _lists(ws.keep(_simple(e, simple), "edges"), ws)
        # Counts of one triple from several jobs add up as well without being brought together first.
        out = closing.by_label(lists, m, bits, width if strategy == "grid" else max(1, width >> depth))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = out.agg(F.sum("triangles").alias("triangles"))
    out = ws.keep(out.select(F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles")), "count")
    ws.drop("edges", "lists")
    return out


def _by_label(e: DataFrame, ws: Workspace, width: int | None = None) -> DataFrame:
    """Counts of simple edges by the labels of the three edges (l0, l1, l2), where they have them, and by the strips of their vertices (v, u, w) of a width."""
    lists, m, bits = _lists(e, ws)
    names = closing.label_names(lists, width)
    found = closing.by_label(lists, m, bits, width).repartition(graph.tasks_for(e.sparkSession, m), *names)
    out = ws.keep(found.groupBy(*names).agg(F.sum("triangles").alias("triangles")), "job-results")
    ws.drop("lists")
    return out


def per_grid_triple(e: DataFrame, width: int = partition.WIDTH, simple: bool = False) -> DataFrame:
    """Triangles by the grid triple of their edges: i (middle vertex), grid_row, grid_col."""
    ws = Workspace(e.sparkSession)
    t = _by_label(ws.keep(_simple(e, simple), "edges"), ws, width)
    ws.drop("edges")
    return t.select(F.col("u").alias("i"), F.col("v").alias("grid_row"), F.col("w").alias("grid_col"), "triangles")


def per_shard_triple(e: DataFrame, depth: int, width: int = partition.WIDTH, simple: bool = False) -> DataFrame:
    """Triangles by the shards of v, u and w at one depth (v_shard, u_shard, w_shard are global shard
    positions along an axis)."""
    t = per_grid_triple(e, max(1, width >> depth), simple)
    return t.select(F.col("grid_row").alias("v_shard"), F.col("i").alias("u_shard"), F.col("grid_col").alias("w_shard"), "triangles")


def _named(counts: DataFrame, names: DataFrame) -> DataFrame:
    """g0, g1, g2 in place of their labels; ``names`` has a row (label, s) for each."""
    for r in range(3):
        counts = counts.join(names.select(F.col("label").alias(f"l{r}"), F.col("s").alias(f"g{r}")), f"l{r}")
    return counts.select("g0", "g1", "g2", "triangles")


def _numbered(rows: DataFrame, key: list[str], ws: Workspace) -> DataFrame:
    """Different keys with a ``label`` from 0 without gaps, of few bytes: each edge carries it to each of its jobs."""
    rows = ws.keep(rows.select(*key), "keys")
    kind = "int" if rows.count() < 1 << 31 else "long"
    out = ws.keep(scans.indexed(rows, key, ws, "key-runs", "label").withColumn("label", F.col("label").cast(kind)), "numbered")
    ws.drop("keys", "key-runs")
    return out


def _by_shard(e: DataFrame, shards: DataFrame, width: int, ws: Workspace) -> DataFrame:
    """Normalised edges with the number of their shard as ``label``, written as ``labelled``. ``shards`` are numbered."""
    return ws.keep(partition.with_leaf(e, shards, width, extra=("label",)).select("src", "dst", "label"), "labelled")


def per_job(e: DataFrame, shards: DataFrame, width: int = partition.WIDTH, simple: bool = False) -> DataFrame:
    """Triangles of each surviving shard triple of a catalogue with mixed depths (g0, g1, g2 structs). ``simple``: ``e`` is a written table of normalised edges."""
    ws = Workspace(e.sparkSession)
    key = ["gr", "gc", "depth", "sr", "sc"]
    shards = _numbered(shards, key, ws)
    kept = e.select("src", "dst") if simple else ws.keep(graph.normalize(e), "normalised")
    counts = _by_label(_by_shard(kept, shards, width, ws), ws)
    out = ws.keep(_named(counts, shards.select("label", F.struct(*key).alias("s"))), "counts")
    ws.drop("normalised", "labelled", "numbered", "job-results")
    return out


def over_jobs(e: DataFrame, shards: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """One row, ``triangles``: those of all jobs over the shards of all of ``e``, a written table of normalised edges.

    Counts of jobs add up without being brought together or named first. Where all shards have one depth, an edge's shard follows from its ids."""
    ws = Workspace(e.sparkSession)
    depth = partition.one_depth(shards)
    if depth is not None and width >> depth << depth == width:
        lists, m, bits = _lists(e.select("src", "dst"), ws)
        found = closing.by_label(lists, m, bits, width >> depth)
    else:
        shards = _numbered(shards, ["gr", "gc", "depth", "sr", "sc"], ws)
        lists, m, bits = _lists(_by_shard(e, shards, width, ws), ws)
        found = closing.by_label(lists, m, bits)
    out = ws.keep(found.agg(F.coalesce(F.sum("triangles"), F.lit(0)).cast("long").alias("triangles")), "count")
    ws.drop("labelled", "numbered", "lists")
    return out


def per_slice_triple(e: DataFrame, size: int, width: int = partition.WIDTH, simple: bool = False) -> DataFrame:
    """Triangles of each triple of linear slices (g0, g1, g2 structs of gr, gc, slice).

    Grids follow from the ids. Only edges of grids that have more than one slice are sorted for theirs; where no grid has, edges carry no label."""
    ws = Workspace(e.sparkSession)
    e = ws.keep(_simple(e, simple), "edges")
    sizes = partition.with_grid(e, width).groupBy("gr", "gc").agg(F.count("*").alias("n")).where(F.col("n") > size)
    sizes = ws.keep(sizes, "several")
    most = sizes.agg(F.max("n")).first()[0]
    if most is not None:
        placed = partition.with_grid(e, width).join(sizes, ["gr", "gc"], "left")
        several = partition.with_slice(placed.where("n IS NOT NULL").select("src", "dst"), size, width).select("src", "dst", F.col("slice").alias("label"))
        whole = several.unionByName(placed.where("n IS NULL").select("src", "dst", F.lit(0).alias("label")))
        e = ws.keep(whole.withColumn("label", F.col("label").cast("int" if most // size < 1 << 31 else "long")), "labelled")
    counts = _by_label(e, ws, width)
    if most is None:
        counts = counts.withColumns({x: F.lit(0).cast("long") for x in closing.LABELS})
    ws.drop("edges", "several", "labelled")
    part = lambda r, c, k: F.struct(F.col(r).alias("gr"), F.col(c).alias("gc"), F.col(k).alias("slice"))
    return counts.select(part("u", "w", "l0").alias("g0"), part("v", "w", "l1").alias("g1"), part("v", "u", "l2").alias("g2"), "triangles")


#: Bits of an edge's label: from the larger id to the smaller, and back.
_DOWN, _UP = 1, 2
#: The directions of (v, u), (v, w) and (u, w), v > u > w, of the six orders of three vertices; the two others are cycles.
_ORDERS = [(a, b, c) for a in (_DOWN, _UP) for b in (_DOWN, _UP) for c in (_DOWN, _UP) if not a == c != b]


def transitive_triads(e: DataFrame) -> DataFrame:
    """Ordered triads v->u, v->w, u->w of a directed edge set (repeats and loops removed); counts every
    triad, wherever its grids lie.

    Each is a triangle of the graph without directions, which are counted in jobs by the directions of their edges; a triangle has as many
    triads as there are orders of its vertices that its edges follow."""
    ws = Workspace(e.sparkSession)
    way = F.when(F.col("src") > F.col("dst"), F.lit(_DOWN)).otherwise(F.lit(_UP))
    sides = graph.drop_loops(e).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"), way.alias("label"))
    lists, m, bits = _lists(ws.keep(sides.groupBy("src", "dst").agg(F.bit_or("label").alias("label")), "edges"), ws)
    orders = reduce(add, [F.when((F.col("l2").bitwiseAND(a) > 0) & (F.col("l1").bitwiseAND(b) > 0) & (F.col("l0").bitwiseAND(c) > 0), F.col("triangles")).otherwise(0) for a, b, c in _ORDERS])
    out = ws.keep(closing.by_label(lists, m, bits).agg(F.coalesce(F.sum(orders), F.lit(0)).cast("long").alias("triads")), "count")
    ws.drop("edges", "lists")
    return out
