"""Grids, quadtree shards, linear slices, compressed rows, and the jobs over them.

A grid is a square block of the adjacency matrix; a shard is a block of a grid halved ``depth`` times
along both axes. Labels are computed from the ids alone, so a shard's label always states the half
its edges lie in.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import closing, scans
from .graph import dealt, tasks_for
from .storage import Workspace

#: Default grid width.
WIDTH = 1 << 24


#: Ids of a grid whose rows a task orders at once.
ROW_CHUNK = 1 << 16


def with_grid(e: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add grid coordinates gr, gc and local ids ls, ld."""
    return e.withColumns({
        "gr": F.expr(f"src div {width}"), "gc": F.expr(f"dst div {width}"),
        "ls": F.col("src") % width, "ld": F.col("dst") % width,
    })


def grid_extent(e: DataFrame, width: int = WIDTH) -> DataFrame:
    return with_grid(e, width).agg(F.max("gr").alias("max_gr"), F.max("gc").alias("max_gc"), F.max(F.greatest("gr", "gc")).alias("max_index"))


def csr_rows(e: DataFrame, width: int = WIDTH, tasks: int | None = None) -> DataFrame:
    """The row index of each grid: each non-empty local source with its slice of the column array.

    Offsets are running sums within chunks of ``ROW_CHUNK`` ids of a grid, after the totals of the grid's earlier chunks: no task orders the
    rows of a grid, and the number of tasks grows with the rows. ``tasks``: see :func:`graph.dealt`."""
    ws = Workspace(e.sparkSession)
    chunk = F.expr(f"ls div {ROW_CHUNK}")
    row = ["gr", "gc", "ls"]
    rows = ws.keep(dealt(with_grid(e, width).select(*row), tasks, *row).groupBy(*row).agg(F.count("*").alias("n")), "rows")
    key = ["gr", "gc", "chunk"]
    placed = rows.withColumn("chunk", chunk).repartition(tasks_for(e.sparkSession, rows.count()), *key)
    placed = placed.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("ls").rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lit(0)
    if width > ROW_CHUNK:
        totals = rows.groupBy("gr", "gc", chunk.alias("chunk")).agg(F.sum("n").alias("m"))
        earlier = Window.partitionBy("gr", "gc").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.join(totals.select(*key, F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before")), key)
        before = F.col("before")
    return placed.select("gr", "gc", "ls", (before + F.col("upto") - F.col("n")).cast("long").alias("ptr_start"), (before + F.col("upto")).cast("long").alias("ptr_end"))


def adjacency(e: DataFrame, width: int = WIDTH, tasks: int | None = None) -> DataFrame:
    """The neighbours of each local source, ascending. ``tasks``: see :func:`graph.dealt`."""
    key = ["gr", "gc", "ls"]
    return dealt(with_grid(e, width).select(*key, "ld"), tasks, *key).groupBy(*key).agg(F.array_sort(F.collect_list("ld")).alias("nbrs"))


def csr_chunks(e: DataFrame, size: int, width: int = WIDTH, tasks: int | None = None) -> DataFrame:
    """Compressed rows of each grid in chunks of ``size`` edges: gr, gc, chunk, and the arrays row, ptr and col. ``ptr`` counts from the grid's
    start, so chunks in order are the grid's arrays; a source with more targets goes on in the next chunk. No array holds
    more than a chunk, however large the grid. ``tasks``: see :func:`graph.dealt`."""
    placed = with_slice(e, size, width).select("gr", "gc", "slice", (F.col("src") % width).alias("ls"), (F.col("dst") % width).alias("ld"))
    placed = dealt(placed, tasks, "gr", "gc", "slice")
    lists = placed.groupBy("gr", "gc", "slice", "ls").agg(F.array_sort(F.collect_list("ld")).alias("nbrs"))
    rows = lists.groupBy("gr", "gc", "slice").agg(F.array_sort(F.collect_list(F.struct("ls", "nbrs"))).alias("rows"))
    start = F.expr(f"slice * {size}L")
    step = F.aggregate("rows", F.array(start), lambda p, r: F.concat(p, F.array(F.element_at(p, -1) + F.size(r["nbrs"]))))
    # Offsets by running sums of the sizes: a list of sizes is short next to the chunk's columns.
    return rows.select("gr", "gc", F.col("slice").alias("chunk"), F.transform("rows", lambda r: r["ls"]).alias("row"), step.alias("ptr"), F.flatten(F.transform("rows", lambda r: r["nbrs"])).alias("col"))


def csr_arrays(e: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per grid with its row, ptr and col arrays; for grids that fit a record (:func:`csr_chunks` has no such limit)."""
    rows = adjacency(e, width).join(csr_rows(e, width), ["gr", "gc", "ls"]).groupBy("gr", "gc").agg(F.array_sort(F.collect_list(F.struct("ls", "nbrs", "ptr_end"))).alias("rows"))
    ptr = F.concat(F.array(F.lit(0).cast("long")), F.transform("rows", lambda r: r["ptr_end"]))
    return rows.select("gr", "gc", F.transform("rows", lambda r: r["ls"]).alias("row"), ptr.alias("ptr"), F.flatten(F.transform("rows", lambda r: r["nbrs"])).alias("col"))


def with_shard(e: DataFrame, depth: int, width: int = WIDTH) -> DataFrame:
    """Add the shard coordinates at a fixed depth."""
    w = max(1, width >> depth)
    return with_grid(e, width).withColumns({"depth": F.lit(depth), "sr": F.expr(f"ls div {w}"), "sc": F.expr(f"ld div {w}")})


def levels_of(width: int) -> int:
    """Halvings from a grid to one id."""
    if width & (width - 1):
        raise ValueError("quadtree grids need a width that is a power of two")
    return width.bit_length() - 1


#: Halvings that a cell above the limit is counted by at a time.
DEEPER = 4


def quadtree(e: DataFrame, limit: int, width: int = WIDTH) -> DataFrame:
    """Shards of at most ``limit`` edges (or one id wide): gr, gc, depth, sr, sc, edges; final where a shard fits and its
    parent doesn't."""
    return split(e, limit, levels_of(width), width)


def _fits(limit: int, levels: int, least: int) -> Column:
    return ((F.col("edges") <= limit) & (F.col("depth") >= least)) | (F.col("depth") == levels)


def split(e: DataFrame, limit: int, levels: int, width: int = WIDTH, least: int = 0) -> DataFrame:
    """:func:`quadtree` over ``levels`` halvings of ids local to a grid (2 ** levels at least ``width``), with shards at ``least`` deep.

    Edges are counted once, in cells of a depth at which most fit; the counts of cells, not edges, are rolled up to all
    coarser depths. Only edges in cells still above the limit are counted again, ``DEEPER`` halvings further down. That depth
    comes from the grids above the limit; where they hold few of the edges, grids themselves, counted already, are the first cells."""
    ws = Workspace(e.sparkSession)
    kept = ws.keep(e.select("src", "dst"), "edges")
    zero = F.lit(0).cast("long")
    sizes = with_grid(kept, width).groupBy("gr", "gc").agg(F.count("*").alias("edges"))
    sizes = ws.keep(sizes.select("gr", "gc", zero.alias("sr"), zero.alias("sc"), "edges"), "cells-0")
    over = F.col("edges") > limit
    size = sizes.agg(F.sum("edges").alias("m"), F.sum(F.when(over, F.col("edges"))).alias("heavy"), F.count_if(over).alias("grids")).first()
    deep = 10 * (size["heavy"] or 0) > (size["m"] or 0)
    base = min(levels, max(least, 1 + math.ceil(math.log(size["heavy"] / (max(1, limit) * size["grids"]), 4)))) if deep else least
    low, grids, leaves = 0, with_grid(kept, width).select("gr", "gc", "ls", "ld"), []
    key = ["gr", "gc", "sr", "sc"]
    while True:
        shift = levels - base
        at = grids.withColumns({"sr": F.shiftright("ls", shift), "sc": F.shiftright("ld", shift)})
        cells = ws.keep(at.groupBy(*key).agg(F.count("*").alias("edges")), f"cells-{base}") if base else sizes
        up = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(base))).alias("depth"))
        up = up.select("gr", "gc", "depth", F.expr(f"shiftright(sr, {base} - depth)").alias("sr"), F.expr(f"shiftright(sc, {base} - depth)").alias("sc"), "edges")
        counted = up.groupBy("gr", "gc", "depth", "sr", "sc").agg(F.sum("edges").alias("edges"))
        counted = ws.keep(counted.withColumn("fits", _fits(limit, levels, least)), f"counts-{base}")
        heavy = counted.where("NOT fits")
        parents = heavy.select("gr", "gc", (F.col("depth") + 1).alias("depth"), F.col("sr").alias("pr"), F.col("sc").alias("pc"))
        fits = counted.where("fits").withColumns({"pr": F.shiftright("sr", 1), "pc": F.shiftright("sc", 1)})
        # At the first depth of a pass every cell's parent was above the limit, or it is a grid.
        leaves.append(fits.where(F.col("depth") == low).drop("pr", "pc"))
        leaves.append(fits.where(F.col("depth") > low).join(parents, ["gr", "gc", "depth", "pr", "pc"], "left_semi"))
        heavy = heavy.where(F.col("depth") == base).select(*key)
        if base == levels or heavy.isEmpty():
            break
        grids = at.join(heavy, key, "left_semi").select("gr", "gc", "ls", "ld")
        low, base = base + 1, min(levels, base + DEEPER)
    out = reduce(DataFrame.unionByName, [x.select("gr", "gc", "depth", "sr", "sc", "edges") for x in leaves])
    out = ws.keep(out, "shards")
    ws.drop("edges", *[f"{name}-{d}" for name in ("cells", "counts") for d in range(levels + 1)])
    return out


def with_leaf(e: DataFrame, shards: DataFrame, width: int = WIDTH, levels: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add to each edge the shard (depth, sr, sc, and the extra columns named) of a quadtree that it lies in, and the ids local to its grid.

    Cells of the finest depth in use are looked up among the shards at the depths in use; each edge then joins its cell."""
    levels = levels_of(width) if levels is None else levels
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())
    shift = levels - (depths[-1] if depths else 0)
    g = with_grid(e, width).withColumns({"cr": F.shiftright("ls", shift), "cc": F.shiftright("ld", shift)})
    cells = g.select("gr", "gc", "cr", "cc").distinct()
    at = F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>"))
    finest = depths[-1] if depths else 0
    cells = cells.withColumn("depth", at).withColumns({"sr": F.expr(f"shiftright(cr, {finest} - depth)"), "sc": F.expr(f"shiftright(cc, {finest} - depth)")})
    found = cells.join(shards.select("gr", "gc", "depth", "sr", "sc", *extra), ["gr", "gc", "depth", "sr", "sc"])
    return g.join(found, ["gr", "gc", "cr", "cc"]).drop("cr", "cc")


def shard_name(df: DataFrame) -> DataFrame:
    """Add the file stem of a shard: ``gr-gc`` or ``gr-gc,depth,sr-sc``."""
    grid = F.concat_ws("-", "gr", "gc")
    return df.withColumn("stem", F.when(F.col("depth") == 0, grid).otherwise(F.concat_ws(",", grid, "depth", F.concat_ws("-", "sr", "sc"))))


def parse_shard_name(df: DataFrame, column: str = "stem") -> DataFrame:
    """gr, gc, depth, sr, sc of a file stem; names that aren't stems are dropped."""
    pattern = r"^(\d+)-(\d+)(?:,(\d+),(\d+)-(\d+))?$"
    part = lambda k: F.when(F.regexp_extract(column, pattern, k) != "", F.regexp_extract(column, pattern, k).cast("long"))
    zero = lambda k: F.coalesce(part(k), F.lit(0).cast("long"))
    return df.where(F.col(column).rlike(pattern)).withColumns({"gr": part(1), "gc": part(2), "depth": zero(3).cast("int"), "sr": zero(4), "sc": zero(5)})


def catalogue(shards: DataFrame, width: int = WIDTH, extra: tuple[str, ...] = ()) -> DataFrame:
    """Half-open global id ranges of shards (gr, gc, depth, sr, sc, edges), with the extra columns named."""
    w = F.expr(f"shiftright({width}, depth)")
    return shards.select(
        "gr", "gc", "depth", "sr", "sc", "edges",
        (F.col("gr") * width + F.col("sr") * w).cast("long").alias("row_from"), (F.col("gr") * width + (F.col("sr") + 1) * w).cast("long").alias("row_to"),
        (F.col("gc") * width + F.col("sc") * w).cast("long").alias("col_from"), (F.col("gc") * width + (F.col("sc") + 1) * w).cast("long").alias("col_to"), *extra,
    )


def shard_catalogue(e: DataFrame, depth: int, width: int = WIDTH) -> DataFrame:
    shards = with_shard(e, depth, width).groupBy("gr", "gc", "depth", "sr", "sc").agg(F.count("*").alias("edges"))
    return catalogue(shards, width)


def _cell_triples(cells: DataFrame, ws: Workspace, results: DataFrame | None = None) -> DataFrame:
    """Triples of cells (src, dst, each once, and maybe label) of a matrix that meet, as rows a, b, c: cells (a, b), (a, c) and (b, c), with a >= b >= c.

    Rows of cells are lists that are closed inside jobs (:mod:`trigrid.closing`), and triples stream out of them: neither pairs nor
    triples, which may be as many as the cube of the matrix's side, are shuffled or written."""
    lower = ws.keep(cells.where("src >= dst"), "job-cells")
    size = lower.agg(F.count("*").alias("m"), F.max("src").alias("top")).first()
    small = (size["top"] or 0) < 1 << 31 and results is None
    kind = "int" if small else "long"
    lower = lower.withColumns({"src": F.col("src").cast(kind), "dst": F.col("dst").cast(kind)})
    lists = ws.keep(closing.neighbours(lower, tasks_for(cells.sparkSession, size["m"])), "job-lists")
    found = closing.triples(closing.deal_cells(lists, size["m"], results), results is not None)
    return found.withColumns({x: F.col(x).cast("long") for x in ("a", "b", "c")})


def grid_jobs(grids: DataFrame) -> DataFrame:
    """Triples of non-empty grids with gc <= i <= gr: G0 (i, gc), G1 (gr, gc), G2 (gr, i)."""
    cells = grids.select(F.col("gr").cast("long").alias("src"), F.col("gc").cast("long").alias("dst")).distinct()
    return _cell_triples(cells, Workspace(grids.sparkSession)).select(F.col("b").alias("i"), F.col("a").alias("gr"), F.col("c").alias("gc"))


#: Overlap of the three shared axes: rows of G1 and G2, columns of G1 and G0, and G0's rows with G2's columns.
OVERLAP = (
    "greatest(g1.row_from, g2.row_from) < least(g1.row_to, g2.row_to) AND greatest(g1.col_from, g0.col_from) < least(g1.col_to, g0.col_to) "
    "AND greatest(g0.row_from, g2.col_from) < least(g0.row_to, g2.col_to)"
)


def one_depth(shards: DataFrame) -> int | None:
    """The depth of a catalogue that lies in the lower triangle and has one depth only."""
    found = shards.agg(F.min("depth").alias("a"), F.max("depth").alias("b"), F.bool_and(F.expr("gr > gc OR (gr = gc AND sr >= sc)")).alias("lower")).first()
    return found["a"] if found["lower"] and found["a"] == found["b"] else None


def shard_jobs(shards: DataFrame, results: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """Triples of shards (gr, gc, depth, sr, sc) that can hold a triangle, by their stems' parts.

    Shards of one depth are cells of a matrix, whose triples stream out of jobs; those of several depths are matched by :func:`overlapping`.
    For a catalogue of the ``depth`` named, ``results`` (a, b, c, n: positions of the shards of v, u and w along an axis) come along as n, 0 without one."""
    key = ["gr", "gc", "depth", "sr", "sc"]
    ws = Workspace(shards.sparkSession)
    if depth is None:
        shards = ws.keep(shards.select(*key), "job-shards")
        depth = one_depth(shards)
    if depth is None:
        return overlapping(shards.select(*key, F.struct(*key).alias("s")))
    place = lambda g, x: F.expr(f"shiftleft(cast({g} AS long), {depth}) + {x}")
    t = _cell_triples(shards.select(place("gr", "sr").alias("src"), place("gc", "sc").alias("dst")).distinct(), ws, results)

    def shard(r: str, c: str) -> Column:
        part = {"gr": F.shiftright(r, depth), "gc": F.shiftright(c, depth), "depth": F.lit(depth), "sr": F.col(r).bitwiseAND((1 << depth) - 1), "sc": F.col(c).bitwiseAND((1 << depth) - 1)}
        kinds = {f.name: f.dataType for f in shards.schema}
        return F.struct(*[x.cast(kinds[k]).alias(k) for k, x in part.items()])

    return t.select(shard("b", "c").alias("g0"), shard("a", "c").alias("g1"), shard("a", "b").alias("g2"), *(["n"] if results is not None else []))


def _span(grid: str, part: str) -> Column:
    """An axis range of a shard as one number: its position among the ranges of its depth, and the depth."""
    return F.expr(f"shiftleft(shiftleft({grid}, depth) + {part}, 6) | depth")


def _spans_over(span: str, itself: bool) -> Column:
    """The ranges that hold this one, from the grid down, with or without itself."""
    depths = f"sequence(0, cast({span} & 63 AS int))"
    found = f"transform({depths}, d -> shiftleft(shiftright(shiftright({span}, 6), cast({span} & 63 AS int) - d), 6) | d)"
    return F.explode(F.expr(found if itself else f"slice({found}, 1, cast({span} & 63 AS int))"))


def overlapping(shards: DataFrame) -> DataFrame:
    """Triples (g0, g1, g2: the column ``s``) of shards whose ranges overlap on all three shared axes: rows of G1 and G2, columns of
    G1 and G0, rows of G0 and columns of G2.

    Of two ranges from halving that overlap one holds the other. So they meet by equality: one of them is the other or one of the
    ranges over it. Each pair and triple is made once, and nothing is joined that doesn't overlap."""
    ws = Workspace(shards.sparkSession)
    c = ws.keep(shards.select("s", _span("gr", "sr").alias("r"), _span("gc", "sc").alias("c")), "spans")
    g1 = c.select(F.col("s").alias("g1"), F.col("r").alias("v"), F.col("c").alias("w"))
    g2 = c.select(F.col("s").alias("g2"), F.col("r").alias("v"), F.col("c").alias("u"))
    g0 = c.select(F.col("s").alias("g0"), F.col("r").alias("u"), F.col("c").alias("w"))
    pairs = g1.join(g2.withColumn("v", _spans_over("v", True)), "v").unionByName(g1.withColumn("v", _spans_over("v", False)).join(g2, "v"))
    pairs = ws.keep(pairs.select("g1", "g2", "u", "w"), "pairs")
    triples = []
    for wide_u in (True, False):
        for wide_w in (True, False):
            # The wider range of an axis stands as it is; the other side brings the ranges over its own.
            p, q = pairs, g0
            p = p.withColumn("u", _spans_over("u", True)) if wide_u else p
            p = p.withColumn("w", _spans_over("w", True)) if wide_w else p
            q = q if wide_u else q.withColumn("u", _spans_over("u", False))
            q = q if wide_w else q.withColumn("w", _spans_over("w", False))
            triples.append(p.join(q, ["u", "w"]).select("g0", "g1", "g2"))
    out = ws.keep(reduce(DataFrame.unionByName, triples), "triples")
    ws.drop("spans", "pairs")
    return out


def with_slice(e: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """Add the grid and the ``slice`` of each edge: its position in the order of (src, dst) within its grid by ``size``.

    Positions are those in the order of the whole table less that of the grid's first edge."""
    ws = Workspace(e.sparkSession)
    g = ws.keep(with_grid(e, width).select("src", "dst", "gr", "gc"), "edges")
    placed = ws.keep(scans.indexed(g, ["gr", "gc", "src", "dst"], ws, "runs"), "placed")
    ws.drop("edges", "runs")
    starts = placed.groupBy("gr", "gc").agg(F.min("index").alias("start"))
    return placed.join(starts, ["gr", "gc"]).select("src", "dst", "gr", "gc", F.expr(f"(index - start) div {size}").alias("slice"))


def linear_slices(e: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """Slices of ``size`` edges in the order of (src, dst) within each grid: gr, gc, slice, edges. All but a grid's last are full, so the sizes of
    grids tell them and no edge is sorted."""
    sizes = with_grid(e, width).groupBy("gr", "gc").agg(F.count("*").alias("n"))
    slices = sizes.select("gr", "gc", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {size})")).alias("slice"))
    return slices.select("gr", "gc", "slice", F.least(F.lit(size).cast("long"), F.col("n") - F.col("slice") * size).alias("edges"))


def slice_jobs(slices: DataFrame) -> DataFrame:
    """Triples of slices of the grids of each grid job, as structs g0, g1, g2 of gr, gc, slice. A grid's slices count from 0 without gaps."""
    cells = slices.groupBy(F.col("gr").cast("long").alias("src"), F.col("gc").cast("long").alias("dst")).agg((F.max("slice") + 1).cast("int").alias("label"))
    t = _cell_triples(cells, Workspace(slices.sparkSession))
    part = lambda r, c, k: F.struct(F.col(r).alias("gr"), F.col(c).alias("gc"), F.col(k).alias("slice"))
    return t.select(part("b", "c", "k0").alias("g0"), part("a", "c", "k1").alias("g1"), part("a", "b", "k2").alias("g2"))


def slice_name(df: DataFrame) -> DataFrame:
    """Add the file stem of a slice: ``gr-gc,slice``."""
    return df.withColumn("stem", F.concat_ws(",", F.concat_ws("-", "gr", "gc"), "slice"))


def parse_slice_name(df: DataFrame, column: str = "stem") -> DataFrame:
    """gr, gc, slice of a file stem; names that aren't such stems are dropped."""
    pattern = r"^(\d+)-(\d+),(\d+)$"
    part = lambda k: F.regexp_extract(column, pattern, k).cast("long")
    return df.where(F.col(column).rlike(pattern)).withColumns({"gr": part(1), "gc": part(2), "slice": part(3)})


def large_shards(shards: DataFrame, share: float) -> DataFrame:
    """Shards whose size is at least that of the shard at the given share of the descending order."""
    cut = shards.agg(F.expr(f"percentile_disc({1 - share}) WITHIN GROUP (ORDER BY edges)").alias("cut"))
    return shards.join(F.broadcast(cut), F.col("edges") >= F.col("cut")).drop("cut")
