"""Temperature mixing of sources, realised as budgeted permutations of blocks.

Token shares of the sources are raised to an exponent in [0, 1] and normalised. The exponent is found by
bisection on the per-source totals: the smallest (flattest mix) at which the repetition limit holds and
the entropy doesn't exceed its target, both monotone in the exponent. Each step is one aggregation
over the per-source table, which stays in Spark.

A source's weight times the budget is its share of tokens. Its documents are dealt into blocks by a
hash, blocks are put in a random order anew for every pass, and whole passes are followed by a partial
one: blocks in order while they fit, then the documents of the first block that doesn't, while they fit.
A source has at most ``MAX_BLOCKS`` blocks, so ordering them is a small job however large the source
is; only the single block where a budget ends is ordered by document, on ids without texts.

:func:`mix_plan` gives the showings (document, pass, block, position); :func:`mix` gives the rows themselves
in the order of the permutation: a position in [0, 1) says how far into its source's budget a showing
stands, so that sorting by it interleaves the sources by weight. Rows meet the small table of blocks,
so texts move once, into their order.

By default the budget is the smallest that shows every source at least once, so no document is lost and
the smaller sources repeat up to the limit.

Defined results: tokens are words ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none, takes part in
every pass of its source, and in a source without tokens appears once; texts of any length are counted whole, one that
doesn't fit the rest of a budget is left out of the partial pass; a null source is a source; repeated rows are
documents of their own, each with showings of its own, also where a budget ends among them; ties in the order are
settled by the id and a hash of the text; an empty table gives an empty result; other columns, of any name, pass
through :func:`mix` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Workspace

MAX_BLOCKS = 4096
BLOCK_TOKENS = 65_536


@dataclass(frozen=True)
class MixTarget:
    """What the mix must meet. ``max_entropy`` is a share of the logarithm of the number of sources."""

    max_repeats: float = 2.0
    max_entropy: float = 1.0
    budget_tokens: int | None = None
    seed: int = 17


def token_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def fit_exponent(shares: DataFrame, target: MixTarget, steps: int = 40) -> float:
    """Bisect the exponent over a table with a column ``share`` (positive). One pass of repetitions and
    entropy per step; the limits hold at the exponent returned (1.0 keeps the shares as they are)."""
    total = shares.agg(F.max("share").alias("top"), F.min("share").alias("low"), F.count("*").alias("n")).first()
    if not total["n"] or total["n"] == 1:
        return 1.0
    def holds(exponent: float) -> bool:
        # Passes over a source are w / p; relative to the least repeated one this is (top / low) ** (1 - exponent).
        if (total["top"] / total["low"]) ** (1 - exponent) > target.max_repeats * (1 + 1e-12):
            return False
        if target.max_entropy >= 1:
            return True
        w = F.pow("share", F.lit(exponent))
        s = shares.agg(F.sum(w).alias("z"), F.sum(w * F.log("share")).alias("l")).first()
        return math.log(s["z"]) - exponent * s["l"] / s["z"] <= target.max_entropy * math.log(total["n"]) + 1e-12

    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def _weights(rows: DataFrame, ws: Workspace, target: MixTarget) -> DataFrame:
    """One row per source: tokens, weight, quota in tokens, whole passes, rest of the quota, number of blocks."""
    sums = ws.keep(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(total or 1))).alias("share"))
    exponent = fit_exponent(shares.select("share"), target)
    z = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    weights = shares.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z))
    budget = target.budget_tokens
    if budget is None:
        least = weights.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
        budget = least or 0.0
    # Budgets are whole tokens; a hair is added so that exactly one pass stays one pass.
    weights = weights.withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) * (1 + 1e-9) + 1e-6).cast("long"))
    weights = weights.withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("long")).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    zero = F.lit(0).cast("long")
    empty = sums.where("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), zero.alias("quota"), F.lit(1).cast("long").alias("passes"), zero.alias("rest"))
    weights = weights.select("source", "tokens", "weight", "quota", "passes", "rest").union(empty)
    n_blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("long")
    weights = ws.keep(weights.withColumn("blocks", n_blocks), "mix-weights")
    ws.drop("mix-sources")
    return weights


def _showings(rows: DataFrame, ws: Workspace, target: MixTarget) -> Callable[[DataFrame], DataFrame]:
    """A function that shows rows: it takes a frame with the columns ``row`` (id and hash of the text) and
    ``source`` among others, and gives each row as often as the mix shows it, with ``epoch``, ``block``,
    ``position`` and ``weight``. ``rows`` has one row (row, source, n_tokens) for each of the table's."""
    seed = target.seed
    weights = _weights(rows, ws, target)
    dealing = weights.select("source", "blocks", "passes", "weight")
    block = F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("blocks")).alias("block")
    dealt = ws.keep(rows.join(dealing.drop("passes", "weight"), "source").select("row", "source", "n_tokens", block), "mix-dealt")

    # Block order of each pass, with the tokens before each block.
    sizes = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    order = sizes.join(weights.drop("blocks"), "source")
    order = order.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).where("epoch < passes OR rest > 0")
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    order = order.withColumn("before", F.coalesce(F.sum("size").over(turn), F.lit(0)))
    order = order.withColumn("room", F.when(F.col("epoch") >= F.col("passes"), F.col("rest") - F.col("before")))
    order = order.where("room IS NULL OR room > 0").select("source", "block", "epoch", "before", "size", "room", "tokens", "quota", "weight")
    order = ws.keep(order, "mix-order")
    whole = order.where("room IS NULL OR room >= size")

    # The blocks in which budgets end (one a source at most): the documents that still fit, on ids alone. Of equal
    # rows the first so many stand for the ones that fit.
    cut = dealt.join(order.where("room < size").select("source", "block", "epoch", "before", "room", "tokens", "quota", "weight"), ["source", "block"])
    line = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "row", "epoch"), "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("run", F.sum("n_tokens").over(line)).where("run <= room")
    cut = cut.withColumn("k", F.row_number().over(Window.partitionBy("source", "row").orderBy("run")))
    position = (F.col("epoch") * F.col("tokens") + F.col("before") + F.col("run") - F.col("n_tokens")) / F.greatest(F.lit(1), F.col("quota"))
    cut = ws.keep(cut.select("source", "row", "k", "epoch", "block", position.alias("position"), "weight"), "mix-cut")
    cut_blocks = order.where("room < size").select("source", "block")

    def show(frame: DataFrame) -> DataFrame:
        placed = frame.join(dealing, "source").select(*frame.columns, block)
        within = _unit(F.lit(seed + 2), F.col("row"), F.col("epoch"))
        at = (F.col("epoch") * F.col("tokens") + F.col("before") + within * F.col("size")) / F.greatest(F.lit(1), F.col("quota"))
        at = F.when(F.col("quota") > 0, at).otherwise(within)
        full = placed.join(whole, ["source", "block"]).select(*frame.columns, "epoch", "block", at.alias("position"), "weight")
        copy = F.row_number().over(Window.partitionBy("source", "row").orderBy(F.xxhash64(F.to_json(F.struct(*frame.columns)))))
        parts = placed.join(cut_blocks, ["source", "block"]).select(*frame.columns).withColumn("k", copy)
        parts = parts.join(cut, ["source", "row", "k"]).select(*frame.columns, "epoch", "block", "position", "weight")
        out = full.unionByName(parts)
        return out.withColumn("position", F.least(F.col("position"), F.lit(1 - 2.0**-53)).cast(T.DoubleType()))

    return show


def _source(source: str) -> Column:
    """In a struct, so that null is a source like others."""
    return F.struct(F.col(f"`{source}`").alias("s")).alias("source")


def _row(id_col: str, text: str) -> Column:
    return F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h")).alias("row")


def _rows(docs: DataFrame, ws: Workspace, id_col: str, text: str, source: str) -> DataFrame:
    return ws.keep(docs.select(_row(id_col, text), _source(source), token_count(F.col(f"`{text}`")).alias("n_tokens")), "mix-rows")


def mix_plan(docs: DataFrame, ws: Workspace, target: MixTarget = MixTarget(), id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as a table: which document stands in which pass, block and position."""
    rows = _rows(docs, ws, id_col, text, source)
    shown = _showings(rows, ws, target)(rows)
    ws.drop("mix-dealt")
    return shown.select(F.col("row.id").alias("doc_id"), F.col("source.s").alias("source"), "n_tokens", "epoch", "block", "position", "weight")


def mix(docs: DataFrame, ws: Workspace, target: MixTarget = MixTarget(), id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix shows them, all columns as they are, in the order of the block
    permutation: partitions are consecutive ranges of the position, each sorted by it."""
    show = _showings(_rows(docs, ws, id_col, text, source), ws, target)
    ws.drop("mix-rows", "mix-dealt")
    shown = show(docs.select(_row(id_col, text), _source(source), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shown.repartitionById(n, F.floor(F.col("position") * n).cast("int")).sortWithinPartitions("position", "row", "epoch")
    return ordered.select("doc.*")
