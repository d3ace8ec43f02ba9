"""Positions and prefix scans over a whole table in a global order, without a task that sees all rows.

Rows are range-partitioned by the order, sorted within each partition (a *run*) and written once with their place in the run.
What a row needs from the runs before it is one total for each run: a table as long as the number of partitions, scanned
on its own and sent back. Rows with equal order keys lie in one run; name further columns in the order where ties are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import tasks_for
from .storage import Workspace

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_RUN_BIT = 33


def _key(segment: list[str]) -> Column:
    """Segments as one struct, in which nulls are values like others."""
    return F.struct(*segment) if segment else F.lit(0)


def sorted_runs(df: DataFrame, order: list[str | Column], ws: Workspace, name: str, segment: list[str] | None = None) -> DataFrame:
    """The rows, written in sorted runs, with ``__run``, ``__at`` (place in the run) and the segment as ``__key``. ``df`` is read twice,
    once for the borders of the ranges, and counted: pass a written table or a cheap plan. The number of runs grows with the rows."""
    by = [*(segment or []), *order]
    placed = df.repartitionByRange(tasks_for(df.sparkSession, df.count()), *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    rows = placed.withColumns({"__run": F.shiftright("__id", _RUN_BIT), "__at": F.col("__id").bitwiseAND((1 << _RUN_BIT) - 1), "__key": _key(segment or [])})
    return ws.keep(rows.drop("__id"), name)


def _with_totals(rows: DataFrame, totals: dict[str, Column], before: dict[str, Column], segment: list[str] | None = None) -> DataFrame:
    """Rows with what the runs before theirs add up to within their segment. Without segments that is one row for each run, which is
    broadcast; a segment adds one for each run that it lies in, and Spark picks the join."""
    runs = rows.groupBy("__key", "__run").agg(*[c.alias(k) for k, c in totals.items()])
    earlier = Window.partitionBy("__key").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__key", "__run", *[c.over(earlier).alias(k) for k, c in before.items()])
    return rows.join(runs if segment else F.broadcast(runs), ["__key", "__run"])


def indexed(df: DataFrame, order: list[str | Column], ws: Workspace, name: str, index: str = "index") -> DataFrame:
    """Add each row's position, from 0, in the order of the whole table."""
    rows = sorted_runs(df, order, ws, name)
    out = _with_totals(rows, {"__n": F.count("*")}, {"__offset": F.sum("__n")})
    return out.withColumn(index, (F.coalesce("__offset", F.lit(0)) + F.col("__at")).cast("long")).drop("__run", "__at", "__key", "__offset")


def prefix_scan(df: DataFrame, value: str, order: list[str | Column], ws: Workspace, name: str, segment: list[str] | None = None) -> DataFrame:
    """Add the running sums ``exclusive`` and ``inclusive`` and the extremes ``min_before``, ``max_before`` (null at the start),
    ``min_upto``, ``max_upto`` over the whole table, or over each segment, however large. Null values add nothing."""
    rows = sorted_runs(df, order, ws, name, segment)
    rows = _with_totals(
        rows,
        {"__s": F.sum(value), "__lo": F.min(value), "__hi": F.max(value)},
        {"__sum": F.sum("__s"), "__min": F.min("__lo"), "__max": F.max("__hi")},
        segment,
    )
    w = Window.partitionBy("__run", "__key").orderBy("__at")
    prior, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.coalesce(F.col("__sum"), F.lit(0))
    out = rows.withColumns({
        "exclusive": so_far + F.coalesce(F.sum(value).over(prior), F.lit(0)), "inclusive": so_far + F.coalesce(F.sum(value).over(upto), F.lit(0)),
        "min_before": F.least("__min", F.min(value).over(prior)), "max_before": F.greatest("__max", F.max(value).over(prior)),
        "min_upto": F.least("__min", F.min(value).over(upto)), "max_upto": F.greatest("__max", F.max(value).over(upto)),
    })
    return out.drop("__run", "__at", "__key", "__sum", "__min", "__max")


def carried(df: DataFrame, value: str, order: list[str | Column], ws: Workspace, name: str, out: str, segment: list[str] | None = None) -> DataFrame:
    """Add the last non-null value up to each row (a copy scan): the operator is associative, so runs add up by their own last."""
    rows = sorted_runs(df, order, ws, name, segment)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at")))
    rows = _with_totals(rows, {"__last": last}, {"__carry": F.last("__last", ignorenulls=True)}, segment)
    w = Window.partitionBy("__run", "__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), "__carry")).drop("__run", "__at", "__key", "__carry")


def neighbour(df: DataFrame, columns: list[str], order: list[str | Column], ws: Workspace, name: str, out: str) -> DataFrame:
    """Add the struct ``out`` of the row before in the order of the whole table (null for the first row)."""
    rows = sorted_runs(df, order, ws, name)
    own = F.struct(*columns)
    rows = _with_totals(rows, {"__end": F.max_by(own, "__at")}, {"__left": F.last("__end", ignorenulls=True)})
    before = F.lag(own).over(Window.partitionBy("__run").orderBy("__at"))
    return rows.withColumn(out, F.when(F.col("__at") == 0, F.col("__left")).otherwise(before)).drop("__run", "__at", "__key", "__left")
