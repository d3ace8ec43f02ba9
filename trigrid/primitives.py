"""Data-parallel primitives as DataFrame operations: scans, segmented reductions, runs, histograms and
sparse products. Each takes its order and segment columns, since rows of a DataFrame have no order. Without segment columns
the whole table is one array: it is scanned in sorted runs (:mod:`trigrid.scans`), not by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans
from .storage import Workspace


def scan(df: DataFrame, value: str, order: list[str], segment: list[str]) -> DataFrame:
    """Add exclusive and inclusive running sums within each segment."""
    if not segment:
        out = scans.prefix_scan(df, value, order, Workspace(df.sparkSession), "scan")
        return out.select(*df.columns, F.col("exclusive").cast("long").alias("exclusive"), F.col("inclusive").cast("long").alias("inclusive"))
    w = Window.partitionBy(*segment).orderBy(*order)
    return df.withColumns({
        "exclusive": F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        "inclusive": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"),
    })


def extreme_scan(df: DataFrame, value: str, order: list[str], segment: list[str]) -> DataFrame:
    """Add running minimum and maximum within each segment, without (null at the start) and with the row itself."""
    if not segment:
        return scans.prefix_scan(df, value, order, Workspace(df.sparkSession), "scan").select(*df.columns, "min_before", "max_before", "min_upto", "max_upto")
    w = Window.partitionBy(*segment).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        "min_before": F.min(value).over(before), "max_before": F.max(value).over(before),
        "min_upto": F.min(value).over(upto), "max_upto": F.max(value).over(upto),
    })


def segmented_sort(df: DataFrame, keys: list[str], segment: list[str], descending: bool = False) -> DataFrame:
    """Add each row's ``position`` in its segment's order by the keys, from 0."""
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    if not segment:
        return scans.indexed(df, order, Workspace(df.sparkSession), "sort", "position")
    return df.withColumn("position", (F.row_number().over(Window.partitionBy(*segment).orderBy(*order)) - 1).cast("long"))


def segmented_reduce(df: DataFrame, value: str, index: str, segment: list[str]) -> DataFrame:
    """Sum, extremes and their positions for each segment (ties: the smallest position for the minimum,
    the largest for the maximum)."""
    key = F.struct(value, index)
    return df.groupBy(*segment).agg(
        F.sum(value).cast("long").alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.min_by(index, key).alias("argmin"), F.max_by(index, key).alias("argmax"),
    )


def _whole_runs(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The table as one array, with each row's position and the number of runs up to it (``inclusive``)."""
    ws = Workspace(df.sparkSession)
    placed = ws.keep(scans.indexed(df, order, ws, "placed-runs", "__at_all"), "placed")
    before = scans.neighbour(placed, [value], ["__at_all"], ws, "neighbour-runs", "__before")
    # As within segments, null equals nothing.
    marked = ws.keep(before.withColumn("__new", F.when(F.col(f"__before.{value}") == F.col(value), 0).otherwise(1)).drop("__before"), "marked")
    out = scans.prefix_scan(marked, "__new", ["__at_all"], ws, "runs")
    ws.drop("placed", "placed-runs", "neighbour-runs")
    return out


def run_lengths(df: DataFrame, value: str, order: list[str], segment: list[str], total: str) -> DataFrame:
    """Runs of equal consecutive values: number, value, length, and the sum of ``total`` over the run."""
    if not segment:
        rows = _whole_runs(df, value, order)
        return rows.groupBy(F.col("inclusive").cast("long").alias("run")).agg(F.min(value).alias("value"), F.count("*").alias("length"), F.sum(total).cast("long").alias("total"))
    w = Window.partitionBy(*segment).orderBy(*order)
    new = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("__new", new).withColumn("run", run)
    return rows.groupBy(*segment, "run").agg(F.min(value).alias("value"), F.count("*").alias("length"), F.sum(total).cast("long").alias("total"))


def long_runs(df: DataFrame, value: str, order: list[str], segment: list[str]) -> DataFrame:
    """Start (rows before it in its segment) and length of each run of two equal consecutive values or more."""
    if not segment:
        runs = _whole_runs(df, value, order).groupBy("inclusive").agg(F.min("__at_all").alias("start"), F.count("*").alias("length"))
        return runs.where("length > 1").drop("inclusive")
    w = Window.partitionBy(*segment).orderBy(*order)
    marked = df.withColumns({"__at": F.row_number().over(w) - 1, "__new": F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)})
    rows = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*segment, "__run").agg(F.min("__at").cast("long").alias("start"), F.count("*").alias("length"))
    return runs.where("length > 1").drop("__run")


def select_flagged(df: DataFrame, condition: str) -> DataFrame:
    return df.where(condition)


def partition_flagged(df: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """The rows that meet the condition, and all others."""
    return df.where(condition), df.where(~F.coalesce(F.expr(condition), F.lit(False)))


def unique_consecutive(df: DataFrame, value: str, order: list[str], segment: list[str]) -> DataFrame:
    """The first row of each run of equal consecutive values."""
    if not segment:
        out = scans.neighbour(df, [value], order, Workspace(df.sparkSession), "neighbour", "__before")
        return out.where(F.col("__before").isNull() | ~F.col(f"__before.{value}").eqNullSafe(F.col(value))).drop("__before")
    w = Window.partitionBy(*segment).orderBy(*order)
    return df.withColumn("__before", F.lag(F.struct(value)).over(w)).where(~F.col("__before").eqNullSafe(F.struct(value))).drop("__before")


def histogram_even(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts in equal bins over [low, high); values outside are left out, empty bins too."""
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    at = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("long")
    return inside.groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def _bin(value: str, borders: list[float]) -> Column:
    """The bin [borders[i], borders[i + 1]) of a value, by binary search over the sorted borders; null outside."""
    edges = F.array(*[F.lit(float(b)) for b in borders])
    x = F.col(value).cast("double")
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    under = lambda s: F.get(edges, middle(s)) <= x
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(under(s), middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(under(s), s["hi"]).otherwise(middle(s)).alias("hi")))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(len(borders).bit_length())), state, step, lambda s: s["lo"] - 1)
    return F.when((x >= float(borders[0])) & (x < float(borders[-1])), at)


def histogram_range(df: DataFrame, value: str, borders: list[float]) -> DataFrame:
    """Counts in the bins [borders[i], borders[i + 1])."""
    return df.select(_bin(value, borders).cast("int").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def _channels(df: DataFrame, bins: dict[str, Column]) -> DataFrame:
    """Counts by channel and bin from one pass over the rows; a null bin counts nowhere."""
    cells = F.array(*[F.struct(F.lit(name).alias("channel"), at.cast("long").alias("bin")) for name, at in bins.items()])
    cell = df.select(F.explode(cells).alias("c")).select("c.channel", "c.bin")
    return cell.where("bin IS NOT NULL").groupBy("channel", "bin").agg(F.count("*").alias("n"))


def multi_histogram_even(df: DataFrame, channels: dict[str, tuple[int, float, float]]) -> DataFrame:
    """:func:`histogram_even` of several columns at once: (bins, low, high) by column."""
    return _channels(df, {
        c: F.when((F.col(c) >= low) & (F.col(c) < high), F.least(F.floor((F.col(c) - low) / ((high - low) / n)), F.lit(n - 1)))
        for c, (n, low, high) in channels.items()
    })


def multi_histogram_range(df: DataFrame, channels: dict[str, list[float]]) -> DataFrame:
    """:func:`histogram_range` of several columns at once: borders by column."""
    return _channels(df, {c: _bin(c, borders) for c, borders in channels.items()})


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """y = A x for A as (src, dst, x) and x as (i, v)."""
    products = matrix.join(vector, matrix["dst"] == vector["i"])
    return products.groupBy(F.col("src").alias("row")).agg(F.sum(F.col("x") * F.col("v")).alias("y"))
