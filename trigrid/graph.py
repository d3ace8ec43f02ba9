"""Edge-set operations: normalising, orienting, degrees and relabelling.

An edge DataFrame has two long columns ``src`` and ``dst``. Every function is a declarative plan; ids
stay global (grid-local ids are derived columns, see :mod:`trigrid.partition`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a task groups or joins, where tasks are set by the size of the data.
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    """The session's shuffle partitions, or more where tasks would otherwise get more than ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def dealt(df: DataFrame, tasks: int | None, *key: str) -> DataFrame:
    """Rows by their key in a number of tasks that the caller knows from the size of the data; without one as Spark deals them."""
    return df.repartition(tasks, *key) if tasks else df


def edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Two columns of any frame as an edge list; rows with a null end are no edges."""
    out = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    return out.where("src IS NOT NULL AND dst IS NOT NULL")


def from_adjacency(adj: DataFrame) -> DataFrame:
    """Flatten (src, dst array) rows into edges."""
    return adj.select("src", F.explode("dst").alias("dst"))


def pair_tasks(df: DataFrame) -> int:
    """Tasks among which :func:`co_occurrence` deals the edges of a table."""
    return 2 * tasks_for(df.sparkSession, df.count())


def co_occurrence(df: DataFrame, group: str, item: str) -> DataFrame:
    """Normalised edges between different items of one group (for example parts of an order).

    The number of tasks grows with the rows, so that neither groups nor edges pile up in a task; rows are counted first, which for
    a Parquet table reads its footers only. A group is one sorted list, made once, whose items pair with those before them: a task sorts
    its rows once, where a join of the table with itself would hash and sort them for either side. Few edges repeat within a task
    before they are dealt by their ends."""
    tasks = pair_tasks(df) // 2
    rows = df.select(F.col(group).alias("g"), F.col(item).cast("long").alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    groups = rows.repartition(tasks, "g").groupBy("g").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    ends = groups.select("vs", F.posexplode("vs").alias("smaller", "src"))
    return ends.select("src", F.explode(F.slice("vs", F.lit(1), F.col("smaller"))).alias("dst")).repartition(2 * tasks, "src", "dst").distinct()


def drop_loops(e: DataFrame) -> DataFrame:
    return e.where("src <> dst")


def lower_triangle(e: DataFrame) -> DataFrame:
    """Point every edge from the larger id to the smaller one."""
    return e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))


def normalize(e: DataFrame, lower: bool = True) -> DataFrame:
    """Simple edges: no loops, no repeats, larger id first (or as given with ``lower=False``)."""
    e = drop_loops(e)
    return (lower_triangle(e) if lower else e).distinct()


def undirected(e: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops and repeats."""
    e = drop_loops(e)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def directed_as_is(e: DataFrame) -> DataFrame:
    """Edges as given, loops kept, repeats removed."""
    return e.distinct()


def endpoints(e: DataFrame) -> DataFrame:
    """One row (vid) for each end of each edge; one pass over the edges."""
    return e.select(F.explode(F.array("src", "dst")).alias("vid"))


def degrees(e: DataFrame) -> DataFrame:
    """Edge ends per vertex of the raw list: loops don't count, repeats do. Vertices without edges are
    left out; see :func:`complete_degrees`."""
    return endpoints(drop_loops(e)).groupBy("vid").agg(F.count("*").alias("degree"))


def vertex_bounds(e: DataFrame) -> DataFrame:
    return e.agg(F.min(F.least("src", "dst")).alias("min_vid"), F.max(F.greatest("src", "dst")).alias("max_vid"))


def complete_degrees(e: DataFrame, max_vid: int | None = None) -> DataFrame:
    """Degrees of every id from 0 to ``max_vid`` (by default the largest that occurs), zeros filled."""
    if max_vid is None:
        max_vid = vertex_bounds(e).first()["max_vid"]
    ids = e.sparkSession.range(0 if max_vid is None else max_vid + 1).withColumnRenamed("id", "vid")
    return ids.join(degrees(e), "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


#: The two relabelings: rising degree with unused ids last, and falling degree and id.
RELABELINGS = ("asc", "desc")


def relabel_table(deg: DataFrame, kind: str) -> DataFrame:
    """(vid, new_vid): positions in the order of degree.

    A global rank without one task seeing all rows: vertices are counted by degree (a table as long as
    the number of distinct degrees), which gives each degree its offset; within a degree, ids are
    ranked in chunks of the id range, whose sizes are counted the same way."""
    if kind not in RELABELINGS:
        raise ValueError(f"unknown relabelling {kind!r}")
    chunk = 1 << 16
    sign = 1 if kind == "asc" else -1
    rows = deg.select("vid", "degree", (sign * F.col("degree")).alias("d"), (sign * F.floor(F.col("vid") / chunk)).alias("c"), (sign * F.col("vid")).alias("v"))
    if kind == "asc":
        rows = rows.withColumn("d", F.when(F.col("degree") == 0, F.lit((1 << 62))).otherwise(F.col("degree")))
    cells = rows.groupBy("d", "c").agg(F.count("*").alias("n"))
    by_degree = cells.groupBy("d").agg(F.sum("n").alias("m"))
    # Distinct degrees number at most the square root of twice the edge ends.
    base = by_degree.select("d", F.coalesce(F.sum("m").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("d").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(base, "d").select("d", "c", (F.col("base") + F.col("before")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("d", "c").orderBy("v")) - 1
    ranked = rows.withColumn("k", rank).join(offsets, ["d", "c"])
    return ranked.select("vid", (F.col("offset") + F.col("k")).cast("long").alias("new_vid"))


def relabel(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace both ids by the mapping's; orientation is for the caller, on the new ids."""
    s = mapping.select(F.col("vid").alias("src"), F.col("new_vid").alias("s"))
    d = mapping.select(F.col("vid").alias("dst"), F.col("new_vid").alias("d"))
    return e.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def relabelled(e: DataFrame, kind: str, max_vid: int | None = None) -> DataFrame:
    """Normalised edges over ids relabelled by the raw list's degrees."""
    return normalize(relabel(drop_loops(e), relabel_table(complete_degrees(e, max_vid), kind)))


def orient_by_degree(e: DataFrame, simple: bool = False) -> DataFrame:
    """Simple edges from the lower to the higher degree, ties by the global id. Out-degrees are then at
    most the square root of twice the number of edges, whatever the hubs. ``simple``: ``e`` is normalised already."""
    deg = degrees(e)
    pairs = e if simple else normalize(e)
    pairs = pairs.join(deg.select(F.col("vid").alias("src"), F.col("degree").alias("ds")), "src")
    pairs = pairs.join(deg.select(F.col("vid").alias("dst"), F.col("degree").alias("dd")), "dst")
    first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return pairs.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def adjacent_gaps(e: DataFrame, tasks: int | None = None) -> DataFrame:
    """Difference of each neighbour id to the next smaller one of the same source. ``tasks``: see :func:`dealt`."""
    w = Window.partitionBy("src").orderBy("dst")
    return dealt(e, tasks, "src").select("src", "dst", (F.col("dst") - F.lag("dst").over(w)).alias("gap"))
