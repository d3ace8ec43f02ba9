"""Parameter sweeps of triangle counts with a run log to resume from.

A setting is a row of ``KEYS``. Each finished run is appended to the log at once, a folder of CSV files, and a
sweep runs only the settings that an anti-join with the log leaves, so one that broke off goes on where it
stopped. The driver loops over settings; the counts are Spark jobs.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import partition, triangles

SETTING_SCHEMA = "dataset string, strategy string, width long, depth int, partitions int"
LOG_SCHEMA = SETTING_SCHEMA + ", triangles long, seconds double"
KEYS = [c.split()[0] for c in SETTING_SCHEMA.split(", ")]


def settings(
    spark: SparkSession,
    datasets: Iterable[str],
    strategies: Iterable[str] = ("oriented",),
    widths: Iterable[int] = (partition.WIDTH,),
    depths: Iterable[int] = (2,),
    partitions: Iterable[int] = (200,),
) -> DataFrame:
    """Every combination of the given values, one row each."""
    return spark.createDataFrame(list(itertools.product(datasets, strategies, widths, depths, partitions)), SETTING_SCHEMA)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The runs logged so far; a folder that isn't there yet is an empty log."""
    try:
        return spark.read.schema(LOG_SCHEMA).csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def append_log(runs: DataFrame, path: str) -> None:
    runs.coalesce(1).write.mode("append").csv(path, header=True)


def pending(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """The settings without a run in the log."""
    return wanted.join(log.select(*KEYS).distinct(), KEYS, "left_anti")


def run(spark: SparkSession, wanted: DataFrame, path: str, load: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Run the pending settings in the order of their keys and return the log. ``load`` gives the
    normalised edges of a dataset."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for s in pending(wanted, read_log(spark, path)).distinct().orderBy(*KEYS).collect():
            spark.conf.set("spark.sql.shuffle.partitions", str(s["partitions"]))
            began = time.monotonic()
            found = triangles.count(load(spark, s["dataset"]), s["strategy"], width=s["width"], depth=s["depth"]).first()["triangles"]
            append_log(spark.createDataFrame([(*s, found, time.monotonic() - began)], LOG_SCHEMA), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return read_log(spark, path)


def fastest(log: DataFrame) -> DataFrame:
    """For each dataset the setting of its quickest run."""
    row = F.min_by(F.struct(*KEYS[1:], "triangles"), "seconds")
    return log.groupBy("dataset").agg(F.min("seconds").alias("seconds"), row.alias("r")).select("dataset", "r.*", "seconds")


def disagreements(log: DataFrame) -> DataFrame:
    """Datasets whose runs don't all give one count; empty when all is well."""
    return log.groupBy("dataset").agg(F.min("triangles").alias("low"), F.max("triangles").alias("high")).where("low <> high")
