"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A folder of its own below the cluster's shared one (``spark.checkpoint.dir``).

    ``keep`` writes a DataFrame as Parquet there and reads it back: a plan that uses it several times reads
    it, and a lost executor costs a re-read, not a recomputation. Where the setting is absent a session on one machine
    (tests) gets a folder of that machine, recorded in the session; on a cluster that is an error, as
    executors would each write to a disk of their own. What is left of the folder goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="trigrid-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/trigrid-{uuid.uuid4().hex}"
        self._marked = False

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        if not self._marked:
            path, fs = self._at(self.root)
            self._marked = fs.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing returned depends on any more."""
        for name in names:
            path, fs = self._at(self.path(name))
            fs.delete(path, True)

    def _at(self, path: str):  # noqa: ANN202  (objects of the JVM)
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())
