"""Helpers of the text operators: Arrow mapping, grouped streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Workspace
from .textkernel import slices

__all__ = ["Workspace", "arrow_map", "keyed_texts", "lower_keys", "runs", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text, under fixed names; other columns (of any name) are left out."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | dict], schema: str, text_col: str = "text") -> DataFrame:
    """mapInArrow over slices of bounded text size; ``work`` returns columns for one slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [n or 0 for n in pa.compute.binary_length(batch.column(text_col)).to_pylist()]
            for a, b in slices(lengths):
                out = work(batch.slice(a, b - a))
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
        # Workers outlive the task; what Arrow has set aside goes back.
        pa.default_memory_pool().release_unused()

    import pyarrow.compute  # noqa: F401  (bound as pa.compute on the executors too)

    return df.mapInArrow(run, schema)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches sorted by them. Several small groups
    come together as one table whose rows are whole groups; at most one group waits for the next batch."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = None
        for k, v in zip(keys, ends, strict=True):
            eq = pc.equal(batch.column(k), v)
            same = eq if same is None else pc.and_(same, eq)
        tail = batch.num_rows - (pc.sum(same).as_py() or 0)
        if last is not None and tail and [batch.column(k)[0].as_py() for k in keys] != last:
            yield pa.Table.from_batches(held)
            held = []
        elif last is not None and not tail and ends != last:
            yield pa.Table.from_batches(held)
            held = []
        if tail:
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = []
        held.append(batch.slice(tail))
        last = ends
    if held:
        yield pa.Table.from_batches(held)


def lower_keys(rows: np.ndarray, keys: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bit set for each of ``n`` rows of its keys below ``key`` (``rows[k]`` has ``keys[k]``). Two rows that meet under
    several keys are dealt with under the lowest: where their bit sets share nothing."""
    below = keys < key
    distinct, at = np.unique(keys[below], return_inverse=True)
    has = np.zeros((n, len(distinct)), dtype=bool)
    has[rows[below], at.ravel()] = True
    return np.packbits(has, axis=1)
