"""The adj6 data source: byte ranges, bounded files, commits; and grids written in parts."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from trigrid import formats, partition, sources

EDGES = "src long, dst long"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(6)
    out = {(rng.randrange(1 << 40), rng.randrange(1 << 47)) for _ in range(500)} | {(77, k) for k in range(4000)} | {(5, 0)}
    return sorted(out)


def save(df, path, mode="append", **options):
    sources.register(df.sparkSession)
    df.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.format("adj6").mode(mode).options(**options).save(str(path))


@pytest.mark.parametrize("split_bytes", [12, 100, 5000, 1 << 30])
def test_one_file_by_ranges(spark, tmp_path, edges, split_bytes):
    """A single file is cut into many tasks, within the list of a hub too, and nothing is lost or read twice."""
    src, dst = (np.array(x, dtype=np.int64) for x in zip(*edges, strict=True))
    (tmp_path / "all.adj6").write_bytes(formats.adj6_bytes(src, dst))
    (tmp_path / "empty").write_bytes(b"")
    sources.register(spark)
    got = spark.read.format("adj6").option("split_bytes", split_bytes).load(str(tmp_path))
    size = os.path.getsize(tmp_path / "all.adj6")
    with open(tmp_path / "all.adj6", "rb") as f:
        index = list(sources.ranges(lambda n, at: (f.seek(at), f.read(n))[1], "x", size, split_bytes))
    assert sum(r.stop - r.start for r in index) == size - 12 * len({r.start for r in index if r.src is not None and index[index.index(r) - 1].src != r.src})
    assert all(r.stop - r.start <= max(split_bytes, 12) for r in index)
    if split_bytes < 10_000:
        assert got.rdd.getNumPartitions() == len(index) > 4
    if split_bytes > 12:
        assert pairs(got) == edges


def test_writes_bounded_files_and_reads_them(spark, tmp_path, edges):
    df = spark.createDataFrame(edges, EDGES)
    save(df, tmp_path / "out", file_edges=300)
    files = sorted(os.listdir(tmp_path / "out"))
    assert len(files) >= len(edges) / 300 and not [f for f in files if f.startswith(".")]
    assert max(os.path.getsize(tmp_path / "out" / f) for f in files) <= 300 * 18
    assert pairs(spark.read.format("adj6").load(f"file://{tmp_path}/out")) == edges
    save(df.limit(3), tmp_path / "out", "overwrite")
    assert spark.read.format("adj6").load(str(tmp_path / "out")).count() == 3
    save(df.limit(2), tmp_path / "out")
    assert spark.read.format("adj6").load(str(tmp_path / "out")).count() == 5


def test_failed_writes_leave_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(1, 2), (3, 1 << 50)], EDGES)
    with pytest.raises(Exception, match="48 bits"):
        save(bad, tmp_path / "out", file_edges=1)
    assert not [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] if (tmp_path / "out").exists() else True
    with pytest.raises(Exception, match="columns src and dst"):
        save(bad.withColumnRenamed("dst", "to").withColumn("dst", bad["src"]), tmp_path / "other")


@pytest.mark.parametrize("cut", [5, 11, 17, 20])
def test_cut_off_files(spark, tmp_path, cut):
    raw = formats.adj6_bytes(np.array([1, 1, 2]), np.array([0, 5, 1]))
    (tmp_path / "a.adj6").write_bytes(raw[:cut])
    sources.register(spark)
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("adj6").load(str(tmp_path)).collect()


def test_large_grids_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(formats, "FILE_EDGES", 50)
    rng = random.Random(2)
    edges = sorted({(rng.randrange(64), rng.randrange(64)) for _ in range(900)})
    e = spark.createDataFrame(edges, EDGES)
    for write, read in ((formats.write_el32, formats.read_el32), (formats.write_csr, formats.read_csr)):
        table = write(e, 32)
        rows = table.collect()
        assert max(len(r.content) for r in rows) <= 50 * 8 + 4 and any("," in r.name for r in rows)
        assert len({r.name for r in rows}) == len(rows) and {"0-0", "1-1"} <= {r.name.split(".")[0] for r in rows}
        assert pairs(read(spark.createDataFrame([tuple(r) for r in rows], formats.FILES), 32)) == edges


def test_chunks_in_order_are_the_grids_arrays(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(300)} | {(9, d) for d in range(40)}
    e = spark.createDataFrame(sorted(edges), EDGES)
    whole = {(r.gr, r.gc): r for r in partition.csr_arrays(e, 20).collect()}
    chunks = {}
    for r in partition.csr_chunks(e, 7, 20).collect():
        assert len(r.col) <= 7 and len(r.ptr) == len(r.row) + 1
        chunks.setdefault((r.gr, r.gc), []).append(r)
    assert set(chunks) == set(whole)
    for key, parts in chunks.items():
        parts.sort(key=lambda r: r.chunk)
        assert [d for p in parts for d in p.col] == whole[key].col
        ends = {}
        for p in parts:
            ends |= dict(zip(p.row, p.ptr[1:], strict=True))
        assert list(ends) == whole[key].row and list(ends.values()) == whole[key].ptr[1:]
