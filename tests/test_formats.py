"""Hand-written bytes, round trips through files, and names and cut-off files."""

from __future__ import annotations

import random
import struct

import pytest

from trigrid import formats, graph

SIX = lambda *n: b"".join(x.to_bytes(6, "big") for x in n)


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def edges_of(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def table(spark, files):
    return spark.createDataFrame(list(files.items()), formats.FILES)


@pytest.fixture(scope="module")
def some_edges():
    draw = random.Random(3)
    return sorted({(draw.randrange(300), draw.randrange(300)) for _ in range(2000)} | {(7, d) for d in range(300)})


def test_adj6_by_hand(spark):
    content = SIX(2, 2, 0, 1) + SIX(1, 1, 0) + SIX(9, 0)
    assert edges_of(formats.read_adj6(table(spark, {"part": content, "empty": b""}))) == [(1, 0), (2, 0), (2, 1)]
    written = formats.write_adj6(frame(spark, [(2, 1), (1, 0), (2, 0)]).coalesce(1)).orderBy("name").collect()
    assert b"".join(bytes(r["content"]) for r in written)[:18] == SIX(1, 1, 0)


def test_csr_by_hand(spark):
    got = {r["name"]: bytes(r["content"]) for r in formats.write_csr(frame(spark, [(1, 0), (2, 0), (2, 1)]), 8).collect()}
    assert got == {"0-0.row": struct.pack("<2I", 1, 2), "0-0.ptr": struct.pack("<3I", 0, 1, 3), "0-0.col": struct.pack("<3I", 0, 0, 1)}
    shard = {"1-0,1,1-0.row": struct.pack("<I", 2), "1-0,1,1-0.ptr": struct.pack("<2I", 0, 1), "1-0,1,1-0.col": struct.pack("<I", 3), "README": b"x"}
    assert edges_of(formats.read_csr(table(spark, shard), 8)) == [(8 + 4 + 2, 3)]


@pytest.mark.parametrize("write, read", [
    (formats.write_adj6, formats.read_adj6),
    (lambda e: formats.write_el32(e, 64), lambda t: formats.read_el32(t, 64)),
    (lambda e: formats.write_csr(e, 64), lambda t: formats.read_csr(t, 64)),
])
def test_round_trips_through_files(spark, tmp_path, some_edges, write, read):
    assert formats.write_files(write(frame(spark, some_edges)), str(tmp_path)) > 0
    assert edges_of(read(formats.files(spark, str(tmp_path)))) == some_edges
    assert edges_of(read(write(frame(spark, [])))) == []


def test_adj6_keeps_duplicates_and_wide_ids(spark):
    edges = [(1, 1), (1, 1), ((1 << 48) - 1, 0)]
    assert edges_of(formats.read_adj6(formats.write_adj6(frame(spark, edges)))) == edges


def test_cut_off_files_raise(spark):
    for content in (SIX(1, 2, 0), SIX(1), b"abc"):
        with pytest.raises(Exception, match="cut off"):
            formats.read_adj6(table(spark, {"part": content})).collect()
    with pytest.raises(Exception, match="lacks one"):
        formats.read_csr(table(spark, {"0-0.row": struct.pack("<I", 1)})).collect()


def test_relabel_tsv_and_metadata(spark, tmp_path, some_edges):
    e = frame(spark, some_edges)
    mapping = graph.relabel_table(graph.complete_degrees(e), "desc")
    pairs = lambda df: sorted((r["vid"], r["new_vid"]) for r in df.select("vid", "new_vid").collect())
    assert pairs(formats.read_relabel(formats.write_relabel(mapping))) == pairs(mapping)
    assert pairs(formats.read_relabel(table(spark, {"relabel.bin": struct.pack("<2Q", 1, 0)}))) == [(0, 1), (1, 0)]
    (tmp_path / "in.tsv").write_text("# a comment\n3\t1\n2\t1\n")
    assert edges_of(formats.read_tsv(spark, str(tmp_path / "in.tsv"))) == [(2, 1), (3, 1)]
    formats.write_tsv(e, str(tmp_path / "out"))
    assert edges_of(formats.read_tsv(spark, str(tmp_path / "out"))) == some_edges
    meta = formats.metadata(e, "sample", 64)
    formats.write_metadata(meta, str(tmp_path / "meta"))
    got = formats.read_metadata(spark, str(tmp_path / "meta")).first()
    assert got == meta.first() and got["info"]["count"]["row"] == 5 and got["info"]["max_vid"] == 299
    assert len(got["grid"]) == len({(s // 64, d // 64) for s, d in some_edges})
