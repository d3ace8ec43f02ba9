"""Readers and writers of the binary graph files, the tab-separated edge list and the metadata document.

Codecs work between edges and a table of files (``name``, ``content``). :func:`files` reads such a table
from any store Spark reads; :func:`write_files` puts one into a folder that all executors mount, or it is
written as a Parquet table where they mount none.

Layouts: adj6 holds records of source, count and that many targets, each six bytes, big-endian; el32
holds pairs of little-endian 32-bit local ids; a grid's compressed rows are three files of such integers
(row, ptr, col); a relabel table holds little-endian 64-bit new ids by old id. A record of adj6 states its
own length: here one file is one task's work, and writers keep files at ``FILE_EDGES`` edges.

Empty files hold nothing; files with other names are passed over; a cut-off file raises ValueError.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, partition
from .storage import Workspace

FILES = "name string, content binary"
FILE_EDGES = 4_000_000
#: Rows handed on at a time.
ROWS = 200_000
RELABEL_BLOCK = 4_000_000
#: Grids of a part of the metadata document, about.
DOCUMENT_GRIDS = 100_000
#: The stem of a further part of a grid.
_PART = r"^(\d+-\d+),\d+$"
_PLACES = 256 ** np.arange(5, -1, -1, dtype=np.int64)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name and content of the files under a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def listing(spark: SparkSession, path: str, glob: str = "*", over: int = 0, recursive: bool = True) -> DataFrame:
    """path, name and length of the files of more than ``over`` bytes under a path; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return found.where(F.col("length") > over).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def file_catalogue(listed: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """The catalogue of compressed-row files from their names and lengths (name, length): shards with id
    ranges, edges and ``n_rows``. Shards without a .row or .col file are left out."""
    named = listed.select(F.regexp_extract("name", r"^(.*)\.(row|col)$", 1).alias("stem"), F.regexp_extract("name", r"\.(row|col)$", 1).alias("ext"), "length").where("ext <> ''")
    size = lambda x: F.expr(f"max(CASE WHEN ext = '{x}' THEN length END) div 4")
    shards = partition.parse_shard_name(named.groupBy("stem").agg(size("row").alias("n_rows"), size("col").alias("edges")).where("n_rows IS NOT NULL AND edges IS NOT NULL"))
    return partition.catalogue(shards, width, ("n_rows",))


def write_files(table: DataFrame, folder: str) -> int:
    """Write each row as a file into a folder that every executor mounts; the number of files. A file
    appears whole under its name, so a repeated task does no harm."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    return table.select("name", "content").mapInArrow(run, "written long").agg(F.sum("written")).first()[0] or 0


def _longs(content: bytes, kind: str, name: str) -> np.ndarray:
    if len(content) % np.dtype(kind).itemsize:
        raise ValueError(f"{name} is cut off")
    return np.frombuffer(content, dtype=kind).astype(np.int64)


def _decoded(table: DataFrame, decode: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for columns in decode(*row):
                    yield pa.RecordBatch.from_pydict(columns)

    return table.mapInArrow(run, schema)


def _joined(column: pa.Array, kind: str, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all files of a batch one after another, and how many each has."""
    column = column.cast(pa.large_binary())
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lengths = np.diff(offsets)
    if (bad := np.flatnonzero(lengths % size)).size:
        raise ValueError(f"{names[int(bad[0])].as_py()} is cut off")
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(whole.tobytes(), kind).astype(np.int64), lengths // size


def _contents(numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Files of little-endian 32-bit numbers from those of all files one after another."""
    offsets = np.concatenate(([0], np.cumsum(counts * 4))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype("<u4").tobytes())]).cast(pa.binary())


def _by_batch(table: DataFrame, decode: Callable[[pa.RecordBatch], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows of all files of a batch at once: many small files cost no more than a few large ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # By parts of bounded bytes: a batch may hold large files.
            total = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_binary(c.type)))
            at = 0
            while at < batch.num_rows:
                done = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, done + (64 << 20), side="right")))
                for columns in in_rows(decode(batch.slice(at, end - at))):
                    yield pa.RecordBatch.from_pydict(columns)
                at = end

    return table.mapInArrow(run, schema)


def in_rows(columns: dict[str, np.ndarray]) -> Iterator[dict]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS):
        yield {k: pa.array(v[at : at + ROWS]) for k, v in columns.items()}


def six_byte_numbers(content: bytes) -> np.ndarray:
    return np.frombuffer(content, dtype=np.uint8).reshape(-1, 6) @ _PLACES


def adj6_edges(numbers: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """src and dst of the numbers of whole records."""
    counts, n = numbers.tolist(), len(numbers)
    heads, at = [], 0
    while at < n:
        heads.append(at)
        if at + 1 >= n or (at := at + 2 + counts[at + 1]) > n:
            raise ValueError(f"{name} is cut off")
    head = np.array(heads, dtype=np.int64)
    body = np.ones(n, dtype=bool)
    body[head] = body[head + 1] = False
    return {"src": np.repeat(numbers[head], numbers[head + 1]), "dst": numbers[body]}


def read_adj6(table: DataFrame) -> DataFrame:
    """Edges (src, dst) of adj6 files, a task each; :mod:`trigrid.sources` reads large files by parts."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        if len(content) % 6:
            raise ValueError(f"{name} is cut off")
        return in_rows(adj6_edges(six_byte_numbers(content), name))

    return _decoded(table.select("name", "content"), decode, "src long, dst long")


def _six(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]


def adj6_bytes(src: np.ndarray, dst: np.ndarray) -> bytes:
    """Records of neighbouring rows with one source."""
    if min(src.min(), dst.min()) < 0 or max(src.max(), dst.max()) >= 1 << 48:
        raise ValueError("an id does not fit 48 bits")
    first = np.concatenate(([0], np.flatnonzero(src[1:] != src[:-1]) + 1))
    counts = np.diff(np.concatenate((first, [len(src)])))
    spots = first + 2 * np.arange(len(first))
    numbers = np.empty(len(src) + 2 * len(first), dtype=np.int64)
    body = np.ones(len(numbers), dtype=bool)
    body[spots] = body[spots + 1] = False
    numbers[spots], numbers[spots + 1], numbers[body] = src[first], counts, dst
    return _six(numbers).tobytes()


def adj6_name(src: np.ndarray, dst: np.ndarray) -> str:
    return f"{int(src[0]):015d}-{int(dst[0]):015d}-{uuid.uuid4().hex[:8]}.adj6"


def in_parts(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of batches as tables of at most ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_adj6(e: DataFrame) -> DataFrame:
    """Edges as a table of adj6 files, in ranges of (src, dst): a source with very many targets spans files, with a
    record in each. Duplicates and self-loops are kept; ids take 48 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, FILE_EDGES):
            src, dst = (part.column(c).to_numpy() for c in ("src", "dst"))
            yield pa.RecordBatch.from_pydict({"name": pa.array([adj6_name(src, dst)]), "content": pa.array([adj6_bytes(src, dst)], pa.binary())})

    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return e.select("src", "dst").repartitionByRange(parts, "src", "dst").sortWithinPartitions("src", "dst").mapInArrow(run, FILES)


def read_el32(table: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """Edges with global ids of edge-list files ``gr-gc.el32`` (sorted or not), or of their later parts ``gr-gc,part.el32``."""
    named = table.withColumn("stem", F.regexp_replace("name", r"\.el32(\.sorted)?$", "")).where("stem <> name")
    parsed = partition.parse_shard_name(named.withColumn("stem", F.regexp_replace("stem", _PART, "$1"))).select("name", "content", "gr", "gc")

    def decode(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        pairs, counts = _joined(batch.column("content"), "<u4", batch.column("name"))
        if (bad := np.flatnonzero(counts % 2)).size:
            raise ValueError(f"{batch.column('name')[int(bad[0])].as_py()} is cut off")
        gr, gc = (np.repeat(batch.column(c).to_numpy(), counts // 2) for c in ("gr", "gc"))
        return {"src": pairs[0::2] + gr * width, "dst": pairs[1::2] + gc * width}

    return _by_batch(parsed, decode, "src long, dst long")


Slices = dict[str, tuple[np.ndarray, np.ndarray]]


def _by_slice(e: DataFrame, width: int, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], Slices]) -> DataFrame:
    """Files of each slice of ``FILE_EDGES`` edges of each grid: its first slice has the grid's name, later ones their number as well.

    Slices are dealt by range and stream through their task in order, so no task holds more than one and a batch: a grid of
    any size is written. ``encode`` takes the edges of whole slices and where each starts, and gives by extension the numbers of
    all their files and how many each has, so many small grids are encoded at once."""
    placed = partition.with_slice(e.select("src", "dst").distinct(), FILE_EDGES, width)
    rows = placed.select("gr", "gc", "slice", (F.col("src") % width).alias("ls"), (F.col("dst") % width).alias("ld"))
    order = ["gr", "gc", "slice"]

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        gr, gc, k, r, c = (t.column(x).to_numpy() for x in (*order, "ls", "ld"))
        start = np.concatenate(([0], np.flatnonzero((gr[1:] != gr[:-1]) | (gc[1:] != gc[:-1]) | (k[1:] != k[:-1])) + 1))
        for x, (numbers, counts) in encode(r, c, start).items():
            key = {"gr": pa.array(gr[start]), "gc": pa.array(gc[start]), "slice": pa.array(k[start])}
            yield pa.RecordBatch.from_pydict(key | {"ext": pa.array([x] * len(start)), "content": _contents(numbers, counts)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in order]
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != k[0] for c, k in zip(order, keys, strict=True)):
                yield from done(held)
                held = []
            # The batch's last slice may go on in the next one.
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(held)

    made = rows.repartitionByRange(*order).sortWithinPartitions(*order, "ls", "ld").mapInArrow(run, "gr long, gc long, slice long, ext string, content binary")
    stem = F.concat_ws("-", "gr", "gc")
    return made.select(F.concat(F.when(F.col("slice") > 0, F.concat_ws(",", stem, "slice")).otherwise(stem), F.lit("."), "ext").alias("name"), "content")


def _each_size(start: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(start, n))


def write_el32(e: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """Sorted, unique edge-list files, one or more a grid."""
    return _by_slice(e, width, lambda r, c, start: {"el32.sorted": (np.stack((r, c), axis=1).ravel(), 2 * _each_size(start, len(r)))})


def _compressed(r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """The three arrays of edges sorted by (r, c)."""
    rows, first = np.unique(r, return_index=True)
    return {"row": rows, "ptr": np.append(first, len(r)), "col": c}


def _compressed_slices(r: np.ndarray, c: np.ndarray, start: np.ndarray) -> Slices:
    """The three arrays of each slice, from edges sorted by (slice, r, c)."""
    opens = np.ones(len(r), bool)
    opens[1:] = r[1:] != r[:-1]
    opens[start] = True
    first = np.flatnonzero(opens)
    sizes = _each_size(start, len(r))
    of = np.searchsorted(start, first, side="right") - 1
    rows = np.bincount(of, minlength=len(start))
    # A slice's offsets are those of its rows and, last, its number of edges.
    ptr = np.empty(len(first) + len(start), np.int64)
    ptr[np.arange(len(first)) + of] = first - start[of]
    ptr[np.cumsum(rows + 1) - 1] = sizes
    return {"row": (r[first], rows), "ptr": (ptr, rows + 1), "col": (c, sizes)}


def write_csr(e: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """Compressed-row files of each grid: ``gr-gc.row``, ``.ptr`` and ``.col``, with further parts for large grids."""
    return _by_slice(e, width, _compressed_slices)


def write_shards(e: DataFrame, shards: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """Compressed-row files of each quadtree shard, with ids that count from the shard's start. A row
    holds one shard, which the quadtree's limit bounds, whatever the size of the grid."""
    side = F.expr(f"shiftright({width}, depth)")
    leaves = partition.with_leaf(e.select("src", "dst").distinct(), shards, width)
    pair = F.struct((F.col("ls") % side).alias("r"), (F.col("ld") % side).alias("c"))
    whole = leaves.groupBy("gr", "gc", "depth", "sr", "sc").agg(F.collect_list(pair).alias("p"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = batch.column("p")[i].values
                r, c = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.lexsort((c, r))
                arrays = _compressed(r[order], c[order])
                stem = batch.column("stem")[i].as_py()
                content = [a.astype("<u4").tobytes() for a in arrays.values()]
                yield pa.RecordBatch.from_pydict({"name": pa.array([f"{stem}.{x}" for x in arrays]), "content": pa.array(content, pa.binary())})

    return partition.shard_name(whole).select("stem", "p").mapInArrow(run, FILES)


def convert(e: DataFrame, limit: int, width: int = partition.WIDTH, relabel: str | None = None) -> DataFrame:
    """Edges as read (say by :func:`read_adj6`) to the files of quadtree shards: relabelled by degree or
    as they are, pointed to smaller ids, repeats and loops removed, cut into shards of at most ``limit`` edges."""
    ws = Workspace(e.sparkSession)
    kept = ws.keep(graph.relabelled(e, relabel) if relabel else graph.normalize(e), "converted")
    return write_shards(kept, ws.keep(partition.quadtree(kept, limit, width), "shards"), width)


def read_csr(table: DataFrame, width: int = partition.WIDTH) -> DataFrame:
    """Edges with global ids of compressed-row files, of grids or quadtree shards. Local ids count from
    the start of the shard that the name states."""
    named = table.withColumns({"stem": F.regexp_extract("name", r"^(.*)\.(row|ptr|col)$", 1), "ext": F.regexp_extract("name", r"\.(row|ptr|col)$", 1)}).where("ext <> ''")
    whole = named.groupBy("stem").agg(*(F.max(F.when(F.col("ext") == x, F.col("content"))).alias(x) for x in ("row", "ptr", "col")))
    whole = whole.withColumn("stem", F.regexp_replace("stem", _PART, "$1"))
    parsed = partition.parse_shard_name(whole).select("stem", "row", "ptr", "col", "gr", "gc", "depth", "sr", "sc")

    def decode(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        stem = batch.column("stem")
        fault = lambda bad, what: f"{stem[int(np.flatnonzero(bad)[0])].as_py()} {what}"
        lacks = np.logical_or.reduce([batch.column(x).is_null().to_numpy(zero_copy_only=False) for x in ("row", "ptr", "col")])
        if lacks.any():
            raise ValueError(fault(lacks, "lacks one of its three files"))
        (rows, n_rows), (starts, n_starts), (cols, n_cols) = (_joined(batch.column(x), "<u4", stem) for x in ("row", "ptr", "col"))
        if (bad := n_starts != n_rows + 1).any():
            raise ValueError(fault(bad, "is cut off"))
        ends = np.cumsum(n_starts)
        if (bad := starts[ends - 1] != n_cols).any():
            raise ValueError(fault(bad, "is cut off"))
        # Differences of neighbours, without those from one file's last to the next one's first.
        sizes = np.delete(np.diff(starts), ends[:-1] - 1)
        gr, gc, depth, sr, sc = (np.repeat(batch.column(x).to_numpy().astype(np.int64), n_cols) for x in ("gr", "gc", "depth", "sr", "sc"))
        return {"src": np.repeat(rows, sizes) + gr * width + sr * (width >> depth), "dst": cols + gc * width + sc * (width >> depth)}

    return _by_batch(parsed, decode, "src long, dst long")


def write_relabel(mapping: DataFrame) -> DataFrame:
    """A relabel table (vid, new_vid; ids from 0 without gaps) as files of one block of old ids each."""
    block = mapping.groupBy(F.expr(f"vid div {RELABEL_BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("vid", "new_vid"))).alias("p"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = batch.column("p")[i].values
                vid, new = (pairs.field(k).to_numpy() for k in (0, 1))
                first = batch.column("block")[i].as_py() * RELABEL_BLOCK
                if (vid != np.arange(first, first + len(vid))).any():
                    raise ValueError("the relabel table has gaps")
                yield pa.RecordBatch.from_pydict({"name": pa.array([f"relabel-{first:015d}.bin"]), "content": pa.array([new.astype("<u8").tobytes()], pa.binary())})

    return block.mapInArrow(run, FILES)


def read_relabel(table: DataFrame) -> DataFrame:
    """vid, new_vid of relabel files; ``relabel.bin`` counts from 0, a block from the id it names."""
    first = F.coalesce(F.regexp_extract("name", r"^relabel-(\d+)\.bin$", 1).try_cast("long"), F.lit(0).cast("long"))
    named = table.where(F.col("name").rlike(r"^relabel(-\d+)?\.bin$")).select("name", "content", first.alias("first"))

    def decode(name: str, content: bytes, first: int) -> Iterator[dict]:
        new = _longs(content, "<u8", name)
        return in_rows({"vid": np.arange(first, first + len(new)), "new_vid": new})

    return _decoded(named, decode, "vid long, new_vid long")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated edges; lines that start with # are comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="src long, dst long").where("src IS NOT NULL AND dst IS NOT NULL")


def write_tsv(e: DataFrame, path: str) -> None:
    e.select("src", "dst").write.mode("overwrite").csv(path, sep="\t")


def metadata(e: DataFrame, dataname: str, width: int = partition.WIDTH) -> DataFrame:
    """The metadata document of a grid data set, with its non-empty grids by name: one row, or where there are many grids a row for each part of
    about ``DOCUMENT_GRIDS``, which all state the whole data set's extent. No row, and no task, holds all grids."""
    ws = Workspace(e.sparkSession)
    grids = ws.keep(partition.with_grid(e, width).groupBy("gr", "gc").agg(F.max(F.greatest("src", "dst")).alias("top")), "grids")
    whole = grids.agg(F.count("*").alias("n"), F.max(F.greatest("gr", "gc")).alias("last"), F.max("top").alias("max_vid")).first()
    parts = max(1, -(-whole["n"] // DOCUMENT_GRIDS))
    name = F.struct(F.concat_ws("-", "gr", "gc").alias("name"), F.struct(F.col("gr").alias("row"), F.col("gc").alias("col")).alias("index"))
    # Without grids there is one document still, an empty one.
    rows = grids.select(F.pmod(F.xxhash64("gr", "gc"), F.lit(parts)).alias("part"), name.alias("g"))
    listed = (rows.repartition(parts, "part").groupBy("part") if whole["n"] else rows.groupBy()).agg(F.array_sort(F.collect_list("g")).alias("grid"))
    side = F.lit((-1 if whole["last"] is None else whole["last"]) + 1).cast("long")
    top = F.lit(whole["max_vid"]).cast("long")
    return listed.select(
        F.lit(dataname).alias("dataname"),
        F.struct(F.lit("row").alias("row"), F.lit("ptr").alias("ptr"), F.lit("col").alias("col")).alias("extension"),
        F.struct(F.struct(side.alias("row"), side.alias("col")).alias("count"), F.struct(F.lit(width).cast("long").alias("row"), F.lit(width).cast("long").alias("col")).alias("width"), top.alias("max_vid")).alias("info"),
        "grid",
    )


def write_metadata(meta: DataFrame, path: str) -> None:
    """As JSON, a file for each row."""
    meta.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    pair = "struct<row: long, col: long>"
    schema = f"dataname string, extension struct<row: string, ptr: string, col: string>, info struct<count: {pair}, width: {pair}, max_vid: long>, grid array<struct<name: string, index: {pair}>>"
    return spark.read.json(path, schema=schema, multiLine=True)
