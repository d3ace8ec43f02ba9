"""Removal of long repeated spans over a compacted token de Bruijn graph.

Edges are 50-word k-mers. Materialising every edge would multiply the corpus, so edges are held as
paths from the start. Each k-mer is governed by the smallest 16-word hash inside it (its anchor: equal
k-mers have equal anchors), and the consecutive k-mers of a document with one anchor form a path, a
row of anchor, path hash, document and word range. Then, by Spark aggregations and joins:

1. anchors seen in one document only are dropped: none of their edges repeats;
2. an anchor all of whose paths are equal does not branch: its path is one compacted edge, and all
   but the first document's copies are repeats;
3. at a branching anchor equal paths still compact: all but the first document's are repeats. Only
   the first copy of each distinct path is expanded into its edges, which are compared one by one.

Hashes only propose repeats. Every proposed span carries the coordinates of its source, the first document's copy
(document, word range), and goes only if the words at both coordinates have one 128-bit digest, taken from the texts
themselves: a collision of hashes can leave a repeat in place but never takes a word that is not one. A span is checked as
the path or edge it was found by, so a source is read once for each of its own paths, however many copies it has. Verified
spans of a document that touch are then cut as one.

Defined results: documents are ordered by doc_id; a word goes if any 50-word window over it also
starts in a document with a smaller doc_id. A null doc_id neither removes nor loses words; a null or
empty text has no words; rows that share a doc_id are one document with respect to ownership (they
don't remove each other's words) and keep a result row each; texts of any length are read whole; an
empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, keyed_texts
from .textkernel import Words

WINDOW = 50
ANCHOR = 16
#: Tells apart rows of one doc_id with different texts; as computed in _paths.
_TEXT_KEY = "cast(crc32(encode(coalesce(text, ''), 'utf-8')) as bigint)"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value in each full window of the given width, of equal ones the first: equal windows
    choose alike, whatever slice they lie in."""
    best, at = values, np.arange(len(values))

    def later(step: int) -> None:
        nonlocal best, at
        n = len(best) - step
        lower = best[step:] < best[:n]
        best, at = np.where(lower, best[step:], best[:n]), np.where(lower, at[step:], at[:n])

    done = 1
    while 2 * done <= width:
        later(done)
        done *= 2
    if width > done:
        later(width - done)
    return at


def _paths(batch: pa.RecordBatch, window: int, anchor: int) -> dict:
    """The paths of a slice of documents."""
    words = Words(batch.column("text").to_pylist())
    ids = batch.column("doc_id")
    n = len(words.starts)
    empty = np.zeros(0, dtype=np.int64)
    doc = at = lo = hi = empty
    grams = np.zeros(0, dtype=np.uint64)
    if n >= window:
        grams = words.grams(anchor)
        chosen = _sliding_argmin(grams, window - anchor + 1)
        start = np.arange(len(chosen))
        owner = np.searchsorted(words.first, start, side="right") - 1
        valid = start + window <= words.first[owner + 1]
        start, owner, chosen = start[valid], owner[valid], chosen[valid]
        if len(start):
            new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])))
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(start)])) - 1
            doc, at, lo, hi = owner[first], chosen[first], start[first], start[last]
    base = words.first[doc]
    key = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], dtype=np.int64)
    return {
        "doc_id": ids.take(pa.array(doc)),
        "row_key": pa.array(key[doc]),
        "anchor": pa.array(grams[at].view(np.int64)),
        "path": pa.array(words.spans(lo, hi + window, 1).view(np.int64)),
        "lo": pa.array((lo - base).astype(np.int32)),
        "hi": pa.array((hi - base).astype(np.int32)),
    }


def _edges(batch: pa.RecordBatch, window: int) -> dict:
    """The k-mers that start in the wanted ranges of each document."""
    words = Words(batch.column("text").to_pylist())
    e1, e2 = words.grams(window, 0), words.grams(window, 1)
    doc, pos = [], []
    for i, ranges in enumerate(batch.column("ranges").to_pylist()):
        starts = sorted({p for r in ranges for p in range(r["lo"], r["hi"] + 1)})
        doc += [i] * len(starts)
        pos += starts
    doc, pos = np.array(doc, dtype=np.int64), np.array(pos, dtype=np.int64)
    at = words.first[doc] + pos
    return {
        "doc_id": batch.column("doc_id").take(pa.array(doc)),
        "row_key": batch.column("row_key").take(pa.array(doc)),
        "e1": pa.array(e1[at].view(np.int64)),
        "e2": pa.array(e2[at].view(np.int64)),
        "lo": pa.array(pos.astype(np.int32)),
    }


def _digests(batch: pa.RecordBatch) -> dict:
    """A digest of the words of every span asked for, next to the span."""
    spans = batch.column("spans")
    of, flat = spans.value_parent_indices(), spans.flatten()
    words = Words(batch.column("text").to_pylist())
    of_row = of.to_numpy()
    lo, hi = (np.minimum(words.first[of_row] + flat.field(name).to_numpy(), words.first[of_row + 1]) for name in ("lo", "hi"))
    # Words joined by one byte, so that equal digests mean equal words whatever stands between them.
    plain, at = words.joined()
    starts, ends = at[lo], at[hi] - 1
    digest = [hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    columns = {name: batch.column(name).take(of) for name in ("doc_id", "row_key")}
    columns |= {name: flat.field(name) for name in ("lo", "hi", "source", "source_key", "source_lo")}
    return columns | {"digest": pa.array(digest, pa.binary())}


def _kept(batch: pa.RecordBatch, texts: bool) -> dict:
    """Counts and digest of the words outside the removed ranges."""
    n_words, n_removed, digest, kept_texts, spans = [], [], [], [], []
    for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        merged: list[list[int]] = []
        for a, b in sorted((r["lo"], r["hi"]) for r in ranges or ()):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        n_words.append(len(words))
        n_removed.append(sum(b - a for a, b in merged))
        for a, b in reversed(merged):
            del words[a:b]
        kept = b" ".join(words)
        digest.append(hashlib.sha256(kept).hexdigest())
        if texts:
            kept_texts.append(kept.decode("utf-8", "surrogatepass"))
            spans.append([{"lo": a, "hi": b} for a, b in merged])
    out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
    if texts:
        out |= {"kept_text": pa.array(kept_texts, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))}
    return out


def remove_repeats(docs: DataFrame, ws: Workspace, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """One row per document: word counts and digest of what is left; with ``texts`` the text left and
    the removed word ranges too."""
    docs = keyed_texts(docs)
    found_schema = "doc_id long, row_key long, lo int, hi int, source long, source_key long, source_lo int"
    paths = arrow_map(
        docs.where("doc_id IS NOT NULL"), lambda b: _paths(b, window, anchor), "doc_id long, row_key long, anchor long, path long, lo int, hi int"
    )
    paths = ws.keep(paths, "paths")
    # Aggregates are written before they join back to what they sum up: adaptive execution splits the hot
    # anchors (a passage in a third of all documents) of a join of two scans, not those of a join with an aggregate.
    # The first document's copy: its id, and row and position as one number, which a hash aggregate can hold.
    first_copy = [F.min("doc_id").alias("source"), F.expr("min_by(shiftleft(row_key, 31) | lo, doc_id) AS place")]
    anchors = paths.groupBy("anchor").agg(F.min("path").alias("p0"), F.max("path").alias("p1"), *first_copy, F.max("doc_id").alias("last"))
    anchors = ws.keep(anchors.where("source <> last").select("anchor", "source", "place", (F.col("p0") != F.col("p1")).alias("branches")), "anchors")
    shared = ws.keep(paths.join(anchors, "anchor").select("doc_id", "row_key", "anchor", "path", "lo", "hi", "source", "place", "branches"), "shared")
    ws.drop("paths")
    source = ["source", "shiftrightunsigned(place, 31) AS source_key", f"cast(place & {(1 << 31) - 1} AS int) AS source_lo"]
    span = ["doc_id", "row_key", "lo", f"hi + {window} AS hi", *source]
    compacted = shared.where("NOT branches AND doc_id > source").selectExpr(*span)
    branching = shared.where("branches").drop("source", "place")
    owners = ws.keep(branching.groupBy("anchor", "path").agg(*first_copy), "owners")
    branching = ws.keep(branching.join(owners, ["anchor", "path"]).select("doc_id", "row_key", "lo", "hi", "source", "place"), "branching")
    copies = branching.where("doc_id > source").selectExpr(*span)
    # The first copies of branching paths, with their text: ranges of a document come together, which
    # its own length bounds.
    wanted = branching.where("doc_id = source").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    known = docs.where("doc_id IS NOT NULL").withColumn("row_key", F.expr(_TEXT_KEY))
    edges = arrow_map(known.join(wanted, ["doc_id", "row_key"]), lambda b: _edges(b, window), "doc_id long, row_key long, e1 long, e2 long, lo int")
    edges = ws.keep(edges, "edges")
    owned = edges.groupBy("e1", "e2").agg(*first_copy, F.max("doc_id").alias("last")).where("source <> last")
    owned = ws.keep(owned.select("e1", "e2", "source", "place"), "owned")
    single = edges.join(owned, ["e1", "e2"]).where("doc_id > source").selectExpr("doc_id", "row_key", "lo", f"lo + {window} AS hi", *source)
    found = ws.keep(compacted.union(copies).union(single), "found")
    ws.drop("anchors", "shared", "owners", "branching", "edges", "owned")
    # Both coordinates of every span go to the texts: a source once for each of its spans.
    sources = found.selectExpr("source AS doc_id", "source_key AS row_key", "source_lo AS lo", "source_lo + hi - lo AS hi").distinct()
    asked = found.unionByName(sources, allowMissingColumns=True)
    asked = asked.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "hi", "source", "source_key", "source_lo")).alias("spans"))
    digests = arrow_map(known.join(asked, ["doc_id", "row_key"]), _digests, found_schema + ", digest binary")
    digests = ws.keep(digests, "digests")
    first = digests.where("source IS NULL").select(
        F.col("doc_id").alias("source"), F.col("row_key").alias("source_key"), F.col("lo").alias("source_lo"), F.expr("hi - lo AS words"), "digest"
    )
    same = digests.where("source IS NOT NULL").withColumn("words", F.expr("hi - lo"))
    same = same.join(first, ["source", "source_key", "source_lo", "words", "digest"], "left_semi")
    spans = same.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    spans = ws.keep(spans, "spans")
    # Rows that share a doc_id may each have ranges; those of other texts are filtered by the row key.
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("row_key", "ranges")).alias("rows"))
    by_doc = ws.keep(by_doc, "by-doc")
    ws.drop("found", "digests", "spans")
    own = F.expr("flatten(transform(filter(rows, r -> r.row_key = " + _TEXT_KEY + "), r -> r.ranges))").alias("ranges")
    joined = docs.where("doc_id IS NOT NULL").join(by_doc, "doc_id", "left").select("doc_id", "text", own)
    # Rows without an id take no part in the join: they would all meet in one task.
    joined = joined.unionByName(docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("ranges")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return arrow_map(joined, lambda b: _kept(b, texts), schema + ", kept_text string, spans array<struct<lo:int,hi:int>>" * texts)

