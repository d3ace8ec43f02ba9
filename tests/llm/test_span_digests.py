"""Spans proposed by hashes are confirmed by the words at both coordinates."""

import hashlib
import random

import pyarrow as pa

from trigrid.llm import debruijn
from trigrid.llm.common import Workspace

SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("source", pa.int64()), ("source_key", pa.int64()), ("source_lo", pa.int32())]))


def test_digests_are_those_of_the_words():
    texts = ["a b  c\td\ne", None, "é  b\n\nc d ", ""]
    spans = [[(0, 3), (2, 5)], None, [(1, 4), (0, 9)], []]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([1, 2, 3, 4], pa.int64()),
        "row_key": pa.array([7, 7, 7, 7], pa.int64()),
        "text": pa.array(texts),
        "spans": pa.array([None if s is None else [{"lo": a, "hi": b} for a, b in s] for s in spans], SPAN),
    })
    got = debruijn._digests(batch)
    want = [hashlib.blake2b(" ".join((t or "").split()[a:b]).encode(), digest_size=16).digest() for t, s in zip(texts, spans, strict=True) for a, b in s or ()]
    assert got["digest"].to_pylist() == want
    assert got["doc_id"].to_pylist() == [1, 1, 3, 3] and got["lo"].to_pylist() == [0, 2, 1, 0]


def test_sources_with_many_copies_repeated_rows_and_shared_ids(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    rows = [(i, f"{rng.choice(vocab)} {passage} {rng.choice(vocab)}" if i % 3 else None if i % 2 else passage[: i * 4]) for i in range(90)]
    rows += [rows[1], rows[1], (5, passage + " more " + passage), (None, passage), (None, None)]
    got = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark), window=8, anchor=3)
    starts: dict[tuple, int] = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for p in range(len(w) - 7):
            starts.setdefault(tuple(w[p : p + 8]), i)
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = {p + k for p in range(len(w) - 7) if i is not None and starts[tuple(w[p : p + 8])] < i for k in range(8)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
