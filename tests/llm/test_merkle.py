"""The manifest against a tree in plain Python and against its SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from trigrid.llm import merkle, queries
from trigrid.llm.common import Workspace

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return digest(*["-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}" for v in values])


def climb(nodes):
    """Root of a list of digests, and each one's steps (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, a in enumerate(at):
            run, i = runs[a // 8], a % 8
            steps[k].append((run[:i], run[i + 1 :]))
            at[k] = a // 8
        nodes = [digest(*run) for run in runs]
    return nodes[0], steps


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        found = leaf(r, r["text"].translate(lower) if hit and r["text"] is not None else r["text"])
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), found))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[g])]) for g in order]
    if not trees:
        return []
    root, above = climb([t[0] for t in trees])
    out = []
    for g, (subroot, steps), more in zip(order, trees, above, strict=True):
        for (known, doc_id, own, found), path in zip(sorted(groups[g]), steps, strict=True):
            fold = found
            for left, right in path + more:
                fold = digest(*left, fold, *right)
            proof = digest(*[s for left, right in path + more for s in left + right])
            out.append((doc_id if known else None, own, subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


def results(df):
    assert df.columns == RESULT
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_python(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = results(queries.op12_merkle_manifest(spark, SMALL))
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


@pytest.mark.parametrize("langs", [["en"], [None, "", "de", "dé", "en", "zz"], [f"l{k}" for k in range(70)]])
def test_odd_rows_and_many_groups(spark, langs):
    rng = random.Random(len(langs))
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "Aé", "a B", "x" * 5000]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 5])) for _ in range(150)]
    rows += rows[:20] + [(500, "Alone", "only", None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("clash"), "root": F.lit(1), "tree": F.lit(2), "index": F.lit(3), "children": F.lit(4), "__at": F.lit(5)})
    got = results(merkle.manifest(df, Workspace(spark), merkle.every_third()))
    # Rows without id are in no order but that of their digests, as ties are.
    assert got == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, DOCS).toArrow())
    assert got == sorted(con.sql(f"SELECT {', '.join(RESULT)} FROM ({merkle.ORACLE})").fetchall(), key=repr)


def test_untampered_proofs_all_verify_and_the_store_has_levels(spark):
    df = spark.createDataFrame([(i, f"Text {i}", "en", None, i) for i in range(100)], DOCS)
    ws = Workspace(spark)
    got = merkle.manifest(df, ws).collect()
    assert all(r.verified and r.folded_root == r.root == r.subroot for r in got)
    store = spark.read.parquet(ws.path("group"))
    assert {(r.level, r["count"]) for r in store.groupBy("level").count().collect()} == {(0, 100), (1, 13), (2, 2), (3, 1)}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.manifest(none, Workspace(spark)).count() == 0
    (row,) = merkle.manifest(none.union(spark.createDataFrame([(1, "a", None, None, None)], DOCS)), Workspace(spark)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest("") and row.verified
