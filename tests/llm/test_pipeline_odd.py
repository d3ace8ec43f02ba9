"""Every stage of the pipeline on nulls, empty tables, long texts, repeated rows and clashing columns."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from trigrid.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long, para, lone = text(60_000), text(200), text(80)
    rows = [(1, para, "en", "a", 1), (2, para, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, long, "en", None, 1), (6, "few words", "en", "a", 9), (None, lone, "en", "a", 5), (7, text(120), "de", "c", 2)]
    rows += [rows[7], rows[3]]
    clash = {"kept": F.lit("x"), "row": F.lit(1), "position": F.lit(2), "doc": F.lit("y"), "page": F.lit(3), "__copies": F.lit(4), "component_id": F.lit(5), "host": F.lit(6), "block": F.lit(7)}
    docs = spark.createDataFrame(rows, DOCS).withColumns(clash)
    now, ws, seen = docs, Workspace(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        after = ws.keep(stage(spark, now, ""), name)
        if name != "bpe":
            assert after.columns == docs.columns
            assert all((r.kept, r.row, r.position, r["__copies"]) == ("x", 1, 2, 4) for r in after.collect())
        seen[name] = sorted((r.doc_id for r in after.collect()), key=repr)
        now = after
    assert seen["quality"] == sorted([1, 2, 5, 7, 7, None], key=repr)
    assert seen["lines"] == seen["quality"]
    assert seen["neardup"] == sorted([1, 5, 7, 7, None], key=repr)
    assert set(seen["mixing"]) == set(seen["neardup"]) and len(seen["mixing"]) >= len(seen["neardup"])
    assert seen["bpe"] == seen["mixing"]


def test_stages_on_an_empty_table(spark):
    now, ws = spark.createDataFrame([], DOCS), Workspace(spark)
    for name, stage in corpus_pipeline.STAGES:
        now = ws.keep(stage(spark, now, ""), name)
        assert now.count() == 0
