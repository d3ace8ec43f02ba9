"""Copies of a page are one page: the line stage empties none, and one copy of each survives the pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb

from trigrid.llm import linededup
from trigrid.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def page(rng):
    return "\n".join(" ".join(f"w{rng.randrange(4000)}" for _ in range(12)) for _ in range(6))


def rows_of_copies():
    rng = random.Random(4)
    rows = []
    for host in range(10):
        text = page(rng)
        rows += [(10 * host + k, text, "en", f"host{host}", len(text)) for k in range(2)]
    menu = "home\nabout us"
    rows += [(200 + k, f"{menu}\n{page(rng)}", "en", "busy", 1) for k in range(30)]
    return rows + rows[20:40] + [(300, None, "en", "busy", None), (301, None, "en", "busy", None)]


def test_copies_keep_their_lines(spark):
    rows = rows_of_copies()
    df = spark.createDataFrame(rows, DOCS)
    cleaned = linededup.clean_documents(df, Workspace(spark)).collect()
    before = {r[0]: r[1] for r in rows}
    for r in cleaned:
        if r.source != "busy":
            assert r.text == before[r.doc_id]
        elif r.text is not None:
            assert r.text == before[r.doc_id].removeprefix("home\nabout us\n")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"text": object}).where(lambda x: x.notnull(), None))
    got = linededup.line_report(df, Workspace(spark))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({linededup.ORACLE})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_one_copy_of_each_page_survives_the_pipeline(spark):
    rows = rows_of_copies()[:20]
    now, ws = spark.createDataFrame(rows, DOCS), Workspace(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = ws.keep(stage(spark, now, ""), name)
    assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted((i, t) for i, t, *_ in rows if i % 10 == 0)
