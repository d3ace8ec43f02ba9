"""Equal rows, budgets, and the order in which the mix is written."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from trigrid.llm import mixing
from trigrid.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_equal_rows_share_exactly(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 2, DOCS)
    for shown in (0, 1, 3, 6):
        target = mixing.MixTarget(budget_tokens=3 * shown)
        assert mixing.mix(df, Workspace(spark), target).count() == shown


def test_equal_rows_with_other_columns(spark):
    rows = [(1, "a b c", "en", "s", k) for k in range(4)] + [(2, "d e f", "en", "s", 9)]
    df = spark.createDataFrame(rows, DOCS)
    for shown in (3, 7):
        got = mixing.mix(df, Workspace(spark), mixing.MixTarget(budget_tokens=3 * shown)).collect()
        times = collections.Counter(r.n_chars for r in got)
        assert len(got) == shown and set(times.values()) <= {shown // 5, shown // 5 + 1}


@pytest.mark.parametrize("budget", [None, 5000, 40_000])
def test_mix_is_the_plan_in_order(spark, budget, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a"] * 8 + ["b", None]), 0) for i in range(600)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("clash"), "position": F.lit(1), "__row": F.lit("x"), "block": F.lit(2)})
    target = mixing.MixTarget(budget_tokens=budget)
    plan = mixing.mix_plan(df, Workspace(spark), target).collect()
    mixed = mixing.mix(df, Workspace(spark), target)
    assert mixed.columns == df.columns
    # The rows as they are written, part by part.
    got = [r for part in mixed.rdd.glom().collect() for r in part]
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in plan)
    want = [r.doc_id for r in sorted(plan, key=lambda r: r.position)]
    assert [r.doc_id for r in got] == want or sum(a != b for a, b in zip([r.doc_id for r in got], want, strict=True)) <= 2 * (len(plan) - len({r.position for r in plan}))
    tokens = collections.Counter()
    for r in rows:
        tokens[r[3]] += len(r[1].split())
    by = collections.defaultdict(list)
    for r in plan:
        by[r.source, r.epoch].append(r)
        assert 0 <= r.position < 1
    # Whole passes show each row once; blocks follow one another; a partial pass ends where the next row doesn't fit.
    total = sum(tokens.values()) if budget is None else budget
    for (source, epoch), shown in by.items():
        shown.sort(key=lambda r: r.position)
        order = [r.block for r in shown if r.n_tokens]
        runs = [b for k, b in enumerate(order) if not k or order[k - 1] != b]
        assert len(runs) == len(set(runs))
        if (source, epoch + 1) in by:
            assert sum(r.n_tokens for r in shown) == tokens[source]
            assert max(r.position for r in shown) <= min(r.position for r in by[source, epoch + 1])
    if budget is not None:
        spent = sum(r.n_tokens for r in plan)
        assert total - 40 * len(tokens) - len(tokens) <= spent <= total


def test_a_whole_source_of_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    assert mixing.mix(df, Workspace(spark)).count() == 3
    assert mixing.mix(df.limit(0), Workspace(spark)).count() == 0
    assert mixing.mix_plan(df.limit(0), Workspace(spark)).count() == 0
