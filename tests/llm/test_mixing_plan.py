"""The plan of a mix row by row against one made in plain Python; only the hashes that order rows and blocks come from Spark."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from trigrid.llm import mixing
from trigrid.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SEED = mixing.MixTarget().seed


def hashes(spark, name, keys, schema, *parts):
    """xxhash64 of the seed and the columns, by key."""
    df = spark.createDataFrame(sorted(keys), schema).withColumn("h", F.xxhash64(F.lit(SEED + name), *parts))
    return {tuple(r)[:-1]: r.h for r in df.collect()}


def plan(spark, rows, budget, max_repeats, block_tokens):
    tokens, of = collections.Counter(), collections.defaultdict(list)
    for i, text, _, source, _ in rows:
        n = len((text or "").split())
        tokens[source] += n
        of[source].append((i, text, n))
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    # The repetition limit in closed form: (top / low) ** (1 - exponent) <= limit.
    spread = max(share.values()) / min(share.values())
    exponent = max(0.0, 1 - math.log(max_repeats) / math.log(spread)) if spread > 1 else (1.0 if len(share) == 1 else 0.0)
    weight = {s: p**exponent / sum(q**exponent for q in share.values()) for s, p in share.items()}
    if budget is None:
        budget = max(tokens[s] / w for s, w in weight.items())
    text_of = {i: t for docs in of.values() for i, t, _ in docs}
    row = F.struct(F.col("id"), F.xxhash64("text").alias("h"))
    epochs = range(12)
    dealt = hashes(spark, 0, [(i, t) for i, t in text_of.items()], "id long, text string", row)
    line = hashes(spark, 2, [(i, t, e) for i, t in text_of.items() for e in epochs], "id long, text string, epoch long", row, "epoch")
    turn = hashes(spark, 1, [(b, e) for b in range(200) for e in epochs], "block long, epoch long", "block", "epoch")
    out = []
    for source, docs in of.items():
        if not tokens[source]:
            out += [(i, source, 0, 0) for i, _, _ in docs]
            continue
        quota = math.floor(weight[source] * budget * (1 + 1e-9) + 1e-6)
        passes, rest = divmod(quota, tokens[source])
        n_blocks = max(1, math.ceil(tokens[source] / block_tokens))
        blocks = collections.defaultdict(list)
        for i, t, n in docs:
            blocks[dealt[i, t] % n_blocks].append((i, t, n))
        out += [(i, source, e, b) for e in range(passes) for b, held in blocks.items() for i, _, _ in held]
        room = rest
        for b in sorted(blocks, key=lambda b: (turn[b, passes], b)):
            size = sum(n for _, _, n in blocks[b])
            if room <= 0:
                break
            if size <= room:
                out += [(i, source, passes, b) for i, _, _ in blocks[b]]
            else:
                run = 0
                for i, t, n in sorted(blocks[b], key=lambda d: line[d[0], d[1], passes]):
                    run += n
                    if run <= room:
                        out.append((i, source, passes, b))
            room -= size
    return sorted(out, key=repr), weight


@pytest.mark.parametrize(("budget", "max_repeats"), [(None, 2.0), (None, 1.3), (3000, 2.0), (25_000, 4.0)])
def test_plan_row_by_row(spark, monkeypatch, budget, max_repeats):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 150)
    rng = random.Random(8)
    sources = ["web"] * 12 + ["books"] * 3 + ["code", None]
    rows = [(i, None if i % 41 == 0 else " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 30))), "en", rng.choice(sources), 0) for i in range(500)]
    rows += [(900, "", "en", "blank", 0), (901, None, "en", "blank", 0)]
    target = mixing.MixTarget(budget_tokens=budget, max_repeats=max_repeats)
    got = mixing.mix_plan(spark.createDataFrame(rows, DOCS), Workspace(spark), target).collect()
    want, weight = plan(spark, rows, budget, max_repeats, 150)
    assert sorted(((r.doc_id, r.source, r.epoch, r.block) for r in got), key=repr) == want
    for r in got:
        assert 0 <= r.position < 1 and r.weight == pytest.approx(weight.get(r.source, 0.0), rel=1e-6)
    # Passes of a source stand one after the other in its order.
    for s in weight:
        last = -1
        for r in sorted((r for r in got if r.source == s), key=lambda r: r.position):
            assert r.epoch >= last or r.n_tokens == 0
            last = max(last, r.epoch)
