"""The threshold is a parameter, and what depends on it follows."""

from __future__ import annotations

import numpy as np
import pytest

from trigrid.llm import minhash, neardup
from trigrid.llm.common import Workspace


def test_representatives_at_a_lower_threshold(spark):
    words = [f"w{i}" for i in range(54)]
    near = [*words[:30], "other", *words[31:]]
    far = [*words[:20], "else", *words[21:30], "other", *words[31:]]
    texts = [" ".join(words), " ".join(near), " ".join(f"z{i}" for i in range(54)), " ".join(f"y{i}" for i in range(54)), " ".join(far).replace("w", "y")]
    # 45 of 55 shingles in common: 0.818; of the last two 40 of 60.
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in neardup.keep_representatives(docs, Workspace(spark), 80).collect()) == [0, 2, 3, 4]
    assert all(r.kept for r in neardup.near_duplicates(docs, Workspace(spark)).collect())


def test_limits_follow_from_the_threshold():
    assert (neardup.Limits().least_agreement, neardup.Limits().rows) == (0.69, 4)
    assert (neardup.Limits(80).least_agreement, neardup.Limits(80).rows) == (0.62, 4)
    for t in (50, 60, 70, 80, 85, 90, 95):
        limits = neardup.Limits(t)
        assert (1 - (t / 100) ** limits.rows) ** limits.bands <= minhash.MOST_MISSED
        assert len(minhash.bands(np.arange(minhash.BINS, dtype=np.uint64), limits.rows)) == limits.bands


@pytest.mark.parametrize("threshold", [60, 80])
def test_limits_reach_the_block_pass(threshold):
    a = np.arange(100, dtype=np.uint64)
    b = np.arange(100 - threshold - 5, 200 - threshold - 5, dtype=np.uint64)
    both = threshold + 5
    assert neardup._linked(a, b, threshold) == (100 * both >= threshold * (200 - both))
