"""Coverage by repeated n-grams is judged at every length."""

from __future__ import annotations

import collections
import random

import pytest

from trigrid.llm import quality


@pytest.mark.parametrize("words", [50, 150, 250])
def test_coverage_at_every_length(words):
    spam = "\n".join(f"buy cheap watches here today {i}" for i in range(words // 6 + 1))
    plain = " ".join(f"word{i}" for i in range(words))
    header = "the daily example of all the news"
    framed = f"{header}\n" + " ".join(f"word{i}" for i in range(words - 14)) + f"\n{header}"
    got = quality.measure([spam, plain, framed])
    assert got["base_failed"] == [False, False, False]
    assert got["kept"] == [False, True, True]
    assert "dup_5gram" in got["reasons"][0] and "top_4gram" in got["reasons"][0]


@pytest.mark.parametrize("least", [2, 3, 5])
def test_top_grams_by_their_least_count(least):
    """Against counts of joined words, with the least count as the only difference to the published rule."""
    rng = random.Random(least)
    texts = [" ".join(rng.choice("abcdefghijklm") * rng.choice([1, 9]) for _ in range(rng.randint(20, 60))) for _ in range(150)]
    got = quality.measure(texts, quality.QualityRules(min_top_count=least))
    for text, reasons in zip(texts, got["reasons"], strict=True):
        w = text.split()
        for n, limit in quality.QualityRules().top_gram_limits:
            counts = collections.Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
            most = max(counts.values())
            shares = {most * len(g.replace(" ", "")) / len("".join(w)) > limit for g, c in counts.items() if c == most}
            if len(shares) == 1:
                assert (f"top_{n}gram" in reasons) == (most >= least and shares == {True})
