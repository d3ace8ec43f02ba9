"""Constants propagate through sums of any length."""

from __future__ import annotations

import random

import pytest

from trigrid.llm import secret_scan


def test_long_sums_report_every_literal():
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcXYZ0189+/") for _ in range(64)) for _ in range(26)]
    text = "\n".join(f'p{i} = "{p}"' for i, p in enumerate(parts)) + "\nprivate_key = " + " + ".join(f"p{i}" for i in range(26))
    assert [text[a:b] for a, _, b in secret_scan.lexed_spans(text)] == parts
    blob = "".join(rng.choice("abcXYZ0189") for _ in range(300))
    text = f'blob = "{blob}"\napi_token = "v1." + blob\n'
    assert [text[a:b] for a, _, b in secret_scan.lexed_spans(text)] == [blob, "v1."]
    doubled = 'x = "abZ9k!Qe"\n' + "x = x + x\n" * 2000 + "api_token = x\n"
    assert secret_scan.lexed_spans(doubled) == [(5, 3, 13)]


@pytest.mark.parametrize("seed", range(20))
def test_profiles_score_as_the_text_does(seed):
    rng = random.Random(seed)
    bits = ["Zk9", "q!", "ab", "xx", "exam", "ple", "**", " ", "<", ">", "${", "Your", "_", "é", "{", "change", "me"]
    for _ in range(50):
        parts = ["".join(rng.choice(bits[: rng.choice([3, 17])]) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(rng.randint(1, 8))]
        value = ""
        for p in parts:
            value = secret_scan.added(value, secret_scan._kept(p))
        assert secret_scan.score("api_token", value) == pytest.approx(secret_scan.score("api_token", "".join(parts)), abs=1e-12)
