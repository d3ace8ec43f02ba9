"""Shares, reasons and verdict against a version in plain Python."""

from __future__ import annotations

import collections
import random
import re

import pytest

from trigrid.llm import quality

DUP = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP = {2: 0.20, 3: 0.18, 4: 0.16}


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def judge(text):
    """kept, reasons, worst n-gram share, line shares; ties of the top n-gram leave its share open."""
    text = text or ""
    w = words_of(text)
    chars = sum(map(len, w))
    lines = [x for x in text.split("\n") if words_of(x)]
    framed = len(lines) > 1 and lines[0] == lines[-1]
    end = len(w) - (len(words_of(lines[-1])) if framed else 0)
    reasons, worst, tops = [], 0.0, {}
    for n, limit in DUP.items():
        seen, marked = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen and i < end:
                marked |= set(range(i, i + n))
            seen.add(g)
        share = sum(len(w[i]) for i in marked) / chars if chars and len(w) > n else 0.0
        worst = max(worst, share)
        if share > limit:
            reasons.append(f"dup_{n}gram")
    for n, limit in TOP.items():
        counts = collections.Counter(tuple(w[i : i + n]) for i in range(min(end, len(w) - n + 1)))
        best = max(counts.values(), default=0)
        tops[n] = {best * sum(map(len, g)) / chars > limit for g, c in counts.items() if c == best and best > 2 and len(w) > n}
        if tops[n] == {True}:
            reasons.append(f"top_{n}gram")
    seen, dup, dup_chars = set(), 0, 0
    for k, line in enumerate(lines):
        if line in seen and not (framed and k == len(lines) - 1):
            dup += 1
            dup_chars += len(line)
        seen.add(line)
    share, char_share = (dup / len(lines), dup_chars / len(text)) if w else (0.0, 0.0)
    reasons += ["dup_lines"] * (share > 0.30) + ["dup_line_chars"] * (char_share > 0.20)
    reasons += ["symbols"] * bool(w and len(re.findall(r"[#*$%&|<>]", text)) / len(w) > 0.10)
    counts = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    marked = {k for j in range(len(w) - 7) if counts[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return {"failed": failed, "reasons": reasons, "worst": worst, "share": share, "char_share": char_share, "open": any(len(t) > 1 for t in tops.values())}


@pytest.mark.parametrize("seed", range(6))
def test_verdict_matches_brute_force(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a\na", "x y z\nx y z"]
    for _ in range(120):
        vocab = [rng.choice(["w", "é", "lo"]) + str(k) for k in range(rng.choice([3, 12, 60, 2000]))]
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 14))]
        lines += [rng.choice(lines) for _ in range(rng.choice([0, 0, 1, 3]))]
        if rng.random() < 0.4:
            lines.append(lines[0])
        if rng.random() < 0.2:
            lines.append("# | * <b>")
        texts.append("\n".join(lines))
    got = quality.measure(texts)
    for i, text in enumerate(texts):
        want = judge(text)
        assert got["base_failed"][i] == want["failed"], text
        assert abs(got["dup_gram_share"][i] - want["worst"]) < 1e-12, text
        assert abs(got["dup_line_share"][i] - want["share"]) < 1e-12 and abs(got["dup_line_char_share"][i] - want["char_share"]) < 1e-12, text
        if not want["open"]:
            assert got["reasons"][i] == ",".join(want["reasons"]), text
            assert got["kept"][i] == (not want["failed"] and not want["reasons"]), text


@pytest.mark.parametrize("words", [30, 60, 120, 400, 5000])
def test_a_frame_is_no_repetition(words):
    header = "the daily example of all the news"
    body = " ".join(f"word{i}" for i in range(words))
    got = quality.measure([f"{header}\n{body}\n{header}", f"{header}\n{header}\n{body}\n{header}\n{header}\n{header}"])
    assert got["kept"][0] and got["dup_gram_share"][0] == 0 and got["n_dup_lines"][0] == 1
    assert not got["kept"][1] and "dup_lines" in got["reasons"][1]
