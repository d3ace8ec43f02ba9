"""Quality rules by repetition coverage.

For each document, rolling hashes of 5- to 10-word n-grams (numpy, one pass per length) mark every
n-gram seen before in the same document; the measure is the share of word characters inside those
repeats, next to the shares of repeated lines and of their characters. The most frequent 2- to
4-gram's share completes the set. Thresholds are those published for the MassiveText filters, for texts of
every length, with two exceptions of our own. A top n-gram is one found ``min_top_count`` times: the published limits are for long
texts, where twice is nothing, while in 20 words any pair of long words that comes again is above them. A frame is no repetition: where the last line with a word equals the first one (a running
header as footer), the verdict and the shares leave that one last line out, whatever the length.

Defined results: a null or empty text has no words and fails the base rule; texts are read whole,
of any length; repeated rows are judged alike, each on its own; an empty table gives an empty
result; columns besides id and text are ignored by :func:`quality_report` and passed on untouched by
:func:`quality_filter`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, keyed_texts
from .textkernel import Words

REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_gram_share double, dup_line_share double, dup_line_char_share double, top_gram_share double, symbol_ratio double, reasons string"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict; a document above any of them is rejected."""

    min_words: int = 20
    max_repeat_pct: int = 30
    dup_gram_limits: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    top_gram_limits: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    min_top_count: int = 3
    max_dup_line_share: float = 0.30
    max_dup_line_char_share: float = 0.20
    max_symbols_per_word: float = 0.10


def _continuation(buffer: np.ndarray) -> np.ndarray:
    """Prefix counts of UTF-8 continuation bytes, to turn byte lengths into code points."""
    out = np.zeros(len(buffer) + 1, dtype=np.int64)
    np.cumsum((buffer & 0xC0) == 0x80, out=out[1:])
    return out


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _longest_run(keys: np.ndarray) -> tuple[int, int]:
    """The highest count of a key and the smallest key that has it."""
    s = np.sort(keys)
    edge = np.flatnonzero(s[1:] != s[:-1]) + 1
    if len(edge) == len(s) - 1:
        return 1, s[0]
    at = np.concatenate(([0], edge))
    counts = np.diff(np.concatenate((at, [len(s)])))
    k = int(counts.argmax())
    return int(counts[k]), s[at[k]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    more = np.empty(len(keys), dtype=bool)
    again = np.empty(len(keys), dtype=bool)
    again[order] = ~new
    more[order] = ~new | np.concatenate((~new[1:], [False]))
    return more, again


def _covered(marks: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside any marked n-word window."""
    edge = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(marks)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None], rules: QualityRules = QualityRules()) -> dict[str, list]:
    """Counts, shares and verdict for each text."""
    words = Words(texts)
    cont = _continuation(words.buffer)
    chars = (words.ends - words.starts) - (cont[words.ends] - cont[words.starts])
    symbols = np.zeros(len(words.buffer) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[words.buffer], out=symbols[1:])
    lengths = sorted({8, *(n for n, _ in rules.dup_gram_limits), *(n for n, _ in rules.top_gram_limits)})
    grams = {n: words.grams(n) for n in lengths}
    # A line with a word is identified by its bytes: the words and the white space around them.
    breaks = np.flatnonzero(words.buffer == 10)
    out: dict[str, list] = {k.split()[0]: [] for k in REPORT.split(", ")[1:]}
    for i in range(len(texts)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        lo, hi = int(words.offsets[i]), int(words.offsets[i + 1]) - 1
        n = b - a
        own = chars[a:b]
        total = int(own.sum())
        symbol = int(symbols[hi] - symbols[lo])
        lines = n_lines = dup_lines = 0
        dup_chars = 0
        repeat = 0
        worst = top = 0.0
        over = []
        if n:
            seen: set[bytes] = set()
            x, y = np.searchsorted(breaks, [lo, hi])
            start, first, last, at_last = lo, None, b"", lo
            for end in [*breaks[x:y].tolist(), hi]:
                line = words.blob[start:end]
                if line.strip(b" \t\n\v\f\r"):
                    lines += 1
                    if first is None:
                        first = line
                    last, at_last = line, start
                    if line in seen:
                        dup_lines += 1
                        dup_chars += len(line.decode("utf-8", "surrogatepass"))
                    else:
                        seen.add(line)
                start = end + 1
            n_lines = lines
            frame = lines > 1 and last == first
            # Windows that start in the frame's last line are whole in it.
            judged = (int(np.searchsorted(words.starts, at_last)) if frame else b) - a
            # No repeated n-gram, no repeated longer one: most texts end after one sort.
            shortest = min(8, *(size for size, _ in rules.dup_gram_limits))
            repeats = n > shortest and _longest_run(grams[shortest][a : b - shortest + 1])[0] > 1
            if n > 8 and repeats:
                more, _ = _repeated(grams[8][a : b - 7])
                repeat = int(_covered(more, 8, n).sum())
            for size, limit in rules.dup_gram_limits:
                if n > size and repeats:
                    _, again = _repeated(grams[size][a : b - size + 1])
                    again[judged:] = False
                    share = float(own[_covered(again, size, n)].sum()) / total
                    worst = max(worst, share)
                    if share > limit:
                        over.append(f"dup_{size}gram")
            for size, limit in rules.top_gram_limits:
                keys = grams[size][a : min(b - size + 1, a + judged)] if n > size else ()
                if len(keys) > 1:
                    count, key = _longest_run(keys)
                    if count >= rules.min_top_count:
                        at = int(np.flatnonzero(keys == key)[0])
                        share = count * float(own[at : at + size].sum()) / total
                        top = max(top, share)
                        if share > limit:
                            over.append(f"top_{size}gram")
            if frame:
                counted, frame_chars = dup_lines - 1, len(last.decode("utf-8", "surrogatepass"))
            else:
                counted, frame_chars = dup_lines, 0
        line_share = counted / n_lines if n else 0.0
        line_chars = (dup_chars - frame_chars) / (hi - lo - int(cont[hi] - cont[lo])) if n else 0.0
        ratio = symbol / n if n else 0.0
        if line_share > rules.max_dup_line_share:
            over.append("dup_lines")
        if line_chars > rules.max_dup_line_char_share:
            over.append("dup_line_chars")
        if ratio > rules.max_symbols_per_word:
            over.append("symbols")
        failed = n < rules.min_words or 100 * repeat > rules.max_repeat_pct * n
        row = (n, total, symbol, dup_lines, repeat, failed, not failed and not over, worst, line_share, line_chars, top, ratio, ",".join(over))
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return out


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row of counts, shares and verdict per document."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in measure(batch.column("text").to_pylist(), rules).items()}

    return arrow_map(keyed_texts(docs), work, REPORT)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns as they are."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(measure(batch.column(text_col).to_pylist(), rules)["kept"]))

    return arrow_map(docs, work, docs.schema, text_col)
