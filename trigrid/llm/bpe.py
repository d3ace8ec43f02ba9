"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over all tokens yields, in one pass over a word, the tokens that start at each
position. The encoder takes the longest, checks it against the token before it with the pair table (two
tokens are compatible when merging them from scratch would leave them side by side), falls back to the
next shorter one, and steps back when none fits; positions that failed are never tried again, so the
work is linear in the word. The result equals merging by rank.

Decoding gathers the bytes of each id from one flat table through an offsets array.

A null text is the empty text and gives no tokens; texts of any length, and words of any length, are encoded whole;
repeated rows give repeated results; an empty table an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, keyed_texts

END = "</w>"
#: Distinct words whose tokens a worker remembers in each of two generations; bounds its memory.
REMEMBERED = 120_000
#: Symbols of a word whose matches are held at a time.
STRETCH = 65_536
#: The usual splitting pattern, and the same for the quicker ``re`` module; its classes differ only for
#: the characters in ODD (numbers that are not digits, and four control characters).
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\w\s_]+(?:[^\w\s]|_)*|_(?:[^\w\s]|_)*")


@lru_cache(maxsize=1)
def odd_characters() -> frozenset[str]:
    letter, space = re.compile(r"[^\W\d_]"), ("Zs", "Zl", "Zp")
    out = set()
    for c in map(chr, range(0x110000)):
        kind = unicodedata.category(c)
        blank = kind in space or c in "\t\n\v\f\r\x85"
        if c.isspace() != blank or bool(letter.match(c)) != (kind[0] == "L") or c.isdecimal() != (kind[0] == "N"):
            out.add(c)
    return frozenset(out)


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes are themselves, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _Starts:
    """The tokens that start at each position of a very long word, found stretch by stretch as the encoder moves;
    one that it steps back into is found again. Bounds what a run of a million letters takes."""

    def __init__(self, vocabulary: Vocabulary, symbols: str) -> None:
        self.vocabulary, self.symbols = vocabulary, symbols
        self.stretches: dict[int, list[list[int]]] = {}

    def __getitem__(self, at: int) -> list[int]:
        k, i = divmod(at, STRETCH)
        if k not in self.stretches:
            if len(self.stretches) > 1:
                del self.stretches[next(iter(self.stretches))]
            lo = k * STRETCH
            self.stretches[k] = self.vocabulary.starts(self.symbols, lo, min(len(self.symbols), lo + STRETCH))
        return self.stretches[k][i]


@dataclass
class Vocabulary:
    """What the encoder needs of a tokenizer file; small (one entry a token) and shipped to the tasks."""

    tokens: list[str]
    merges: list[tuple[int, int]]
    n_base: int
    specials: dict[str, int]
    pattern: str
    _built: bool = field(default=False, repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizers JSON file with an NFC + lower-case normaliser, a splitting pattern, the
        byte-level alphabet and word-end suffixes; its merges must be in the order of their ids."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["end_of_word_suffix"] != END or spec["post_processor"] or spec["decoder"] or model["unk_token"]:
            raise ValueError("not a word-end byte-level BPE file")
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*vocab.values(), *specials.values()]))
        for t, i in [*vocab.items(), *specials.items()]:
            tokens[i] = t
        merges = [(vocab[a], vocab[b]) for a, b in model["merges"]]
        n_base = len(vocab) - len(merges)
        if any(vocab[a + b] != n_base + k for k, (a, b) in enumerate(model["merges"])):
            raise ValueError("merges are not in the order of their ids")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(tokens, merges, n_base, specials, split)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("tokens", "merges", "n_base", "specials", "pattern")} | {"_built": False}

    def build(self) -> Vocabulary:
        """The automaton and tables, made once in each worker."""
        if self._built:
            return self
        n = self.n_base
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.inner = [chr(ids[s]) for s in byte_symbols()]
        self.final = [chr(ids[s + END]) for s in byte_symbols()]
        spelled = [chr(i) for i in range(n)]
        self.halves: list[tuple[int, int] | None] = [None] * n
        self.joined: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(self.merges):
            spelled.append(spelled[pair[0]] + spelled[pair[1]])
            self.halves.append(pair)
            self.joined[pair] = n + k
        self.lengths = [len(s) for s in spelled]
        self.longest = max(self.lengths)
        self.automaton = ahocorasick.Automaton()
        for i, s in enumerate(spelled):
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        written = [(t + " ").encode() for t in self.tokens]
        self.flat = np.frombuffer(b"".join(written), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(w) for w in written])))
        self.words = regex.compile(self.pattern.replace("\\s", "\\p{White_Space}"))
        self.odd = odd_characters() if self.pattern == USUAL else None
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.forget()
        self._built = True
        return self

    def forget(self) -> None:
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def tokens_of(self, word: str) -> tuple[bytes, bytes]:
        """Ids (as 32-bit integers) of a word that is not in the young generation, and the same in decimal."""
        entry = self.old.get(word)
        if entry is None:
            ids = [self.specials[word]] if word in self.specials else self.encode_word(word)
            entry = (array("i", ids).tobytes(), " ".join(map(str, ids)).encode())
        self.young[word] = entry
        return entry

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding left's text followed by right's leaves just these two tokens.

        Both are taken apart from the last merge backwards. At each point the two tokens that touch the
        border are those of that moment; had their merge come before the one just undone, it would
        have been done instead."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            bound, known = len(self.tokens), True
            a, b = left, right
            while True:
                merged = self.joined.get((a, b))
                if merged is not None and merged < bound:
                    known = False
                    break
                # Undo the later of the two merges; of equal ones the right token's is the later.
                if a > b and self.halves[a]:
                    bound, a = a, self.halves[a][1]
                elif self.halves[b]:
                    bound, b = b + 1, self.halves[b][0]
                elif self.halves[a]:
                    bound, a = a, self.halves[a][1]
                else:
                    break
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def starts(self, symbols: str, lo: int, hi: int) -> list[list[int]]:
        """For each position of a stretch the tokens that start there, the shorter first; an empty list at its end."""
        lengths = self.lengths
        out: list[list[int]] = [[] for _ in range(hi - lo + 1)]
        for end, token in self.automaton.iter(symbols, lo, min(len(symbols), hi + self.longest)):
            start = end + 1 - lengths[token] - lo  # ends ascend, so lengths do
            if start < hi - lo:
                out[start].append(token)
        return out

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word (after normalising and splitting)."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, lengths, fits = self.inner, self.lengths, self.fits
        symbols = raw[:-1].decode("latin-1").translate(inner) + self.final[raw[-1]]
        if symbols in self.automaton:
            return [self.automaton.get(symbols)]
        n = len(symbols)
        starts = _Starts(self, symbols) if n > STRETCH else self.starts(symbols, 0, n)
        failed = bytearray(n + 1)
        out: list[int] = []
        untried: list[int] = []  # for each chosen token, how many shorter ones are left
        at, left = 0, len(starts[0])
        while at < n:
            options = starts[at]
            while left:
                left -= 1
                token = options[left]
                end = at + lengths[token]
                if not failed[end] and (not out or fits(out[-1], token)):
                    out.append(token)
                    untried.append(left)
                    at, left = end, len(starts[end])
                    break
            else:
                failed[at] = 1
                at -= lengths[out.pop()]
                left = untried.pop()
        return out

    def split(self, text: str) -> list[str]:
        """Special tokens and normalised words of a text, in order."""
        if self.special is not None and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Lower-casing is by character: no special form for a sigma at a word's end.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if self.odd is None or not self.odd.isdisjoint(frozenset(text)):
            return self.words.findall(text)
        return QUICK.findall(text)

    def encode(self, text: str | None) -> tuple[np.ndarray, bytes]:
        """The ids, and the same written in decimal, joined by one space."""
        known, other = self.young.get, self.tokens_of
        found = [known(w) or other(w) for w in self.split(text or "")]
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        return np.frombuffer(b"".join([f[0] for f in found]), dtype=np.intc), b" ".join([f[1] for f in found])

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts joined by one space, gathered from the flat table through the offsets."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes()[:-1]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded text for every document; with ``keep_ids`` the ids
    and the decoded text themselves too. The vocabulary is read on the driver and broadcast: its size
    is that of the file, whatever the data."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def work(batch: pa.RecordBatch) -> dict:
        v = vocabulary.value.build()
        n, ids_hash, text_hash, all_ids, all_texts = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            ids, written = v.encode(text)
            decoded = v.decode(ids)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(written).hexdigest())
            text_hash.append(hashlib.sha256(decoded).hexdigest())
            if keep_ids:
                all_ids.append(ids)
                all_texts.append(decoded.decode())
        out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
        return out | ({"ids": pa.array(all_ids, pa.list_(pa.int64())), "decoded": pa.array(all_texts, pa.string())} if keep_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(keyed_texts(docs), work, schema + ", ids array<long>, decoded string" * keep_ids)
