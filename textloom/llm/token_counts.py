"""Token counts under a byte-level BPE vocabulary, by the whole-token shortcut.

A text is cut into pre-tokens by the vocabulary's pattern. Offline, once per vocabulary, every vocabulary string is
encoded alone: those that come out as one token and are a single pre-token are *whole*. A pre-token that is whole
counts one token with a single dictionary probe; only the rest are merged, and their counts are remembered in a bounded
table, as the same words come again and again.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, doc_rows, remembers

#: The pre-token pattern of byte-level BPE (a fixed value: counts depend on it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pre-token of more symbols is merged with a heap: N log N instead of N squared.
LONG = 48
#: Remembered counts per Python worker; the table starts anew when full.
REMEMBERED = 400_000
#: Longer pre-tokens are not remembered, so the table's bytes are bounded too.
REMEMBERED_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file: printable Latin-1 bytes stand
    for themselves, the others are numbered from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def check_settings(data: dict) -> None:
    """An error unless the file is a plain byte-level BPE: what it says beside vocabulary and merges would change counts."""
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    for wrong, what in (
        (model.get("type", "BPE") != "BPE", "is no BPE"),
        (any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")), "has options of its model set"),
        (data.get("normalizer"), "normalizes texts"),
        (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True), "cuts texts in another way"),
        (any(t.get(k) for t in data.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")), "has added tokens with conditions"),
    ):
        if wrong:
            raise ValueError(f"the vocabulary {what}")


class Vocabulary:
    """Merges of a byte-level BPE file, its special strings, and the strings proven to be whole."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        check_settings(data)
        alphabet = byte_alphabet()
        ids = data["model"]["vocab"]
        self.byte_id = {alphabet[s]: i for s, i in ids.items() if len(s) == 1}
        self.merged: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merged[ids[a] << 20 | ids[b]] = (rank, ids[a + b])
        special = [t["content"] for t in data.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.whole = self.prove(ids, alphabet)

    def prove(self, ids: dict[str, int], alphabet: dict[str, int]) -> frozenset[str]:
        found = set()
        for s, i in ids.items():
            try:
                text = bytes(alphabet[c] for c in s).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: never a pre-token by itself
            if self.merge(text) == [i] and self.pattern.findall(text) == [text]:
                found.add(text)
        return frozenset(found)

    def merge(self, pre_token: str) -> list[int]:
        """Token ids of one pre-token: the lowest-ranked adjacent pair is merged, leftmost first, until none is left."""
        symbols = [self.byte_id[b] for b in pre_token.encode()]
        return self._merge_long(symbols) if len(symbols) > LONG else self._merge_short(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        look = self.merged.get
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                m = look(symbols[i] << 20 | symbols[i + 1])
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            symbols[at : at + 2] = [best[1]]
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n, look = len(symbols), self.merged.get
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := look(symbols[i] << 20 | symbols[after[i]])) is not None:
                heapq.heappush(heap, (m[0], i, m[1], symbols[i], symbols[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s, a in zip(symbols, alive, strict=True) if a]


class Counts(dict):
    """Pre-token -> number of tokens. Whole strings are in from the start; others are merged at the first probe."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.vocabulary = vocabulary

    def __missing__(self, pre_token: str) -> int:
        n = len(self.vocabulary.merge(pre_token))
        if len(pre_token) <= REMEMBERED_CHARS:
            if len(self) > REMEMBERED + len(self.vocabulary.whole):
                self.clear()
                self.update(dict.fromkeys(self.vocabulary.whole, 1))
            self[pre_token] = n
        return n

    def of(self, text: str) -> int:
        v = self.vocabulary
        parts = [text] if v.special is None else v.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, v.pattern.findall(p))) for p in parts)


@lru_cache(maxsize=2)
def counts_for(path: str) -> Counts:
    return Counts(Vocabulary(path))


remembers(__name__, counts_for.cache_clear)


def count_tokens(df: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; null ids stay null; repeated rows give repeated rows; an empty table
    gives none; further columns are ignored. ``vocabulary_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_for(vocabulary_path)
        for b in batches:
            n = [counts.of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = doc_rows(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return arrow_map(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
