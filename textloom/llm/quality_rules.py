"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every byte n-gram falls into one of 2**16 buckets. Two multinomials over the buckets are counted over all texts: the raw
corpus, and the texts of a trusted target within it. A text's score is the mean over its n-grams of log(target share /
raw share); it is kept if the score reaches the threshold and no base rule fails. There is no sampling and no random
choice: the same corpus always gives the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, chunks, doc_rows, with_maybe
from textloom.llm.vector import SPACE, U, Words, joined, mix, sums
from textloom.plans.storage import materialize

GRAM, BITS = 4, 16
#: Counts travel in slices of so many buckets, so that no task gathers all of them from all others.
SLICE = 1 << 10
#: Bytes of a text whose n-grams are counted together.
PIECE = 1 << 20
#: A text is kept from this mean log-ratio on. Clean prose scores around the log of the inverse clean share, slightly above
#: zero; text in a style that the target lacks scores below -1.
THRESHOLD = -0.5
#: Symbols, least words, and the share (%) of words in repeated windows of so many words.
SYMBOLS, LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = b"#*$%&|<>", 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that lie in one text, and where those of each text begin (with the total at the end)."""
    data, start = joined([t + b" " * (GRAM - 2) for t in texts])  # with joined's own space, n-1 bytes between texts
    n = max(0, len(data) - GRAM + 1)
    h = np.zeros(n, U)
    for k in range(GRAM):
        h = h * U(257) + data[k : k + n].astype(U)
    lengths = np.maximum(np.array([len(t) for t in texts], np.int64) - GRAM + 1, 0)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, np.minimum(start[:-1], n), 1)
    np.add.at(inside, np.minimum(start[:-1] + lengths, n), -1)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=first[1:])
    return (mix(h) >> U(64 - BITS)).astype(np.int64)[np.cumsum(inside[:-1]).astype(bool)], first


def pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Texts cut so that no piece is much over PIECE bytes and every n-gram is in one, and the text that each is of."""
    out, of = [], []
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - GRAM + 1), PIECE):
            out.append(t[k : k + PIECE + GRAM - 1])
            of.append(i)
    return out, np.array(of, np.int64)


def gram_counts(rows: DataFrame) -> np.ndarray:
    """Bucket counts over all ``text``: an array of fixed size, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            texts, _ = pieces([t.encode() for t in b.column(0).to_pylist()])
            for i, j in chunks(texts):
                total += np.bincount(buckets(texts[i:j])[0], minlength=1 << BITS)
        if total.any():
            parts = range(0, 1 << BITS, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([p // SLICE for p in parts], pa.int32()), pa.array([total[p : p + SLICE].tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(c, np.int64)
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    parts = arrow_map(arrow_map(rows.select("text"), count, schema).repartition("slice"), add, schema)
    total = np.zeros(1 << BITS, np.int64)
    for k, c in parts.collect():  # one row for each slice
        total[k * SLICE : (k + 1) * SLICE] = np.frombuffer(c, np.int64)
    return total


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed by one count a bucket. Without any target text nothing is known, and all ratios are zero."""
    if not target.any():
        return np.zeros(len(raw))
    share = lambda c: np.log((c + 1) / (c.sum() + len(c)))
    return share(target) - share(raw)


def repeated_words(text: bytes, start: np.ndarray, end: np.ndarray) -> int:
    """Words in windows that are found twice or more, the first time included. Words are numbered, and windows sorted by a
    hash of their numbers; windows that meet there are compared number by number, so the count is exact."""
    known: dict[bytes, int] = {}
    number = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 16):
        a, z = start[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist()
        number[i : i + len(a)] = [known.setdefault(text[x:y], len(known)) for x, y in zip(a, z, strict=True)]
    n = len(number) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, U)
    for k in range(REPEAT_WINDOW):
        h = h * U(0xD6E8FEB86659FD93) + mix(number[k : k + n].astype(U))
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = order[near], order[near + 1]
    same = np.ones(len(near), bool)
    for k in range(REPEAT_WINDOW):
        same &= number[a + k] == number[b + k]
    if not same.all():  # different windows of one hash: those that share it are told apart by their numbers
        at = np.unique(np.concatenate([a, b]))
        _, which, count = np.unique(np.stack([number[at + k] for k in range(REPEAT_WINDOW)], 1), axis=0, return_inverse=True, return_counts=True)
        at = at[count[which] > 1]
    else:
        at = np.concatenate([a, b])
    covered = np.zeros(len(number) + 1, np.int64)
    at = np.unique(at)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + REPEAT_WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = Words(texts)
    n_words = np.diff(w.first)
    inner = np.minimum(w.text_start, len(w.bytes))
    chars = sums(((w.bytes & 0xC0) != 0x80) & ~SPACE[w.bytes], inner)
    symbols = sums(_SYMBOL[w.bytes], inner)
    duplicate = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        duplicate.append(len(lines) - len(set(lines)))
    # texts in which two windows have one hash are counted exactly; in all others no window is repeated
    h = w.hashes()
    n = max(0, len(h) - REPEAT_WINDOW + 1)
    window = np.zeros(n, U)
    for k in range(REPEAT_WINDOW):
        window = window * U(0xD6E8FEB86659FD93) + h[k : k + n]
    whole = w.text[:n] == w.text[REPEAT_WINDOW - 1 :] if n else np.zeros(0, bool)
    text = w.text[:n][whole]
    key = mix(window[whole] + mix(text.astype(U)))
    order = np.argsort(key)
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    repeated = np.zeros(len(texts), np.int64)
    for i in np.unique(text[order[again]]).tolist():
        a, z = w.first[i], w.first[i + 1]
        repeated[i] = repeated_words(texts[i], w.start[a:z] - w.text_start[i], w.end[a:z] - w.text_start[i])
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": np.array(duplicate, np.int64), "n_repeat_words": repeated}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ratios_of(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Raw counts by a scan; the target's counts over the texts that may be trusted, the only ones that are shuffled."""
    rows = doc_rows(df, id_col, text_col)
    ids = materialize(trusted.select(trusted[trusted.columns[0]].cast("long").alias("t_id")).where("t_id IS NOT NULL").distinct())
    maybe = with_maybe(rows, "doc_id", ids, "t_id", "maybe").where("maybe")
    # always a sort-merge join: whether the ids would fit a broadcast changes with the corpus; an inner one, as a semi-join
    # would be moved below the filter
    target = maybe.hint("merge").join(ids, F.col("doc_id") == F.col("t_id"))
    return log_ratios(gram_counts(rows), gram_counts(target))


def judged_texts(texts: list[bytes], ratio: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the score of each text."""
    found: dict[str, list[np.ndarray]] = {c: [np.zeros(0)] for c in COUNTS}
    for i, j in chunks(texts):
        for c, v in base_counts(texts[i:j]).items():
            found[c].append(v)
    parts, of = pieces(texts)
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, j in chunks(parts):
        g, first = buckets(parts[i:j])
        np.add.at(total, of[i:j], sums(ratio[g], first))
        np.add.at(n, of[i:j], np.diff(first))
    return {c: np.concatenate(v).astype(np.int64) for c, v in found.items()} | {"score": total / np.maximum(n, 1)}


def base_rules_fail(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def quality_rules(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the five base counts, ``base_failed, score, kept``.

    ``trusted`` holds the ids of the target's rows (repeated ids count once, null ids never). Null and empty texts have
    no words, fail the base rules, and score 0, as do texts shorter than an n-gram. Repeated rows give repeated rows and
    count each; an empty table gives none; further columns are ignored. Only texts that may be trusted are shuffled, to
    meet the trusted ids; counts and scores are scans, and what is broadcast has a fixed size.
    """
    ratios = df.sparkSession.sparkContext.broadcast(ratios_of(df, trusted, id_col, text_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = judged_texts([t.encode() for t in b.column(1).to_pylist()], ratios.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    judged = arrow_map(doc_rows(df, id_col, text_col), judge, f"doc_id long, {', '.join(c + ' long' for c in COUNTS)}, score double")
    judged = judged.withColumn("base_failed", base_rules_fail(F.col("n_words"), F.col("n_repeat_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_quality(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that quality_rules() keeps, all columns as they were. Rows are judged where they stand, so
    nothing is joined back, and repeated and null ids don't matter."""
    ratios = df.sparkSession.sparkContext.broadcast(ratios_of(df, trusted, id_col, text_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = judged_texts([(t or "").encode() for t in b.column(text_col).to_pylist()], ratios.value)
            yield b.filter(pa.array(~base_rules_fail(found["n_words"], found["n_repeat_words"]) & (found["score"] >= threshold)))

    return arrow_map(df, keep, df.schema)
