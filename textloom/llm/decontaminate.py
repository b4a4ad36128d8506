"""Benchmark decontamination by spaced-seed hashing.

Texts are compared as sequences of normalised words. Fixed masks pick some positions of a short window and ignore the
others; the hashes of the picked words of every benchmark window are joined with those of the training texts. A hit places
a text along a benchmark item; the two are then compared word by word on that diagonal, which tolerates substitutions,
and the best overlap counts if enough words match.

The join is by the benchmark's size. Up to BLOCK_BYTES of text it is broadcast as an index and the documents are scanned;
a larger one is joined by seed hash, documents' seeds being dropped first that a filter of fixed size rules out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, chunks, doc_rows, remembers
from textloom.llm.vector import U, mix
from textloom.plans.storage import materialize

#: Positions of a window that a seed compares (1) and ignores (0). Each picks five, so overlaps of five words can hit; with
#: every fifth word replaced, the second one still hits.
MASKS = ("11111", "111101", "1101011", "10110011")
#: Those of items of fewer than SHORT words, after the others: one of them hits whichever fifth of the words differs.
SHORT, LONG_MASKS = 8, len(MASKS)
MASKS += ("1111", "11101", "11011", "10111")
#: Items of fewer than WHOLE words must match whole, so their masks are all ones.
WHOLE, SHORT_MASKS = 5, len(MASKS)
MASKS += ("1", "11", "111", "1111")
WIDEST = max(map(len, MASKS))
#: Of an overlap's words at least this share match, and so many of them (of an item with fewer words: this share of them).
SHARE, LEAST_MATCHES = 0.8, 13
#: SHARE in whole numbers: so much a match counts for a stretch and a mismatch against it.
FOR, AGAINST = 1, 4
#: A benchmark of up to so many bytes of text is broadcast.
BLOCK_BYTES = 8 << 20
#: Remembered spellings of a Python worker, and their greatest length.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
#: Hits, diagonals and compared words that are looked at together.
TOGETHER = 1 << 20
#: Bits of the filter of a large benchmark's seeds: about sixteen a seed, within these bounds; and bytes of its slices.
FILTER_BITS, SLICE_BYTES = (20, 28), 1 << 16

UNKNOWN, NOTHING = -1, -2


def masks_of(n: int) -> Sequence[int]:
    """The masks of an item of n words."""
    if n < WHOLE:
        return range(SHORT_MASKS + n - 1, SHORT_MASKS + n)
    return range(LONG_MASKS, SHORT_MASKS) if n < SHORT else range(LONG_MASKS)


def normal(word: str) -> str:
    """Lower case, letters and digits only."""
    w = word.lower()
    return w if w.isalnum() else "".join(c for c in w if c.isalnum())


class Spellings(dict):
    """Word as written -> number of its normal form, NOTHING if nothing is left of it. Numbers are those of ``known``
    (UNKNOWN for others), or without it 63-bit hashes."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        w = normal(word)
        n = NOTHING if not w else xxhash.xxh64_intdigest(w.encode()) >> 1 if self.known is None else self.known.get(w, UNKNOWN)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def words(self, text: str) -> np.ndarray:
        w = np.array(list(map(self.__getitem__, text.split())), np.int64)
        return w[w != NOTHING]

    def side_by_side(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts, with so many UNKNOWN between them that no window reaches over, and where each begins
        (with the total at the end)."""
        every: list[int] = []
        ends = []
        for t in texts:
            every.extend(map(self.__getitem__, t.split()))
            every.extend([UNKNOWN] * WIDEST)
            ends.append(len(every))
        w = np.array(every, np.int64)
        said = w != NOTHING
        upto = np.concatenate([[0], np.cumsum(said)])
        return w[said], upto[[0, *ends]]


def seeds(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of mask k begin that pick no unknown word, and their hashes."""
    picked = [i for i, c in enumerate(MASKS[k]) if c == "1"]
    n = max(0, len(words) - len(MASKS[k]) + 1)
    known = words >= 0
    at = known[:n].copy()
    for i in picked[1:]:
        at &= known[i : i + n]
    at = np.flatnonzero(at)
    h = np.full(len(at), k + 1, U)
    for i in picked:
        h = h * U(0x9E3779B97F4A7C15) + words[at + i].astype(U)
    return at, mix(h)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs begin: of entries that agree in all columns but the last, which goes up by one."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = columns[-1][1:] != columns[-1][:-1] + 1
        for c in columns[:-1]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spread(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the range, entry) of the ranges first .. first + size - 1, about TOGETHER entries at once."""
    upto = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + TOGETHER, "right")) - 1)
        which = np.repeat(np.arange(i, j), size[i:j])
        yield which, first[which] + np.arange(len(which)) - (upto[which] - upto[i])
        i = j


class Index:
    """Seeds of one block of benchmark items. Items that read the same are one."""

    FILTER_BITS = 20

    def __init__(self, items: list[tuple[int | None, str]]):
        known: dict[str, int] = {}
        same: dict[tuple[int, ...], list[int | None]] = {}
        for item_id, text in items:
            w = tuple(known.setdefault(x, len(known)) for x in map(normal, text.split()) if x)
            if w:
                same.setdefault(w, []).append(item_id)
        self.known = known
        self.ids = [sorted(x, key=lambda i: (i is None, i)) for x in same.values()]
        self.items = [np.array(w, np.int64) for w in same]
        self.masks: set[int] = set()
        hashes, item, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, w in enumerate(self.items):
            for k in masks_of(len(w)):
                self.masks.add(k)
                p, h = seeds(w, k)
                hashes.append(h)
                item.append(np.full(len(h), n))
                at.append(p)
        h, item, at = np.concatenate(hashes), np.concatenate(item), np.concatenate(at)
        order = np.lexsort((at, item, h))
        h, item, at = h[order], item[order], at[order]
        # windows of one hash that follow one another, as in a run of one word, are one entry
        begin = runs(h, item, at)
        self.hash, self.item, self.at = h[begin], item[begin], at[begin]
        self.run = np.diff(np.append(begin, len(h)))
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[self.hash >> U(64 - self.FILTER_BITS)] = True

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(start of a run of windows, its length, first and last entry of the index + 1 with its hash), for each mask."""
        for k in sorted(self.masks):
            at, h = seeds(words, k)
            maybe = self.filter[h >> U(64 - self.FILTER_BITS)]
            at, h = at[maybe], h[maybe]
            begin = runs(h, at)
            size = np.diff(np.append(begin, len(at)))
            at, h = at[begin], h[begin]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            found = hi > lo
            yield at[found], size[found], lo[found], hi[found]

    def hit_texts(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which of the texts side by side share a seed with an item."""
        found = [at for at, *_ in self.hits(words)]
        return np.unique(np.searchsorted(begin, np.concatenate([np.zeros(0, np.int64), *found]), "right") - 1)

    def diagonals(self, words: np.ndarray) -> np.ndarray:
        """Item << 32 | start in the text less start in the item + 2**31 of all hits, each once. A run of windows against a
        run gives a range of diagonals, so a repeated word costs as much as it is long."""
        parts = [np.zeros(0, np.int64)]
        for at, size, lo, hi in self.hits(words):
            for which, row in spread(lo, hi - lo):
                first = at[which] - self.at[row] - self.run[row] + 1
                for pair, d in spread(first, size[which] + self.run[row] - 1):
                    parts.append(np.unique(self.item[row][pair] << 32 | d + (1 << 31)))
                    if sum(map(len, parts)) > 4 * TOGETHER:
                        parts = [np.unique(np.concatenate(parts))]
        return np.unique(np.concatenate(parts))

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, start in the text, start in the item, length, matches) of the best overlap with each item."""
        keys = self.diagonals(words)
        items, first = np.unique(keys >> 32, return_index=True)
        out = []
        for item, a, z in zip(items.tolist(), first.tolist(), np.append(first, len(keys)).tolist()[1:], strict=True):
            best = best_overlap(words, self.items[item], (keys[a:z] & ((1 << 32) - 1)) - (1 << 31))
            if best:
                out.append((item, *best))
        return out


def best_overlap(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int, int] | None:
    """(start in the text, start in the item, length, matches) of the overlap with the most matches on the diagonals (the
    first of several), if it is one that counts."""
    n, m = len(words), len(item)
    need = min(LEAST_MATCHES, SHARE * m)
    if len(diagonals) <= 8:
        total = np.array([np.count_nonzero(words[max(0, d) : min(n, m + d)] == item[max(0, -d) : min(m, n - d)]) for d in diagonals.tolist()], np.int64)
    else:
        padded = sliding_window_view(np.concatenate([np.full(m, UNKNOWN), words, np.full(m, UNKNOWN)]), m)
        step = max(1, TOGETHER // m)
        total = np.concatenate([(padded[diagonals[i : i + step] + m] == item).sum(axis=1) for i in range(0, len(diagonals), step)])
    # a stretch has no more matches than its diagonal, so those with the most come first and the rest are left alone
    best = None
    for i in np.lexsort((diagonals, -total)).tolist():
        d = int(diagonals[i])
        if total[i] < need or best and total[i] < best[3]:
            break
        if best and total[i] == best[3] and d > best[0] - best[1]:
            continue
        a, z = max(0, -d), min(m, n - d)
        start, length, matches = best_stretch(words[a + d : z + d] == item[a:z])
        if matches >= need and (not best or matches > best[3] or matches == best[3] and d < best[0] - best[1]):
            best = a + d + start, a + start, length, matches
    return best


def best_stretch(match: np.ndarray) -> tuple[int, int, int]:
    """(start, length, matches) of the stretch with the most matches of which at least SHARE match, without mismatches at
    its ends; the first of several. With 1 for a match and -4 against a mismatch such stretches have a sum of 0 or more;
    of these the longest has the most matches, since one that can't grow has a sum of 0 to 3, or is the whole."""
    total = np.concatenate([[0], np.cumsum(np.where(match, FOR, -AGAINST))])
    # the longest stretch to each end begins at the first place where the sum is not above that at the end
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    length = np.arange(len(total)) - first
    end = int(np.argmax(length))
    start = int(first[end])
    at = np.flatnonzero(match[start:end])
    if not len(at):
        return start, 0, 0
    return start + int(at[0]), int(at[-1] - at[0]) + 1, len(at)


# --- a benchmark that is broadcast

_KEPT: dict[str, tuple[Index, Spellings]] = {}
remembers(__name__, _KEPT.clear)


def index_of(name: str, items: list[tuple[int | None, str]]) -> tuple[Index, Spellings]:
    """The index of a benchmark, and spellings met with it: built once per Python worker, the last one only is kept."""
    if name not in _KEPT:
        index = Index(items)
        _KEPT.clear()
        _KEPT[name] = index, Spellings(index.known)
    return _KEPT[name]


def overlaps_of(texts: list[str], index: Index, spellings: Spellings) -> Iterator[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """(number of the text, its overlaps) for the texts that have any; texts without a hit cost a few vector operations."""
    for i, j in chunks(texts):
        words, begin = spellings.side_by_side(texts[i:j])
        for k in index.hit_texts(words, begin).tolist():
            found = index.overlaps(words[begin[k] : begin[k + 1] - WIDEST])
            if found:
                yield i + k, found


Matcher = Callable[[list[str]], Iterator[tuple[int, list[tuple[int, int, int, int, int]]]]]

PLACE = "doc_start long, item_start long, n_words long, n_matches long"


def small_benchmark(items: DataFrame) -> list[tuple[int | None, str]] | None:
    """The items if their text is no more than BLOCK_BYTES."""
    size = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    return [tuple(r) for r in items.collect()] if size <= BLOCK_BYTES else None


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(benchmark[item_col].cast("long").alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row and benchmark item that overlap: ``doc_id, item_id, doc_start, item_start, n_words,
    n_matches``, in normalised words; rows that overlap with nothing are not in the result.

    Null and empty texts and items overlap with nothing; items of fewer than five words must be found whole; a null id
    stays null; repeated rows and repeated items give a row each; further columns are ignored. Of several overlaps with
    one item the one with the most matches is given (the first such diagonal). A benchmark whose size has been found
    small is broadcast and nothing is shuffled; a larger one is joined by the hashes of its seeds.
    """
    items, rows = items_of(benchmark, item_col, item_text_col), doc_rows(df, id_col, text_col)
    small = small_benchmark(items)
    if small is None:
        docs = rows.select("doc_id", F.xxhash64("text").alias("th"))
        found, named = joined_overlaps(rows.select(F.xxhash64("text").alias("th"), "text"), items)
        return docs.join(found, "th").join(named, "item_key").select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches")
    shared, name = df.sparkSession.sparkContext.broadcast(small), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, spellings = index_of(name, shared.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [(ids[k], i, *place) for k, overlaps in overlaps_of(b.column(1).to_pylist(), index, spellings) for item, *place in overlaps for i in index.ids[item]]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches"])

    return arrow_map(rows, run, f"doc_id long, item_id long, {PLACE}")


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns kept, that overlap with no benchmark item; rows are told apart by themselves, so
    repeated and null ids don't matter."""
    items = items_of(benchmark, item_col, item_text_col)
    small = small_benchmark(items)
    if small is None:
        text = F.coalesce(df[text_col].cast("string"), F.lit(""))
        found, _ = joined_overlaps(df.select(F.xxhash64(text).alias("th"), text.alias("text")), items)
        bad = found.select(F.col("th").alias("bad_th")).distinct()
        return df.join(bad, F.xxhash64(text) == F.col("bad_th"), "left_anti")
    shared, name = df.sparkSession.sparkContext.broadcast(small), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, spellings = index_of(name, shared.value)
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            clean[[k for k, _ in overlaps_of([t or "" for t in b.column(text_col).to_pylist()], index, spellings)]] = False
            yield b.filter(pa.array(clean))

    return arrow_map(df, run, df.schema)


# --- a benchmark that is joined


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, text) -> (item_key, item_id, words): the key is a hash of the words."""
    spellings = Spellings()
    for b in batches:
        words = [spellings.words(t).tobytes() for t in b.column(1).to_pylist()]
        keys = [xxhash.xxh64_intdigest(w) >> 1 for w in words]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0), pa.array(words, pa.binary())], ["item_key", "item_id", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_key, words) -> (seed, item_key, item_at)."""
    for b in batches:
        for key, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = np.frombuffer(w, np.int64)
            for k in masks_of(len(words)):
                at, h = seeds(words, k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(at), key)), pa.array(at)], ["seed", "item_key", "item_at"])


def seed_filter(item_seeds: DataFrame) -> np.ndarray:
    """A bit for the highest bits of every seed; its size goes with the number of seeds up to a bound."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * item_seeds.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[np.asarray(b.column(0)).view(U) >> U(64 - bits)] = True
        packed = np.packbits(seen).tobytes()
        starts = [i for i in range(0, len(packed), SLICE_BYTES) if any(packed[i : i + SLICE_BYTES])]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([packed[i : i + SLICE_BYTES] for i in starts], pa.binary())], ["start", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(s, np.uint8)
                found[i] = found[i] | part if i in found else part
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["start", "bits"])

    schema = "start long, bits binary"
    out = np.zeros((1 << bits) // 8, np.uint8)
    for start, part in arrow_map(arrow_map(item_seeds.select("seed"), mark, schema).repartition("start"), unite, schema).collect():
        out[start : start + len(part)] = np.frombuffer(part, np.uint8)
    return out


def joined_overlaps(texts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``th, item_key`` and the place of the best overlap of texts ``th, text`` with items ``item_id, text``; and the
    ``item_key, item_id`` of all items. Equal texts (by hash) and items that read the same are compared once."""
    worded = materialize(arrow_map(items, _item_words, "item_key long, item_id long, words binary").where("octet_length(words) > 0"))
    unique = worded.groupBy("item_key").agg(F.min("words").alias("words"))
    item_seeds = materialize(arrow_map(unique.select("item_key", "words"), _item_seeds, "seed long, item_key long, item_at long"))
    shared = texts.sparkSession.sparkContext.broadcast(seed_filter(item_seeds))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings, maybe = Spellings(), shared.value
        bits = (8 * len(maybe)).bit_length() - 1
        for b in batches:
            th, text = np.asarray(b.column(0)), b.column(1).to_pylist()
            for i, j in chunks(text):
                words, begin = spellings.side_by_side(text[i:j])
                for k in range(len(MASKS)):
                    at, h = seeds(words, k)
                    place = (h >> U(64 - bits)).astype(np.int64)
                    hit = (maybe[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                    at, h = at[hit], h[hit]
                    of = np.searchsorted(begin, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(th[i:j][of]), pa.array(at - begin[of])], ["seed", "th", "doc_at"])

    seen = arrow_map(texts.select("th", "text"), doc_seeds, "seed long, th long, doc_at long").distinct()
    hits = materialize(seen).join(item_seeds, "seed").select("th", "item_key", (F.col("doc_at") - F.col("item_at")).alias("d")).distinct()
    hits = materialize(hits.groupBy("th", "item_key").agg(F.collect_list("d").alias("d")))
    wanted = materialize(texts.join(hits.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.min("text").alias("text")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = Spellings()
        for b in batches:
            found, last, words = [], None, None
            for th, key, d, w, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if words is None or th != last:
                    last, words = th, spellings.words(text)
                best = best_overlap(words, np.frombuffer(w, np.int64), np.sort(np.array(d, np.int64)))
                if best:
                    found.append((th, key, *best))
            columns = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["th", "item_key", "doc_start", "item_start", "n_words", "n_matches"])

    pairs = hits.join(materialize(unique), "item_key").join(wanted, "th").select("th", "item_key", "d", "words", "text")
    return materialize(arrow_map(pairs, verify, f"th long, item_key long, {PLACE}")), worded.select("item_key", "item_id")
