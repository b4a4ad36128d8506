"""Exact substring dedup: remove every byte that a string of LENGTH bytes covers which also starts earlier.

The method is blockwise suffix sorting with a difference cover. Suffixes are dealt into buckets so that equal strings of
LENGTH bytes meet in one bucket; buckets are sorted one at a time, and suffixes that share their first bytes (long ties)
are ordered by the ranks of a sample of suffixes at the positions of a difference cover, ranked once per bucket: for any
two suffixes there is a short shift by which both reach the sample. So a comparison of any depth takes one step, and
memory is bounded by the bucket. Of neighbours in the order that agree in LENGTH bytes, all but the earliest are removed.

Dealing out single suffixes would move LENGTH times the corpus. Instead all strings whose least-hashed GRAM-byte gram (the
anchor) is the same share a bucket, and neighbouring strings with one anchor travel as one *stretch* of text:

1. of equal texts only the first is looked into: in the others every string is found earlier;
2. anchors whose gram is found in one place only can't be in a repeated string; they are dropped before any text moves;
3. equal stretches collapse: all but the earliest are removed whole, without being sorted;
4. anchors with two or more different stretches are sorted, bucket by bucket;
5. an anchor with very many different stretches is spread by the strings themselves: each is dealt by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, chunks
from textloom.llm.vector import P, P_INVERSE, U, mix, powers
from textloom.plans.storage import discard, materialize

LENGTH, GRAM = 100, 24
#: Grams of a string.
SPAN = LENGTH - GRAM + 1
#: A difference cover: every residue modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text that are gathered for one sort, and the stretches of one anchor that a sort can hold (in four times the
#: bytes, at their greatest length); the strings of an anchor with more are dealt one by one.
BUCKET = 1 << 20
MOST_STRETCHES = 4 * BUCKET // (LENGTH + SPAN - 1)
#: Longer texts are read in pieces that overlap by LENGTH - 1 bytes. As large as chunks() of short texts: a worker takes
#: about a hundred times the bytes that are looked into at once.
PIECE = 1 << 20
PLACE_BITS = 24


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, big-endian, as one number; places past the end read zeros."""
    padded = np.zeros(-(-len(data) // 8) * 8 + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(padded) - 8, U)
    for k in range(8):
        part = out[k::8]
        part[:] = padded[k : k + 8 * len(part)].view(">u8")
    return out[: len(data)]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Stretches of all texts, in order: (text, first string's start, last string's start, anchor's hash, stretch's hash)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts], np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return _NOTHING
    w = words_at(data)
    g = len(data) - GRAM + 1
    h = np.full(g, 0x51ED270B, U)
    for k in range(0, GRAM, 8):
        h = (h ^ w[k : k + g]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(32)
    h = mix(h)
    # equal strings order their grams alike: by hash, then by place
    key = (h >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(g, dtype=U)
    least, wide = key, 1
    while 2 * wide <= SPAN:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: n], least[SPAN - wide : SPAN - wide + n])
    place = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.maximum(ends - starts, 0))[:n]
    inside = np.arange(n) + LENGTH <= ends[text]
    at = np.flatnonzero(inside)
    if not len(at):
        return _NOTHING
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    t, a, z = text[at[first]], at[first], at[last]
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(P, len(data)), out=total[1:])
    content = mix((total[z + LENGTH] - total[a]) * powers(P_INVERSE, len(data))[a] + (z - a).astype(U))
    return t, a - starts[t], z - starts[t], h[place[a]], content


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))


def pieces(texts: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
    """Texts cut into overlapping pieces: the pieces, the text of each, and where it starts there."""
    out: list[bytes] = []
    of: list[int] = []
    at: list[int] = []
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            out.append(t[k : k + PIECE + LENGTH - 1])
            of.append(i)
            at.append(k)
    return out, of, at


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of texts of any length, in bounded memory, with the number of a piece behind that of its text."""
    parts, of, at = pieces(texts)
    for i, j in chunks(parts):
        t, a, z, h, s = anchors(parts[i:j])
        shift = np.array(at[i:j], np.int64)[t]
        yield np.array(of[i:j], np.int64)[t], t, a + shift, z + shift, h, s


# --- sorting a bucket

_SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by several keys, and the dense rank of each entry."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at the difference cover's positions, to a depth of LENGTH bytes at least; others are zero."""
    at = np.flatnonzero(np.isin(np.arange(len(data)) % PERIOD, COVER))
    read = lambda k: np.where(at + k < len(words), words[np.minimum(at + k, len(words) - 1)], U(0))
    # the first PERIOD bytes: three whole numbers, and seven bytes of the fourth
    _, rank = _dense([read(0), read(8), read(16), read(24) >> U(8)])
    full = np.zeros(len(data) + PERIOD, np.int64)
    depth = PERIOD
    while depth < LENGTH:
        full[at] = rank + 1
        _, rank = _dense([rank, full[np.minimum(at + depth, len(full) - 1)]])
        depth *= 2
    full[:] = 0
    full[at] = rank + 1
    return full


def sorted_suffixes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes, and for each whether it agrees with the one before in LENGTH bytes.
    ``data`` must go on for LENGTH bytes behind every start."""
    words = words_at(data)
    head = [words[starts], words[starts + 8], words[starts + 16], words[starts + 24] >> U(8)]
    order, rank = _dense(head)
    order = starts[order]
    # the long ties: runs of one rank, partitioned around a pivot until nothing is left to tell apart
    first = np.flatnonzero(np.concatenate([[True], np.diff(np.sort(rank)) > 0]))
    size = np.diff(np.append(first, len(order)))
    tied = size > 1
    slot = np.repeat(first[tied], size[tied]) + _count(size[tied])
    group = np.repeat(np.arange(tied.sum()), size[tied])
    if len(slot):
        ranks = cover_ranks(data, words)
    while len(slot):
        at = order[slot]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(begin, len(group)))
        pivot = np.repeat(at[begin + size // 2], size)
        shift = _SHIFT[at % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[at + shift] - ranks[pivot + shift]) + 1
        key = np.repeat(np.arange(len(size)), size) * 3 + side
        by = np.argsort(key, kind="stable")
        order[slot] = at[by]
        key = key[by]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        left = np.repeat((size > 1) & (key[begin] % 3 != 1), size)
        slot, group = slot[left], key[left]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        same[1:] = True
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            same[1:] &= words[a + k] == words[b + k]
    return order, same


def _count(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def repeated(strings: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """Of stretches (document's rank, place in it): (stretch, begin, end) of what is covered by strings that are found
    earlier too; begin and end are places in the document."""
    size = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings) + bytes(LENGTH + PERIOD), np.uint8)
    base = np.cumsum(size) - size
    n = np.maximum(size - LENGTH + 1, 0)
    of = np.repeat(np.arange(len(strings)), n)
    offset = _count(n)
    starts = base[of] + offset
    order, same = sorted_suffixes(data, starts)
    owner = np.empty(len(data), np.int64)
    owner[starts] = of
    s = owner[order]
    place = doc[s] << 32 | start[s] + order - base[s]
    begin = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(place, begin), np.diff(np.append(begin, len(order))))
    late = np.sort(order[place != least])
    if not len(late):
        return []
    s = owner[late]
    at = start[s] + late - base[s]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (at[1:] > at[:-1] + LENGTH)])
    b = np.flatnonzero(new)
    e = np.append(b[1:], len(late)) - 1
    return list(zip(s[b].tolist(), at[b].tolist(), (at[e] + LENGTH).tolist(), strict=True))


# --- the operator


def _emit_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, th, n, text) -> (h, s, id, th, n, b, e): each different stretch of a piece of text once, where it is
    found first; and with null s (and th for h) what the others of the piece cover, which are found earlier there."""
    for batch in batches:
        ids, th, n = (np.asarray(batch.column(i)) for i in range(3))
        for t, piece, a, z, h, s in stretches(batch.column(3).to_pylist()):
            e = z + LENGTH
            _, first = np.unique(mix(mix(h ^ s) + s + piece.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
            again = np.ones(len(t), bool)
            again[first] = False
            k, r = np.flatnonzero(~again), np.flatnonzero(again)
            lt, lb, le = t[r], a[r], e[r]
            new = np.ones(len(r), bool)
            new[1:] = (lt[1:] != lt[:-1]) | (lb[1:] > le[:-1])
            begin = np.flatnonzero(new)
            lt, lb, le = lt[begin], lb[begin], le[np.append(begin[1:], len(r))[: len(begin)] - 1]
            of, none = np.append(t[k], lt), np.append(np.zeros(len(k), bool), np.ones(len(lt), bool))
            columns = [np.append(h[k].view(np.int64), th[lt]), np.append(s[k].view(np.int64), np.zeros(len(lt), np.int64)), ids[of], th[of], n[of], np.append(a[k], lb), np.append(e[k], le)]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=none if i == 1 else None) for i, c in enumerate(columns)], ["h", "s", "id", "th", "n", "b", "e"])


def _emit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, th, n, text, array of (h, b, e)) -> (h, id, th, n, b, stretch)."""
    for batch in batches:
        rows = [(w["h"], i, th, n, w["b"], text[w["b"] : w["e"]]) for i, th, n, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in wanted]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)], ["h", "id", "th", "n", "b", "stretch"])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, id, th, b, stretch, n), sorted by h: whole anchors are gathered into buckets of about BUCKET bytes."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        docs = {d: i for i, d in enumerate(sorted({(r[1], r[2]) for r in rows}))}
        doc = np.array([docs[r[1], r[2]] for r in rows], np.int64)
        found = repeated([r[4] for r in rows], doc, np.array([r[3] for r in rows], np.int64))
        columns = [[rows[s][2] for s, _, _ in found], [rows[s][5] for s, _, _ in found], [b for _, b, _ in found], [e for _, _, e in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["th", "n", "b", "e"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BUCKET and row[0] != held[-1][0]:
                yield judged(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield judged(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, end, removed, n = [], 0, 0, 0
            for s in sorted((s["b"], s["e"]) for s in spans or []):
                if n == 0 or s[0] > end:
                    kept.append(text[end : s[0]])
                    n += 1
                    removed += s[1] - s[0]
                    end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    end = s[1]
            kept.append(text[end:])
            rows.append((len(text), removed, n, b"".join(kept)))
        size, removed, n, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: the bytes left, in UTF-8 of the text).

    A byte goes if a string of LENGTH bytes covers it that also starts earlier: in a text of a smaller id, or earlier in
    its own; strings never cross texts. Strings are judged on the input. Null texts are empty; a null id sorts as the
    least long. Rows of one id with different texts are ordered by a hash of the text; rows of equal id and text are one
    place, so they lose the same bytes and none because of each other. An empty table gives no rows; further columns are
    ignored. Cuts may fall inside a character, hence the binary result. Texts are told apart by a 64-bit hash and their
    length, stretches by 128 bits of hash.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    doc_id = df[id_col].cast("long")
    docs = df.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n"), text.cast("binary").alias("text"))
    same_text = ["th", "n"]
    # 1. of equal texts only the one of the least id is looked into; in the others every string is found earlier
    texts = docs.groupBy(*same_text).agg(F.min("id").alias("id"))

    # 2. stretches of the anchors that are found in more than one place, and whether they differ
    # kept, as it is read twice: to count anchors, and to pick stretches
    found = materialize(arrow_map(docs.where(F.col("n") >= LENGTH).select("id", *same_text, "text"), _emit_stretches, "h long, s long, id long, th long, n long, b long, e long"))
    where_found = F.xxhash64("th", "n", "s", "b")
    again = found.where("s IS NOT NULL").groupBy("h").agg(F.min(where_found).alias("x"), F.max(where_found).alias("y"), (F.min("s") < F.max("s")).alias("differ"))
    # aggregates are written before they are joined back, so that a join on a hot key can be split
    again = materialize(again.where("x <> y").select(F.col("h").alias("again"), "differ"))
    left = materialize(found.join(again.hint("merge"), F.col("h") == F.col("again"), "left").where("s IS NULL OR again IS NOT NULL").drop("again"))
    discard(found, again)
    spans = left.where("s IS NULL").select(*same_text, "b", "e")

    # 3. equal stretches: of a text that several rows have, the others show the same places
    shown = left.where("s IS NOT NULL")
    firsts = materialize(shown.groupBy("h", "s").agg(F.min(F.struct("id", "th", "b", "n", "e")).alias("first"), F.first("differ").alias("differ")))
    place = F.struct("th", "n", "b")
    later = shown.join(firsts.select("h", "s", "first").hint("merge"), ["h", "s"]).where(place != F.struct("first.th", "first.n", "first.b")).select(*same_text, "b", "e")

    # 4. the texts of stretches that share their anchor with others, once each; sorted in buckets
    wanted = firsts.where("differ").select("h", "first.*").groupBy("id", *same_text).agg(F.collect_list(F.struct("h", "b", "e")).alias("wanted"))
    read = docs.select("id", *same_text, "text").hint("merge").join(materialize(wanted), ["id", *same_text])
    stretch = arrow_map(read.select("id", *same_text, "text", "wanted"), _emit_texts, "h long, id long, th long, n long, b long, stretch binary")

    # 5. an anchor with too many different stretches for a bucket: its strings are dealt by their own hash
    hot = materialize(firsts.where("differ").groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MOST_STRETCHES).select("h"))
    cold, dealt_out, written = stretch, None, [left, firsts]
    if not hot.isEmpty():
        # written only here, where it is read twice
        stretch = materialize(stretch)
        written.append(stretch)
        cold = stretch.join(hot, "h", "left_anti")
        single = stretch.join(hot, "h", "left_semi").select("id", *same_text, "b", "stretch", F.explode(F.sequence(F.lit(0), F.octet_length("stretch") - LENGTH)).alias("i"))
        string = F.expr(f"substring(stretch, i + 1, {LENGTH})")
        single = materialize(single.select("id", *same_text, (F.col("b") + F.col("i")).alias("b"), F.xxhash64(string).alias("s1"), F.xxhash64(F.lit(1), string).alias("s2")))
        whole = F.struct("id", "th", "b")
        least = materialize(single.groupBy("s1", "s2").agg(F.min(whole).alias("first"), F.max(whole).alias("last")).where("first <> last").select("s1", "s2", "first"))
        dealt_out = single.join(least.hint("merge"), ["s1", "s2"]).where(whole != F.col("first")).select(*same_text, "b", (F.col("b") + LENGTH).alias("e"))
    dealt = cold.select("h", "id", "th", "b", "stretch", "n").repartition("h").sortWithinPartitions("h", "id", "th", "b")
    sorted_out = arrow_map(dealt, _sort_buckets, "th long, n long, b long, e long")

    # 6. cut
    gone = spans.unionByName(later).unionByName(sorted_out)
    if dealt_out is not None:
        gone = gone.unionByName(dealt_out)
    gone = gone.groupBy(*same_text).agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    judged = materialize(texts.hint("merge").join(gone, same_text, "left").select(F.col("th").alias("t_th"), F.col("n").alias("t_n"), F.col("id").alias("first_id"), "spans"))
    discard(*written)
    out = docs.hint("merge").join(judged, (F.col("th") == F.col("t_th")) & (F.col("n") == F.col("t_n")))
    whole = F.when(F.col("n") >= LENGTH, F.array(F.struct(F.lit(0).cast("long").alias("b"), F.col("n").alias("e"))))
    spans = F.when(F.col("id") == F.col("first_id"), F.col("spans")).otherwise(whole)
    return arrow_map(out.select("doc_id", "text", spans.alias("spans")), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
