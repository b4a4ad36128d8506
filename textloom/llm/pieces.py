"""SentencePiece merge-type encoding by backtracking, and decoding.

The encoding of a stretch is the one sequence of pieces that covers it and whose neighbours are all *compatible*: two
pieces are compatible if merging their joined text from characters gives just these two again. An Aho-Corasick automaton of
the pieces read backwards runs once over the stretch read backwards, and so gives the longest match that begins at every
place; shorter ones are its prefixes. The sequence is found left to right: a piece is taken if it is compatible with the one
before and no earlier try has failed from where it ends (a bitfield of failed positions); otherwise a shorter one is, and
with none left the last piece is given up and the place marked as failed.

Stretches come from cutting the text where no merge can cross: a piece holds the word mark only at its start (or is a run
of marks), and characters outside the vocabulary stand alone and fall back to bytes. That the model is one of these (its
type and normalisation, its kinds of pieces, its word marks) is read from the file and checked when it is loaded; any
other is an error.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import arrow_map, doc_rows, remembers

MARK = "▁"
#: Bounds of the remembered words and pairs of a Python worker; each starts anew when full.
REMEMBERED_WORDS, REMEMBERED_CHARS, REMEMBERED_PAIRS = 600_000, 64, 500_000


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the wire format of protocol buffers."""
    i = 0

    def number() -> int:
        nonlocal i
        n = shift = 0
        while True:
            c = message[i]
            i += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while i < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, message[i : i + size]
        i += size


#: Numbers of fields in a model file, of its trainer's and its normalizer's settings and of a piece; the
#: merge type of model; and the kind of piece that a user has defined.
PIECE_FIELD, TRAINER_FIELD, NORMALIZER_FIELD, KIND_FIELD = 1, 2, 3, 3
MODEL_TYPE, MARK_BEHIND, CHARACTER_MAP, DUMMY_PREFIX, DROP_SPACES, ESCAPE_SPACES = 3, 24, 2, 3, 4, 5
MERGE_TYPE, USER_DEFINED = 2, 4


def check_model(path: str) -> None:
    """An error unless the file says what this encoder assumes. Fields that are not there have their defaults."""
    with open(path, "rb") as f:
        found = list(fields(f.read()))
    settings = lambda k: dict(x for n, v in found if n == k for x in fields(v))
    trainer, normalizer = settings(TRAINER_FIELD), settings(NORMALIZER_FIELD)
    kinds = {dict(fields(v)).get(KIND_FIELD, 1) for n, v in found if n == PIECE_FIELD}
    for wrong, what in (
        (trainer.get(MODEL_TYPE, 1) != MERGE_TYPE, "is not of the merge type"),
        (trainer.get(MARK_BEHIND, 0), "marks words behind them"),
        (normalizer.get(CHARACTER_MAP, b""), "maps characters"),
        (not normalizer.get(DUMMY_PREFIX, 1), "sets no mark before a text"),
        (normalizer.get(DROP_SPACES, 1), "drops spaces"),
        (not normalizer.get(ESCAPE_SPACES, 1), "does not mark spaces"),
        (USER_DEFINED in kinds, "has pieces that a user has defined"),
    ):
        if wrong:
            raise ValueError(f"the model {what}")


class Model:
    """A merge-type model with byte fallback, identity normalisation and a word mark before the text."""

    def __init__(self, path: str):
        import sentencepiece

        check_model(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = {self.pieces[i]: sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.id = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.last_special = max(self.unknown, *self.byte_of, *self.silent)
        if len(self.byte_id) != 256:
            raise ValueError("a model with byte fallback is needed")
        if any(MARK in p[1:] and p.strip(MARK) for p in self.id):
            raise ValueError("a piece holds the word mark after other characters: words can't be cut apart")
        self.chars = {p for p in self.id if len(p) == 1}
        if any(c not in self.chars for p in self.id for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.adjacent = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p[::-1], (i, len(p)))
        self.automaton.make_automaton()
        # of every piece the longest shorter one that it begins with
        self.shorter = {i: next(((self.id[p[:k]], k) for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None) for p, i in self.id.items()}
        self.digits = [str(i) for i in range(n)]
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.words = self.word_pattern()

    def word_pattern(self) -> re.Pattern:
        """A word ends before a mark, before punctuation that follows nothing but punctuation and marks in any piece,
        and around a line feed outside the vocabulary. (Cutting less would be right too, but words come again less.)"""
        free = string.punctuation
        while (less := "".join(c for c in free if all(x[0] in free + MARK for x in self.adjacent if x[1] == c))) != free:
            free = less
        q = "[" + re.escape(free) + "]" if free else "(?!)"
        end = "\n" if "\n" not in self.chars else ""
        rest = f"[^{MARK}{end}{re.escape(free)}]"
        return re.compile(f"{MARK}*{q}*{rest}+|{MARK}*{q}+|{MARK}+" + (f"|{end}" if end else ""))

    # --- merging, the definition against which compatibility is checked

    def merge(self, text: str) -> list[int]:
        """Ids by plain merging of known characters: the best-scored adjacent pair first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def stands_alone(self, a: int) -> bool:
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = self.merge(self.pieces[a]) == [a]
        return known

    # --- encoding

    def backtrack(self, text: str) -> list[int]:
        """Ids of a stretch of known characters. It holds at most one mark, at its start: equal scores, which only runs
        of marks have, then never decide."""
        n, ids, known = len(text), self.id, self.pairs
        whole = ids.get(text)
        if whole is not None and self.stands_alone(whole):
            return [whole]
        shorter = self.shorter
        # matches that end at one place of the reversed text come with the longest first
        longest: list[tuple[int, int] | None] = [None] * n
        for end, match in self.automaton.iter(text[::-1]):
            if longest[n - 1 - end] is None:
                longest[n - 1 - end] = match
        failed = bytearray((n >> 3) + 1)
        taken: list[int] = []
        lengths: list[int] = []
        at = 0
        found = longest[0]
        while True:
            while found:
                i, k = found
                end = at + k
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = known.get(taken[-1] << 32 | i) if taken else self.stands_alone(i)
                    if fits or fits is None and self.compatible(taken[-1], i):
                        break
                found = shorter[i]
            if found:
                taken.append(i)
                if end == n:
                    return taken
                lengths.append(k)
                at = end
                found = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not taken:
                    raise AssertionError("no encoding")  # every known character is a piece
                found = shorter[taken.pop()]
                at -= lengths.pop()

    def stretch(self, text: str) -> list[int]:
        return self.backtrack(text) if MARK not in text[1:] else self.merge_marks(text)

    def merge_marks(self, text: str) -> list[int]:
        """A run of marks and what follows: the last mark goes with the word if they merge (all such pieces score above
        all runs); the runs, whose scores are equal, are merged as defined, from the left."""
        run = len(text) - len(text.lstrip(MARK))
        head = self.backtrack(text[run - 1 :]) if run < len(text) else []
        own = 0 if head and head[0] != self.id[MARK] else 1
        return self.merge_run(run - 1 + own) + head[own if head else 0 :]

    def merge_run(self, n: int) -> list[int]:
        """Leftmost-first merging of n marks. Whatever is left of a merge can't merge any more, or it would have come
        first, so it is a loop over a short list of lengths rather than over all marks."""
        lengths: list[int] = []
        known = {len(p) for p in self.id if not p.strip(MARK)}
        for _ in range(n):
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in known:
                lengths[-2:] = [lengths[-2] + lengths[-1]]
        return [self.id[MARK * k] for k in lengths]

    def word(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return self.stretch(text)
        ids: list[int] = []
        start = 0
        chars, adjacent, n = self.chars, self.adjacent, len(text)
        for i in range(1, n + 1):
            if i == n or text[i - 1 : i + 1] not in adjacent:
                s = text[start:i]
                if s in chars:
                    ids.append(self.id[s])
                elif len(s) == 1:
                    ids.extend(self.byte_id[b] for b in s.encode())
                else:
                    ids.extend(self.stretch(s))
                start = i
        return ids

    def cut(self, text: str) -> list[str]:
        """Words with the marks and the opening punctuation before them."""
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.cut(text) for i in self.word(w)]

    # --- decoding

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) > self.last_special:
            text = "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
            return text[1:] if text.startswith(" ") else text
        out: list[str] = []
        run = bytearray()
        first = True  # the mark before the text is dropped from the first piece that says anything
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(lenient(bytes(run)))
                run.clear()
                first = False
            if i in self.silent:
                continue
            if i == self.unknown:
                out.append(" ⁇ ")
                first = False
                continue
            p = self.pieces[i]
            if first and p.startswith(MARK):
                p = p[1:]
            first = False
            out.append(p.replace(MARK, " "))
        if run:
            out.append(lenient(bytes(run)))
        return "".join(out)


def lenient(run: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is in no whole character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for k in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model_for(path: str) -> Model:
    return Model(path)


class Digests(dict):
    """Digests of a text's ids and of what they decode to. A word's ids, as text, and what those ids decode to are
    remembered. Decoding word by word is decoding: no run of byte pieces reaches over the end of a word, since a word
    holds whole characters."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[int, str, str]:
        ids = self.model.word(word)
        # behind another mark, which decoding drops, the word's own mark is kept
        found = len(ids), ",".join(map(self.model.digits.__getitem__, ids)), self.model.decode([self.model.id[MARK], *ids])
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> tuple[int, str, str]:
        if not text:
            return 0, EMPTY, EMPTY
        n, ids, decoded = zip(*map(self.__getitem__, self.model.cut(text)), strict=True)
        whole = "".join(decoded)[1:]  # the mark before the text
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()


EMPTY = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=2)
def digests_for(path: str) -> Digests:
    return Digests(model_for(path))


def forget() -> None:
    digests_for.cache_clear()
    model_for.cache_clear()


remembers(__name__, forget)


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``ids`` (array of int), as the model's library encodes the text, without
    begin or end ids. Null and empty texts have no ids; null ids stay null; repeated rows give repeated rows; an empty
    table gives none; further columns are ignored. No shuffle; ``model_path`` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_for(model_path)
        for b in batches:
            ids = [m.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(doc_rows(df, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``doc_id`` and ``text``, as the model's library decodes the ids. Null arrays decode to the
    empty text, and so do null ids inside one; ids outside the vocabulary raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_for(model_path)
        for b in batches:
            text = [m.decode([i for i in ids or [] if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids"))
    return arrow_map(rows, run, "doc_id long, text string")


def encoding_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row in one pass; rows and nulls as in encode_texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = digests_for(model_path)
        for b in batches:
            n, ids, decoded = zip(*map(d.of, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(doc_rows(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
