"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Lines end at line feeds; those with no visible character (space, tab to carriage return) are no content and take no part.
Every three consecutive content lines of a document are a window. Of the equal windows of the corpus the first, by
doc_id and place, stays; a content line that any later one covers is removed with its line feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import with_maybe
from textloom.plans.storage import materialize

WINDOW = 3


def _windows(lines: str) -> Column:
    """Of an array of lines: (numbers of the window's lines, two 64-bit hashes of their texts), for each window."""
    content = f"filter(transform({lines}, (l, i) -> struct(i AS i, l AS l)), x -> x.l RLIKE '[^ \\\\t-\\\\r]')"
    cells = lambda f: ", ".join(f"c[j + {k}].{f}" for k in range(WINDOW))
    window = f"struct(array({cells('i')}) AS at, xxhash64({cells('l')}) AS h1, xxhash64(1, {cells('l')}) AS h2)"
    # the content lines are bound to a name by a transform over an array of one
    return F.expr(f"element_at(transform(array({content}), c -> if(size(c) < {WINDOW}, cast(array() AS array<struct<at: array<int>, h1: bigint, h2: bigint>>), transform(sequence(0, size(c) - {WINDOW}), j -> {window}))), 1)")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats_col: str | None = None) -> DataFrame:
    """``df`` with the repeated lines taken out of its texts, every row and column kept; ``stats_col`` adds a struct
    ``(n_lines, n_removed)`` under a name that the caller chooses.

    Null texts become empty ones; texts with fewer than three content lines are untouched. Null ids come first in the
    order. Rows of equal id and text are one place: they all lose the same lines, and none because of another. Rows of
    one id with different texts are different places, ordered by a hash of the text. Windows are compared by 128 bits
    of hash. A text whose lines all go becomes empty.

    Shuffles: window hashes twice (counted with partial aggregation, so a window that a third of the corpus repeats is
    one row a task; then joined), and the documents that may lose lines, by a filter of fixed size, to meet those. Both aggregates are written
    before they are joined back: the joins then stand right above their shuffles, with one row a key on the other side,
    and adaptive execution splits a key that very many rows share. A document's removed lines are gathered as a set.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("k_id"), F.xxhash64(text).alias("k_hash"), F.struct(*(df[c] for c in df.columns)).alias("row"), text.alias("t"))
    w = rows.select("k_id", "k_hash", F.explode(_windows("split(t, '\\n', -1)")).alias("w")).select("k_id", "k_hash", "w.*")
    place = F.struct("k_id", "k_hash", F.get("at", F.lit(0)).alias("i"))
    firsts = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    firsts = materialize(firsts)
    later = w.join(firsts.hint("merge"), ["h1", "h2"]).where(place != F.col("first"))
    lines = later.select("k_id", "k_hash", F.explode("at").alias("i"))
    gone = materialize(lines.groupBy("k_id", "k_hash").agg(F.collect_set("i").alias("gone")).withColumnsRenamed({"k_id": "g_id", "k_hash": "g_hash"}))
    marked = with_maybe(rows, "xxhash64(k_id, k_hash)", gone, "xxhash64(g_id, g_hash)", "maybe")
    maybe = marked.where("maybe")
    lose = maybe.join(gone.hint("merge"), maybe.k_id.eqNullSafe(gone.g_id) & (maybe.k_hash == gone.g_hash), "left")
    both = lose.select("row", "t", "gone").unionByName(marked.where("NOT maybe").select("row", "t", F.lit(None).cast("array<int>").alias("gone")))
    # by kept numbers, in linear time, however many lines a text has; the lines are bound to a name as above
    kept = F.expr("if(gone IS NULL, t, element_at(transform(array(split(t, '\\n', -1)), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), gone), i -> ls[i]), '\\n')), 1))")
    stats = F.struct(F.size(F.split("t", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    out = [kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns]
    return both.select(*out, *([stats.alias(stats_col)] if stats_col else []))
