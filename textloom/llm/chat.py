"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log of events is partitioned by conversation and folded by sequence number into final messages, which are rendered
through a template together with a loss mask. Events:

=============  ===============================================================================
``message``    appends ``text`` to its message (a whole message in one event)
``delta``      the same, for one streamed piece
``edit``       replaces what its message said so far by ``text``
``regenerate`` drops its message and all later messages of the conversation; pieces with a
               higher sequence number build them anew
=============  ===============================================================================

The fold is relational: a piece survives unless a later edit of its message, or a later regeneration of its message or an
earlier one, has a higher sequence number. Windows say so without a per-row loop over a growing state, so a conversation
costs N log N, and its log is sorted by Spark with spilling. Only the finished text of one conversation, which is one
value by nature, has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """``<``, any backslashes, ``|`` gets one backslash more: no control string is left, and unescape() takes it off."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line without control strings: the characters that could end it are percent-encoded."""
    for c in "%\n<|":
        role = F.replace(role, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return role


def unescape_role(role: Column) -> Column:
    for c in "|<\n%":
        role = F.replace(role, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return role


def turns_as_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of whole turns as a log: each row is a message of its own, by turn, then role, then text (nulls first)."""
    rows = turns.select(turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", n.alias("seq"), F.lit("message").alias("event"), n.alias("message"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, role, text`` of a log ``conv_id, seq, event, message, role, text``.

    Null texts are empty; a message's role is that of its first surviving piece that has one, else empty; events of one
    sequence number are taken by event, role and text, so repeated rows count each; unknown events are ignored; a
    conversation without surviving messages is not in the result; null conversation ids form one conversation.
    """
    log = events.select(*(F.col(c) for c in ("conv_id", "seq", "event", "message", "role", "text")))
    edited = F.max(F.when(F.col("event") == "edit", F.col("seq"))).over(W.partitionBy("conv_id", "message"))
    again = F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).over(W.partitionBy("conv_id").orderBy("message").rangeBetween(W.unboundedPreceding, W.currentRow))
    pieces = (
        log.withColumn("again", again).withColumn("edited", edited)
        .where(F.col("event").isin("message", "delta", "edit"))
        .where((F.col("seq") >= F.coalesce("edited", "seq")) & (F.col("again").isNull() | (F.col("seq") > F.col("again"))))
    )
    piece = F.struct("seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"))
    folded = pieces.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    roles = F.filter(F.transform("p", lambda x: x["role"]), lambda r: r.isNotNull())
    return folded.select("conv_id", "message", F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: each message as ``<|im_start|>role LF text<|im_end|> LF``, and the loss mask as
    ``array<struct<start, length>>`` in code points of ``formatted``, one span for each text of ``loss_role``."""
    m = messages.select("conv_id", "message", "role", escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    m = m.withColumn("part", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END + "\n")))
    before = F.coalesce(F.sum(F.length("part")).over(W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("start", before + F.lit(len(START) + 1) + F.length("r"))
    span = F.struct(F.col("start").cast("long").alias("start"), F.length("t").cast("long").alias("length"))
    one = F.struct("message", "part", F.when(F.col("role") == loss_role, span).alias("span"))
    # the window has already placed a conversation's rows together
    whole = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return whole.select("conv_id", F.array_join(F.transform("m", lambda x: x["part"]), "").alias("formatted"), F.filter(F.transform("m", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse render()'s output: ``conv_id, turn, role, text, loss_text`` (null where the loss mask has no span), and the
    ``formatted_chars`` of the conversation.

    Messages and spans are exploded together and meet by their places in windows over the conversation, so a plan that
    holds a conversation's rows together already, as render()'s does, is not shuffled again.
    """
    part, span = "struct(x AS part, cast(NULL AS bigint) AS b, cast(NULL AS bigint) AS n)", "struct(cast(NULL AS string) AS part, x.start AS b, x.length AS n)"
    events = F.expr(rf"concat(transform(split(formatted, '<\\|im_start\\|>'), x -> {part}), transform(loss_spans, x -> {span}))")
    # the length is taken below the generator, or every exploded row would carry the whole conversation
    counted = formatted.select("conv_id", "formatted", "loss_spans", F.length("formatted").cast("long").alias("formatted_chars"))
    rows = counted.select("conv_id", "formatted_chars", F.posexplode(events).alias("pos", "e")).select("conv_id", "formatted_chars", "pos", "e.*").where("pos > 0")
    at = F.sum(F.length("part") + len(START)).over(W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.length("part")
    rows = rows.withColumn("r", F.substring_index("part", "\n", 1)).withColumn("start", F.coalesce("b", at + F.length("r") + 1))
    placed = W.partitionBy("conv_id").orderBy("start", F.col("part").isNull())
    rows = rows.withColumn("length", F.when(F.lead("b").over(placed) == F.col("start"), F.lead("n").over(placed))).where("part IS NOT NULL")
    rows = rows.select("conv_id", "formatted_chars", "pos", "r", "length", F.expr(f"substring(part, length(r) + 2, length(part) - length(r) - 1 - {len(END) + 1})").alias("t"))
    return rows.select("conv_id", F.col("pos").cast("long").alias("turn"), unescape_role(F.col("r")).alias("role"), unescape(F.col("t")).alias("text"), unescape(F.expr("substring(t, 1, cast(length as int))")).alias("loss_text"), "formatted_chars")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from the output."""
    turn = F.struct("turn", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), F.coalesce("loss_text", F.lit("")).alias("loss"))
    turns = read_back(formatted).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("formatted_chars").alias("formatted_chars"), F.array_sort(F.collect_list(turn)).alias("t"))
    turns = turns.select("conv_id", "n_turns", "formatted_chars", F.array_join(F.transform("t", lambda x: x["said"]), "").alias("said"), F.array_join(F.transform("t", lambda x: x["loss"]), "").alias("loss"))
    return turns.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
