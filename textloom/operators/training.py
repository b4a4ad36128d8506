"""Training sets: chat pairs, templated and tokenized examples, budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textloom.functions import text as X
from textloom.functions.constants import MAX_SEQUENCE, MODES, PARAMETER_CAP, SEED
from textloom.operators.profile import length_report
from textloom.operators.split import first_rows, fixed_sample, random_subset
from textloom.plans.storage import materialize, ship

IGNORED = -100


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """``id, prompt, response``: each user turn with the next turn of its conversation, if that is the assistant's."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("response"))
    rows = rows.where("role = 'user' AND next_role = 'assistant'")
    return rows.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"), "response")


def formatted(df: DataFrame, prompt: str, response: str | None, key: str, template: Callable[[Column, bool], Column] = X.chat_text) -> DataFrame:
    """``id, text``: each row through a chat template; without a response it ends where the answer begins."""
    messages = X.chat_messages(prompt, response)
    return df.select(F.col(key).alias("id"), template(messages, response is None).alias("text"))


def word_ids(column: str, vocabulary: int = 50_000) -> Column:
    """Stand-in ids of whitespace words, for want of a model's tokenizer: a hash modulo a vocabulary size."""
    return F.transform(X.tokens(column), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(vocabulary)).cast("int"))


def tokenized(df: DataFrame, text: str, key: str, most: int = MAX_SEQUENCE, multiple: int = 8, encode: Callable[[list[str]], list[list[int]]] | None = None) -> DataFrame:
    """``id, n_tokens, input_ids, labels``: ids cut at ``most``, labels a copy; padded to a multiple, labels with -100.
    ``encode`` is a model's tokenizer, run on Arrow batches; without one word_ids() is used."""
    if encode is None:
        rows = df.select(F.col(key).alias("id"), X.truncated(word_ids(text), most).alias("ids"))
    else:
        ship(df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = [list(x)[:most] for x in encode(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

        rows = df.select(F.col(key).cast("long").alias("id"), X.filled(text).alias("t")).mapInArrow(run, "id long, ids array<int>")
    return rows.select("id", F.size("ids").cast("long").alias("n_tokens"), X.padded("ids", multiple, 0).alias("input_ids"), X.padded("ids", multiple, IGNORED).alias("labels"))


def training_rows(df: DataFrame, key: str, mode: str, seed: int = SEED) -> DataFrame:
    """The share of the rows that a mode trains on."""
    fraction = MODES[mode]["train_frac"]
    return df if fraction >= 1 else random_subset(df, key, fraction, seed)


def evaluation_rows(df: DataFrame, key: str, most: int = 500) -> DataFrame:
    return first_rows(df, key, most)


def generated(df: DataFrame, prompt: str, response: str, key: str, generate: Callable[[list[str]], list[str]], template: Callable[[Column, bool], Column] = X.chat_text) -> DataFrame:
    """``patient_prompt, reference_response, generated_response``: what a model answers to the formatted prompts, on Arrow
    batches, in the order of the key as text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = pa.array(generate(b.column(3).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), answers], ["k", "patient_prompt", "reference_response", "generated_response"])

    rows = df.select(F.col(key).cast("string").alias("k"), X.filled(prompt).alias("p"), X.filled(response).alias("r"), template(X.chat_messages(prompt), True).alias("t"))
    out = rows.mapInArrow(run, "k string, patient_prompt string, reference_response string, generated_response string")
    return out.orderBy("k").drop("k")


def fertility(df: DataFrame, prompt: str, response: str, key: str, n: int = 100, limit: int = MAX_SEQUENCE, encode: Callable[[list[str]], list[list[int]]] | None = None) -> DataFrame:
    """``part, n_rows, mean, median, p95_interpolated, max, p95, over_limit`` of the token counts of prompts, responses
    and both, on a seeded sample of n rows. ``encode`` is a model's tokenizer; without one words are counted."""
    sample = fixed_sample(df, key, n).select(F.col(key).cast("string").alias("k"), X.filled(prompt).alias("p"), X.filled(response).alias("r"))
    if encode is None:
        counts = sample.select(X.n_words("p").alias("prompt"), X.n_words("r").alias("response"))
    else:
        ship(df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = [pa.array([len(x) for x in encode(b.column(c).to_pylist())], pa.int64()) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays(sizes, ["prompt", "response"])

        counts = sample.mapInArrow(run, "prompt long, response long")
    counts = materialize(counts.withColumn("total", F.col("prompt") + F.col("response")))  # read by three reports
    out = None
    for part in ("prompt", "response", "total"):
        report = length_report(counts, part, limit).select(F.lit(part).alias("part"), "*")
        out = report if out is None else out.unionByName(report)
    return out


def check_parameters(total: int, cap: int = PARAMETER_CAP) -> int:
    if total > cap:
        raise ValueError(f"{total} parameters are more than {cap}")
    return total


def parameter_report(layers: list[tuple[int, bool]]) -> dict[str, Any]:
    """Totals of (size, whether trained) of a model's parts."""
    total, trained = sum(n for n, _ in layers), sum(n for n, t in layers if t)
    return {"total": check_parameters(total), "trainable": trained, "percent": 100 * trained / total if total else 0.0}
