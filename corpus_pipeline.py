"""The training-data pipeline: from documents to encoded texts, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all rows that the one before kept, and but for the last
returns the columns of documents. ``run`` writes each result as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.decontaminate import decontaminate
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.pieces import encoding_digests
from textloom.llm.quality_rules import keep_quality
from textloom.llm.queries import table, tokenizer
from textloom.llm.simhash import first_of_components
from textloom.plans.storage import discard, materialize, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the likelihood ratio rejects go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return keep_quality(docs, trusted)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars is counted anew."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; of rows with that id (or of a group without ids) the first by
    text. Every group keeps one row, whichever ids are null or repeated elsewhere."""
    return first_of_components(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text that is left."""
    return encoding_digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL can't express the hashed likelihood ratios, the fingerprints and the encoding; tests hold run() against a plain
#: version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables go once its result is written, and its input once the next is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with temporary() as kept:
            docs = materialize(stage(spark, docs, sf_dir))
            kept.append(docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
