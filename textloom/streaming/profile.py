"""Running statistics of a text column over a stream; state is a few numbers a group, or one row a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources.writers import append_ledger


def stream_of(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_statistics(stream: DataFrame, column: str, *group: str) -> DataFrame:
    """Rows, missing values, total characters and words, least and greatest length by group. (Exact percentiles would need
    all lengths; the batch profile has them.)"""
    chars, words = X.n_chars(column), X.n_words(column)
    return stream.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_missing"), F.sum(chars).alias("chars"), F.sum(words).alias("words"), F.min(chars).alias("chars_min"), F.max(chars).alias("chars_max")
    )


def first_seen(stream: DataFrame, column: str, time: str, delay: str) -> DataFrame:
    """Rows whose normalized text has not been seen within the watermark's delay: keep-first dedup with bounded state."""
    keyed = stream.withColumn("_digest", F.sha2(X.normalized(column), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def ledger_sink(path: str):
    """For ``foreachBatch``: appends every batch of ledger rows."""
    return lambda batch, _: append_ledger(batch, path)
