"""Arrow plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.storage import ship

#: Rows and bytes of one Arrow batch. Texts reach 100 KB and more, so the default of 10,000 rows could take a worker's
#: memory; both bounds hold at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


#: What the operators' modules remember in a Python worker, by module: how to let go of it.
_RELEASE: dict[str, Callable[[], None]] = {}


def remembers(module: str, release: Callable[[], None]) -> None:
    """Says that a module keeps tables in the worker's memory between tasks; they go when another one's function starts."""
    _RELEASE[module] = release


def _take_turn(module: str) -> None:
    for other, release in _RELEASE.items():
        if other != module:
            release()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with bounded batches, the package being with the executors. The bounds are settings of the session, read
    when the plan is run, so they stay set; a smaller bound that the caller has set is left as it is."""
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    ship(spark)
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _take_turn(module)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def doc_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id`` (long) and ``text`` (null: empty); other columns, clashing names among them, never take part."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


#: Bits of a filter of keys.
FILTER_BITS = 23


def with_maybe(rows: DataFrame, key: str, keys: DataFrame, key_of: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false where the long ``key`` (an expression) is surely not among ``key_of`` of
    ``keys``. A filter of one hash and 2**FILTER_BITS bits says so; as 64-bit words it is a table of bounded size, so it is
    broadcast whatever the number of keys."""
    place = lambda c: f"pmod(xxhash64({c}), {1 << FILTER_BITS}L)"
    bit = lambda c: F.expr(f"shiftleft(1L, cast({place(c)} & 63 AS int))")
    word = lambda c: F.expr(f"shiftright({place(c)}, 6)")
    words = keys.groupBy(word(key_of).alias("f_word")).agg(F.bit_or(bit(key_of)).alias("f_bits"))
    both = rows.withColumn("r_word", word(key)).join(F.broadcast(words), F.col("r_word") == F.col("f_word"), "left")
    return both.withColumn(name, F.coalesce(F.col("f_bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("r_word", "f_word", "f_bits")


def hex_of(unsigned: Column) -> Column:
    return F.lower(F.lpad(F.hex(unsigned), 16, "0"))


def chunks(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each (one text may exceed it), so vector work fits in cache."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
