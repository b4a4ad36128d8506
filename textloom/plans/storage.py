"""Shared storage for intermediate results, and shipping of the package. Executors may be lost at any time, so nothing is
kept on one machine."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: Python functions in plans refer to it by name."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="textloom-")  # the driver's own: it serves the file from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "textloom_pkg.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on this one machine may do without: it gets a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


#: With it Spark removes the shuffle files of an execution when that ends, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that are there, for temporary() to remove.
_WRITTEN: list[DataFrame] = []


def materialize(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, columns can be pruned, and the
    shuffle files of the write are gone when it returns, so disk use is that of one phase. With the ``path`` of an earlier
    table rows are added to that."""
    spark = df.sparkSession
    new = path is None
    path = path or f"{checkpoint_dir(spark)}/textloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("errorifexists" if new else "append").parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    if new:
        atexit.register(_remove, spark, path)
        _WRITTEN.append(out)
    return out


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Removes at its end all tables that materialize() has written inside, but for those put in the list it gives. For
    callers that have written a result, so that nothing inside is read again."""
    kept: list[DataFrame] = []
    had = len(_WRITTEN)
    yield kept
    discard(*(t for t in _WRITTEN[had:] if all(t.materialized_at != k.materialized_at for k in kept)))


def discard(*tables: DataFrame) -> None:
    """Remove what materialize() has written, once no plan that is still to run reads it."""
    for t in tables:
        _remove(t.sparkSession, t.materialized_at)
        _WRITTEN[:] = [w for w in _WRITTEN if w.materialized_at != t.materialized_at]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One of fewer files' parts than the session has cores (a small file is one part, however many
    rows) is dealt over all of them; a large one is read as it lies."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended: a folder in reach is removed, others are the cluster's to clean
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
