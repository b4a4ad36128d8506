"""Sources: CSV with declared or inferred types, splits, configuration, files and checkpoints."""

from __future__ import annotations

import importlib
import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from textloom.functions.constants import CSV_NULLS, LEDGER_COLUMNS
from textloom.plans.storage import materialize


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = False) -> DataFrame:
    """A CSV file with header, quoted line feeds and doubled quotes. Types are declared, inferred if asked, else text;
    the usual spellings of a missing value are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", infer).csv(path)
    null = lambda c: F.when(F.col(c).isin(CSV_NULLS), None).otherwise(F.col(c)).alias(c)
    return df.select(*(null(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields))


def read_pairs(spark: SparkSession, path: str, key_type: str = "long", response: bool = True) -> DataFrame:
    """The prompt/response layout ``id, input[, output]`` with the key's type declared."""
    return read_csv(spark, path, f"id {key_type}, input string" + (", output string" if response else ""))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A split document, or a split written as Parquet, as ``side, id``, each id once a side."""
    if not path.endswith(".json"):
        return spark.read.parquet(path).select("side", "id").distinct()
    doc = spark.read.option("multiLine", True).json(path)
    side = lambda name: doc.select(F.lit(name).alias("side"), F.explode(f"{name}_row_ids").alias("id"))
    return side("train").unionByName(side("validation")).distinct()


def read_config(path: str) -> dict[str, Any]:
    """A flat YAML document; an empty one is an empty dict. Driver-side: it is no data."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:  # enough for flat string keys
        found = (re.match(r"(\w+)\s*:\s*(.*?)\s*$", x) for x in text.splitlines() if x and x[0] not in " -#")
        return {m[1]: m[2].strip("\"'") for m in found if m}
    return yaml.safe_load(text) or {}


def find_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, length`` of the files below a folder whose name fits, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def find_file(spark: SparkSession, root: str, name: str, optional: bool = False) -> str | None:
    """The first such path in order; an error if there is none, unless it is optional."""
    found = find_files(spark, root, name).agg(F.min("path")).first()[0]
    if found is None and not optional:
        raise FileNotFoundError(f"no {name} below {root}")
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def digest_matches(spark: SparkSession, path: str, expected: str) -> bool:
    """Whether a file is the one expected; a caller that only warns can go on."""
    return file_digests(spark, path).first()["sha256"] == expected


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes below a path; 0 if it doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """A 0-based position in the given order (unique keys make it deterministic). Rows are ranged over all partitions and
    numbered in each; only the partitions' counts meet in one place."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_local", local).join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return numbered.select(*df.columns, (F.col("_before") + F.col("_local")).cast("long").alias(name))


def ledger_columns(spark: SparkSession, path: str) -> list[str]:
    """The header that an existing ledger has, which later rows follow; the fixed one for a new ledger."""
    if not path_exists(spark, path):
        return LEDGER_COLUMNS
    first = spark.read.text(path).first()
    return first[0].split(",") if first else LEDGER_COLUMNS


def latest_checkpoint(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``path, step`` of the checkpoint folder with the greatest number; none if no name has one."""
    step = F.regexp_extract(path_col, r"checkpoint-(\d+)/*$", 1)
    steps = paths.select(F.col(path_col).alias("path"), step.alias("s")).where("s <> ''").select("path", F.col("s").cast("long").alias("step"))
    return steps.agg(F.max_by("path", F.struct("step", "path")).alias("path"), F.max("step").alias("step")).where("step IS NOT NULL")


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """Names directly below a folder as ``path``: a driver-side listing, bounded by the folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.createDataFrame([(s.getPath().toString(),) for s in fs.listStatus(p)], "path string")


def from_columns(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """An in-memory table from lists of equal length."""
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def read_json_document(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


class ModelBackend:
    """What a model loaded from elsewhere must offer. Nothing here loads weights: there is no network, and they are not
    part of the engine."""

    def encode(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def generate(self, prompts: list[str]) -> list[str]:
        raise NotImplementedError

    def tokenize(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def parameters(self) -> list[tuple[int, bool]]:
        """Size of each part, and whether it is trained; empty if unknown."""
        return []


class NamedModel(ModelBackend):
    """A model named ``module:factory``, made on first use in each Python worker and kept there; what is sent to the
    executors is its name only. The module must be importable on them."""

    _made: dict[str, ModelBackend] = {}

    def __init__(self, name: str):
        if not re.fullmatch(r"[\w.]+:\w+", name):
            raise ValueError(f"not module:factory: {name}")
        self.name = name

    def _model(self) -> ModelBackend:
        if self.name not in self._made:
            module, factory = self.name.split(":")
            self._made[self.name] = getattr(importlib.import_module(module), factory)()
        return self._made[self.name]

    def encode(self, texts: list[str]) -> list[list[float]]:
        return self._model().encode(texts)

    def generate(self, prompts: list[str]) -> list[str]:
        return self._model().generate(prompts)

    def tokenize(self, texts: list[str]) -> list[list[int]]:
        return self._model().tokenize(texts)

    def parameters(self) -> list[tuple[int, bool]]:
        return self._model().parameters()
