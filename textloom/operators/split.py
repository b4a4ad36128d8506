"""Deterministic samples and leakage-free, length-stratified splits.

Nothing here draws random numbers: rows are ordered by the MD5 of their key and a seed, which every engine computes alike
and no repartitioning changes. Orders are numbered by ranges (sources.readers.with_position), never in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textloom.functions import text as X
from textloom.functions.constants import SEED, VALIDATION_RATIO
from textloom.operators.duplicates import least_keys
from textloom.plans.storage import materialize
from textloom.sources.readers import with_position

LABELS = ["short", "medium", "long"]


def shuffle_key(key: Column | str, seed: int = SEED) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(c.cast("string"), F.lit(f"-{seed}")))


def prompt_facts(df: DataFrame, column: str, key: str) -> DataFrame:
    """``id, digest, length`` of the normalized texts: all that a split needs, a few bytes a row, and read only once."""
    t = X.normalized(column)
    return materialize(df.select(F.col(key).alias("id"), F.sha2(t, 256).alias("digest"), F.length(t).alias("length")))


def length_edges(facts: DataFrame) -> DataFrame:
    """One row ``low, short_medium, medium_long, high``: exact 1/3 and 2/3 quantiles of the length."""
    q = facts.agg(F.min("length").alias("low"), F.percentile("length", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"), F.max("length").alias("high"))
    return q.select("low", F.get("q", F.lit(0)).alias("short_medium"), F.get("q", F.lit(1)).alias("medium_long"), "high")


def tertiles(facts: DataFrame) -> DataFrame:
    """``id, length, label``: right-closed thirds by the quantile edges; where edges collapse, thirds by rank."""
    e = length_edges(facts).first()
    if e["low"] is None or e["low"] < e["short_medium"] < e["medium_long"] < e["high"]:
        label = F.when(F.col("length") <= F.lit(e["short_medium"]), LABELS[0]).when(F.col("length") <= F.lit(e["medium_long"]), LABELS[1]).otherwise(LABELS[2])
        return facts.select("id", "length", label.alias("label"))
    third = F.floor(F.col("position") * 3 / facts.count())
    return with_position(facts.select("id", "length"), "length", "id").select("id", "length", F.get(F.array(*map(F.lit, LABELS)), third.cast("int")).alias("label"))


def length_tertiles(df: DataFrame, column: str, key: str) -> DataFrame:
    return tertiles(prompt_facts(df, column, key))


def component_table(labelled: DataFrame, components: DataFrame) -> DataFrame:
    """``component, n_rows, label``: the most frequent label of a component's rows, the least of equally frequent ones."""
    return labelled.join(components, "id").groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"), F.mode("label", True).alias("label"))


def quotas(table: DataFrame, ratio: float) -> DataFrame:
    """``label, quota``: ceil(ratio * all) components in all, shared out by largest remainders (ties by label)."""
    n = table.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()
    n = n.withColumn("all", F.sum("n").over(every)).withColumn("target", F.ceil(F.lit(ratio) * F.col("all")))
    n = n.withColumn("share", F.floor(F.col("target") * F.col("n") / F.col("all"))).withColumn("rest", F.pmod(F.col("target") * F.col("n"), F.col("all")))
    left = F.col("target") - F.sum("share").over(every)
    return n.select("label", (F.col("share") + (F.row_number().over(W.orderBy(F.desc("rest"), "label")) <= left).cast("long")).alias("quota"))


def split_assign(df: DataFrame, prompt: str, key: str, ratio: float = VALIDATION_RATIO, seed: int = SEED, components: DataFrame | None = None) -> DataFrame:
    """``id, component, label, side``: rows of one component (equal normalized prompts unless given) stay together, and
    each length stratum gives its quota of components to validation."""
    facts = prompt_facts(df, prompt, key)
    if components is None:
        components = least_keys(facts, "digest")
    table = materialize(component_table(tertiles(facts), components))
    ordered = with_position(table.select("component", "label", shuffle_key("component", seed).alias("h")), "label", "h", "component")
    first = ordered.groupBy("label").agg(F.min("position").alias("first"))
    sides = ordered.join(F.broadcast(first), "label").join(F.broadcast(quotas(table, ratio)), "label")
    side = F.when(F.col("position") - F.col("first") < F.col("quota"), "validation").otherwise("train")
    return components.join(sides.select("component", "label", side.alias("side")), "component").select("id", "component", "label", "side")


def split_summary(assigned: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``side, n_rows, ratio`` and a zero-filled count of each label."""
    counts = assigned.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col("label") == x).alias(x) for x in labels))
    return counts.withColumn("ratio", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy()))


def leakage_check(assigned: DataFrame) -> DataFrame:
    """One row: components, those on both sides, and whether there are none."""
    sides = assigned.groupBy("component").agg(F.count_distinct("side").alias("n"))
    return sides.agg(F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("n") > 1).alias("n_leaking")).withColumn("no_leakage", F.col("n_leaking") == 0)


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the first column of ``ids``."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def fallback_split(df: DataFrame, key: str, ratio: float = VALIDATION_RATIO, seed: int = SEED) -> DataFrame:
    """``id, side``: the first int((1 - ratio) * n) rows of the shuffled order train, the others validate."""
    rows = df.select(F.col(key).alias("id"), shuffle_key(key, seed).alias("h"))
    n = rows.count()
    return with_position(rows, "h", "id").select("id", F.when(F.col("position") < int((1 - ratio) * n), "train").otherwise("validation").alias("side"))


def random_subset(df: DataFrame, key: str, fraction: float, seed: int = SEED) -> DataFrame:
    """max(1, int(n * fraction)) rows without replacement."""
    n = df.count()
    ranked = with_position(df.select(F.col(key).alias("_k"), shuffle_key(key, seed).alias("_h")), "_h", "_k")
    return df.join(ranked.where(F.col("position") < max(1, int(n * fraction))).select(F.col("_k").alias(key)), key, "left_semi")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows for a small report, in shuffled order."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the least keys; all if n is 0."""
    return df.orderBy(key).limit(n) if n else df


def evenly_spaced(df: DataFrame, key: str, k: int) -> DataFrame:
    """k rows at the positions floor(i * (n - 1) / (k - 1)); all if there are no more."""
    n = df.count()
    if n <= k:
        return df
    i = F.col("id")
    at = df.sparkSession.range(k).select(F.when(i == k - 1, F.lit(n - 1)).otherwise(F.floor(i * ((n - 1) / max(1, k - 1)))).alias("position"))
    return with_position(df, key).join(at, "position", "left_semi").select(*df.columns)
