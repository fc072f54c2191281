"""The one relation of the engine, ``incidence(item, env)``, and what is read off it.

Null items and envs and blank envs are no incidence; rows are distinct. Every function takes and gives DataFrames
and selects its own columns, so other columns, whatever their names, do no harm; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermill.functions.scalar import compared


def incidence(df: DataFrame, item: str | Column, env: str | Column) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(as_col(item).alias("item"), compared(as_col(env)).alias("env"))
    return rows.where("item is not null and env <> ''").distinct()


def inverted_index(inc: DataFrame) -> DataFrame:
    """``env, items``: sorted items of each env."""
    return inc.groupBy("env").agg(F.array_sort(F.collect_set("item")).alias("items"))


def env_frequency(inc: DataFrame) -> DataFrame:
    """``env, n_items``: in how many items each env is."""
    return inc.groupBy("env").agg(F.count("*").alias("n_items"))


def classify(inc: DataFrame, threshold: int) -> DataFrame:
    """``env, n_items, tier``: ``rare`` in at most ``threshold`` items, else ``common``; over the whole relation."""
    return env_frequency(inc).withColumn("tier", F.when(F.col("n_items") <= threshold, "rare").otherwise("common"))


def projected(inc: DataFrame, target: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Incidence of the envs in ``target(env)``, without the items of ``exclude(item)``; items left empty vanish."""
    rows = inc.join(target.select("env").distinct(), "env", "left_semi").select("item", "env")
    return rows if exclude is None else rows.join(exclude.select("item"), "item", "left_anti")


def candidates(inc: DataFrame, target: DataFrame) -> DataFrame:
    """``item, n_target``: items with an env of the target, and how many."""
    return projected(inc, target).groupBy("item").agg(F.count("*").alias("n_target"))


def gap(inc: DataFrame, covered: DataFrame) -> DataFrame:
    """``env``: what the relation has and ``covered(env)`` lacks."""
    return inc.select("env").distinct().join(covered.select("env"), "env", "left_anti")


def covered_by(inc: DataFrame, items: DataFrame) -> DataFrame:
    """``env``: the union over the given items."""
    return inc.join(items.select("item"), "item", "left_semi").select("env").distinct()


def effective_layer(inc: DataFrame, dim: DataFrame) -> DataFrame:
    """Incidence with raw envs replaced by their types, from ``dim(raw, type)``; envs without a type are left out."""
    return inc.join(dim.select(F.col("raw").alias("env"), "type"), "env").select("item", F.col("type").alias("env")).distinct()


def probe_mapped(inc: DataFrame, dim: DataFrame, protect: bool = True) -> DataFrame:
    """``item, env, is_probe_only``: known raw envs by their type; unknown ones as ``probe_only:<raw>`` or left out."""
    rows = inc.join(dim.select(F.col("raw").alias("env"), "type"), "env", "left")
    rows = rows.select("item", F.coalesce("type", F.concat(F.lit("probe_only:"), "env")).alias("env"), F.col("type").isNull().alias("is_probe_only"))
    return (rows if protect else rows.where("not is_probe_only")).distinct()
