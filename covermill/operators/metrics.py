"""Coverage metrics, trajectories and the frames behind reports and plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.functions.scalar import rcut_of
from covermill.operators.cover import global_rank
from covermill.operators.incidence import env_frequency
from covermill.session import Scratch


def coverage(target: DataFrame, covered: DataFrame) -> DataFrame:
    """One row ``n_target, n_covered, n_uncovered, coverage_pct``; of no envs 0 % are covered."""
    rows = target.select("env").distinct().join(covered.select("env").distinct().withColumn("is", F.lit(1)), "env", "left")
    out = rows.agg(F.count("*").alias("n_target"), F.count("is").alias("n_covered"))
    return out.select("n_target", "n_covered", (F.col("n_target") - F.col("n_covered")).alias("n_uncovered"), (100.0 * F.col("n_covered") / F.greatest(F.lit(1), "n_target")).alias("coverage_pct"))


def tier_coverage(tiers: DataFrame, covered: DataFrame) -> DataFrame:
    """``tier, n_target, n_covered, coverage_pct`` for ``rare``, ``common`` and ``total``."""
    rows = tiers.join(covered.select("env").distinct().withColumn("is", F.lit(1)), "env", "left")
    by = rows.groupBy("tier").agg(F.count("*").alias("n_target"), F.count("is").alias("n_covered"))
    every = by.agg(F.lit("total").alias("tier"), F.sum("n_target").alias("n_target"), F.sum("n_covered").alias("n_covered"))
    return by.unionByName(every.where("n_target is not null")).withColumn("coverage_pct", 100.0 * F.col("n_covered") / F.greatest(F.lit(1), "n_target"))


def weighted_coverage(inc: DataFrame, covered: DataFrame) -> DataFrame:
    """One row ``weighted_pct``: covered envs weighted by the items that have them; of no envs 100 % are covered."""
    rows = env_frequency(inc).join(covered.select("env").distinct().withColumn("is", F.lit(1)), "env", "left")
    out = rows.agg(F.sum("n_items").alias("all"), F.sum(F.when(F.col("is") == 1, F.col("n_items"))).alias("hit"))
    return out.select(F.coalesce(100.0 * F.coalesce("hit", F.lit(0)) / F.col("all"), F.lit(100.0)).alias("weighted_pct"))


def types_by_cutoff(inc: DataFrame, default: float = 3.0) -> DataFrame:
    """``rcut, n_types, n_items`` by the cutoff in the env's name."""
    rows = inc.withColumn("rcut", F.round(rcut_of(F.col("env"), default), 6))
    return rows.groupBy("rcut").agg(F.countDistinct("env").alias("n_types"), F.countDistinct("item").alias("n_items"))


def rarity_counts(inc: DataFrame, most: int = 1) -> DataFrame:
    """One row ``n_types, n_seldom, n_iron_centers, n_carbon_centers``: types in at most ``most`` items, and by center."""
    rows = env_frequency(inc)
    return rows.agg(F.count("*").alias("n_types"), F.count_if(F.col("n_items") <= most).alias("n_seldom"), F.count_if(F.col("env").contains(":fe:cn")).alias("n_iron_centers"), F.count_if(F.col("env").contains(":c:cn")).alias("n_carbon_centers"))


def trajectory(scratch: Scratch, ranked: DataFrame, inc: DataFrame, before: DataFrame, most_points: int = 0) -> DataFrame:
    """``step, weighted_pct`` and one ``rcut_<r>_pct`` per cutoff (2.7 as ``2p7``): coverage after each pick of ``ranked(rank, item)``.

    Step 0 is what ``before(env)`` covers. With ``most_points``, steps are a stride apart; the first and last stay.
    """
    weights = env_frequency(inc).withColumn("rcut", F.round(rcut_of(F.col("env")), 6))
    firsts = inc.join(ranked.select("item", "rank"), "item").groupBy("env").agg(F.min("rank").alias("step"))
    firsts = firsts.join(before.select("env").distinct(), "env", "left_anti").unionByName(before.select("env").distinct().withColumn("step", F.lit(0)))
    met = weights.join(firsts, "env", "left")
    cutoffs = [r["rcut"] for r in met.select("rcut").distinct().orderBy("rcut").collect()]
    whole = met.agg(F.sum("n_items").alias("w"), *[F.count_if(F.col("rcut") == c).alias(f"c{i}") for i, c in enumerate(cutoffs)]).first()
    steps = met.where("step is not null").groupBy("step").agg(F.sum("n_items").alias("w"), *[F.count_if(F.col("rcut") == c).alias(f"c{i}") for i, c in enumerate(cutoffs)])
    every = ranked.select(F.col("rank").cast("long").alias("step")).unionByName(ranked.sparkSession.range(1).select(F.col("id").alias("step")))
    rows = every.join(steps, "step", "left").na.fill(0)
    parts = ["w", *(f"c{i}" for i in range(len(cutoffs)))]
    for name in parts:
        rows = global_rank(scratch, rows, [F.asc("step")], name).withColumnRenamed("covered", f"sum_{name}").drop("rank")
    # no dot in a name, which SQL would take for a field
    names = ["weighted_pct", *(f"rcut_{c:g}_pct".replace(".", "p") for c in cutoffs)]
    rows = rows.select(F.col("step").cast("long").alias("step"), *[(100.0 * F.col(f"sum_{p}") / max(1, whole[p] or 0)).alias(n) for p, n in zip(parts, names)])
    if most_points > 1:
        last = ranked.count()
        stride = max(1, math.ceil(last / (most_points - 1)))
        rows = rows.where((F.col("step") % stride == 0) | (F.col("step") == last))
    return rows


def convergence(manifest: DataFrame) -> DataFrame:
    """``step, new_gain, covered, uncovered, coverage_pct, pass_name`` of a manifest."""
    named = F.col("pass_name") if "pass_name" in manifest.columns else F.lit("all")
    return manifest.select(F.col("rank").alias("step"), "new_gain", "covered", "uncovered", "coverage_pct", named.alias("pass_name"))


def gain_histogram(gains: DataFrame, gain: str) -> DataFrame:
    """``bin, low, high, n`` of the positive gains in equal bins, ``min(50, max(10, floor(sqrt(count))))`` of them."""
    rows = gains.select(F.col(gain).cast("double").alias("g")).where("g > 0")
    whole = rows.agg(F.count("*").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi")).first()
    bins = min(50, max(10, math.isqrt(whole["n"])))
    lo, hi = (whole["lo"] or 0.0), (whole["hi"] or 1.0)
    hi = hi if hi > lo else lo + 1.0
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col("g") - lo) / width) + 1, F.lit(bins)).cast("int").alias("bin")
    return rows.groupBy(at).agg(F.count("*").alias("n")).select("bin", (lo + (F.col("bin") - 1) * width).alias("low"), (lo + F.col("bin") * width).alias("high"), "n")


def frequency_ranks(scratch: Scratch, inc: DataFrame) -> DataFrame:
    """``rank, env, n_items``, the most frequent first, equals by name."""
    return global_rank(scratch, env_frequency(inc), [F.desc("n_items"), F.asc("env")]).select("rank", "env", "n_items")


def report(one: DataFrame) -> DataFrame:
    """``key, value`` of a one-row frame, all as text; nulls become empty."""
    text = one.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in one.columns])
    return text.unpivot([], text.columns, "key", "value")


def source_counts(items: DataFrame, kept: DataFrame, source: str) -> DataFrame:
    """``source, n_in, n_kept`` with the items and the kept items of each source."""
    rows = items.select("item", F.col(source).alias("source")).distinct().join(kept.select("item").distinct().withColumn("k", F.lit(1)), "item", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_in"), F.count("k").alias("n_kept"))

