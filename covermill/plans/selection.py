"""Selection pipelines: initial choice, gap supplement, joint minimum cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermill.operators import compress, geometry
from covermill.operators.cover import FINISH, greedy_cover, manifest, sweep, two_tier_cover, without_similar
from covermill.operators.incidence import classify, gap, incidence, probe_mapped, projected
from covermill.operators.metrics import coverage
from covermill.operators.setsim import deduplicated
from covermill.functions.signature import file_state, signature
from covermill.plans.config import Config
from covermill.plans.stages import StageStore
from covermill.session import Scratch, is_empty


def tokens(scratch: Scratch, frames: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """``frame_id, i, raw, meta`` over all cutoffs of the frames that pass the pair filter, and ``raw, meta, feature``."""
    good = geometry.physical(frames, cfg.filter_coeff).where("is_physical").select("frame_id")
    frames = scratch.keep(frames.join(good, "frame_id", "left_semi"))
    found, dims = [], []
    for rcut in cfg.rcuts:
        near = scratch.keep(geometry.environments(frames, rcut))
        found.append(scratch.keep(geometry.raw_tokens(near, rcut, cfg.centers)))
        dims.append(geometry.token_dim(found[-1], geometry.features(near), cfg.feature_samples))
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, dims)


def frozen_map(scratch: Scratch, dim: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``raw, meta, type``: the types of the tokens, to be stored and applied to later data."""
    return compress.fit_types(scratch, dim, cfg.bond_tolerance, cfg.angle_tolerance, cfg.feature_share, cfg.topology_similarity)


def universe(scratch: Scratch, frames: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``item, env``: the effective types of each frame that passes the pair filter, over the tokens of all cutoffs."""
    found, dim = tokens(scratch, frames, cfg)
    types = scratch.keep(frozen_map(scratch, dim, cfg))
    return incidence(found.select("frame_id", "raw").distinct().join(types.select("raw", "type"), "raw"), "frame_id", "type")


def stored_selection(spark: SparkSession, root: str, frames_path: str, probe_path: str | None = None, cfg: Config = Config()) -> dict[str, DataFrame]:
    """From a Parquet table of frames to the manifest by stored stages: ``tokens``, ``dim``, ``map``, ``universe``,
    ``probe`` (with ``probe_path``) and ``manifest``.

    A stage's signature holds the settings it depends on, the state of the files and the signature of the stage
    before, so only what a change concerns is made anew. The map depends on the clustering's settings and the tokens'
    dimension; what it lacks of the probe is kept as ``probe_only`` tags, if ``protect_probe_only`` says so. The cover's
    rounds are stages too: a run that was ended goes on with the round it was in.
    """
    store, state = StageStore(spark, root), file_state(spark, frames_path)
    scratch = Scratch(spark)
    made: dict = {}

    def extracted() -> tuple[DataFrame, DataFrame]:
        if not made:
            made["found"], made["dim"] = tokens(scratch, spark.read.parquet(frames_path), cfg)
        return made["found"], made["dim"]

    first = {"frames": state, "cutoffs": (cfg.rcuts, cfg.centers, cfg.filter_coeff, cfg.feature_samples)}
    found = store.stage("tokens", first, lambda: extracted()[0])
    dim = store.stage("dim", first, lambda: extracted()[1])
    second = {"dim": signature("dim", first), "clusters": (cfg.bond_tolerance, cfg.angle_tolerance, cfg.feature_share, cfg.topology_similarity)}
    types = store.stage("map", second, lambda: frozen_map(scratch, dim, cfg))
    third = {"tokens": signature("tokens", first), "map": signature("map", second)}
    inc = store.stage("universe", third, lambda: incidence(found.select("frame_id", "raw").distinct().join(types.select("raw", "type"), "raw"), "frame_id", "type"))
    out = {"tokens": found, "dim": dim, "map": types, "universe": inc}
    if probe_path:
        fourth = third | {"probe": file_state(spark, probe_path), "protect": cfg.protect_probe_only}
        raws = lambda: tokens(scratch, spark.read.parquet(probe_path), cfg)[0].select(F.col("frame_id").alias("item"), F.col("raw").alias("env")).distinct()
        out["probe"] = store.stage("probe", fourth, lambda: probe_mapped(raws(), types, cfg.protect_probe_only))
    last = {"universe": signature("universe", third), "config": cfg}
    rounds = Scratch(spark, signature("manifest", last))
    out["manifest"] = store.stage("manifest", last, lambda: initial_selection(rounds, inc, cfg))
    rounds.remove()
    return out


def _chosen(scratch: Scratch, inc: DataFrame, target: DataFrame, universe: DataFrame, cfg: Config, budget: int, pct: float, finish: int) -> DataFrame:
    if cfg.two_tier:
        return two_tier_cover(scratch, inc, target, universe, cfg.rare_most, cfg.rare_overlap, cfg.common_overlap, cfg.size_band, cfg.common_pct, budget, finish)
    pool = deduplicated(scratch, projected(inc, target), cfg.rare_overlap, cfg.size_band)
    return greedy_cover(scratch, pool, budget, pct, finish, target.count()).withColumn("pass_name", F.lit("all"))


def initial_selection(scratch: Scratch, inc: DataFrame, cfg: Config = Config(), finish: int = FINISH) -> DataFrame:
    """The manifest of the selected items: cover, redundant items pruned in selection order, similar ones removed.

    Rows keep the pass in which they were picked; gains are counted anew over what stays. The target percentage holds
    only without two tiers. Empty input gives an empty manifest.
    """
    target = inc.select("env").distinct()
    picks = scratch.keep(_chosen(scratch, inc, target, inc, cfg, cfg.initial_budget, cfg.initial_pct, finish))
    chosen = scratch.keep(inc.join(picks.select("item"), "item", "left_semi").select("item", "env"))
    stays = scratch.keep(sweep(scratch, chosen, picks.select("item", F.col("rank").alias("place"))))
    stays = scratch.keep(without_similar(scratch, chosen, stays, cfg.post_overlap, cfg.post_band))
    rows = stays.join(picks.select("item", "pass_name"), "item")
    return _with_sizes(manifest(scratch, rows, inc, ["place"], ["pass_name"]), inc)


def _with_sizes(rows: DataFrame, inc: DataFrame) -> DataFrame:
    """A manifest with ``n_envs``, all envs of the item whether they were new or not."""
    sizes = inc.join(rows.select("item"), "item", "left_semi").groupBy("item").agg(F.count("*").alias("n_envs"))
    return rows.join(sizes, "item", "left").na.fill(0, ["n_envs"])


def tier_statistics(inc: DataFrame, picked: DataFrame, rare_most: int = 5) -> DataFrame:
    """One row about a two-tier selection ``picked(item, pass_name)``: targets, candidates and selected items by tier,
    covered envs and percentages."""
    tiers = classify(inc, rare_most)
    rows = inc.join(tiers.select("env", "tier"), "env")
    held = rows.join(picked.select("item").distinct(), "item", "left_semi").select("env").distinct().withColumn("is", F.lit(1))
    envs = tiers.join(held, "env", "left")
    by = lambda c, tier: F.count_if((F.col("tier") == tier) & c)
    always, hit = F.lit(True), F.col("is").isNotNull()
    counts = envs.agg(by(always, "rare").alias("n_rare_target"), by(always, "common").alias("n_common_target"), by(hit, "rare").alias("covered_rare"), by(hit, "common").alias("covered_common"))
    own = rows.agg(*[F.countDistinct(F.when(F.col("tier") == t, F.col("item"))).alias(f"{t}_candidates_before_dedup") for t in ("rare", "common")])
    chosen = picked.agg(*[F.count_if(F.col("pass_name") == t).alias(f"{t}_selected") for t in ("rare", "common")], F.count("*").alias("total_selected"))
    out = counts.crossJoin(own).crossJoin(chosen).withColumn("covered_total", F.col("covered_rare") + F.col("covered_common"))
    share = lambda n, of: (100.0 * F.col(n) / F.greatest(F.lit(1), of))
    return out.withColumns({
        "coverage_rare_pct": share("covered_rare", F.col("n_rare_target")), "coverage_common_pct": share("covered_common", F.col("n_common_target")),
        "coverage_total_pct": share("covered_total", F.col("n_rare_target") + F.col("n_common_target")),
    })


def selection_summary(inc: DataFrame, picked: DataFrame) -> DataFrame:
    """One row: candidates, selected items, target, covered and uncovered envs, percentage."""
    covered = inc.join(picked.select("item"), "item", "left_semi").select("env").distinct()
    counts = inc.agg(F.countDistinct("item").alias("candidate_structures_with_envs")).crossJoin(picked.agg(F.countDistinct("item").alias("selected_structures")))
    return counts.crossJoin(coverage(inc.select("env"), covered))


def gap_supplement(scratch: Scratch, inc: DataFrame, probe_covered: DataFrame, cfg: Config = Config(), finish: int = FINISH) -> DataFrame:
    """The manifest over the envs that ``probe_covered(env)`` lacks; similar redundant items are removed, without a
    pruning sweep before. No gap gives an empty manifest."""
    target = scratch.keep(gap(inc, probe_covered))
    open_inc = scratch.keep(projected(inc, target))
    picks = scratch.keep(_chosen(scratch, open_inc, target, inc, cfg, cfg.supplement_budget, 100.0, finish))
    if is_empty(picks):
        return picks.withColumn("n_envs", F.lit(0).cast("long"))
    stays = scratch.keep(without_similar(scratch, open_inc, picks.select("item", F.col("rank").alias("place")), cfg.post_overlap, cfg.post_band))
    rows = stays.join(picks.select("item", "pass_name"), "item")
    return _with_sizes(manifest(scratch, rows, open_inc, ["place"], ["pass_name"]), inc)


def joint_cover(scratch: Scratch, probe: DataFrame, pool: DataFrame, cfg: Config = Config(), finish: int = FINISH) -> DataFrame:
    """``rank, source, source_idx, n_envs``: the minimum cover of both sources' envs by items of either.

    Ties prefer the pool, and probe items are looked at first for redundancy, if the settings say so. Items of the
    two sources with equal numbers are different items.
    """
    named = lambda df, s, p: df.select(F.struct(F.lit(s).alias("source"), F.col("item").alias("idx")).alias("item"), "env", F.lit(p).alias("prefer"))
    low, high = (0, 1) if cfg.prefer_phase2 else (1, 0)
    # one key for both sources: struct keys stay inside the JVM, the finishing task gets their text
    both = named(pool, "phase2", low).unionByName(named(probe, "probe", high))
    keyed = both.select(F.concat_ws(":", "item.source", F.lpad(F.col("item.idx").cast("string"), 20, "0")).alias("item"), "env", "prefer").distinct()
    keyed = scratch.keep(keyed)
    picks = scratch.keep(greedy_cover(scratch, keyed, finish=finish))
    chosen = keyed.join(picks.select("item"), "item", "left_semi").select("item", "env")
    probe_first = F.col("item").startswith("probe:")
    place = F.struct(F.when(probe_first, 0 if cfg.prune_probe_first else 1).otherwise(1 if cfg.prune_probe_first else 0).alias("source"), F.col("item").alias("key"))
    stays = sweep(scratch, chosen, picks.select("item", place.alias("place")))
    sizes = chosen.groupBy("item").agg(F.count("*").alias("n_envs"))
    rows = picks.join(stays.select("item"), "item", "left_semi").join(sizes, "item")
    return rows.select("rank", F.split("item", ":")[0].alias("source"), F.split("item", ":")[1].cast("bigint").alias("source_idx"), "n_envs")
