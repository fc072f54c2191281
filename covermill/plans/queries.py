"""The registered queries: one or more per operator, each over whole tables of the data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covermill.functions import scalar
from covermill.functions.signature import file_state
from covermill.operators import compress, cover, embedding, geometry, incidence, metrics, sampling, series, setsim
from covermill.operators.components import components
from covermill.plans import oracles, selection
from covermill.plans.config import Config
from covermill.plans.stages import StageStore
from covermill.session import Scratch, read_table, shared_dir
from covermill.sources import sinks, tables, xyz
from covermill.streaming import intake

_QUERIES: dict = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.oracle_sql().items() if k in _QUERIES}


# --- the relations that the queries are over


def _part_envs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(":", "p_brand", "p_size").alias("env"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and the ``brand:size`` of their parts."""
    rows = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(_part_envs(spark, d), "l_partkey")
    return incidence.incidence(rows, "l_suppkey", "env")


def _pruned_dense(spark: SparkSession, d: str, place: Column) -> DataFrame:
    scratch = Scratch(spark)
    lines = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), "l_partkey")
    inc = scratch.keep(cover.of_last_items(scratch, lines, _part_envs(spark, d), "l_partkey", place))
    return cover.sweep(scratch, inc, inc.select("item", place.alias("place")).distinct()).select(F.col("item").alias("suppkey"))


def _structs(spark: SparkSession, d: str, source: str | None = None) -> DataFrame:
    rows = read_table(spark, d, "struct_envs")
    return incidence.incidence(rows if source is None else rows.where(F.col("source") == source), "struct_id", "env")


def _words(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null")
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"))).alias("env")
    return incidence.incidence(docs.select("doc_id", words), "doc_id", "env")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "frames")


def _near(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours within 3.0, stored, as most queries join them with themselves."""
    return Scratch(spark).keep(geometry.environments(_frames(spark, d), 3.0))


def _manifest(rows: DataFrame, item: str) -> DataFrame:
    cols = [F.col(c).cast("bigint").alias(c) for c in ("rank", "new_gain", "covered", "uncovered")]
    extra = ["pass_name"] if "pass_name" in rows.columns else []
    extra += [F.col("n_envs").cast("bigint").alias("n_envs")] if "n_envs" in rows.columns else []
    return rows.select(F.col("item").alias(item), *extra, *cols, F.round("coverage_pct", 6).alias("coverage_pct"))


# --- covers


@query
def cover_dense_manifest(spark, d):
    return _manifest(cover.greedy_cover(Scratch(spark), _dense(spark, d)), "suppkey")


@query
def cover_dense_budget(spark, d):
    return _manifest(cover.greedy_cover(Scratch(spark), _dense(spark, d), budget=5), "suppkey")


@query
def cover_dense_stop(spark, d):
    return _manifest(cover.greedy_cover(Scratch(spark), _dense(spark, d), stop_pct=85.0), "suppkey")


@query
def cover_structures(spark, d):
    return _manifest(cover.greedy_cover(Scratch(spark), _structs(spark, d)), "struct_id")


@query
def cover_first_pick(spark, d):
    gains = incidence.candidates(_dense(spark, d), _dense(spark, d)).select(F.col("item").alias("suppkey"), F.col("n_target").alias("gain"))
    return gains.orderBy(F.desc("gain"), "suppkey").limit(1)


@query
def prune_dense_sweep(spark, d):
    return _pruned_dense(spark, d, F.col("item"))


@query
def prune_dense_all(spark, d):
    """The sweep over all suppliers with the last one first; prune_dense_sweep begins with the first."""
    return _pruned_dense(spark, d, -F.col("item"))


@query
def two_tier_manifest(spark, d):
    scratch = Scratch(spark)
    inc = scratch.keep(_structs(spark, d))
    return _manifest(cover.two_tier_cover(scratch, inc, inc.select("env").distinct(), inc), "struct_id")


@query
def similar_redundant_removed(spark, d):
    scratch = Scratch(spark)
    inc = scratch.keep(_structs(spark, d, "phase2"))
    stays = cover.without_similar(scratch, inc, inc.select("item", F.col("item").alias("place")).distinct())
    return stays.select(F.col("item").alias("struct_id"))


@query
def initial_selection(spark, d):
    scratch = Scratch(spark)
    return _manifest(selection.initial_selection(scratch, scratch.keep(_structs(spark, d))), "struct_id")


@query
def initial_summary(spark, d):
    scratch = Scratch(spark)
    inc = scratch.keep(_structs(spark, d))
    return metrics.report(selection.selection_summary(inc, selection.initial_selection(scratch, inc)))


@query
def universe_selection(spark, d):
    """From frames to the manifest: pair filter, tokens at each cutoff, types, selection."""
    scratch = Scratch(spark)
    return _manifest(selection.initial_selection(scratch, scratch.keep(selection.universe(scratch, _frames(spark, d)))), "frame_id")


@query
def raw_selection(spark, d):
    """From frames to the manifest with the raw tokens of all cutoffs as envs, without types."""
    scratch = Scratch(spark)
    found, _ = selection.tokens(scratch, _frames(spark, d))
    return _manifest(selection.initial_selection(scratch, scratch.keep(incidence.incidence(found, "frame_id", "raw"))), "frame_id")


@query
def tier_statistics(spark, d):
    scratch = Scratch(spark)
    inc = scratch.keep(_structs(spark, d))
    picks = cover.two_tier_cover(scratch, inc, inc.select("env").distinct(), inc)
    rows = selection.tier_statistics(inc, picks)
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith("_pct") else c for c in rows.columns])


@query
def gap_supplement(spark, d):
    scratch = Scratch(spark)
    covered = _structs(spark, d, "probe").select("env").distinct()
    return _manifest(selection.gap_supplement(scratch, scratch.keep(_structs(spark, d, "phase2")), covered), "struct_id")


@query
def joint_cover(spark, d):
    scratch = Scratch(spark)
    return selection.joint_cover(scratch, scratch.keep(_structs(spark, d, "probe")), scratch.keep(_structs(spark, d, "phase2")))


@query
def joint_summary(spark, d):
    scratch = Scratch(spark)
    probe, pool = scratch.keep(_structs(spark, d, "probe")), scratch.keep(_structs(spark, d, "phase2"))
    kept = selection.joint_cover(scratch, probe, pool)
    # an item is its source and number, as numbers may be in both sources
    named = lambda df, source, number: df.select(F.concat_ws(":", source, F.col(number).cast("string")).alias("item"), source.alias("source"))
    items = named(probe, F.lit("probe"), "item").unionByName(named(pool, F.lit("phase2"), "item"))
    return metrics.source_counts(items, named(kept, F.col("source"), "source_idx"), "source")


# --- frequencies, tiers, gaps


@query
def env_frequency(spark, d):
    return incidence.env_frequency(_structs(spark, d)).select("env", F.col("n_items").alias("n_structures"))


@query
def env_tiers(spark, d):
    return incidence.classify(_structs(spark, d), 5).select("env", "tier")


@query
def inverted_index(spark, d):
    return incidence.inverted_index(_dense(spark, d)).select("env", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("suppliers"))


@query
def rarity_counts(spark, d):
    return metrics.rarity_counts(_structs(spark, d))


@query
def tier_projection(spark, d):
    inc = _structs(spark, d)
    rare = incidence.classify(inc, 5).where("tier = 'rare'")
    return incidence.candidates(inc, rare).select(F.col("item").alias("struct_id"), F.col("n_target").alias("n_rare"))


@query
def projection_without_probe(spark, d):
    inc, probe = _structs(spark, d, "phase2"), _structs(spark, d, "probe")
    rows = incidence.projected(inc, probe, exclude=probe.select("item").distinct())
    return rows.groupBy(F.col("item").alias("struct_id")).agg(F.count("*").alias("n_known"))


@query
def gap_envs(spark, d):
    return incidence.gap(_structs(spark, d, "phase2"), _structs(spark, d, "probe"))


def _picked(spark, d):
    picked = read_table(spark, d, "initial_training_manifest").where("source_idx is not null").select("source", "source_idx").distinct()
    known = read_table(spark, d, "structures").select("struct_id", "source", "source_idx").distinct()
    return known.join(picked, ["source", "source_idx"]).select(F.col("struct_id").alias("item")).distinct()


@query
def covered_union(spark, d):
    return incidence.covered_by(_structs(spark, d), _picked(spark, d))


@query
def heavy_tail_words(spark, d):
    return incidence.env_frequency(_words(spark, d)).groupBy("n_items").agg(F.count("*").alias("n_words"))


@query
def types_by_cutoff(spark, d):
    return metrics.types_by_cutoff(_structs(spark, d))


@query
def coverage_by_tier(spark, d):
    inc = _structs(spark, d)
    rows = metrics.tier_coverage(incidence.classify(inc, 5), _structs(spark, d, "probe"))
    return rows.select("tier", "n_target", "n_covered", F.round("coverage_pct", 6).alias("coverage_pct"))


@query
def coverage_of_probe(spark, d):
    return metrics.coverage(_structs(spark, d), _structs(spark, d, "probe")).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query
def weighted_coverage(spark, d):
    return metrics.weighted_coverage(_structs(spark, d), _structs(spark, d, "probe")).select(F.round("weighted_pct", 6).alias("weighted_pct"))


@query
def frequency_ranks(spark, d):
    return metrics.frequency_ranks(Scratch(spark), _structs(spark, d))


@query
def coverage_trajectory(spark, d):
    scratch = Scratch(spark)
    inc = scratch.keep(_structs(spark, d, "phase2"))
    ranked = scratch.keep(cover.greedy_cover(scratch, inc))
    return metrics.trajectory(scratch, ranked, inc, _structs(spark, d, "probe"), 200)


@query
def convergence_of_runs(spark, d):
    rows = read_table(spark, d, "initial_training_manifest").distinct()
    rows = rows.withColumnRenamed("pick_rank", "rank")
    return metrics.convergence(rows).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query
def manifest_recount(spark, d):
    scratch = Scratch(spark)
    inc = scratch.keep(_structs(spark, d))
    known = read_table(spark, d, "structures").select("struct_id", "source", "source_idx").distinct()
    picks = read_table(spark, d, "initial_training_manifest").groupBy("source", "source_idx").agg(F.min("pick_rank").alias("place"), F.min("run_id").alias("run"))
    picks = picks.join(known, ["source", "source_idx"]).select(F.col("struct_id").alias("item"), "place", "run").join(inc.select("item").distinct(), "item", "left_semi")
    rows = cover.manifest(scratch, picks, inc, ["run", "place", "item"], ["run"])
    return rows.select(F.col("item").alias("struct_id"), *[F.col(c).cast("bigint").alias(c) for c in ("rank", "new_gain", "covered", "uncovered")])


@query
def gain_histogram(spark, d):
    rows = metrics.gain_histogram(read_table(spark, d, "initial_training_manifest").distinct(), "new_gain")
    return rows.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query
def summary_report(spark, d):
    rows = read_table(spark, d, "initial_training_summary").distinct()
    one = rows.agg(F.countDistinct("run_id").alias("n_runs"), F.sum("selected_structures").alias("selected"), F.max("rare_freq_threshold").alias("rare_most"), F.sum("prune_redundant_removed").alias("pruned"))
    return metrics.report(one)


@query
def source_counts(spark, d):
    rows = read_table(spark, d, "structures").where("struct_id is not null")
    kept = read_table(spark, d, "struct_envs").where("env is not null")
    return metrics.source_counts(rows.select(F.col("struct_id").alias("item"), "source"), kept.select(F.col("struct_id").alias("item")), "source")


# --- similarity


@query
def exact_copies(spark, d):
    return setsim.exact_copies(_structs(spark, d)).select(F.col("item").alias("struct_id"), F.col("first").alias("first_id"))


@query
def overlap_links_band(spark, d):
    """Pairs of classes of equal sets, by their first structures; exact_copies has the classes."""
    scratch = Scratch(spark)
    _, links = setsim.class_links(scratch, scratch.keep(_structs(spark, d)), 0.7, 0.25)
    return links.select(F.col("a").alias("struct_a"), F.col("b").alias("struct_b"), F.round("overlap", 6).alias("overlap"))


@query
def representatives(spark, d):
    rows = setsim.representatives(Scratch(spark), _structs(spark, d), 0.85, 0.25)
    return rows.select(F.col("item").alias("struct_id"), F.col("root").alias("root_id"), "is_kept")


@query
def near_documents(spark, d):
    """One row per document with its class of equal word sets and its number of links."""
    scratch = Scratch(spark)
    rows = setsim.links_of_items(*setsim.class_links(scratch, scratch.keep(_words(spark, d)), 0.85, 0.25))
    return rows.withColumnRenamed("item", "doc_id")


@query
def match_components(spark, d):
    rows = read_table(spark, d, "match_pairs").where("jaccard >= 0.85 and not isnan(jaccard)")
    found = components(Scratch(spark), rows.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    return found.select(F.col("item").alias("struct_id"), F.col("root").alias("root_id"))


# --- compression


def _part_dim(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    raw = F.concat_ws(":", "p_brand", "p_type", "p_size").alias("raw")
    return part.select(raw, F.concat_ws(":", "p_brand", "p_type").alias("meta"), "p_size", "p_retailprice")


@query
def frozen_map_applied(spark, d):
    rows = _part_dim(spark, d)
    frozen = rows.where("p_size <= 40").select("raw", F.concat("meta", F.lit(":known")).alias("type")).distinct()
    return compress.frozen_types(rows, frozen)


@query
def compression_stats(spark, d):
    rows = _part_dim(spark, d).select("raw", "meta", F.concat("meta", F.lit(":"), F.floor(F.col("p_size") / 10).cast("string")).alias("type"))
    return compress.compression_stats(rows).withColumn("reduction_pct", F.round("reduction_pct", 6))


@query
def effective_layer(spark, d):
    inc = _structs(spark, d)
    dim = inc.select(F.col("env").alias("raw")).distinct().withColumn("type", F.regexp_extract("raw", r"^([^:]*:[^:]*:[^:]*)", 1))
    return incidence.effective_layer(inc, dim).groupBy("env").agg(F.count("*").alias("n_items"))


@query
def probe_mapped(spark, d):
    dim = _structs(spark, d, "phase2").select(F.col("env").alias("raw")).distinct().withColumn("type", F.col("raw"))
    rows = incidence.probe_mapped(_structs(spark, d, "probe"), dim)
    return rows.groupBy("is_probe_only").agg(F.count("*").alias("n_rows"), F.countDistinct("env").alias("n_envs"))


@query
def ward_types(spark, d):
    near = _near(spark, d)
    dim = geometry.token_dim(Scratch(spark).keep(geometry.raw_tokens(near, 3.0)), geometry.features(near))
    return compress.fit_types(Scratch(spark), dim).select("raw", "meta", "type")


@query
def vector_clusters(spark, d):
    rows = read_table(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    found = compress.distance_components(Scratch(spark), rows, 1.15)
    return found.select(F.col("id").alias("vec_id"), "cluster")


@query
def topology_links(spark, d):
    part = read_table(spark, d, "part").select(F.col("p_brand").alias("group"), F.concat_ws(":", "p_brand", "p_type", "p_name", F.col("p_size").cast("string")).alias("name"))
    rows = compress.topology_links(Scratch(spark), part.distinct(), 0.85)
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"))


# --- geometry


@query
def physical_frames(spark, d):
    return geometry.physical(_frames(spark, d))


@query
def rejected_frames(spark, d):
    rows = geometry.physical(_frames(spark, d))
    every = rows.select(F.col("frame_id").alias("item"))
    return sinks.rejected(every, rows.where("is_physical").select(F.col("frame_id").alias("item")), "phase2")


@query
def valid_cells(spark, d):
    rows = _frames(spark, d).where("frame_id is not null").dropDuplicates(["frame_id"])
    return rows.select("frame_id", scalar.cell_ok(F.col("lattice"), 7.0).alias("is_ok"))


@query
def frame_volumes(spark, d):
    return series.volumes(_frames(spark, d)).select("frame_id", F.round("volume", 4).alias("volume"))


@query
def center_metas(spark, d):
    rows = geometry.meta_keys(_near(spark, d), 3.0)
    return rows.groupBy("meta", "cn").agg(F.count("*").alias("n_centers"))


@query
def center_features(spark, d):
    rows = geometry.features(_near(spark, d))
    total = F.aggregate("feature", F.lit(0.0), lambda s, v: s + v)
    return rows.select("frame_id", F.col("i").alias("center"), F.size("feature").alias("n"), F.round(total, 4).alias("total"))


@query
def raw_token_counts(spark, d):
    """The tokens of both cutoffs."""
    scratch = Scratch(spark)
    near = [(r, scratch.keep(geometry.environments(_frames(spark, d), r))) for r in Config().rcuts]
    rows = reduce(DataFrame.unionByName, [geometry.raw_tokens(n, r) for r, n in near])
    return rows.groupBy("raw", "meta").agg(F.count("*").alias("n_centers"), F.countDistinct("frame_id").alias("n_frames"))


@query
def token_dimension(spark, d):
    near = _near(spark, d)
    rows = geometry.token_dim(Scratch(spark).keep(geometry.raw_tokens(near, 3.0)), geometry.features(near))
    return rows.select("raw", "meta", F.size("feature").alias("n_features"))


@query
def token_examples(spark, d):
    return geometry.examples(geometry.raw_tokens(_near(spark, d), 3.0), 3).groupBy("raw").agg(F.count("*").alias("n_examples"))


@query
def cluster_index(spark, d):
    rows = geometry.raw_tokens(_near(spark, d), 3.0).select(F.col("meta").alias("type"), "raw", F.col("frame_id").alias("source_idx"), "i")
    return sinks.cluster_index(Scratch(spark), rows)


@query
def local_clusters(spark, d):
    rows = geometry.local_cluster(_frames(spark, d), 3.0)
    return rows.select("frame_id", F.col("i").alias("center"), "n_atoms", F.round("box", 4).alias("box"))


# --- series


@query
def radial_distribution(spark, d):
    rows = series.radial_distribution(_frames(spark, d), 5.0, 0.25)
    return rows.select("kind", "bin", F.round("r", 6).alias("r"), "n_pairs", F.round("g", 6).alias("g"))


@query
def angular_distribution(spark, d):
    rows = series.angular_distribution(_frames(spark, d), 3.0, 10.0)
    return rows.select("kind", "bin", "n", F.round("share", 6).alias("share"))


@query
def user_displacement(spark, d):
    rows = read_table(spark, d, "events").where("value is not null").groupBy("event_type", "user_id", F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("v"))
    found = series.mean_square_displacement(rows, ["event_type"], "user_id", "t", ["v"])
    return found.groupBy("event_type").agg(F.round(F.avg("msd"), 4).alias("mean_msd"), F.count("*").alias("n_times"))


@query
def user_correlation(spark, d):
    rows = read_table(spark, d, "events").where("value is not null").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("x"), F.col("value").alias("y"))
    found = series.correlations(rows, ["user_id"], "event_type")
    return found.select("user_id", "kind_a", "kind_b", "n", F.round("pearson", 6).alias("pearson"))


@query
def frame_errors(spark, d):
    frames = _frames(spark, d)
    moved = frames.withColumn("energy", F.col("energy") + F.lit(0.5)).withColumn("stress", F.transform("stress", lambda v: v + F.lit(0.25)))
    rows = series.mean_absolute_errors(frames, moved, "frame_id")
    return rows.select("frame_id", *[F.round(c, 6).alias(c) for c in ("energy_mae", "force_mae", "stress_mae")])


@query
def run_comparison(spark, d):
    """Every run's covered envs after each pick against the mean of all runs."""
    rows = read_table(spark, d, "initial_training_manifest").groupBy("run_id", "pick_rank").agg(F.max("covered").alias("covered"))
    rows = rows.where("run_id is not null and pick_rank is not null").select("run_id", "pick_rank", F.col("covered").cast("double").alias("covered"))
    mean = rows.groupBy("pick_rank").agg(F.avg("covered").alias("covered"))
    means = rows.select("run_id", "pick_rank").join(mean, "pick_rank")
    found = series.compared_series(rows, means, ["run_id", "pick_rank"], ["covered"])
    return found.select("run_id", "pick_rank", *[F.round(c, 6).alias(c) for c in ("covered_left", "covered_right", "covered_diff")])


@query
def run_comparisons(spark, d):
    """Every run's covered envs after each pick against those counted anew."""
    scratch = Scratch(spark)
    picks = read_table(spark, d, "initial_training_manifest").where("run_id is not null and pick_rank is not null")
    said = picks.groupBy("run_id", "pick_rank").agg(F.max("covered").alias("covered"))
    known = read_table(spark, d, "structures").select(F.col("struct_id").alias("item"), "source", "source_idx").distinct()
    items = picks.select("run_id", "pick_rank", "source", "source_idx").distinct().join(known, ["source", "source_idx"])
    firsts = items.join(_structs(spark, d), "item").groupBy("run_id", "env").agg(F.min("pick_rank").alias("pick_rank"))
    gains = firsts.groupBy("run_id", "pick_rank").agg(F.count("*").alias("gain"))
    rows = said.select("run_id", "pick_rank").join(gains, ["run_id", "pick_rank"], "left").na.fill(0, ["gain"])
    ranked = scratch.keep(cover.global_rank(scratch, rows, [F.asc("run_id"), F.asc("pick_rank")], "gain"))
    before = ranked.groupBy("run_id").agg(F.min(F.col("covered") - F.col("gain")).alias("before"))
    counted = ranked.join(before, "run_id").select("run_id", "pick_rank", (F.col("covered") - F.col("before")).alias("covered"))
    return series.compared_series(said, counted, ["run_id", "pick_rank"], ["covered"])


@query
def last_of_runs(spark, d):
    rows = read_table(spark, d, "initial_training_manifest").groupBy("run_id", "pick_rank").agg(F.max("covered").alias("covered"))
    return series.last_values(rows, "run_id", "pick_rank", ["covered"])


@query
def structure_energies(spark, d):
    rows = read_table(spark, d, "structures").where("energy is not null and not isnan(energy)")
    rows = rows.groupBy("struct_id").agg(F.max("energy").alias("energy"), F.max("n_atoms").alias("n_atoms"))
    return rows.select("struct_id", F.round(scalar.inner_energy(F.col("energy"), F.lit(300.0), F.col("n_atoms").cast("double")), 6).alias("inner_energy"), (3 * F.col("n_atoms") - 3).alias("n_modes"), (3 * F.col("n_atoms")).alias("n_all_modes"))


# --- functions, samples, vectors


@query
def safe_casts(spark, d):
    rows = read_table(spark, d, "documents")
    return rows.select("doc_id", F.round(scalar.as_float(F.col("title"), -1.0), 6).alias("as_float"), scalar.as_int(F.col("n_chars").cast("string")).alias("as_int"), scalar.as_int(F.col("lang"), -7).alias("lang_int"))


@query
def file_names(spark, d):
    rows = read_table(spark, d, "documents")
    return rows.select("doc_id", scalar.safe_name(F.col("title")).alias("name"), scalar.safe_name(F.concat_ws("/", "title", "edit_note", "editor"), 20).alias("short_name"))


@query
def key_parts(spark, d):
    envs = read_table(spark, d, "struct_envs").select(scalar.compared(F.col("env")).alias("env")).where("env <> ''").distinct()
    return envs.select("env", scalar.rcut_of(F.col("env")).alias("rcut"), scalar.center_of(F.col("env")).alias("center"), F.sha1("env").alias("sha"), F.substring(F.sha1("env"), 1, 8).alias("short_sha"))


@query
def piece_sets(spark, d):
    rows = read_table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("name")).distinct()
    return rows.select("name", F.array_join(scalar.piece_tokens(F.col("name")), " ").alias("pieces"), F.array_join(scalar.trigrams(F.col("name")), " ").alias("trigrams"))


@query
def type_vectors(spark, d):
    types = read_table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("type"))
    return embedding.hashed_vectors(types).select("type", "slot", F.round("value", 6).alias("value"))


@query
def type_axes(spark, d):
    types = read_table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("type"))
    rows = embedding.hashed_vectors(types, 64)
    dense = rows.groupBy(F.col("type").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m")).select("id", F.expr("transform(sequence(0, 63), k -> coalesce(m[k], 0D))").alias("x"))
    return embedding.principal_axes(dense, 64).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query
def embedding_spread(spark, d):
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    found = embedding.principal_axes(rows, 64)
    return found.agg(F.round(F.var_pop("x"), 6).alias("var_x"), F.round(F.var_pop("y"), 6).alias("var_y"), F.count("*").alias("n"))


@query
def gap_states(spark, d):
    inc = _structs(spark, d)
    before = _structs(spark, d, "probe").select("env").distinct().withColumn("before", F.lit(True))
    new = _structs(spark, d, "phase2").select("env").distinct().withColumn("now", F.lit(True))
    rows = inc.select("env").distinct().join(before, "env", "left").join(new, "env", "left")
    state = F.when(F.col("before").isNull() & F.col("now"), "newly_covered").when(F.col("before"), "covered_before").otherwise("still_uncovered")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n_envs"))


def _states(spark, d):
    """``env, covered_before, covered_by_selected, covered_after`` and the state after the supplement, of each type."""
    inc = _structs(spark, d)
    before = _structs(spark, d, "probe").select("env").distinct().withColumn("b", F.lit(True))
    new = incidence.covered_by(inc, _picked(spark, d)).withColumn("s", F.lit(True))
    rows = inc.select("env").distinct().join(before, "env", "left").join(new, "env", "left").na.fill(False, ["b", "s"])
    state = F.when(F.expr("s and not b"), "newly_covered").when(F.col("b"), "covered_before").otherwise("still_uncovered")
    return rows.select("env", F.col("b").alias("covered_before"), F.col("s").alias("covered_by_selected"), F.expr("b or s").alias("covered_after"), state.alias("state"))


@query
def type_states(spark, d):
    return _states(spark, d)


@query
def type_embedding(spark, d):
    """The table behind the map of types: the axes of the hashed names and what covers each type."""
    rows = _states(spark, d)
    slots = embedding.hashed_vectors(rows.select(F.col("env").alias("type")))
    dense = slots.groupBy(F.col("type").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m")).select("id", F.expr("transform(sequence(0, 127), k -> coalesce(try_element_at(m, k), 0D))").alias("x"))
    axes = embedding.principal_axes(dense, 128).select(F.col("id").alias("env"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))
    return rows.join(axes, "env").select(F.col("env").alias("effective_type"), "x", "y", *[F.col(c).cast("int").alias(c) for c in ("covered_before", "covered_by_selected", "covered_after")], "state")


@query
def sampled_types(spark, d):
    inc = _structs(spark, d)
    names = incidence.classify(inc, 5).select(F.col("env").alias("name"), (F.col("tier") == "common").alias("priority"))
    return sampling.systematic(Scratch(spark), names, 1000)


@query
def every_tenth_frame(spark, d):
    rows = _frames(spark, d).where("frame_id is not null").dropDuplicates(["frame_id"])
    return sampling.every_nth(rows, "step", 2000).select("frame_id", "step", "n_atoms")


@query
def curve_points(spark, d):
    rows = read_table(spark, d, "initial_training_manifest").groupBy("run_id", "pick_rank").agg(F.max("covered").alias("covered"))
    return sampling.curve_points(rows, "pick_rank", 50)


# --- sources, sinks, stages, streams


@query
def xyz_round_trip(spark, d):
    frames = _frames(spark, d).where("frame_id is not null and size(atoms) > 0").dropDuplicates(["frame_id"])
    texts = xyz.frame_text(frames.withColumn("step", F.col("frame_id")))
    path = Scratch(spark).root + "/xyz"
    texts.select("raw_text").write.text(path)
    back = xyz.read_xyz(spark, path, 1 << 20)
    return back.select(F.col("step").alias("frame_id"), "n_atoms", F.round("energy", 5).alias("energy"), F.size("stress").alias("n_stress"), F.round(F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["pos"][0]), 4).alias("sum_x"))


@query
def frames_in_order(spark, d):
    """Frames of both sources written in the order of their energies and read back, with the place of each."""
    scratch = Scratch(spark)
    known = read_table(spark, d, "structures").where("struct_id is not null").groupBy("struct_id").agg(F.min("source").alias("source"))
    one = _frames(spark, d).where("frame_id is not null and size(atoms) > 0").groupBy("frame_id").agg(*[F.min(c).alias(c) for c in ("struct_id", "lattice", "stress", "energy", "pbc", "atoms")])
    frames = scratch.keep(one.join(known, "struct_id", "left").select("*", F.col("frame_id").alias("source_idx"), F.col("frame_id").alias("step")).na.fill("phase2", ["source"]))
    places = scratch.keep(cover.global_rank(scratch, frames.select("source", "source_idx", F.coalesce("energy", F.lit(0.0)).alias("energy")), [F.asc("energy"), F.asc("source_idx")]))
    sinks.write_mixed(frames.where("source = 'probe'"), frames.where("source = 'phase2'"), places.select("source", "source_idx", "rank"), f"{scratch.root}/mixed")
    back = xyz.read_xyz(spark, f"{scratch.root}/mixed", 1 << 16)
    ranked = cover.global_rank(scratch, back, [F.asc("path"), F.asc("offset")])
    return ranked.select("rank", F.col("step").alias("frame_id"), F.size("atoms").alias("n_atoms"))


@query
def log_round_trip(spark, d):
    """Lines of items as white-space tables, read back by the log reader."""
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = read_table(spark, d, "lineitem").where("l_orderkey is not null").select(*names)
    path = f"{Scratch(spark).root}/log"
    rows.select(F.concat_ws("  ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in names])).write.text(path)
    back = tables.read_log(spark, path, len(names) - 1)
    return back.groupBy(F.col("c3").cast("int").alias("line")).agg(F.count("*").alias("n"), F.sum(F.col("gen").cast("long")).alias("sum_gen"), F.round(F.sum("c4"), 2).alias("quantity"))


@query
def spectrum_round_trip(spark, d):
    """Hourly means of the events as spectra, written and read back."""
    rows = read_table(spark, d, "events").where("value is not null").groupBy(F.hour("ts").cast("double").alias("freq")).agg(F.avg("value").alias("dos"))
    path = f"{Scratch(spark).root}/dos"
    sinks.write_spectrum(rows, path)
    return tables.read_spectrum(spark, path).select("freq", F.round("dos", 5).alias("dos"))


@query
def bands_round_trip(spark, d):
    """Every user's events as a band, written and read back: lines and blank lines between bands."""
    rows = read_table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("seg"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "value")).alias("ordinal"), F.col("value").alias("y"))
    path = f"{Scratch(spark).root}/bands"
    sinks.write_bands(rows.withColumn("x", F.col("ordinal").cast("double")), path)
    back = spark.read.text(path).select(F.split("value", " ").alias("p"))
    return back.agg(F.count_if(F.size("p") == 2).alias("n_points"), F.count_if(F.size("p") < 2).alias("n_segments"), F.round(F.sum(F.when(F.size("p") == 2, F.col("p")[1].cast("double"))), 2).alias("sum_y"))


@query
def thermal_round_trip(spark, d):
    """Orders by priority and status as thermal records, written and read back; every three values are a mode."""
    rows = read_table(spark, d, "orders").where("o_orderdate is not null").groupBy(F.year("o_orderdate").cast("double").alias("temperature")).agg(F.avg("o_totalprice").alias("free_energy"), F.count("*").cast("double").alias("entropy"), F.min("o_totalprice").cast("double").alias("heat_capacity"), F.max("o_totalprice").cast("double").alias("energy"))
    path = f"{Scratch(spark).root}/thermal"
    sinks.write_thermal(rows, path)
    back = tables.read_thermal(spark, path)
    return back.select("temperature", *[F.round(c, 4).alias(c) for c in ("free_energy", "entropy", "heat_capacity", "energy")])


@query
def zero_points(spark, d):
    """Of each order status, the thermal record of its earliest month; months stand for temperatures."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("temperature")
    rows = read_table(spark, d, "orders").where("o_orderdate is not null").groupBy("o_orderstatus", month).agg(F.avg("o_totalprice").alias("free_energy"))
    found = series.zero_points(rows, ["o_orderstatus"])
    return found.select("o_orderstatus", F.round("zpe", 4).alias("zpe"), "lowest", "n")


@query
def errors_round_trip(spark, d):
    """Errors of every frame against its copy with other energies, as a CSV table and read back."""
    frames = _frames(spark, d)
    found = series.mean_absolute_errors(frames, frames.withColumn("energy", F.col("energy") + F.lit(0.5)), "frame_id")
    path = f"{Scratch(spark).root}/errors"
    sinks.write_csv(found.select(F.col("frame_id").alias("index"), F.col("energy_mae").alias("energy_MAE"), F.col("force_mae").alias("force_MAE"), F.col("stress_mae").alias("stress_MAE")), path)
    back = tables.read_errors(spark, path)
    return back.agg(F.count("*").alias("n"), F.count("energy_MAE").alias("n_energy"), F.round(F.sum("energy_MAE"), 5).alias("sum_energy"), F.sum("index").cast("long").alias("sum_index"))


@query
def cluster_files(spark, d):
    """The local cluster of every center as CIF: atoms and edge read off the text."""
    rows = sinks.cif_text(geometry.cluster_atoms(_frames(spark, d), 3.0))
    lines = F.split("cif", "\n")
    edge = F.round(F.regexp_extract("cif", r"_cell_length_a ([0-9.]+)", 1).cast("double"), 4)
    return rows.select("frame_id", F.col("i").alias("center"), F.size(F.filter(lines, lambda x: x.rlike(r"^[A-Z][a-z]?\d+ "))).cast("long").alias("n_atoms"), edge.alias("box"))


@query
def stored_stage(spark, d):
    store = StageStore(spark, f"{shared_dir(spark)}/covermill-stages")
    payload = {"folder": d, "config": Config(), "table": file_state(spark, f"{d}/struct_envs.parquet")}
    rows = store.stage("frequency", payload, lambda: incidence.env_frequency(_structs(spark, d)))
    out = rows.groupBy("n_items").agg(F.count("*").alias("n_envs"))
    return out


@query
def streamed_intake(spark, d):
    scratch = Scratch(spark)
    # a pattern, as the table is one file or a folder of files
    folder = f"{d}/struct_env[s].parquet"
    schema = read_table(spark, d, "struct_envs").schema
    stream = intake.file_stream(spark, folder, schema)
    running = intake.start_intake(stream, "struct_id", "env", f"{scratch.root}/in/rows", f"{scratch.root}/in/state")
    running.awaitTermination()
    return intake.taken(spark, f"{scratch.root}/in/rows").groupBy("item").agg(F.count("*").alias("n_envs")).select(F.col("item").alias("struct_id"), "n_envs")


@query
def streamed_windows(spark, d):
    """Events by hour and type, counted as a stream; no event is so late that it is dropped."""
    scratch = Scratch(spark)
    schema = read_table(spark, d, "events").schema
    rows = intake.file_stream(spark, f"{d}/event[s].parquet", schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = intake.windowed_counts(rows.where("ts is not null"), "ts", "event_type", "1 hour", "36500 days")
    intake.start_windows(counts, f"{scratch.root}/windows", f"{scratch.root}/state").awaitTermination()
    found = intake.latest_windows(spark, f"{scratch.root}/windows", "event_type")
    return found.select(F.unix_seconds("window_start").alias("start"), "event_type", "n")
